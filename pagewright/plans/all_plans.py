"""Importing this module registers every plan."""

from pagewright.plans import access, answers, audit, crawl_diff, edits, explorer, extraction, files, geo, history, links, parsed, policy, site_files, streams  # noqa: F401
from pagewright.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
