"""Readers of audits, sitemaps and policies, and writers of crawls and reports."""
