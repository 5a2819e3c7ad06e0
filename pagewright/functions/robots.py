"""Robots files: groups and rules of a body, and the rule that decides a path.

A pattern is a literal beginning, pieces that have to follow in order, and maybe a fixed end. Pieces are found from the
left, each behind the one before, so a path is read once for a pattern and no pattern can make it worse. A file's rules
are held by their literal beginnings: of a path only rules whose beginning it has are looked at, in order of precedence, and
the first that fits decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from typing import NamedTuple

#: What is read of a file, the rules that count for an agent, and the longest pattern in bytes.
MOST_BYTES = 500 * 1024
MOST_RULES = 2_000
MOST_PATTERN_BYTES = 1_024

_TOKEN = re.compile(r"[A-Za-z0-9_-]*")


class Rule(NamedTuple):
    line: int
    allow: bool
    pattern: str  # with the slash that a pattern begins with
    length: int  # in bytes, as precedence counts it


class Group(NamedTuple):
    agents: list[str]
    rules: list[Rule]


def product_token(agent: str) -> str:
    """The name by which a group calls an agent: letters, digits, - and _ at the beginning, in small letters."""
    agent = agent.strip()
    return "*" if agent[:1] == "*" else _TOKEN.match(agent)[0].lower()


def groups_of(body: bytes | str | None) -> list[Group]:
    """The groups of a file. Agent lines in a row open one group; comments, blanks and sitemap lines between them do not
    count. Rules before the first group and lines of other kinds are skipped, as are empty and too long patterns."""
    data = body.encode("utf-8", "surrogatepass") if isinstance(body, str) else bytes(body or b"")
    text = data[:MOST_BYTES].decode("utf-8", "replace").removeprefix("\ufeff")
    groups: list[Group] = []
    naming = False
    for number, line in enumerate(text.split("\n"), 1):
        field, colon, value = line.partition("#")[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon or field == "sitemap":
            continue
        if field == "user-agent":
            if not naming:
                groups.append(Group([], []))
            groups[-1].agents.append(product_token(value))
        elif field in ("allow", "disallow") and groups and value and len(value.encode()) <= MOST_PATTERN_BYTES:
            pattern = value if value[0] in "/*" else f"/{value}"
            groups[-1].rules.append(Rule(number, field == "allow", pattern, len(pattern.encode())))
        naming = field == "user-agent"
    return groups


class Pattern:
    """A pattern taken apart. %2A and %24 stand for a star and a dollar sign that mean themselves."""

    __slots__ = ("begin", "pieces", "end", "least")

    def __init__(self, pattern: str) -> None:
        fixed = pattern.endswith("$")
        parts = [re.sub("%2a", "*", p, flags=re.I).replace("%24", "$") for p in pattern.removesuffix("$").split("*")]
        self.begin = parts[0]
        self.end = parts.pop() if fixed and len(parts) > 1 else None
        self.pieces = None if fixed and self.end is None else [p for p in parts[1:] if p]  # None: nothing may follow
        self.least = len(self.begin) + len(self.end or "") + sum(map(len, self.pieces or ()))

    def fits(self, path: str) -> bool:
        if len(path) < self.least or not path.startswith(self.begin):
            return False
        if self.pieces is None:
            return len(path) == len(self.begin)
        at, to = len(self.begin), len(path) - len(self.end or "")
        if self.end and not path.endswith(self.end):
            return False
        for piece in self.pieces:
            at = path.find(piece, at, to)
            if at < 0:
                return False
            at += len(piece)
        return True


class Verdicts:
    """Which of an agent's rules decides a path: the longest that fits, among equally long ones an allowing one, then the first."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = sorted(rules[:MOST_RULES], key=lambda r: (-r.length, not r.allow))
        self.patterns = [Pattern(r.pattern) for r in self.rules]
        begins: dict[str, list[int]] = defaultdict(list)
        for k, p in enumerate(self.patterns):
            begins[p.begin].append(k)
        self.begins, self.lengths = dict(begins), sorted({len(b) for b in begins})
        self.known: dict[str, Rule | None] = {}

    def rule(self, path: str) -> Rule | None:
        if path not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[path] = self._rule(path)
        return self.known[path]

    def _rule(self, path: str) -> Rule | None:
        if path == "/robots.txt":
            return None
        held = [self.begins[b] for n in self.lengths if n <= len(path) and (b := path[:n]) in self.begins]
        candidates = held[0] if len(held) == 1 else sorted(k for ks in held for k in ks)
        return next((self.rules[k] for k in candidates if self.patterns[k].fits(path)), None)


def rules_for(groups: list[Group], token: str, fallback: str | None = None) -> list[Rule]:
    """The rules that hold for an agent: those of all groups that name it, else of those that name the agent it follows
    instead, else of those for all agents."""
    for name in (product_token(token), fallback and product_token(fallback), "*"):
        if name and (chosen := [g for g in groups if name in g.agents]):
            return [r for g in chosen for r in g.rules]
    return []
