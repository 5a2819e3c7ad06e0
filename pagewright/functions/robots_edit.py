"""A robots file rewritten to what a policy wants of bots."""

from __future__ import annotations

from typing import NamedTuple

from pagewright.functions.dims import BOTS

#: The purposes that a content signal speaks of, and the bots' purposes behind them.
SIGNALS = (("search", "search"), ("ai-input", "user_fetch"), ("ai-train", "training"))


class Intent(NamedTuple):
    """What a policy wants: 'allow', 'block' or 'any' by purpose, and by token where a bot has a stance of its own."""

    purposes: dict[str, str] = {}
    bots: dict[str, str] = {}

    def of(self, token: str, purpose: str | None) -> str:
        own = {t.lower(): s for t, s in self.bots.items()}.get(token.lower())
        return own or self.purposes.get(purpose or "", "any")


def content_signal(intent: Intent) -> str:
    said = (f"{name}={'no' if intent.purposes.get(purpose) == 'block' else 'yes'}" for name, purpose in SIGNALS)
    return "Content-Signal: " + ", ".join(said)


def _field(line: str) -> tuple[str, str]:
    field, colon, value = line.partition("#")[0].partition(":")
    return (field.strip().lower(), value.strip()) if colon else ("", "")


class _Group:
    def __init__(self, tokens: list[tuple[str, str]], rules: list[str]) -> None:
        self.tokens, self.rules = tokens, rules  # (line, token)

    @property
    def for_all(self) -> bool:
        return any(t == "*" for _, t in self.tokens)

    @property
    def shuts_out(self) -> bool:
        fields = [_field(r) for r in self.rules]
        return ("disallow", "/") in fields and all(f != "allow" for f, _ in fields)


def _read(text: str) -> tuple[list[str], list[_Group], list[str]]:
    """Lines before the first group, groups, and sitemap lines. Signals of the group for all are left out: they are made anew."""
    before: list[str] = []
    groups: list[_Group] = []
    sitemaps: list[str] = []
    naming = False
    for line in (x.strip() for x in text.split("\n")):
        field, value = _field(line)
        if not line:
            continue
        if field == "sitemap":
            sitemaps.append(line)
            continue
        if field == "user-agent":
            if not naming:
                groups.append(_Group([], []))
            groups[-1].tokens.append((line, (value.split() or [""])[0]))
        elif field != "content-signal" or not (not groups or groups[-1].for_all):
            (groups[-1].rules if groups else before).append(line)
        naming = field == "user-agent"
    return before, groups, sitemaps


def suggested(text: str | None, intent: Intent) -> str:
    """The file with the policy's bots in their places.

    Bots on which the policy has a stance leave the groups that shut their agents out of everything (that for all keeps
    its own); groups without agents go. The group for all, made where there is none, begins with the content signal. Bots to
    allow get a group where the group for all shuts out everything; bots to block get a group that does. All else stays,
    sitemaps at the end.
    """
    before, groups, sitemaps = _read(text or "")
    purposes = {bot[0].lower(): bot[1] for bot in BOTS}
    every = [bot[0] for bot in BOTS] + [t for t in intent.bots if t.lower() not in purposes]
    stance = {t: intent.of(t, purposes.get(t.lower())) for t in every}
    decided = {t.lower() for t, s in stance.items() if s != "any"}
    for g in groups:
        if g.shuts_out and not g.for_all:
            g.tokens = [t for t in g.tokens if t[1].lower() not in decided]
    groups = [g for g in groups if g.tokens]
    signal = content_signal(intent)
    shared = next((g for g in groups if g.for_all), None)
    if shared is None:
        groups.insert(0, _Group([("User-agent: *", "*")], [signal, "Allow: /"]))
    else:
        shared.rules.insert(0, signal)
    for wanted, rule in (("allow", "Allow: /"), ("block", "Disallow: /")):
        tokens = [t for t in every if stance[t] == wanted]
        if tokens and (wanted == "block" or (shared is not None and shared.shuts_out)):
            groups.append(_Group([(f"User-agent: {t}", t) for t in tokens], [rule]))
    parts = ["\n".join(before)] * bool(before) + ["\n".join([*(line for line, _ in g.tokens), *g.rules]) for g in groups] + ["\n".join(sitemaps)] * bool(sitemaps)
    return "\n\n".join(parts) + "\n"
