"""Challenge and block pages of bot managers: markers in headers and bodies, and whose they are."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: How much of a body is searched where the caller says nothing else, and below which size generic markers count, in bytes.
SCANNED = 64 * 1024
GENERIC_BELOW = 32 * 1024

#: Fixed values, in order of precedence: vendor, header, values (none: any), whether it counts on an answer of 200 to 299.
HEADERS = (
    ("cloudflare", "cf-mitigated", ("challenge",), True), ("vercel", "x-vercel-mitigated", ("challenge",), True), ("aws_waf", "x-amzn-waf-action", ("challenge", "captcha"), True),
    ("datadome", "x-datadome", (), False), ("datadome", "x-dd-b", (), False), ("imperva", "x-iinfo", (), False), ("sucuri", "x-sucuri-block", (), True),
)
#: Fixed values, in order of precedence: vendor, signal, and other spellings; small letters are searched.
BODIES = (
    ("cloudflare", "Just a moment..."), ("cloudflare", "_cf_chl_opt"), ("cloudflare", "Attention Required! | Cloudflare"), ("cloudflare", "cf-error-details"),
    ("cloudflare", "Error 1020"), ("cloudflare", "Error 1010"), ("vercel", "Vercel Security Checkpoint"), ("datadome", "captcha-delivery.com"), ("human", "_pxCaptcha"),
    ("human", "px-captcha"), ("human", "/_px/"), ("human", "Press & Hold"), ("human", "Press &amp; Hold"), ("imperva", "_Incapsula_Resource"), ("imperva", "Incapsula incident ID"),
    ("akamai", "errors.edgesuite.net", "errors&#46;edgesuite&#46;net"), ("sucuri", "Sucuri WebSite Firewall - Access Denied"),
)
GENERIC = ("g-recaptcha", "hcaptcha.com", "cf-turnstile", "challenges.cloudflare.com", "cf-chl", "verify you are human", "enable JavaScript and cookies")
#: A server's name with the words of its refusal.
REFUSAL = ("akamai", "AkamaiGHost", "AkamaiGHost: Access Denied", "access denied", ("reference #", "reference&#32;&#35;"))

_TITLE = re.compile(rb"<title[^>]*>([^<]*)", re.I)


class Detector:
    """All markers in one automaton, so that a body is read once however many there are."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for needle in [n for _, *spellings in BODIES for n in spellings] + [*GENERIC, REFUSAL[3], *REFUSAL[4]]:
            self.automaton.add_word(needle.lower(), needle.lower())
        self.automaton.make_automaton()

    def found(self, status: int | None, headers: Iterable[tuple[str, str]], body: bytes | None, scanned: int | None = SCANNED) -> tuple[str, str] | None:
        """vendor and signal of the first marker by precedence: headers, the server's refusal, vendors' bodies, and on small
        bodies generic ones and a title that speaks of a captcha. Letters' case does not count. Of a body the first `scanned`
        bytes are searched (None: all)."""
        body, sent = body or b"", [(k.strip().lower(), (v or "").strip()) for k, v in headers]
        fine = status is not None and 200 <= status < 300
        for vendor, name, values, when_fine in HEADERS:
            for key, value in sent if when_fine or not fine else ():
                if key == name and (not values or value.lower() in values):
                    return vendor, f"{name}: {value.lower()}" if values else name
        held = {needle for _, needle in self.automaton.iter(body[:scanned].lower().decode("latin-1"))}
        vendor, server, signal, words, numbers = REFUSAL
        if ("server", server.lower()) in ((k, v.lower()) for k, v in sent) and words in held and any(n in held for n in numbers):
            return vendor, signal
        for vendor, *spellings in BODIES:
            if any(s.lower() in held for s in spellings):
                return vendor, spellings[0]
        if len(body) >= GENERIC_BELOW:
            return None
        for needle in GENERIC:
            if needle.lower() in held:
                return "generic", needle
        title = _TITLE.search(body)
        return ("generic", "<title> captcha") if title and b"captcha" in title[1].lower() else None
