"""Sitemap bodies as bytes: plain or gzip, read in pieces, so that a body is never held unpacked."""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from xml.parsers import expat

#: Bytes of a body that are read, after unpacking too, and addresses of a file that are kept.
MOST_BYTES = 50 * 1024 * 1024
MOST_URLS = 50_000
_PIECE = 64 * 1024
_KINDS = {"urlset": "urls", "sitemapindex": "index"}


class Sitemap(NamedTuple):
    """kind is urls, index or invalid. error says why a body is invalid, or where reading stopped; what came before stays."""

    kind: str
    locs: list[str]
    dates: list[str | None]
    error: str | None


def _unpacked(body: bytes) -> Iterator[bytes]:
    """Pieces of a body of at most MOST_BYTES in all; of gzip the first member counts."""
    view, left = memoryview(body), MOST_BYTES
    if body[:2] != b"\x1f\x8b":
        for at in range(0, min(len(view), MOST_BYTES), _PIECE):
            yield bytes(view[at : min(at + _PIECE, MOST_BYTES)])
        return
    unpack = zlib.decompressobj(wbits=31)
    for at in range(0, len(view), _PIECE):
        fed = bytes(view[at : at + _PIECE])
        while fed and left > 0 and not unpack.eof:
            piece = unpack.decompress(fed, min(_PIECE, left))
            fed, left = unpack.unconsumed_tail, left - len(piece)
            yield piece
        if left <= 0 or unpack.eof:
            return
    raise zlib.error("the body ends early")


class _Entries:
    """Handlers that keep loc and lastmod right under each entry right under the root, without a prefix of their own."""

    def __init__(self) -> None:
        self.kind: str | None = None
        self.locs: list[str] = []
        self.dates: list[str | None] = []
        self.depth, self.inside, self.field = 0, False, None
        self.text: list[str] = []
        self.found: dict[str, str] = {}

    def start(self, name: str, _attributes: object) -> None:
        self.depth += 1
        local = name.rpartition(":")[2]
        if self.depth == 1:
            self.kind = _KINDS.get(local, "invalid")
        elif self.depth == 2:
            self.inside, self.found = local in ("url", "sitemap"), {}
        elif self.depth == 3 and self.inside:
            self.field, self.text = (name if name in ("loc", "lastmod") else None), []

    def data(self, text: str) -> None:
        if self.field:
            self.text.append(text)

    def end(self, _name: str) -> None:
        if self.depth == 3 and self.field:
            if value := "".join(self.text).strip():
                self.found[self.field] = value
            self.field = None
        elif self.depth == 2:
            self.close()
        self.depth -= 1

    def close(self) -> None:
        """Takes the entry that is open; one that breaks off counts if its loc was whole."""
        if self.inside and "loc" in self.found and len(self.locs) < MOST_URLS:
            self.locs.append(self.found["loc"])
            self.dates.append(self.found.get("lastmod", "")[:10] or None)
        self.inside = False


def read_sitemap(body: bytes | None) -> Sitemap:
    """The entries of a body. Bytes that are no UTF-8 become U+FFFD, entities that are not known become nothing."""
    held, error = _Entries(), None
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.UseForeignDTD(True)  # without it an entity that is not known ends the file
    parser.ExternalEntityRefHandler = lambda *_: 1
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = held.start, held.end, held.data
    decode = codecs.getincrementaldecoder("utf-8-sig")("replace").decode
    first = True
    try:
        for piece in _unpacked(body or b""):
            text = decode(piece)
            if first and (text := text.lstrip()):
                first = False
            parser.Parse(text)
            if held.kind == "invalid":
                return Sitemap("invalid", [], [], "no sitemap")
            if len(held.locs) >= MOST_URLS:
                break
        else:
            parser.Parse(decode(b"", True), True)
    except zlib.error as e:
        error = f"gzip: {e}"
    except expat.ExpatError as e:
        error = f"xml: {expat.ErrorString(e.code)}"
    held.close()
    if held.kind in (None, "invalid"):
        return Sitemap("invalid", [], [], error or "no sitemap")
    return Sitemap(held.kind, held.locs, held.dates, error)
