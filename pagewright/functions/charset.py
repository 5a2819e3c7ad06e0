"""The encoding of a page's bytes: byte order mark, else header, else a meta element among the first bytes, else UTF-8."""

from __future__ import annotations

import codecs
import re

#: Bytes that are searched for a meta element, and byte order marks.
SEARCHED = 1024
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Labels that pages mean another encoding by.
MEANT = {
    "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "ascii": "windows-1252", "us-ascii": "windows-1252", "latin1": "windows-1252", "l1": "windows-1252", "iso-8859-1": "windows-1252", "iso8859-1": "windows-1252",
    "iso_8859-1": "windows-1252", "cp1252": "windows-1252", "x-cp1252": "windows-1252", "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "unicode": "utf-16-le",
    "iso-8859-9": "windows-1254", "latin5": "windows-1254", "gb2312": "gbk", "gb_2312-80": "gbk", "x-gbk": "gbk", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "korean": "cp949",
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "iso-8859-11": "cp874", "tis-620": "cp874", "x-user-defined": "x-user-defined",
}

_COMMENT = re.compile(rb"<!--.*?(?:-->|\Z)", re.S)
_META = re.compile(rb"<meta[\s/]((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)", re.I)
_ATTRIBUTE = re.compile(rb"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARAMETER = re.compile(r"charset\s*=\s*[\"']?([^;\"' ]+)", re.I)


def encoding(label: str | None) -> str | None:
    """The encoding that a label means, if it is known."""
    label = (label or "").strip().lower()
    if not label:
        return None
    if label in MEANT:
        return MEANT[label]
    try:
        info = codecs.lookup(label)
    except (LookupError, ValueError):
        return None
    return (label if label.startswith("windows-") else info.name) if info._is_text_encoding and not info.name.startswith(("utf-7", "idna", "punycode", "unicode", "raw-unicode", "undefined")) else None


def _in_meta(data: bytes) -> str | None:
    for tag in _META.finditer(_COMMENT.sub(b"", data[:SEARCHED])):
        held: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(tag[1]):
            held.setdefault(name.decode("latin-1").lower(), next((v.decode("latin-1") for v in values if v), ""))
        if "charset" in held:
            found = encoding(held["charset"])
        elif held.get("http-equiv", "").strip().lower() == "content-type" and (said := _PARAMETER.search(held.get("content", ""))):
            found = encoding(said[1])
        else:
            continue
        if found:  # bytes that could be read as far as here are no UTF-16
            return "utf-8" if found.startswith("utf-16") else "windows-1252" if found == "x-user-defined" else found
    return None


def decoded(data: bytes, content_type: str | None = None) -> tuple[str, str]:
    """The encoding and the text; what cannot be read becomes U+FFFD."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, data[len(mark) :].decode(name, "replace")
    said = _PARAMETER.search(content_type or "")
    name = (encoding(said[1]) if said else None) or _in_meta(data) or "utf-8"
    return name, data.decode("windows-1252" if name == "x-user-defined" else name, "replace")
