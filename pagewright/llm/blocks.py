"""Main text of HTML pages by a recurrent block labeller.

A page is cut into blocks, runs of text between block-level tags; scripts, styles, comments, form fields, templates and
frames hold no text. One scan goes forward over the page and remembers what it looked for in vain, so that its time grows
with the page whatever is broken there. A block is a row of numbers: hashed tags, classes and ids of its path, hashed words, and its length, link share,
marks and place. A bidirectional LSTM (numpy) reads the rows of a page in both directions, so that every block is
classified with the whole document as its context, as main text or not.

The network is trained here, on pages that a generator makes with known labels (`training_pages`): articles among menus,
headers, footers, sidebars, notices, adverts, forms and reader comments, in semantic tags, in classes or ids, nested in
various ways, with paragraphs that are never closed. Training takes some seconds on the driver, once per session, and is
deterministic; it does not look at the pages of the query.

Defined results: null html is empty and has the text ''; broken markup is read as far as it goes, an unclosed tag ends
with its parent; a quote that is never closed counts for nothing; a < that no > follows is text; repeated rows are read
each for itself; an empty table gives no rows. Extra columns are ignored. A page of very many blocks is read in slices.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import boxed, column_of, named, with_columns

PATH_CELLS, WORD_CELLS, NUMBERS = 160, 16, 12
WIDTH = PATH_CELLS + WORD_CELLS + NUMBERS
HIDDEN = 20

#: Tags that end a block of text, tags without content, and tags whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "textarea", "title")  # their content is no markup
HIDDEN_TAGS = frozenset((*RAW_TAGS, "template", "iframe"))
_RAW_START = {t: re.compile(rf"<{t}(?=[\s/>])", re.I) for t in RAW_TAGS}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW_TAGS}
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_MARK = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
_CLOSES_P = BLOCK_TAGS - {"option", "optgroup", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An opening tag of the first kind ends an open tag of the same kind.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


_CONTAINERS = ("ul", "ol", "dl", "table", "select", "menu")


@dataclass
class Block:
    text: str
    path: int  # a bit for each cell of the tags and names around it
    linked: int  # characters within links


class _Ends:
    """Where tags end. A search that failed, and the next mark of a tag, are remembered: all searches together are linear."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.vain: set[int] = set()  # quotes from which no > outside of quotes follows
        self.seen_from = self.seen_at = -1

    def after(self, at: int) -> int:
        """The place after the > that ends a tag whose name ends at at; 0 where none does."""
        page, quotes, place = self.page, [], at
        while place <= self.last:
            if not self.seen_from <= place <= self.seen_at:
                found = _TAG_MARK.search(page, place)
                self.seen_from, self.seen_at = place, found.start() if found else len(page)
            place = self.seen_at
            if place == len(page) or place in self.vain:
                break
            if page[place] == ">":
                return place + 1
            quotes.append(place)
            place = page.find(page[place], place + 1) + 1
            if not place:
                break
        self.vain.update(quotes)
        return page.find(">", at) + 1 if at <= self.last else 0


def _tokens(page: str) -> list[tuple[int, int, str, bool, str, bool]]:
    """Start, end, tag, whether it is an end tag, attributes, and whether the element is closed, of each piece of markup.

    Comments and closed raw elements are one piece without a tag. Closed is told of hidden elements only.
    """
    out: list[tuple[int, int, str, bool, str, bool]] = []
    raw_ends: dict[str, list[tuple[int, int]]] = {}
    opened: dict[str, list[int]] = {}
    ends = _Ends(page)
    at = 0
    while (start := page.find("<", at)) >= 0:
        name = _NAME.match(page, start + 1)
        if page.startswith("<!--", start):
            at = page.find("-->", start + 4) + 3
            at = at if at > 2 else len(page)
        elif name:
            at = ends.after(name.end())
        else:
            at = page.find(">", start) + 1 if start < ends.last and page[start + 1] in "!?/" else 0
        if not at:
            at = start + 1  # no markup
            continue
        if not name:
            out.append((start, at, "", False, "", True))
            continue
        tag, end, rest = name[1].lower(), page[start + 1] == "/", page[name.end() : at - 1]
        if tag in RAW_TAGS and not end:
            if tag not in raw_ends:
                raw_ends[tag] = [e.span() for e in _RAW_END[tag].finditer(page)]
            k = bisect_left(raw_ends[tag], (at, 0))
            closed = k < len(raw_ends[tag])
            if rest.endswith("/") and not (closed and not _RAW_START[tag].search(page, at, raw_ends[tag][k][0])):
                out.append((start, at, "", False, "", True))  # self-closed: empty
            elif closed:
                at = raw_ends[tag][k][1]
                out.append((start, at, "", False, "", True))
            else:
                out.append((start, at, tag, False, "", False))
            continue
        if tag in HIDDEN_TAGS and not rest.endswith("/"):
            if not end:
                opened.setdefault(tag, []).append(len(out))
            elif opened.get(tag):
                k = opened[tag].pop()
                out[k] = (*out[k][:5], True)
        out.append((start, at, tag, end, rest, False))
    return out


class _Stack:
    """The open elements, with the depths of each tag and the cells of all their names, kept as elements come and go."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, tuple[int, ...]]] = []
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.walls: dict[int, None] = {}  # depths of closed hidden elements: what opens in them ends nothing outside
        self.counts = [0] * PATH_CELLS
        self.cells = 0

    def last(self, tag: str) -> int:
        """The depth of the innermost open element of a tag, or -1."""
        found = self.depths.get(tag)
        return found[-1] if found else -1

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def last_wall(self) -> int:
        return next(reversed(self.walls), -1)

    def push(self, tag: str, cells: tuple[int, ...]) -> None:
        self.depths.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.tags))
        self.tags.append((tag, cells))
        for c in cells:
            self.counts[c] += 1
            self.cells |= 1 << c

    def cut(self, depth: int) -> None:
        while len(self.tags) > depth:
            tag, cells = self.tags.pop()
            self.depths[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()
            for c in cells:
                self.counts[c] -= 1
                if not self.counts[c]:
                    self.cells &= ~(1 << c)
        while self.walls and self.last_wall() >= depth:
            self.walls.popitem()


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, with character references decoded and white space made single spaces."""
    out: list[Block] = []
    if not page:
        return out
    stack = _Stack()
    held: list[str] = []
    linked = 0
    hidden: int | None = None  # place in the stack of the outermost hidden element

    def close() -> None:
        nonlocal held, linked
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append(Block(text, stack.cells, linked))
            held, linked = [], 0

    def text(piece: str) -> None:
        nonlocal linked
        if hidden is None:
            held.append(piece)
            linked += len(piece) if stack.depths.get("a") else 0

    def leave(depth: int, tag: str) -> None:
        """Ends the element at depth of the stack. A hidden one that is not closed ends with its parent; a block tag that
        ends it from outside ends the block too."""
        nonlocal hidden
        if hidden is not None and depth <= hidden:
            stack.cut(hidden)
            if depth < hidden and tag in BLOCK_TAGS:
                close()
            hidden = None
        stack.cut(depth)

    at = 0
    for start, stop, tag, end, rest, closed in _tokens(page):
        if start > at:
            text(page[at:start])
        at = stop
        if not tag:
            continue
        if tag == "br":
            text(" ")
        if tag in BLOCK_TAGS and hidden is None:
            close()
        if end:
            # An inline end tag does not reach beyond its block.
            depth = stack.last(tag)
            if depth >= 0 and (tag in BLOCK_TAGS or tag in HIDDEN_TAGS or stack.last_block() < depth):
                leave(depth, tag)
            continue
        if tag == "body" and hidden is not None and hidden not in stack.walls:
            leave(hidden, tag)
        if tag in _CLOSES_P and (depth := stack.last("p")) >= 0 and depth == stack.last_block() and depth > stack.last_wall():
            leave(depth, tag)
        if tag in _SIBLINGS:
            depth = max(map(stack.last, _SIBLINGS[tag]))
            if depth > max(stack.last_wall(), *map(stack.last, _CONTAINERS)):
                leave(depth, tag)
        if tag in VOID_TAGS or rest.endswith("/"):
            continue
        cells = [_cell(tag, PATH_CELLS)]
        for a, b, c in _NAMES.findall(rest) if rest else ():
            cells += [_cell("." + x.lower(), PATH_CELLS) for x in _NAME_PARTS.findall(a or b or c)]
        if tag in HIDDEN_TAGS:
            if closed:
                stack.walls[len(stack.tags)] = None
            if hidden is None:
                hidden = len(stack.tags)
        stack.push(tag, tuple(cells))
    if at < len(page):
        text(page[at:])
    if hidden is not None:
        stack.cut(hidden)
    close()
    return out


@lru_cache(maxsize=100_000)
def _cell(name: str, cells: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % cells


def rows(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """The network's input: one row for each of the blocks from first to last, as parts of the whole page."""
    part = page[first:last]
    x = np.zeros((len(part), WIDTH), np.float32)
    paths = b"".join(b.path.to_bytes(PATH_CELLS // 8, "little") for b in part)
    x[:, :PATH_CELLS] = np.unpackbits(np.frombuffer(paths, np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
    total = max(1, len(page))
    for i, b in enumerate(part):
        found = b.text.split(" ")
        for w in set(found):  # hashed words are a bag of presence
            x[i, PATH_CELLS + _cell(w.lower(), WORD_CELLS)] = 0.3
        n, place = len(b.text), (first + i) / total
        x[i, PATH_CELLS + WORD_CELLS :] = (
            np.log1p(n) / 8, min(1.0, b.linked / max(1, n)), np.log1p(len(found)) / 6, min(1.0, b.text.count(".") / len(found)),
            min(1.0, b.text.count(",") / len(found)), n > 80, n > 250, place, 1 - place, b.text[-1] in ".!?", min(1.0, b.text.count("|") / len(found)), 1.0,
        )
    return x


class BiLSTM:
    """Weights of two LSTMs and of the last layer; float32 forward in batches of padded pages."""

    def __init__(self, rng: np.random.Generator | None = None) -> None:
        if rng is not None:
            scale = 1 / np.sqrt(WIDTH + HIDDEN)
            self.w = {}
            for d in "fb":
                self.w[d + "x"] = rng.normal(0, scale, (WIDTH, 4 * HIDDEN))
                self.w[d + "h"] = rng.normal(0, scale, (HIDDEN, 4 * HIDDEN))
                self.w[d + "b"] = np.r_[np.ones(HIDDEN), np.zeros(3 * HIDDEN)]  # forget, input, output, candidate
            self.w["o"] = rng.normal(0, 0.2, (2 * HIDDEN + WIDTH,))
            self.w["ob"] = np.zeros(1)

    def step(self, d: str, xw: np.ndarray, hs: np.ndarray, cs: np.ndarray, m) -> tuple[np.ndarray, ...]:
        """One block further in direction d: gates, candidate, and the new cell and hidden values."""
        z = xw + hs @ self.w[d + "h"]
        g = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        f, i, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        c = np.tanh(z[:, 3 * HIDDEN :])
        c_new = m * (f * cs + i * c)
        tc = np.tanh(c_new)
        return f, i, o, c, tc, c_new, m * (o * tc)

    def long(self, page: list[Block], size: int) -> np.ndarray:
        """Logits of one page, read in slices of size blocks: beyond a slice only the hidden values are held."""
        out = np.full(len(page), self.w["ob"][0], np.float32)
        starts = range(0, len(page), size)
        for k, d in enumerate("fb"):
            hs, cs, last = np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32), self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            for a in starts if d == "f" else reversed(starts):
                x = rows(page, a, a + size)
                xw = x @ self.w[d + "x"] + self.w[d + "b"]
                for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
                    *_, cs, hs = self.step(d, xw[t : t + 1], hs, cs, 1)
                    out[a + t] += hs[0] @ last
                if d == "f":
                    out[a : a + size] += x @ self.w["o"][2 * HIDDEN :]
        return out

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: pages x blocks x WIDTH; mask: 1 where a block is. Logits, and what the backward pass needs."""
        n, length, _ = x.shape
        h, caches = [], []
        for d in "fb":
            steps = range(length) if d == "f" else range(length - 1, -1, -1)
            xw = x @ self.w[d + "x"] + self.w[d + "b"]
            out, hs, cs, cache = np.zeros((n, length, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype), []
            for t in steps:
                m = mask[:, t : t + 1]
                f, i, o, c, tc, c_new, h_new = self.step(d, xw[:, t], hs, cs, m)
                if keep:
                    cache.append((t, hs, cs, f, i, o, c, tc, m))
                hs, cs = h_new, c_new
                out[:, t] = hs
            h.append(out)
            caches.append(cache)
        both = np.concatenate([*h, x], axis=2)
        return both @ self.w["o"] + self.w["ob"], (both, caches)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        logits, (both, caches) = self.run(x, mask, keep=True)
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        count = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / count)
        dz_out = mask * (p - y) / count
        g = {"o": np.einsum("nt,ntk->k", dz_out, both), "ob": np.array([dz_out.sum()])}
        for k, d in enumerate("fb"):
            dh_all = dz_out[:, :, None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), x.dtype)
            dh, dc = np.zeros((len(x), HIDDEN), x.dtype), np.zeros((len(x), HIDDEN), x.dtype)
            gh = np.zeros_like(self.w[d + "h"])
            for t, hs, cs, f, i, o, c, tc, m in reversed(caches[k]):
                dh = m * (dh + dh_all[:, t])
                dcn = dh * o * (1 - tc**2) + m * dc
                dz = np.concatenate([dcn * cs * f * (1 - f), dcn * c * i * (1 - i), dh * tc * o * (1 - o), dcn * i * (1 - c**2)], axis=1) * m
                gh += hs.T @ dz
                dz_all[:, t] = dz
                dh, dc = dz @ self.w[d + "h"].T, dcn * f
            g[d + "h"] = gh
            g[d + "x"] = np.einsum("ntw,ntz->wz", x, dz_all, optimize=True)
            g[d + "b"] = dz_all.sum(axis=(0, 1))
        return loss, g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = max(map(len, pages))
    x, mask = np.zeros((len(pages), length, WIDTH), np.float32), np.zeros((len(pages), length), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


# ---- training pages -------------------------------------------------------------------------------------------------

#: Names that sites give to the parts of a page.
PART_NAMES = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs links mainmenu submenu tabs".split(),
    "header": "header masthead banner topbar siteheader branding logo".split(),
    "footer": "footer foot bottom copyright siteinfo colophon legal".split(),
    "sidebar": "sidebar side aside widget related recommended rail secondary more trending popular".split(),
    "notice": "notice cookie cookies consent alert gdpr privacy popup modal overlay newsletter subscribe message warning".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense".split(),
    "form": "form search login signup contact searchbox".split(),
    "comments": "comments comment discussion replies reply respond disqus thread reader".split(),
    "share": "share social sharing buttons tools tags meta pagination pager author byline".split(),
}
ARTICLE_NAMES = "article content main post entry story body text page container wrapper col row primary maincontent postbody articlebody".split()
PART_TAGS = {"menu": ["nav", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "comments": ["section", "div", "ol"], "form": ["form"], "notice": ["div", "aside", "dialog", "section"], "advert": ["div", "aside", "ins"], "share": ["div", "ul", "p"]}
_MAIN, _OTHER = "\x01", "\x02"  # the generator's marks at the start of a text


def training_pages(n: int, seed: int = 3) -> Iterator[tuple[list[Block], np.ndarray]]:
    """Pages with known labels. Every text starts with a mark that tells its label and is taken off again."""
    rng = np.random.default_rng(seed)
    syllables = "the an er on re at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()

    def pick(seq):
        return seq[int(rng.integers(len(seq)))]

    def sentence(low: int, high: int) -> str:
        words = ["".join(pick(syllables) for _ in range(int(rng.integers(1, 5)))) for _ in range(int(rng.integers(low, high)))]
        noise = pick(["", "", "", "", "###", "!!", " |"])
        if rng.random() < 0.06:  # word salad of one word, or one letter
            words = words[:1] * int(rng.integers(1, 40)) if rng.random() < 0.7 else ["a"] * int(rng.integers(1, 60))
        return " ".join(w + (noise if rng.random() < 0.6 else "") + ("," if rng.random() < 0.1 else "") for w in words).capitalize()

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence(1, 16) + "." for _ in range(int(rng.integers(low, high))))

    def attributes(names: list[str], sure: float) -> str:
        if rng.random() > sure:
            return ""
        name = pick(names)
        if rng.random() < 0.3:
            name += pick(["-", "_", " "]) + pick(["box", "inner", "area", "wrap", "block", "list", "item", "1", "top", "left"])
        return f' {pick(["class", "class", "id"])}="{name}"'

    def part(kind: str) -> str:
        tag = pick(PART_TAGS[kind])
        a = attributes(PART_NAMES[kind], 0.55 if tag in ("nav", "header", "footer", "aside", "form") else 1.0)
        o = _OTHER
        if kind == "menu" or (kind == "sidebar" and rng.random() < 0.5):
            items = "".join(f'<li><a href="/{i}">{o}{sentence(1, 4)}</a></li>' for i in range(int(rng.integers(2, 9))))
            body = items if tag in ("ul", "ol") else f"<ul>{items}</ul>"
            if kind == "sidebar":
                body = f"<h3>{o}{sentence(1, 4)}</h3>" + body
        elif kind == "header":
            body = pick([f"<a href='/'>{o}{sentence(1, 3)}</a>", f"<h1>{o}{sentence(1, 4)}</h1>", f"<p>{o}{sentence(2, 8)}</p>", f"{o}{sentence(1, 4)}"])
        elif kind == "footer":
            body = pick([f"{o}&copy; {sentence(1, 3)} &middot; {prose(1, 3)}", f"<p>{o}{prose(1, 3)}</p><p>{o}&copy; {sentence(1, 3)}</p>", f"<ul><li><a href='/a'>{o}{sentence(1, 3)}</a></li></ul>{o}{sentence(1, 5)}"])
        elif kind == "form":
            body = f"<label>{o}{sentence(1, 3)}</label><input name=q><button>{o}{sentence(1, 2)}</button>" + pick(["", f"<p>{o}{prose(1, 2)}</p>"])
        elif kind == "comments":
            item = "li" if tag == "ol" else pick(["div", "article", "p"])
            many = "".join(f"<{item}{attributes(['comment', 'reply', 'comment-body'], 0.8)}><b>{o}{sentence(1, 3)}</b> " + pick([f"<p>{o}{prose(1, 4)}</p>", prose(1, 4)]) + f"</{item}>" for _ in range(int(rng.integers(1, 5))))
            body = (f"<h3>{o}{sentence(1, 3)}</h3>" if tag != "ol" and rng.random() < 0.7 else "") + many
        elif kind == "share":
            body = f"{o}{sentence(1, 4)} <a href='#'>{sentence(1, 2)}</a>"
        else:
            body = pick([f"{o}{prose(1, 4)}", f"<p>{o}{prose(1, 4)}</p>", f"<p>{o}{prose(1, 3)}</p><a href='/x'>{o}{sentence(1, 3)}</a>"])
        return f"<{tag}{a}>{body}</{tag}>"

    def article() -> str:
        m = _MAIN
        style = rng.random()
        out = f"<h1>{m}{sentence(1, 10)}</h1>" if rng.random() < 0.85 else ""
        for k in range(int(rng.integers(1, 14))):
            r = rng.random()
            text = f"{m}{prose(1, 7) if rng.random() < 0.8 else sentence(1, 5) + '.'}"
            if r < 0.08:
                out += f"<h2>{m}{sentence(1, 8)}</h2>"
            elif r < 0.14:
                out += "<ul>" + "".join(f"<li>{m}{sentence(2, 12)}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>"
            elif r < 0.18:
                out += f"<blockquote>{pick(['', '<p>'])}{text}</blockquote>"
            elif r < 0.22:
                out += f"<table><tr><td>{m}{sentence(1, 5)}</td><td>{m}{sentence(1, 4)}</td></tr></table>"
            elif r < 0.25:
                out += f"<pre>{m}{sentence(2, 9)}</pre>"
            elif r < 0.30:
                out += f"<p>{text} <a href='/l'>{sentence(1, 4)}</a> {sentence(1, 6)}.</p>"
            elif r < 0.33:
                out += f"<figure><img src=x><figcaption>{m}{sentence(2, 9)}</figcaption></figure>"
            elif style < 0.35 and r < 0.6:
                out += f"<p><b>{text}<br>"
            elif style > 0.9:
                out += f"<div>{text}</div>"
            else:
                out += f"<p>{text}</p>"
            if rng.random() < 0.05:
                out += part(pick(["advert", "share", "form", "sidebar", "notice"]))
        if rng.random() < 0.15:
            out += part("comments")
        return out

    for _ in range(n):
        r = rng.random()
        if r < 0.5:
            core = f"<article{attributes(ARTICLE_NAMES, 0.3)}>{article()}</article>"
        elif r < 0.65:
            core = f"<main{attributes(ARTICLE_NAMES, 0.3)}>{article()}</main>"
        elif r < 0.92:
            core = f"<div{attributes(ARTICLE_NAMES, 1.0)}>{article()}</div>"
        else:
            core = f"<div>{article()}</div>"
        if rng.random() < 0.3:
            core = f"<{pick(['main', 'div', 'section'])}{attributes(ARTICLE_NAMES, 0.6)}>{core}" + (part(pick(["comments", "sidebar", "share", "advert"])) if rng.random() < 0.5 else "") + "</div>"
        before = [k for k in ("notice", "header", "menu", "form", "advert", "share") if rng.random() < 0.45]
        after = [k for k in ("share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer") if rng.random() < 0.35]
        if rng.random() < 0.3:
            before = ["menu", "advert"]
            after = ["footer"]
        page = "<!DOCTYPE html><html><head><title>t</title><script>var t='</p>';</script></head><body>" + "".join(map(part, before)) + core + "".join(map(part, after)) + "</body></html>"
        cut = blocks(page)
        y = np.array([b.text[0] == _MAIN if b.text[0] in (_MAIN, _OTHER) else False for b in cut], np.float32)
        for b in cut:
            b.text = b.text.replace(_MAIN, "").replace(_OTHER, "").strip() or "."
        if len(cut):
            yield cut, y


def train(n_pages: int = 1600, epochs: int = 7, seed: int = 3) -> BiLSTM:
    """A labeller trained on generated pages by Adam."""
    rng = np.random.default_rng(seed)
    data = [(rows(b), y) for b, y in training_pages(n_pages, seed)]
    model = BiLSTM(rng)
    model.w = {k: v.astype(np.float32) for k, v in model.w.items()}
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        groups = [sorted(order[a : a + 512], key=lambda i: len(data[i][0])) for a in range(0, len(order), 512)]
        for g in groups:
            for a in rng.permutation(range(0, len(g), 32)):
                chosen = g[a : a + 32]
                x, mask = padded([data[i][0] for i in chosen])
                y = np.zeros(mask.shape, np.float32)
                for k, i in enumerate(chosen):
                    y[k, : len(data[i][1])] = data[i][1]
                # Names are left out now and then, so that the context has to carry the label.
                # So are words and numbers of half the pages, so that the path counts for more than the wording.
                drop = rng.random((len(chosen), 1, PATH_CELLS)) < 0.06
                x[:, :, :PATH_CELLS] *= ~drop
                x[:, :, PATH_CELLS:-1] *= rng.random((len(chosen), 1, 1)) < 0.5
                _, grads = model.gradients(x, mask, y)
                norm = np.sqrt(sum((v**2).sum() for v in grads.values()))
                step += 1
                rate = 0.01 * (1 - 0.7 * epoch / epochs)
                for k, v in grads.items():
                    v = v * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v**2
                    model.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


@lru_cache(maxsize=1)
def trained() -> BiLSTM:
    return train()


def label(model: BiLSTM, pages: list[list[Block]], most_cells: int = 4096) -> list[np.ndarray]:
    """Whether each block of each page is main text. Pages of like length are run together; a very long page in slices."""
    out = [model.long(p, most_cells) > 0 if len(p) > most_cells else np.zeros(len(p), bool) for p in pages]
    order = sorted((i for i, p in enumerate(pages) if 0 < len(p) <= most_cells), key=lambda i: len(pages[i]))
    a = 0
    while a < len(order):
        z = a + 1
        while z < len(order) and (z - a + 1) * len(pages[order[z]]) <= most_cells:
            z += 1
        chosen = order[a:z]
        x, mask = padded([rows(pages[i]) for i in chosen])
        logits, _ = model.run(x, mask)
        for k, i in enumerate(chosen):
            out[i] = logits[k, : len(pages[i])] > 0
        a = z
    return out


def _extractor(model: BiLSTM):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, 256):
                piece = part.slice(a, 256)
                pages = [blocks(p) for p in column_of(piece, "html")]
                texts = ["\n\n".join(b.text for b, m in zip(p, y) if m) for p, y in zip(pages, label(model, pages))]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string())], names=["box", "text"])

    return run


def main_text(pages: DataFrame, keep: list[str], html_col: str = "html", text_col: str = "text", model: BiLSTM | None = None) -> DataFrame:
    """The columns in keep of every page, and its main text."""
    boxes = boxed(pages, keep, html=named(html_col))
    return boxes.mapInArrow(_extractor(model or trained()), with_columns(boxes, "text string")).select("box.*", F.col("text").alias(text_col))
