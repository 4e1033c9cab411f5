"""A small tolerant reader of HTML: a tree of block elements, the text runs between block borders, and features of each block."""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the HTML standard: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Controls: what they hold is a label, no text of the page. One that isn't closed ends where the next block begins or ends.
CONTROL = frozenset("button select".split())
#: What a browser shows instead of text, or only if it can't show something else.
EMBEDDED = frozenset("noscript object video audio canvas svg template".split())
BLOCK = EMBEDDED | frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend head".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",),
}
#: The tag of the anonymous block that a run of text directly in html or body makes.
LOOSE = ""
SCOPE = frozenset("table ul ol dl td th article section div body html form aside nav header footer main".split())
#: Words of class, id, role, aria-label and itemprop are told apart by so many hash values.
TOKENS = 4096

_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_TAG_END = re.compile(r">|=[ \t\n\r\f]*([\"'])")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|aria-label|hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_BLOCKS = "|".join(sorted(BLOCK - EMBEDDED))
_CONTROL_END = {t: re.compile(rf"(</{t}\s*>)|</?(?:{_BLOCKS})[\s/>]", re.I) for t in CONTROL}


@dataclass(slots=True)
class Block:
    tag: str
    parent: int
    depth: int
    tokens: list[int] = field(default_factory=list)
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    chars: int = 0  # of its own runs, as are the rest
    links: int = 0
    words: int = 0
    stops: int = 0
    runs: int = 0


@dataclass(slots=True)
class Page:
    blocks: list[Block]
    runs: list[tuple[int, str]]


def _attributes(block: Block, raw: str) -> None:
    for m in _ATTRIBUTE.finditer(raw):
        if m[1].lower() == "hidden":
            block.hidden = True
            continue
        value = m[2] or m[3] or m[4] or ""
        block.tokens += [zlib.crc32(w.encode()) % TOKENS for w in set(_WORD.findall(_HUMP.sub(r"\1 \2", value).lower()))]


class _Open:
    """The open elements. Where each tag is open is kept by tag, so that finding what an end tag or a new block closes takes no walk down the stack."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, int]] = []  # tag, and the block that text in it belongs to
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []

    def push(self, tag: str, block: int) -> None:
        at = len(self.elements)
        self.places.setdefault(tag, []).append(at)
        if tag in SCOPE:
            self.scopes.append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        self.elements.append((tag, block))

    def pop(self) -> str:
        tag, _ = self.elements.pop()
        self.places[tag].pop()
        for kept in (self.scopes, self.blocks):
            if kept and kept[-1] == len(self.elements):
                kept.pop()
        return tag

    def last(self, tag: str) -> int:
        """Where the innermost element of this tag is open, 0 if none is above the root."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def ended_by(self, tag: str) -> int:
        """Where an end tag closes, 0 if nowhere: a block's end doesn't reach out of a scope."""
        at = self.last(tag)
        return 0 if tag in BLOCK and tag not in SCOPE and self.scopes and at < self.scopes[-1] else at

    def closed_by(self, tag: str) -> int:
        """The lowest element that a new block closes within its scope, 0 if none."""
        closes = CLOSES.get(tag, ())
        bound = 0
        for at in reversed(self.scopes):
            if self.elements[at][0] not in closes:
                bound = at
                break
        found = 0
        for other in ("p", *closes):
            places = self.places.get(other, ())
            k = bisect.bisect_right(places, bound)
            if k < len(places):
                found = min(found or places[k], places[k])
        return found


class _Scanner:
    """Finds markup in a page, in time that grows with its length: a search that ran to the end in vain isn't made again."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.quoted = True
        self.ends: dict[str, tuple[int, re.Match | None]] = {}

    def find(self, pattern: re.Pattern, key: str, at: int) -> re.Match | None:
        """The first match from at on, kept while it lies ahead."""
        since, m = self.ends.get(key, (at + 1, None))
        if since > at or m is not None and m.start() < at:
            m = pattern.search(self.source, at)
            self.ends[key] = (at, m)
        return m

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends here ends, behind its >: one in a quoted value doesn't count, unless a quote stays open."""
        place = at
        while self.quoted:
            m = _TAG_END.search(self.source, place)
            if m is None:
                self.quoted = False
            elif m[1] is None:
                return m.end()
            elif (place := self.source.find(m[1], m.end()) + 1) == 0:
                self.quoted = False
        end = self.source.find(">", at)
        return end + 1 if end >= 0 else len(self.source)

    def markup(self, at: int):
        """(start, end, tag, whether it closes, attributes) of the next markup; the tag is None for comments and declarations; None if there is no more."""
        m = _MARKUP.search(self.source, at)
        if m is None:
            return None
        if m[2] is not None:
            end = self.tag_end(m.end())
            return m.start(), end, m[2].lower(), bool(m[1]), self.source[m.end() : end].removesuffix(">")
        close = "-->" if m[0] == "<!--" else "]]>" if m[0] == "<![CDATA[" else ">"
        end = self.source.find(close, m.end())
        return m.start(), end + len(close) if end >= 0 else len(self.source), None, False, ""

    def raw_end(self, tag: str, at: int) -> int:
        m = self.find(re.compile(rf"</{tag}\s*>", re.I), tag, at)
        return m.end() if m else len(self.source)

    def control_end(self, tag: str, at: int) -> int:
        """Behind the end tag of a control, or before the next block begins or ends; where neither comes, here."""
        m = self.find(_CONTROL_END[tag], tag, at)
        return at if m is None else m.end() if m[1] else m.start()

    def closed(self, tag: str, at: int) -> bool:
        return self.find(re.compile(rf"</{tag}[\s>]", re.I), f"/{tag}", at) is not None


def read_page(source: str) -> Page:
    """The blocks in page order (the first is the root) and the text runs with the block each belongs to. White space in a run is one space; references are decoded.

    A run directly in html or body is an anonymous block, named by the inline elements that were open at its first character.
    """
    blocks = [Block("html", -1, 0)]
    open_ = _Open()
    open_.push("html", 0)
    stack = open_.elements
    runs: list[tuple[int, str]] = []
    text: list[str] = []
    names: list[tuple[tuple[str, int], int, Block]] = []  # inline elements directly in html or body that a loose run may start in, their places, and what they and those around them are named
    begun = False
    link = linked = 0
    at, end = 0, len(source)

    def flush() -> None:
        nonlocal linked, begun
        if text:
            run = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if run:
                k = stack[-1][1]
                if blocks[k].tag in ("html", "body"):
                    b = Block(LOOSE, k, blocks[k].depth + 1)
                    if names:
                        b.tokens, b.hidden = names[-1][2].tokens, names[-1][2].hidden
                    blocks[k].children.append(len(blocks))
                    k = len(blocks)
                    blocks.append(b)
                b = blocks[k]
                runs.append((k, run))
                b.chars += len(run)
                b.links += min(linked, len(run))
                b.words += run.count(" ") + 1
                b.stops += run.count(".") + run.count(",") + run.count("?") + run.count("!")
                b.runs += 1
        linked, begun = 0, False
        forget()

    def forget() -> None:
        while names and (names[-1][1] >= len(stack) or stack[names[-1][1]] is not names[-1][0]):
            names.pop()

    def close(depth: int) -> None:
        nonlocal link
        if open_.blocks and open_.blocks[-1] >= depth:
            flush()
        while len(stack) > depth:
            link -= open_.pop() == "a"
        if not begun:
            forget()

    def said(piece: str) -> None:
        nonlocal linked, begun
        if piece:
            text.append(piece)
            begun = begun or not piece.isspace()
            if link:
                linked += len(piece)

    scanner = _Scanner(source)
    while at < end:
        found = scanner.markup(at)
        if found is None:
            said(source[at:])
            break
        start, stop, tag, closing, raw = found
        said(source[at:start])
        at = stop
        if tag is None:
            continue
        if closing:
            if depth := open_.ended_by(tag):
                close(depth)
            continue
        if tag in ("html", "body") and open_.places.get(tag):
            continue
        if tag in RAW:
            if not raw.endswith("/"):
                at = scanner.raw_end(tag, at)
            said(" ")
            continue
        if tag in CONTROL:
            at = scanner.control_end(tag, at)
            said(" ")
            continue
        if tag in EMBEDDED and (raw.endswith("/") or not scanner.closed(tag, at)):
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "wbr") and tag != "wbr":
                said(" ")
            continue
        if tag in BLOCK:
            flush()
            if depth := open_.closed_by(tag):
                close(depth)
            parent = stack[-1][1]
            block = Block(tag, parent, blocks[parent].depth + 1)
            _attributes(block, raw)
            blocks[parent].children.append(len(blocks))
            open_.push(tag, len(blocks))
            blocks.append(block)
        else:
            link += tag == "a"
            open_.push(tag, stack[-1][1])
            if not begun and blocks[stack[-1][1]].tag in ("html", "body"):
                named = Block(tag, -1, 0)
                _attributes(named, raw)
                if names:
                    around = names[-1][2]
                    named.tokens, named.hidden = list({*around.tokens, *named.tokens}) if named.tokens else around.tokens, named.hidden or around.hidden
                names.append((stack[-1], len(stack) - 1, named))
    flush()
    return Page(blocks, runs)


NAMES = (
    "heading paragraph item list division section article main nav header footer aside form table cell quote figure preformatted embedded depth hidden token_low token_high above_low above_high in_nav in_header in_footer "
    "in_aside in_form in_article in_list log_chars link_share words_per_run stops_per_word runs blocks chars_per_block children position sibling_index siblings same_siblings sibling_chars parent_chars parent_links loose loose_share article_share".split()
)
AT = {name: i for i, name in enumerate(NAMES)}
_KIND = {"p": "paragraph", "li": "item", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "div": "division", "section": "section", "article": "article", "main": "main", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside"}
_KIND |= {"form": "form", "fieldset": "form", "table": "table", "td": "cell", "th": "cell", "blockquote": "quote", "figure": "figure", "figcaption": "figure", "pre": "preformatted"} | {f"h{k}": "heading" for k in range(1, 7)} | dict.fromkeys(EMBEDDED, "embedded")
_ABOVE = {"nav": "in_nav", "header": "in_header", "footer": "in_footer", "aside": "in_aside", "form": "in_form", "article": "in_article", "main": "in_article", "ul": "in_list", "ol": "in_list", "dl": "in_list", "menu": "in_list"}


def features(page: Page, odds: np.ndarray) -> np.ndarray:
    """A row for each block: what it is, how its attribute tokens speak (odds: learned, by token), where it stands, and the density of its subtree beside its siblings'."""
    blocks = page.blocks
    n = len(blocks)
    own = np.array([(b.chars, b.links, b.words, b.stops, b.runs, 1) for b in blocks], np.float64)
    before = np.cumsum(own[:, 0]) - own[:, 0]
    total = max(1.0, own[:, 0].sum())
    tree = own.copy()
    for i in range(n - 1, 0, -1):
        tree[blocks[i].parent] += tree[i]
    out = np.zeros((n, len(NAMES)))
    out[:, AT["loose_share"]] = sum(b.chars for b in blocks if b.tag == LOOSE) / total
    out[:, AT["article_share"]] = max((tree[i, 0] for i, b in enumerate(blocks) if b.tag in ("article", "main")), default=0) / total
    low, high, above, first_in, dense = AT["token_low"], AT["token_high"], slice(AT["above_low"], AT["in_list"] + 1), AT["above_low"], slice(AT["log_chars"], AT["children"] + 1)
    for i, b in enumerate(blocks):
        f = out[i]
        if (kind := _KIND.get(b.tag)) is not None:
            f[AT[kind]] = 1
        if b.tokens:
            told = odds[b.tokens]
            f[low], f[high] = min(0.0, told.min()), max(0.0, told.max())
        chars, links, words, stops, runs, count = tree[i]
        f[AT["depth"]], f[AT["hidden"]], f[AT["position"]], f[AT["loose"]] = min(b.depth, 30), b.hidden, before[i] / total, b.tag == LOOSE
        f[dense] = np.log1p(chars), links / max(1, chars), words / max(1, runs), stops / max(1, words), runs, count, chars / count, len(b.children)
        f[AT["siblings"]] = 1
        if i:
            mother, m, many = out[b.parent], tree[b.parent], len(blocks[b.parent].children)
            f[above] = mother[above]
            f[first_in], f[first_in + 1] = min(f[first_in], mother[low]), max(f[first_in + 1], mother[high])
            if (k := _ABOVE.get(blocks[b.parent].tag)) is not None:
                f[AT[k]] = 1
            f[AT["siblings"]] = many
            f[AT["sibling_chars"]], f[AT["parent_chars"]], f[AT["parent_links"]] = np.log1p((m[0] - chars) / max(1, many - 1)), np.log1p(m[0]), m[1] / max(1, m[0])
    for b in blocks:
        tags = Counter(blocks[c].tag for c in b.children)
        for k, c in enumerate(b.children):
            out[c, AT["sibling_index"]], out[c, AT["same_siblings"]] = k / len(b.children), tags[blocks[c].tag] / len(b.children)
    return out
