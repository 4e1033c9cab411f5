"""Personal data in texts: strict patterns, and candidates that boosted trees judge.

Generators of high recall propose spans that may overlap: windows over the groups of every chain of digits as phone and card,
colon-separated and defanged addresses, at-signs in any spelling. Trees see a candidate's format and the words around it; a kind's threshold is the least
score from which held-out samples are nearly all right. Of candidates that overlap the best one stays, and none that overlaps a strict match
(but for an address in which a strict one is only a part, as where letters beyond ASCII come before it).
"""

from __future__ import annotations

import bisect
import functools
import ipaddress
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewire.llm.boosting import BoostedTrees
from sedgewire.llm.common import in_batches, map_arrow, without_columns
from sedgewire.llm.pii_samples import luhn_digit, sample_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# The strict patterns, written so that no text takes more than linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def passes_luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def _only_digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _byte(part: str) -> bool:
    """Whether a run of ASCII digits is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def strict_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the strict patterns by kind, leftmost first; a match that fails its test is dropped and not tried again."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _only_digits(m[0])) <= 19 and passes_luhn(d)]
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    left: int = 0  # digit groups of the same chain (parts of the address) before and behind it
    right: int = 0
    middle: int = 0  # where an address's at-sign begins


_CHAIN = re.compile(r"\(?[0-9](?:[0-9]|[\x20 ._/()-]{1,3}(?=[0-9(])|[)](?=[\x20-]?[0-9]))*")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"(?i)[\x20]?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20(?:at|arroba|arobase)\x20|[_-]at[_-]|\x20?[@＠]\x20?")
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20(?:dot|punto|punkt|point)\x20|[_-]dot[_-]|\x20\.\x20|\.)"
_NAME = r"[^\W_](?:[\w%+-]*[^\W_])?"
_DOMAINS = re.compile(rf"(?i)(?:(?!dot[_-])[^\W_](?:(?![_-]dot[_-])[\w-]){{0,62}}){_DOT}(?:[^\W_](?:(?![_-]dot[_-])[\w-]){{0,62}}{_DOT}){{0,4}}[^\W\d_]{{2,24}}(?![\w])")
_BEFORE_AT = re.compile(r"[\w.%+-]{1,64}\Z")
_LONGER = re.compile(rf"(?i)[\w.%+-]{{1,64}}(?:{_DOT})\Z")
_LABEL_END = re.compile(rf"(?i)(?<=[^\W\d_]{{2}})(?={_DOT}|\Z)")
_PARTS = re.compile(r"(?i)(?<![\w.])[0-9]{1,3}(?:(?:\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?|\x20dot\x20|\x20\.\x20)[0-9]{1,3}){3}(?![\w])")
_COLONS = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:)|(?<=:):){2,8}(?:[0-9A-Fa-f]{1,4})?(?![\w:])")


def _chain_candidates(text: str) -> Iterator[Candidate]:
    for chain in _CHAIN.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        groups = [m.span() for m in _GROUP.finditer(text, chain.start(), chain.end())]
        for i, (start, _) in enumerate(groups):
            opened = start > chain.start() and text[start - 1] == "("
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                begin = start - 1 if opened and ")" in text[start : groups[j][1]] else start
                if 7 <= digits <= 15:
                    yield Candidate("phone", begin, groups[j][1], i, len(groups) - 1 - j)
                if digits >= 13:
                    yield Candidate("card", start, groups[j][1], i, len(groups) - 1 - j)


def candidates(text: str) -> Iterator[Candidate]:
    """Spans that may be personal data: they overlap, and most aren't."""
    if _DIGIT.search(text):
        yield from _chain_candidates(text)
        for m in _PARTS.finditer(text):
            yield Candidate("ip", m.start(), m.end())
    if ":" in text:
        for m in _COLONS.finditer(text):
            yield Candidate("ip", m.start(), m.end())
    low = "@" in text or "＠" in text or "at" in text or "AT" in text or "arroba" in text or "arobase" in text
    if low and (_DOT_WORD.search(text) or "@" in text or "＠" in text or _BRACKET_AT.search(text)):
        for m in _AT.finditer(text):
            if (local := _BEFORE_AT.search(text, max(0, m.start() - 64), m.start())) and (domain := _DOMAINS.match(text, m.end())):
                starts = [local.start()]
                while len(starts) < 3 and (more := _LONGER.search(text, max(0, starts[-1] - 72), starts[-1])):
                    starts.append(more.start())
                ends = [domain.start() + e.start() for e in _LABEL_END.finditer(domain[0]) if _DOMAINS.fullmatch(domain[0], 0, e.start())]
                for i, start in enumerate(starts):
                    for j, end in enumerate(ends):
                        yield Candidate("email", start, end, len(starts) - 1 - i, len(ends) - 1 - j, m.start())


_DOT_WORD = re.compile(r"(?i)[\x20_\[({-](?:dot|punto|punkt|point)[\x20_\])}-]")
_SPELLED = re.compile(r"(?i)[\x20_\[({-](?:dot|punto|punkt|point|\.)[\x20_\])}-]")
_BRACKET_AT = re.compile(r"(?i)[\[({<]\x20?at\x20?[\])}>]")

#: Slots for hashed words of the context, for each kind.
_SLOTS = 2048
_NEAR = re.compile(r"[^\W\d_]{2,20}(?:-[^\W\d_]{2,20})?")


def context_words(text: str, c: Candidate) -> list[int]:
    """Slots of the words just before and behind a candidate, those before and those behind apart."""
    before = _NEAR.findall(text, max(0, c.start - 40), c.start)[-3:]
    behind = _NEAR.findall(text, c.end, min(len(text), c.end + 24))[:2]
    return [zlib.crc32((side + w.lower()).encode()) % _SLOTS for side, words in (("<", before), (">", behind)) for w in words]


NAMES = (
    "email ip card phone chars digits groups first second last longest space hyphen dot bracket slash kinds repeats luhn lead two fours zero double_zero left right before_letter before_digit before_money before_sign before_point "
    "behind_letter behind_digit behind_percent behind_point letters upper foreign at_sign at_bracket at_word dot_word dot_bracket labels end_length bytes double_colon colons valid_six hex_letters wide_gap north local_spelled domain_spelled low high".split()
)
AT = {name: i for i, name in enumerate(NAMES)}
_SIX = re.compile(r"[0-9A-Fa-f:]+")


def _valid_six(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def features(text: str, c: Candidate, odds: np.ndarray) -> list[float]:
    """The row of a candidate: its format, its neighbours and what the words around it say (odds: learned, by kind and slot)."""
    value = text[c.start : c.end]
    groups = _GROUP.findall(value)
    digits = "".join(groups)
    seps = [ch for ch in value if ch in "  -._/()[]{}"]
    before, behind = text[c.start - 1 : c.start] or " ", text[c.end : c.end + 1] or " "
    further = text[c.end + 1 : c.end + 2]
    letters = sum(map(str.isalpha, value))
    low = value.lower()
    kind = KINDS.index(c.kind)
    said = odds[kind][context_words(text, c)]
    email, six = kind == 0, kind == 1 and ":" in value
    sizes = list(map(len, groups)) or [0]
    return [
        *(float(kind == k) for k in range(4)), len(value), len(digits), len(groups), sizes[0], sizes[1] if len(sizes) > 1 else 0, sizes[-1], max(sizes),
        " " in value or " " in value, "-" in value, "." in value, "(" in value or "[" in value or "{" in value, "/" in value or "_" in value, len(set(seps)), len(seps) / max(1, len(groups)),
        kind == 2 and passes_luhn(digits), int(digits[0]) if digits else -1, int(digits[:2]) if digits else -1, kind == 2 and all(s == 4 for s in sizes[:-1]), digits[:1] == "0", digits[:2] == "00", c.left, c.right,
        before.isalpha(), before.isdigit(), before in "$€£", before in "#=:@&%", before in ".-/+,", behind.isalpha() or behind == "_", behind.isdigit() or (behind in ".,-/" and further.isdigit()), behind in "%°$€", behind == ":" or behind == "@", letters, sum(map(str.isupper, value)), not value.isascii(),
        email and ("@" in value or "＠" in value), email and re.search(r"[\[({<]\s?(?:at|@)", low) is not None, email and re.search(r"[\s_-](?:at|arroba|arobase)[\s_-]", low) is not None, re.search(r"[\s_-](?:dot|punto|punkt|point)[\s_-]", low) is not None, re.search(r"[\[({]\s?(?:dot|\.)", low) is not None,
        email and low.count(".") + low.count("dot"), email and len(re.split(r"[^\w]", low)[-1]), kind == 1 and not six and all(map(_byte, groups)), six and "::" in value, six and value.count(":"), six and _valid_six(value), six and sum(ch in "abcdefABCDEF" for ch in value), "  " in value or " - " in value,
        kind == 3 and len(digits) in (10, 11) and sizes[-3:] == [3, 3, 4] and groups[-3][0] not in "01", email and _SPELLED.search(text, c.start, c.middle) is not None, email and _SPELLED.search(text, c.middle + 1, c.end) is not None, min(0.0, said.min(initial=0)), max(0.0, said.max(initial=0)),
    ]


def _overlaps(spans: list[Span], start: int, end: int) -> bool:
    """Whether one of these spans, which are in order and apart, overlaps."""
    at = bisect.bisect_left(spans, (end,))
    return at > 0 and spans[at - 1][1] > start


def _open(strict: dict[str, list[Span]], c: Candidate) -> bool:
    """Whether a candidate overlaps no strict match, or is an address that goes on where a strict one within it stops."""
    own = strict["email"] if c.kind == "email" else []
    at = bisect.bisect_left(own, (c.start,))
    wider = at < len(own) and own[at][1] <= c.end and (at + 1 == len(own) or own[at + 1][0] >= c.end) and own[at] != (c.start, c.end) and not (at and own[at - 1][1] > c.start)
    return not any(_overlaps(strict[k], c.start, c.end) for k in KINDS if not (wider and k == "email"))


def chosen(text: str, strict: dict[str, list[Span]], model: Model, most: int = 20_000) -> list[tuple[str, int, int, float]]:
    """The candidates that reach their kind's threshold, the best of overlapping ones, none that overlaps a strict match (see _open). Judged in parts of `most`, so that memory follows what is found."""
    good: list[tuple[float, int, int, str]] = []
    part: list[Candidate] = []

    def judge() -> None:
        if part:
            scores = model.trees.logits(np.array([features(text, c, model.odds) for c in part], np.float64))
            good.extend((s, c.start, c.end, c.kind) for s, c in zip(scores.tolist(), part, strict=True) if s >= model.threshold[c.kind])
            part.clear()

    for c in candidates(text):
        if _open(strict, c):
            part.append(c)
            if len(part) >= most:
                judge()
    judge()
    kept: dict[str, list[Span]] = {k: [] for k in KINDS}
    out = []
    for score, start, end, kind in sorted(good, key=lambda x: (-x[0], x[1], -x[2])):
        if not any(_overlaps(kept[k], start, end) for k in KINDS):
            bisect.insort(kept[kind], (start, end))
            out.append((kind, start, end, 1 / (1 + float(np.exp(-score)))))
    return out


@dataclass
class Model:
    trees: BoostedTrees
    odds: np.ndarray
    threshold: dict[str, float]


def _table(samples: list, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    rows, right, kinds = [], [], []
    for text, spans in samples:
        strict, truth = strict_spans(text), set(spans)
        for c in candidates(text):
            if _open(strict, c):
                rows.append(features(text, c, odds))
                right.append((c.kind, c.start, c.end) in truth)
                kinds.append(c.kind)
    return np.array(rows, np.float64), np.array(right), kinds


@functools.lru_cache(maxsize=2)
def fitted(texts: int = 3000, seed: int = 5, precision: float = 0.98) -> Model:
    """The model; made anew in each driver, the same each time. A third of the samples teaches the context words, a third the trees, and on a third each kind gets the least
    threshold from which on `precision` of the candidates are right (a probability of 0.7 at least)."""
    samples = sample_texts(texts, seed)
    seen = np.zeros((2, len(KINDS), _SLOTS))
    for text, spans in samples[::3]:
        truth = set(spans)
        said = {(int((c.kind, c.start, c.end) in truth), KINDS.index(c.kind), w) for c in candidates(text) for w in context_words(text, c)}
        for key in said:
            seen[key] += 1
    odds = np.log(seen[1] + 0.5) - np.log(seen[0] + 0.5)
    x, y, _ = _table(samples[1::3], odds)
    trees = BoostedTrees(x, y.astype(float), np.ones(len(y)), trees=60, depth=4, rate=0.3)
    x, y, kinds = _table(samples[2::3], odds)
    scores, threshold = trees.logits(x), {}
    for kind in KINDS:
        own = np.array([k == kind for k in kinds])
        order = np.argsort(-scores[own])
        s, share = scores[own][order], np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        enough = np.flatnonzero(share >= precision)
        threshold[kind] = max(float(np.log(0.7 / 0.3)), float(s[enough[-1]]) if len(enough) else np.inf)
    return Model(trees, odds, threshold)


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))


def spans_of(text: str, model: Model) -> list[dict]:
    """All spans of a text by kind as listed, then start: strict ones (base, score 1) and the chosen candidates."""
    strict = strict_spans(text)
    all_ = [(k, s, e, True, 1.0) for k in KINDS for s, e in strict[k]] + [(k, s, e, False, p) for k, s, e, p in chosen(text, strict, model)]
    all_.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    return [dict(zip(("kind", "start", "end", "base", "score"), x, strict=True)) for x in all_]


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _find_batch(batch: pa.RecordBatch, model: Model, redact: bool) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    found = [spans_of(t or "", model) for t in texts]
    if redact:
        batch = batch.set_column(batch.column_names.index("text"), "text", pa.array([t if t is None else redacted(t, s) for t, s in zip(texts, found, strict=True)], pa.string()))
    return batch.append_column("spans", pa.array(found, _ARROW))


def find(docs: DataFrame, redact: bool = False) -> DataFrame:
    """docs with spans: arrays of (kind, start, end, base, score) in code points, end exclusive, over the whole text; with `redact` text has each replaced by its kind.

    A null or empty text has none (and stays null or empty). A column of docs named spans is replaced; repeated rows repeat; an empty table gives an empty result.
    """
    docs = without_columns(docs, "spans")
    shared = docs.sparkSession.sparkContext.broadcast(fitted())
    shape = T.StructType([*docs.schema.fields, T.StructField("spans", _SPANS)])
    return map_arrow(docs, lambda it: in_batches(lambda b: _find_batch(b, shared.value, redact), it), shape)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, a row for each row of docs: counts by kind and digest of the strict spans, all spans as text, and n_added, how many the trees added. Other columns are ignored."""
    found = find(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))
