"""Removing every byte that a repeated 200-byte string covers, over the whole corpus.

1. Each window of 200 bytes belongs to an anchor (repeat_anchors.py). Anchors that occur once in the
   corpus are left out: a fixed-size bitmap of the others filters a second pass. A full bitmap would let more
   rows through, never fewer.
2. Occurrences with equal segments are counted by aggregation: if a segment occurs twice, all of its windows do.
   That decides whole copies and the inside of shared passages. A text that occurs twice is decided as a whole.
3. What is left are the edges of shared passages: single segments whose anchor has others. They and one
   occurrence of each other segment of those anchors are fetched, dealt out by anchor, and a run-length
   index over each share (run_length_index.py) gives matching statistics: a window repeats where they reach 200.
4. The segments of an anchor that has more than `group` are dealt out finer: cut in two by the windows' distance to the anchor, with
   what those windows have in common as their new anchor, as often as it takes; the index marks them too. At the finest cut a group is one window.
Rows are told apart by 128 bits of hash of the text, so equal texts get equal results and no row needs an id.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import arrow_bytes, checkpointed, in_batches, with_fields, without_columns, written
from sedgewire.llm.repeat_anchors import PIECE, anchors, halves
from sedgewire.llm.run_length_index import build

#: Bits of the anchor bitmap; 16 MB whatever the corpus.
_BITMAP = 1 << 27
_BUCKET = 1 << 15


def _anchor_column(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    data, offsets = arrow_bytes(batch.column("text"))
    found = [anchors(data[a:b], window)[0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["anchor"])


def _bit(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(37)).astype(np.int64)


def _occurrences(batch: pa.RecordBatch, window: int, bitmap: np.ndarray) -> pa.RecordBatch:
    data, offsets = arrow_bytes(batch.column("text"))
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    counts = np.zeros(batch.num_rows, np.int64)
    for i in range(batch.num_rows):
        parts = anchors(data[offsets[i] : offsets[i + 1]], window)
        bit = _bit(parts[0])
        keep = (bitmap[bit >> 3] >> (bit & 7) & 1).astype(bool)
        counts[i] = keep.sum()
        for column, part in zip(columns, parts, strict=True):
            column.append(part[keep])
    own = pa.array(np.repeat(np.arange(batch.num_rows), counts))
    anchor, segment, start, n, offset = (np.concatenate(c) for c in columns)
    hashes = [pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), batch.column("text_key").take(own), batch.column("text_check").take(own)]
    return pa.RecordBatch.from_arrays([*hashes, pa.array(start), pa.array(n.astype(np.int32)), pa.array(offset.astype(np.int32))], names=["anchor", "segment", "text_key", "text_check", "start", "n", "offset"])


_PIECES = [("key", pa.int64()), ("content", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("offset", pa.int32()), ("text_key", pa.int64()), ("text_check", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("single", pa.bool_()), ("hot", pa.bool_()), ("bytes", pa.binary())]
_PIECES_DDL = "key long, content binary, low int, high int, offset int, text_key long, text_check long, start long, n int, single boolean, hot boolean, bytes binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_PIECES)], names=[name for name, _ in _PIECES])


def _fetch(batch: pa.RecordBatch, window: int, seen: set[tuple[int, int]]) -> pa.RecordBatch:
    """The wanted segments of each text that this task hasn't met: copies of a text come to one task, or to a few if Spark splits them."""
    data, offsets = arrow_bytes(batch.column("text"))
    rows = []
    for i, wanted in enumerate(batch.column("wanted").to_pylist()):
        key = (batch.column("text_key")[i].as_py(), batch.column("text_check")[i].as_py())
        if key in seen:
            continue
        seen.add(key)
        text = data[offsets[i] : offsets[i + 1]]
        for w in wanted:
            raw = text[w["start"] : w["start"] + w["n"] + window - 1].tobytes()
            rows.append((w["anchor"], w["segment"].to_bytes(8, "little", signed=True), 0, window - PIECE, w["offset"], *key, w["start"], w["n"], w["single"], w["hot"], raw))
    return _pieces(rows)


def _halve(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Both halves of each piece, dealt by what their windows have in common and where."""
    rows = []
    for r in batch.to_pylist():
        for low, high, core, first, n, offset, raw in halves(r["bytes"], r["n"], r["offset"], r["low"], r["high"], window):
            key = xxhash.xxh3_64_intdigest(core, seed=low << 16 | high) - (1 << 63)
            rows.append((key, xxhash.xxh3_128_digest(raw), low, high, offset, r["text_key"], r["text_check"], r["start"] + first, n, r["single"], True, raw))
    return _pieces(rows)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def _share(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Repeated starts of the single pieces of one share."""
    pdf = pdf.drop_duplicates(["key", "content"])
    index = build(pdf["bytes"].tolist())
    repeated = index.matching() >= window
    out = []
    for begin, key, check, start, n, single in zip(index.starts.tolist(), pdf["text_key"], pdf["text_check"], pdf["start"], pdf["n"], pdf["single"], strict=True):
        if single:
            out.extend((key, check, start + a, b - a) for a, b in _runs(repeated[begin : begin + n]))
    return pd.DataFrame(out, columns=["text_key", "text_check", "start", "n"]).astype({"text_key": "int64", "text_check": "int64", "start": "int64", "n": "int32"})


_MARKS = "text_key long, text_check long, start long, n int"


def _indexed(pieces: DataFrame, window: int, share: int) -> DataFrame:
    """Marks of the single pieces, by indexes over shares of about so many pieces; the pieces of a key are in one share."""
    shares = max(1, pieces.count() // share)
    return pieces.groupBy(F.pmod(F.xxhash64("key"), F.lit(shares)).alias("share")).applyInPandas(lambda pdf: _share(pdf, window), _MARKS)


def _finer(pieces: DataFrame, window: int, group: int, share: int) -> DataFrame:
    """Marks of pieces whose key has too many of them for one share: halves, dealt by what each half's windows have in common, until few are left or equal ones only."""
    marks = None
    while not pieces.isEmpty():
        cut = written(pieces.mapInArrow(lambda it: in_batches(lambda b: _halve(b, window), it), _PIECES_DDL))
        rest = [F.first(c).alias(c) for c in ("low", "high", "offset", "text_key", "text_check", "start", "n", "hot", "bytes")]
        distinct = cut.groupBy("key", "content").agg(F.count("*").alias("times"), F.every("single").alias("alone"), *rest)
        distinct = checkpointed(distinct.withColumn("single", (F.col("times") == 1) & F.col("alone")))
        keys = distinct.groupBy("key").agg(F.count("*").alias("pieces"), F.some("single").alias("open")).where("open and pieces > 1")
        repeated = distinct.where("not single").select("key", "content")
        found = cut.where("single").join(repeated, ["key", "content"], "left_semi").select("text_key", "text_check", "start", "n")
        left = distinct.join(keys, "key").select(*[c for c, _ in _PIECES], "pieces")
        small = left.where(F.col("pieces") <= group).drop("pieces")
        found = checkpointed(found.union(_indexed(small, window, share)))
        marks = found if marks is None else marks.union(found)
        pieces = checkpointed(left.where((F.col("pieces") > group) & (F.col("low") < F.col("high"))).drop("pieces"))
    return marks


def _bitmap(repeated: DataFrame) -> np.ndarray:
    bit = F.shiftrightunsigned("anchor", 37)
    parts = repeated.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(_BUCKET))).alias("bits"))
    out = np.zeros(_BITMAP // 8, np.uint8)
    for bucket, bits in parts.toPandas().itertuples(index=False):
        own = np.frombuffer(bytes(bits), np.uint8)
        out[bucket * (_BUCKET // 8) : bucket * (_BUCKET // 8) + len(own)] = own
    return out


def _text_hashes(text) -> tuple:
    return F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit("text"), text).alias("text_check")


def repeated_marks(docs: DataFrame, window: int = 200, group: int = 2_000, share: int = 2_500) -> DataFrame:
    """(text_key, text_check, start, n, by): n repeated window starts from start on; by: copy (whole text), segment (counted by aggregation) or index.

    Texts go by two xxhash64 of the text (null as empty), 128 bits; a segment by its 64-bit hash among those of its 64-bit anchor.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text"), *_text_hashes(text), F.octet_length(text).alias("n_bytes")).where(F.col("n_bytes") >= window)
    alone = texts.select("text").mapInArrow(lambda it: in_batches(lambda b: _anchor_column(b, window), it), "anchor long")
    again = alone.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    inside = texts.select("text_key", "text_check", "text")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(again))
    occurrences = inside.mapInArrow(lambda it: in_batches(lambda b: _occurrences(b, window, bitmap.value), it), "anchor long, segment long, text_key long, text_check long, start long, n int, offset int")
    occurrences = written(occurrences)

    segments = occurrences.groupBy("segment", "anchor").agg(F.count("*").alias("times"), F.min(F.struct("text_key", "text_check", "start", "n", "offset")).alias("at"))
    segments = checkpointed(segments)
    kinds = segments.groupBy("anchor").agg(F.count("*").alias("segments"), F.count_if(F.col("times") == 1).alias("singles")).where("segments > 1 and singles > 0")
    wanted = segments.join(kinds, "anchor").select("anchor", "segment", "at", (F.col("times") == 1).alias("single"), (F.col("segments") > group).alias("hot"))
    one = F.struct("anchor", "segment", F.col("at.start").alias("start"), F.col("at.n").alias("n"), F.col("at.offset").alias("offset"), "single", "hot")
    wanted = wanted.groupBy(F.col("at.text_key").alias("text_key"), F.col("at.text_check").alias("text_check")).agg(F.collect_list(one).alias("wanted"))
    fetched = inside.join(wanted, ["text_key", "text_check"]).mapInArrow(lambda it: in_batches(partial(_fetch, window=window, seen=set()), it), _PIECES_DDL)
    fetched = written(fetched)
    edges = _indexed(fetched.where("not hot"), window, share)
    if (hot := _finer(fetched.where("hot").dropDuplicates(["key", "content"]), window, group, share)) is not None:
        edges = edges.union(hot)

    names = ("text_key", "text_check", "start", "n")
    decided = occurrences.join(segments.where("times > 1").select("segment", "anchor"), ["segment", "anchor"], "left_semi").select(*names, F.lit("segment").alias("by"))
    copies = texts.groupBy("text_key", "text_check", "n_bytes").agg(F.count("*").alias("times")).where("times > 1")
    whole = copies.select("text_key", "text_check", F.lit(0).cast("long").alias("start"), (F.col("n_bytes") - window + 1).cast("int").alias("n"), F.lit("copy").alias("by"))
    return decided.union(edges.select(*names, F.lit("index"))).union(whole)


def repeated_ranges(docs: DataFrame, window: int = 200, **options) -> DataFrame:
    """(text_key, text_check, ranges): the marks of each text that has any, as an array of (start, n)."""
    return repeated_marks(docs, window, **options).groupBy("text_key", "text_check").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))


_ADDED = "n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    data, offsets = arrow_bytes(batch.column("text"))
    sizes, removed, spans, kept = [], [], [], []
    for i, ranges in enumerate(batch.column("ranges").to_pylist()):
        text = data[offsets[i] : offsets[i + 1]]
        change = np.zeros(len(text) + 1, np.int32)
        if ranges:
            starts = np.array([r["start"] for r in ranges])
            np.add.at(change, starts, 1)
            np.add.at(change, starts + np.array([r["n"] for r in ranges]) + window - 1, -1)
        covered = np.cumsum(change[:-1]) > 0
        sizes.append(len(text))
        removed.append(int(covered.sum()))
        spans.append([{"start": a, "end": b} for a, b in _runs(covered)])
        kept.append(text[~covered].tobytes())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    values = [sizes, removed, [len(s) for s in spans], spans, kept]
    batch = batch.drop_columns(["ranges"])
    for part, kind, name in zip(values, kinds, [x.split()[0] for x in _ADDED.split(", ")], strict=True):
        batch = batch.append_column(name, pa.array(part, kind))
    return batch


def remove_repeats(docs: DataFrame, window: int = 200, **options) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (byte ranges) and kept (the remaining bytes; a span may cut a character in two).

    A byte goes if a string of `window` bytes that covers it also starts anywhere else, in this text or another; equal texts count
    as elsewhere. Null is empty, has nothing to remove, and keeps 0 bytes; so is a text shorter than the window, which keeps all. Repeated rows are copies of each other. An empty
    table gives an empty result. Columns of the added names are replaced.
    """
    names = [x.split()[0] for x in _ADDED.split(", ")]
    docs = without_columns(docs, *names)
    ranges = repeated_ranges(docs, window, **options).alias("r")
    keyed = docs.select(F.struct("*").alias("row"), *_text_hashes(F.coalesce("text", F.lit("")))).alias("k")  # in one column no name can clash
    joined = keyed.join(ranges, (F.col("k.text_key") == F.col("r.text_key")) & (F.col("k.text_check") == F.col("r.text_check")), "left")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    flat = joined.select(*[F.col("k.row")[c].alias("text" if c == "text" else n) for c, n in zip(docs.columns, inner, strict=True)], "ranges")
    ddl = with_fields([f for f in flat.schema if f.name != "ranges"], _ADDED)
    cut = flat.mapInArrow(lambda it: in_batches(lambda b: _cut(b, window), it), ddl)
    return cut.select(*[F.col("text" if c == "text" else n).alias(c) for c, n in zip(docs.columns, inner, strict=True)], *names)
