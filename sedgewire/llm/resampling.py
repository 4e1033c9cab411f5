"""Importance resampling towards a target's distribution of word features, by partition-local word tries.

A piece of a partition's text becomes a trie over its words, three words deep: a node stands for a run of words, and holds
how often it occurs and the CRC state of its text, from which a child's follows. First the nodes' counts are summed into
buckets by CRC, over the corpus and over the target; then the tries are built again, each node gets its bucket's gain, and a
document's weight is the sum of gains on the paths that its words walk.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewire.llm.common import checkpointed, hash_spans, in_batches, map_arrow, without_columns, written
from sedgewire.llm.terms import Terms, terms_of

DEPTH = 3


@functools.lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """Four tables of 256 that carry a CRC over so many bytes of zero: the part that a prefix has in the CRC of a longer text."""
    if length == 0:
        return np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    if length > 1:
        half = _shift(length // 2)
        twice = _carry(half, half.ravel()).reshape(4, 256)
        return _carry(_shift(1), twice.ravel()).reshape(4, 256) if length % 2 else twice
    one = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return one


def _carry(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ tables[3][crc >> np.uint32(24)]


def _continued(state: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC of each text that has this state and goes on with bytes of this CRC and length."""
    out = np.empty_like(state)
    order = np.argsort(length, kind="stable")
    sizes, firsts = np.unique(length[order], return_index=True)
    for size, first, last in zip(sizes, firsts, np.append(firsts, len(order))[1:], strict=True):
        at = order[first:last]
        out[at] = _carry(_shift(int(size)), state[at])
    return out ^ crc


@dataclass
class Trie:
    """The nodes of one piece, level by level: how often each occurs and its CRC state. path[d] has the node of depth d + 1 at each word, -1 where the row's words end before."""

    counts: list[np.ndarray]
    states: list[np.ndarray]
    path: list[np.ndarray]


def trie_of(t: Terms) -> Trie:
    """The trie of a piece; runs begin at its fresh words."""
    words, n = len(t.starts), t.fresh
    hashes = hash_spans(t.data, t.starts, t.ends)
    _, sample, word = np.unique(hashes, return_index=True, return_inverse=True)
    word = word.reshape(-1)
    raw = t.data.tobytes()
    spelled = [raw[a:b] for a, b in zip(t.starts[sample].tolist(), t.ends[sample].tolist(), strict=True)]
    own = np.array([zlib.crc32(s) for s in spelled], np.uint32)
    behind = np.array([zlib.crc32(b" " + s) for s in spelled], np.uint32)
    length = np.array([len(s) + 1 for s in spelled], np.int64)
    node, state = word[:n], own
    counts, states, path = [np.bincount(node, minlength=len(own))], [state], [node]
    at = np.arange(n)
    for d in range(1, DEPTH):
        far = at[at + d < words]
        far = far[t.row[far + d] == t.row[far]]
        edge, sample, child = np.unique(path[-1][far] * len(own) + word[far + d], return_index=True, return_inverse=True)
        last = word[far[sample] + d]
        state = _continued(state[edge // len(own)], behind[last], length[last])
        walked = np.full(n, -1, np.int64)
        walked[far] = child.reshape(-1)
        counts.append(np.bincount(child.reshape(-1), minlength=len(edge)))
        states.append(state)
        path.append(walked)
    return Trie(counts, states, path)


def _bucket_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for t in terms_of(batch.column("text"), overlap=DEPTH - 1):
            trie = trie_of(t)
            for state, count in zip(trie.states, trie.counts, strict=True):
                np.add.at(total, state % np.uint32(buckets), count)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; empty buckets have no row."""
    parts = texts.select("text").mapInArrow(lambda it: _bucket_counts(it, buckets), "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the logarithm of its smoothed share in the target over that in the corpus, rounded down."""
    s, t, buckets = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(batch: pa.RecordBatch, gain: np.ndarray) -> pa.RecordBatch:
    n_words, n, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
    for t in terms_of(batch.column("text"), overlap=DEPTH - 1):
        trie, row = trie_of(t), t.row[: t.fresh]
        np.add.at(n_words, row, 1)
        for state, path in zip(trie.states, trie.path, strict=True):
            walks = path >= 0
            np.add.at(n, row[walks], 1)
            np.add.at(weight, row[walks], gain[state % np.uint32(len(gain))][path[walks]])
    for name, values in (("n_words", n_words), ("n_features", n), ("weight", weight)):
        batch = batch.append_column(name, pa.array(values))
    return batch.drop_columns(["text"])


def weighed(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """docs without text, but with n_words, n_features and weight: the gains of all features of the text towards the target's texts.

    A null or empty text has none and weighs 0; without a target every feature's gain follows from the corpus alone. Columns of the added names are replaced; repeated rows repeat
    (and count as often in the corpus); an empty table gives an empty result. Bucket totals are `buckets` pairs of numbers, whatever the texts.
    """
    docs = without_columns(docs, "n_words", "n_features", "weight")
    totals = [np.zeros(buckets, np.int64) for _ in range(2)]
    for total, texts in zip(totals, (docs, target), strict=True):
        for r in bucket_counts(texts, buckets).collect():  # `buckets` rows at most
            total[r.bucket] = r.n
    gain = docs.sparkSession.sparkContext.broadcast(gains(*totals))
    shape = T.StructType([f for f in docs.schema if f.name.lower() != "text"] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    return map_arrow(docs, lambda it: in_batches(lambda b: _weigh(b, gain.value), it), shape)


def gumbel(doc_id: Column, seed: int = 42) -> Column:
    """A draw of Gumbel's distribution in thousandths, fixed by seed and id (null as empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = 10_000) -> DataFrame:
    """weighed(), with score and rank: of the documents with at least `min_words` words `percent` of a hundred (rounded down) are drawn, the highest scores first, ties to the
    smaller doc_id (null first); rank counts them from 1 and is null for the others.

    The weighed rows are written, as sorting reads them twice, and sorted by range, those that can be drawn first; a row's rank is its place in its range and the lengths of the ranges before. Columns named score and rank are replaced.
    """
    out = without_columns(weighed(docs, target, buckets), "score", "rank")
    out = out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("__can", F.col("n_words") >= min_words)
    placed = checkpointed(written(out).orderBy(F.desc("__can"), F.desc("score"), F.asc("doc_id")).withColumn("__place", F.monotonically_increasing_id()))
    in_range = F.shiftright("__place", 33)
    sizes = {r.part: (r.rows, r.can) for r in placed.groupBy(in_range.alias("part")).agg(F.count("*").alias("rows"), F.count_if("__can").alias("can")).collect()}  # a row a partition
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part][0]
    drawn = percent * sum(can for _, can in sizes.values()) // 100
    firsts = F.broadcast(docs.sparkSession.createDataFrame(starts, "__part long, __before long"))
    rank = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(firsts, in_range == F.col("__part")).withColumn("rank", F.when(rank <= drawn, rank)).drop("__can", "__place", "__part", "__before")
