"""Ranked lexical search by a threshold-seeded join.

The documents' terms meet the items' terms in a table of a row for each document (its length, and the items' terms in it
with their frequencies). From it come, for each term, its weight, its largest impact and its k-th largest one. At least k
documents score an item's k-th impact of any one term, so the greatest of those bounds the item's k-th score from below.
Terms whose largest impacts together stay under that bound bring no document in by themselves: documents with another
term are the candidates, those that the pruned terms can't lift to the bound go, and the rest get all their terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedgewire.llm.common import hash_spans, in_batches, written
from sedgewire.llm.terms import terms_of

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLOTS = 1 << 20
_PARTS = 64


def term_list(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(f"({_TERM})"), 1)


class Vocabulary:
    """Terms by code, found in texts by a table of hash bits, a sorted list of hashes and a comparison of the bytes."""

    def __init__(self, terms: list[str]) -> None:
        raw = [t.encode() for t in terms]
        ends = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes = hash_spans(data, ends[:-1], ends[1:])
        order = np.argsort(hashes, kind="stable")
        self.size, self.data, self.starts, self.lengths = len(raw), data, ends[:-1][order], (ends[1:] - ends[:-1])[order]
        self.hashes, self.code = hashes[order], order.astype(np.int32)
        self.alike = int(np.unique(hashes, return_counts=True)[1].max()) if len(raw) else 0
        self.table = np.zeros(_SLOTS, bool)
        self.table[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)] = True

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which spans are terms of the vocabulary, their codes)"""
        hashes = hash_spans(data, starts, ends)
        near = np.flatnonzero(self.table[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)]) if len(hashes) else np.zeros(0, np.int64)
        place = np.searchsorted(self.hashes, hashes[near])
        spans, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k in range(self.alike):
            at = np.minimum(place + k, self.size - 1)
            same = (place + k < self.size) & (self.hashes[at] == hashes[near]) & (self.lengths[at] == ends[near] - starts[near])
            span, at = near[same], at[same]
            if len(span):
                length = self.lengths[at]
                firsts = np.cumsum(length) - length
                inside = np.arange(int(length.sum())) - np.repeat(firsts, length)
                equal = np.logical_and.reduceat(data[np.repeat(starts[span], length) + inside] == self.data[np.repeat(self.starts[at], length) + inside], firsts)
                spans.append(span[equal])
                codes.append(self.code[at[equal]])
        return np.concatenate(spans), np.concatenate(codes)


def _index_batch(batch: pa.RecordBatch, vocabulary: Vocabulary) -> pa.RecordBatch:
    rows, size = batch.num_rows, max(1, vocabulary.size)
    n, keys = np.zeros(rows, np.int64), [np.zeros(0, np.int64)]
    for t in terms_of(batch.column("text")):
        n += np.bincount(t.row, minlength=rows)
        span, code = vocabulary.find(t.data, t.starts, t.ends)
        keys.append(t.row[span] * size + code)
    key, tf = np.unique(np.concatenate(keys), return_counts=True)
    offsets = pa.array(np.searchsorted(key, np.arange(rows + 1) * size).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key % size, tf)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "codes", "tfs"])


@dataclass
class Impacts:
    """What a term brings to a document's score, in 64-bit integers."""

    documents: int
    length: int
    weight: np.ndarray

    def of(self, code: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * n * self.documents) // max(1, self.length)
        return self.weight[code] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _postings(batch: pa.RecordBatch, impacts: Impacts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, impact) of a batch of the index."""
    lists = batch.column("codes")
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    code = lists.flatten().to_numpy(zero_copy_only=False)
    tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = batch.column("n").to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int64)
    return row, code, impacts.of(code, tf, n)


def _best(group: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each group."""
    order = np.lexsort((-value, group))
    g = group[order]
    first = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return order[rank < k]


def _top_impacts(batches: Iterator[pa.RecordBatch], impacts: Impacts, k: int) -> Iterator[pa.RecordBatch]:
    """(code, impact): the k largest impacts of each term in this part of the index."""
    codes, values = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            _, code, value = _postings(batch.slice(at, 4096), impacts)
            codes, values = np.concatenate([codes, code]), np.concatenate([values, value])
            best = _best(codes, values, k)
            codes, values = codes[best], values[best]
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(values)], names=["code", "impact"])


def _top_rows(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """rows with their rank in each group, the first k of each: parts of a group are cut to k rows before they meet, in two rounds, so that no task gets a row set that grows with the input."""
    salted = rows.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(_PARTS)))
    some = salted.withColumn("rank", F.row_number().over(W.partitionBy(group, "__part").orderBy(*order))).where(F.col("rank") <= k).drop("rank", "__part")
    return some.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


class Plan:
    """The items of a block with their thresholds: which terms bring candidates in (essential), and what the others can add at most."""

    def __init__(self, ids: pa.Array, item: np.ndarray, code: np.ndarray, repeats: np.ndarray, top: np.ndarray, kth: np.ndarray, impacts: Impacts, k: int) -> None:
        self.ids, self.k, self.impacts = ids, k, impacts
        most = repeats * top[code]
        self.threshold = np.zeros(len(ids), np.int64)
        np.maximum.at(self.threshold, item, repeats * kth[code])
        order = np.lexsort((most, item))
        item, code, repeats, most = item[order], code[order], repeats[order], most[order]
        upto = np.cumsum(most)
        first = np.searchsorted(item, np.arange(len(ids)))
        upto -= np.concatenate([[0], upto])[first][item]  # sums of the smallest bounds of each item
        pruned = upto < self.threshold[item]
        self.rest = np.zeros(len(ids), np.int64)
        np.add.at(self.rest, item[pruned], most[pruned])
        self.pruned = int(pruned.sum())
        self.essential = self._by_code(item[~pruned], code[~pruned], repeats[~pruned], len(top))
        self.others = self._by_code(item[pruned], code[pruned], repeats[pruned], len(top))

    @staticmethod
    def _by_code(item: np.ndarray, code: np.ndarray, repeats: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(code, kind="stable")
        return np.searchsorted(code[order], np.arange(terms + 1)), item[order], repeats[order]


def _pairs(side: tuple[np.ndarray, np.ndarray, np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posting, item, repeats) of the postings with these codes."""
    offsets, items, repeats = side
    many = offsets[code + 1] - offsets[code]
    posting = np.repeat(np.arange(len(code)), many)
    at = np.repeat(offsets[code] - (np.cumsum(many) - many), many) + np.arange(len(posting))
    return posting, items[at], repeats[at]


def _search(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """(item_id, doc_id, score): the best k documents of this part of the index for each item, as far as they reach its threshold."""
    items, k = len(plan.ids), plan.k
    if not items:
        return
    threshold = plan.threshold.copy()
    docs = max(1, min(4096, (1 << 21) // max(1, items)))
    best: pa.Table | None = None
    waiting: list[pa.Table] = []
    many = 0

    def reduced() -> pa.Table:
        """The best k of each item of what waits; its k-th score is a threshold for the rest of this part."""
        table = pa.concat_tables([*([best] if best is not None else []), *waiting])
        table = table.take(pc.sort_indices(table, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
        item = table.column("item").to_numpy()
        first = np.searchsorted(item, np.arange(items))
        rank = np.arange(len(item)) - first[item]
        full = np.flatnonzero(rank == k - 1)
        np.maximum.at(threshold, item[full], table.column("score").to_numpy()[full])
        return table.filter(pa.array(rank < k))

    for whole in batches:
        for at in range(0, whole.num_rows, docs):
            batch = whole.slice(at, docs)
            row, code, impact = _postings(batch, plan.impacts)
            score = np.zeros(batch.num_rows * items, np.int64)
            posting, item, repeats = _pairs(plan.essential, code)
            np.add.at(score, row[posting] * items + item, impact[posting] * repeats)
            near = score > 0
            near &= (score.reshape(-1, items) + plan.rest >= threshold).ravel()
            posting, item, repeats = _pairs(plan.others, code)
            cell = row[posting] * items + item
            meant = near[cell]
            np.add.at(score, cell[meant], (impact[posting] * repeats)[meant])
            found = np.flatnonzero(near)
            found = found[score[found] >= threshold[found % items]]
            waiting.append(pa.table({"item": found % items, "score": score[found], "doc_id": batch.column("doc_id").take(pa.array(found // items))}))
            many += len(found)
            if many > max(200_000, 2 * k * items):
                best, waiting, many = reduced(), [], 0
    if waiting or best is not None:
        best = reduced()
        out = pa.RecordBatch.from_arrays([plan.ids.take(best.column("item").combine_chunks()), best.column("doc_id").combine_chunks(), best.column("score").combine_chunks()], names=["item_id", "doc_id", "score"])
        yield out


def _block(docs: DataFrame, pairs: DataFrame, id_type: T.DataType, k: int) -> DataFrame:
    """The search for one block of items, whose (item_id, term, repeats) fit the driver and each task."""
    context = docs.sparkSession.sparkContext
    known = pairs.toArrow()
    ids = known.column("item_id").combine_chunks().dictionary_encode()
    terms = known.column("term").combine_chunks().dictionary_encode()
    item, code = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, terms))
    repeats = known.column("repeats").to_numpy().astype(np.int64)
    vocabulary = context.broadcast(Vocabulary(terms.dictionary.to_pylist()))
    doc_id = docs.schema["doc_id"]
    shape = T.StructType([doc_id, T.StructField("n", T.LongType()), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    index = written(docs.select("doc_id", "text").mapInArrow(lambda it: in_batches(lambda b: _index_batch(b, vocabulary.value), it), shape))
    total = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(terms.dictionary), np.int64)
    for r in index.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect():  # a row a term of the block
        df[r.code] = r.df
    weight = np.floor(1000 * np.log((2.0 * total.documents + 2) / (2.0 * df + 1))).astype(np.int64)
    impacts = Impacts(total.documents, total.length, weight)
    shared = context.broadcast(impacts)
    tops = index.mapInArrow(lambda it: _top_impacts(it, shared.value, k), "code int, impact long")
    top, kth = np.zeros_like(df), np.zeros_like(df)
    for r in _top_rows(tops, "code", [F.desc("impact")], k).where(F.col("rank").isin(1, k)).collect():  # two rows a term at most
        if r["rank"] == 1:
            top[r.code] = r.impact
        if r["rank"] == k:
            kth[r.code] = r.impact
    plan = context.broadcast(Plan(ids.dictionary, item, code, repeats, top, kth, impacts, k))
    shape = T.StructType([T.StructField("item_id", id_type), doc_id, T.StructField("score", T.LongType())])
    return index.mapInArrow(lambda it: _search(it, plan.value), shape)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = 1_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text) by the contract's score; fewer if fewer score above 0.

    Items go in blocks of about `block` (item, term) pairs, each with its own pass over the documents; what tasks hold of the items
    is bounded by a block (and by the largest item). Equal scores rank by ascending doc_id, null first. Null and empty texts have no terms: such documents
    are in no result and not in N, such items have no rows. Rows of an item that repeat count once; different texts of one id are one item.
    Rows of documents that repeat an id rank each for itself. An empty table of either gives an empty result. Other columns are ignored.
    """
    pairs = items.select("item_id", "text").distinct().select("item_id", F.explode(term_list(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("repeats"))
    pairs = written(pairs)
    found, blocks = None, max(1, -(-pairs.count() // block))
    number = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    for b in range(blocks):
        part = _block(docs, pairs.where(number == b), items.schema["item_id"].dataType, k)
        found = part if found is None else found.union(part)
    best = _top_rows(found, "item_id", [F.desc("score"), F.asc("doc_id")], k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
g AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM n),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, big_n),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // l)))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc_id), g GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
