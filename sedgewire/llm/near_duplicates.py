"""Near-duplicate documents: SuperMinHash, banding, exact verification and grouping.

1. A pass over the texts gives each one's set fingerprint (128 bits of its distinct shingles),
   size, signature and band hashes. Texts with one fingerprint are one node from here on.
2. Nodes that share a band's bucket are candidates. Each is first compared with the bucket's
   least node; the full shingle sets decide (array_intersect in the JVM). A second pass over the
   texts makes the sets, of the candidates alone.
3. In a bucket that still holds several components, the members outside its center's component are
   compared with all members, inside tasks, in blocks, each pair in the first band it shares, on full sets
   again. So no pairs are written and nothing is capped, and the work of a bucket is its size times those outside, not its square.
4. Links are grouped by contraction (components.py).

m = bands * rows slots: with 24 bands of 4 a pair at similarity 0.8 is missed with probability 3e-6, at 0.85 with 2e-8.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import U64, arrow_bytes, bitmap_of, broadcast_if_small, checkpointed, files_for, in_batches, mix64, slices
from sedgewire.llm.components import connected_components
from sedgewire.llm.superminhash import shingle_sets, signatures

_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])
_SKETCH_DDL = "doc_id long, text_key long, node binary, n_shingles long, bands array<long>, signature binary"


def _fingerprints(elements: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    a, b = (np.concatenate([[U64(0)], np.cumsum(mix64(elements ^ U64(seed)), dtype=np.uint64)]) for seed in (0x51ED27, 0xA7C3F1))
    sums = np.stack([a[firsts[1:]] - a[firsts[:-1]], b[firsts[1:]] - b[firsts[:-1]]], axis=1)
    return np.ascontiguousarray(mix64(sums))


def _sketch_batch(batch: pa.RecordBatch, k: int, bands: int, rows: int) -> pa.RecordBatch:
    data, offsets = arrow_bytes(batch.column("text"))
    nodes, sizes, hashes, short = [], [], [], []
    for a, b in slices(offsets):
        elements, firsts = shingle_sets(data, offsets[a : b + 1], k)
        slots = signatures(elements, firsts, bands * rows)
        parts = slots.reshape(b - a, bands, rows)
        h = np.zeros((b - a, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
        for j in range(rows):
            h = mix64(h ^ parts[:, :, j])
        nodes.append(_fingerprints(elements, firsts))
        sizes.append(np.diff(firsts))
        hashes.append(h.view(np.int64))
        short.append((mix64(slots) >> U64(48)).astype(np.uint16))
    n = batch.num_rows
    size = np.concatenate(sizes)
    empty = size == 0
    node = np.concatenate(nodes)
    h = np.concatenate(hashes)
    short = np.concatenate(short)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(h.reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            batch.column("text_key"),
            pa.array([None if e else x.tobytes() for x, e in zip(node, empty, strict=True)], pa.binary()),
            pa.array(size.astype(np.int64)),
            lists,
            pa.array([x.tobytes() for x in short], pa.binary()),
        ],
        schema=_SKETCH,
    )


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """One row per document: doc_id, text_key, node (null if there are no words), n_shingles, bands, signature."""
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    run = partial(_sketch_batch, k=k, bands=bands, rows=rows)
    return source.mapInArrow(lambda it: in_batches(run, it), _SKETCH_DDL)


def _set_batch(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    data, offsets = arrow_bytes(batch.column("text"))
    nodes, parts, ends, at = [], [], [0], 0
    for a, b in slices(offsets):
        elements, firsts = shingle_sets(data, offsets[a : b + 1], k)
        nodes.extend(x.tobytes() for x in _fingerprints(elements, firsts))
        parts.append(elements)
        ends.extend((firsts[1:] + at).tolist())
        at = ends[-1]
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), sets], names=["node", "shingles"])


def full_sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(node, bands, signature, shingles) of the needed nodes (node, bands, signature, source: a document's id and text key).

    Texts don't cross the shuffle. A bitmap of the sources, 32 bits or more for each, tells which texts make their sets where they are read; nodes follow from the sets,
    and a join on them drops the few that only share a bit. From 2^24 sources on the bitmap stays at 64 MB: more texts pass that the join drops, the result is the same.
    """
    key = lambda doc_id, text_key: F.xxhash64(doc_id, text_key).alias("key")
    width = min(29, max(20, needed.count().bit_length() + 5))
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(needed.select(key("source.doc_id", "source.text_key")), "key", width))

    def wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
        bit = (batch.column("key").to_numpy().view(np.uint64) >> U64(64 - width)).astype(np.int64)
        return batch.filter(pa.array((bitmap.value[bit >> 3] >> (bit & 7) & 1).astype(bool)))

    texts = docs.select(key(F.col("doc_id").cast("long"), F.xxhash64("text")), "text")
    made = texts.mapInArrow(lambda it: in_batches(partial(_set_batch, k=k), map(wanted, it)), "node binary, shingles array<long>")
    return made.dropDuplicates(["node"]).join(needed.select("node", "bands", "signature"), "node").select("node", "bands", "signature", "shingles")


def _block_links(pdf: pd.DataFrame, percent: int, margin: float) -> pd.DataFrame:
    """Links between different components, a spanning forest of them: the rows marked left, which are outside the center's component, against those marked member."""
    out: list[tuple[bytes, bytes]] = []
    band = int(pdf["band"].iloc[0])
    nodes, left, member, outside = pdf["node"].tolist(), pdf["left"].to_numpy(), pdf["member"].to_numpy(), pdf["outside"].to_numpy()
    comp = np.unique(np.array([x.hex() for x in pdf["root"]]), return_inverse=True)[1].astype(np.int64)
    order = np.argsort(np.argsort(np.array([x.hex() for x in nodes])))
    sets = [np.sort(np.asarray(x, dtype=np.int64)) for x in pdf["shingles"]]  # only membership matters below
    size = np.array([len(x) for x in sets])
    bands = np.stack([np.asarray(x, dtype=np.int64) for x in pdf["bands"]])
    sig = np.stack([np.frombuffer(x, np.uint16) for x in pdf["signature"]])
    least = percent / 100 - margin
    for i in np.flatnonzero(left):
        others = np.flatnonzero(member & (comp != comp[i]) & (~outside | (order > order[i])))  # two outside meet once
        small, large = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        others = others[100 * small >= percent * large]
        others = others[(bands[others, :band] != bands[i, :band]).all(axis=1)]  # else an earlier band compares the pair
        others = others[(sig[others] == sig[i]).mean(axis=1) >= least]
        for j in others:
            if comp[j] == comp[i]:
                continue
            x, y = sets[i], sets[j]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                out.append((nodes[i], nodes[j]))
                comp[comp == comp[j]] = comp[i]
    return pd.DataFrame(out, columns=["a", "b"], dtype=object)


def near_duplicate_groups(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, block_rows: int = 2048, margin: float = 0.3) -> DataFrame:
    """Per document: doc_id, text_key (xxhash64 of the text), n_shingles, component_id, kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their k-word shingle
    sets (words are lower-cased in ASCII); component_id is the least doc_id reachable. A null or
    empty text has no shingles and is linked with nothing. Repeated rows give repeated results;
    null ids never become a component_id unless the whole group has none, and then are kept. Other
    columns of docs are ignored. margin: pairs in the step inside buckets are compared on full sets
    if their signatures agree on at least percent/100 - margin of the slots (seven standard
    deviations of the estimate at 96 slots).
    """
    files, short = files_for(docs)
    base = checkpointed(sketches(docs, k, bands, rows), files)
    nodes = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "text_key")).alias("source"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = checkpointed(nodes, files)
    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("band", "bucket").agg(F.min("node").alias("center"), F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(members.join(buckets, ["band", "bucket"]), files)
    pairs = shared.where("node <> center").select("node", "center").distinct()

    needed = checkpointed(shared.select("node").distinct().join(nodes, "node").select("node", "bands", "signature", "source"), files)
    sets = checkpointed(full_sets(docs, needed, k), files)

    roots = connected_components(verified(pairs, sets, percent), files=short)
    near = broadcast_if_small(roots)

    named = shared.join(near, "node", "left").select("band", "bucket", "n", shared.node, F.coalesce("root", shared.node).alias("root"))
    same = (F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.reverse(F.hex("node")))).alias("y"))
    mixed = named.groupBy("band", "bucket", "n").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("node").alias("first"), F.min_by("root", "node").alias("main"), *same).where("lo <> hi")
    # a bucket with the very members of one of an earlier band has no pair that it would be the first to compare
    mixed = mixed.groupBy("n", "first", "x", "y").agg(F.min(F.struct("band", "bucket", "main")).alias("b")).select("b.band", "b.bucket", "b.main")
    held = checkpointed(named.join(mixed, ["band", "bucket"]).withColumn("outside", F.col("root") != F.col("main")), files)
    out_blocks = F.ceil(F.col("s") / block_rows).cast("int")
    counts = held.where("outside").groupBy("band", "bucket").agg(F.count("*").alias("s")).select("band", "bucket", out_blocks.alias("sb"))
    all_blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.lit(1)).cast("int")
    split = held.join(counts, ["band", "bucket"]).withColumn("nb", all_blocks).withColumn("mine", F.pmod(F.xxhash64("node"), all_blocks).cast("int"))
    split = split.withColumn("own", F.when(F.col("outside"), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("sb"))).cast("int"))
    against = F.transform(F.sequence(F.lit(0), F.col("sb") - 1), lambda y: F.struct(y.alias("bi"), F.col("mine").alias("bj")))
    from_own = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.struct(F.col("own").alias("bi"), x.alias("bj")))
    split = split.select("*", F.inline(F.when(F.col("outside"), F.array_distinct(F.concat(against, from_own))).otherwise(against)))
    roles = (F.coalesce(F.col("bi") == F.col("own"), F.lit(False)).alias("left"), (F.col("bj") == F.col("mine")).alias("member"))
    split = split.select("band", "bucket", "node", "root", "outside", "bi", "bj", *roles)
    grouped = split.join(sets, "node").groupBy("band", "bucket", "bi", "bj")
    extra = grouped.applyInPandas(lambda pdf: _block_links(pdf, percent, margin), "a binary, b binary")
    extra = checkpointed(extra, files)
    if not extra.isEmpty():
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = connected_components(stars.union(extra), files=short)
        near = broadcast_if_small(roots)

    rooted = nodes.join(near, "node", "left").select(nodes.node, "id", F.coalesce("root", nodes.node).alias("root"))
    least = rooted.where("id is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    component = rooted.join(least, "root", "left").select("node", "component_id")
    out = base.join(component, "node", "left").select("doc_id", "text_key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, center) whose full sets are similar enough, as links (a, b)."""
    slim = sets.select("node", "shingles")
    x, y = F.col("x.shingles"), F.col("y.shingles")  # by aliases, not renamed: both joins read one exchange of the sets
    both = pairs.alias("p").join(slim.alias("x"), F.col("p.node") == F.col("x.node")).select("p.node", "p.center", x).alias("x").join(slim.alias("y"), F.col("x.center") == F.col("y.node"))
    both = both.where(100 * F.least(F.size(x), F.size(y)) >= percent * F.greatest(F.size(x), F.size(y)))
    both = both.select(F.col("x.node").alias("a"), F.col("x.center").alias("b"), F.size(F.array_intersect(x, y)).alias("i"), (F.size(x) + F.size(y)).alias("s"))
    return both.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that head their group, with all their columns; repeated rows (same id, same text) count as one."""
    decided = near_duplicate_groups(docs, **options).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.withColumn("__key2", F.xxhash64("text"))
    joined = keyed.join(decided, keyed.doc_id.cast("long").eqNullSafe(decided["__id"]) & (keyed["__key2"] == decided["__key"]))
    return joined.dropDuplicates(["__id", "__key"]).select(*[keyed[f"`{c}`"] for c in docs.columns])
