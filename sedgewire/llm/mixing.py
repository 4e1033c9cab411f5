"""Mixing sources to target weights by hash thresholds. DataFrame functions only.

Each document has a fixed 60-bit hash. A source's budget beyond whole passes is met by the
documents below a threshold of that hash. Sizes are summed by source and 4096 hash buckets; the bucket
in which the running sum crosses the budget is refined by the next 12 bits of the hash, over its
documents alone, until one hash is left. Nothing is sorted but the buckets of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedgewire.llm.common import WORD, broadcast_if_small, checkpointed, files_for, without_columns

_BITS, _LEVELS = 12, 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(doc_id: Column) -> Column:
    """60 bits of md5 over the id as text; null as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn. Targets share `share` of all
    sizes by weight, none above `most` times its source; what is cut off goes to the others by weight.
    In order of cap over weight, a source is capped while the level that the rest
    would reach is above its own; so one pass finds the level of all that aren't capped.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"))
    ratio = F.col("source_size") * F.lit(float(most)) / F.col("weight")
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    per = per.withColumn("ratio", ratio)
    per = per.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("open_weight"),
    )
    level = (F.col("total") * F.lit(float(share)) - F.col("capped") * F.lit(float(most))) / F.col("open_weight")
    per = per.withColumn("level", level)
    per = per.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    target = F.least(F.coalesce(F.col("water") * F.col("weight"), F.col("source_size") * F.lit(float(most))), F.col("source_size") * F.lit(float(most)))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, files: int | None = None) -> DataFrame:
    """(source, source_size, target, passes, threshold) from (source, size, h): every document is taken `passes` times, and once more if h < threshold.

    Where whole passes meet the target the threshold is 0, so texts without words aren't taken more often than the others; a source without words is taken once.
    files: as checkpointed() takes it.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = checkpointed(plan.select("source", "source_size", "target", "passes", "rest"), files)
    state = plan.select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    rows, done = sizes, None
    for level in range(_LEVELS):
        shift = _BITS * (_LEVELS - 1 - level)
        buckets = rows.withColumn("prefix", F.shiftright("h", shift)).groupBy("source", "prefix").agg(F.sum("size").alias("size"))
        running = F.sum("size").over(W.partitionBy("source").orderBy("prefix").rowsBetween(W.unboundedPreceding, 0))
        filled = buckets.withColumn("upto", running)
        known = broadcast_if_small(state.select(F.col("source").alias("s"), "rest"))
        over = filled.join(known, filled.source.eqNullSafe(known.s)).where(F.col("upto") > F.col("rest"))
        edge = over.groupBy("source").agg(F.min(F.struct("prefix", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"), "size")).alias("e"))
        last = F.lit(int(level == _LEVELS - 1))  # one hash is left: its documents are taken if that comes nearer to the budget
        state = checkpointed(edge.select("source", "e.rest", (F.col("e.prefix") + F.when(F.col("e.size") < 2 * F.col("e.rest"), last).otherwise(0)).alias("prefix")), files)
        done = state.select("source", F.shiftleft("prefix", shift).alias("threshold")) if done is None else _newer(done, state, shift)
        done = checkpointed(done, files)
        if level == _LEVELS - 1 or state.isEmpty():
            break
        edge_of = broadcast_if_small(state.select(F.col("source").alias("s"), F.col("prefix").alias("p")))
        rows = checkpointed(rows.join(edge_of, rows.source.eqNullSafe(edge_of.s) & (F.shiftright("h", shift) == F.col("p"))).select("source", "size", "h"), files)
    above = F.lit(1 << (_BITS * _LEVELS))
    return plan.alias("a").join(done.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.source", "source_size", "target", "passes", F.when((F.col("source_size") > 0) & (F.col("rest") <= 0), 0).otherwise(F.coalesce("threshold", above)).cast("long").alias("threshold"))


def _newer(done: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    new = state.select(F.col("source").alias("s"), F.shiftleft("prefix", shift).alias("t"))
    return done.join(new, done.source.eqNullSafe(new.s), "left").select("source", F.coalesce("t", "threshold").alias("threshold"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes the document (0 to `most`).

    Null texts have size 0; null is a source like any other, after all others. Rows that repeat an id share their
    fate. The document that crosses the budget is taken if the sum then comes nearer to it. An empty table gives an empty result. Columns of docs with the added names are replaced.
    """
    docs = without_columns(docs, "size", "source_size", "target", "copies")
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("h", mix_hash(F.col("doc_id")))
    files, short = files_for(docs)
    slim = checkpointed(sized.select("source", "size", "h"), files)
    plan = broadcast_if_small(checkpointed(thresholds(slim, source_targets(slim, weights, share, most), short).withColumnRenamed("source", "__source"), short))
    joined = sized.join(plan, sized.source.eqNullSafe(plan["__source"]))
    copies = F.col("passes") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return joined.select(*[sized[f"`{c}`"] for c in docs.columns], "size", "source_size", "target", copies.cast("int").alias("copies"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, columns as in docs: each document as often as the mix takes it."""
    mixed = mix(docs, **options)
    repeated = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE / weight AS ratio FROM s),
w AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, coalesce(sum(source_size) OVER b, 0)::BIGINT AS capped,
    (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS open_weight
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total * 1.5::DOUBLE - capped * 2.0::DOUBLE) / open_weight AS level FROM w),
t AS (SELECT *, least(coalesce(max(level) FILTER (level <= ratio) OVER () * weight, source_size * 2.0::DOUBLE), source_size * 2.0::DOUBLE) AS target FROM l),
p AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (passes + CASE WHEN upto <= rest OR (upto - own <= rest AND own < 2 * (rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
