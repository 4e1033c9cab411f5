"""Merkle trees over numbered rows: a digest for each fixed range of rows, and digests of 1,024 digests upwards.

A leaf is the SHA-256 of its rows' values in row order, joined by commas; a node above is that of its children's digests.
Ranges follow from the row number alone, so two snapshots have the same ranges, and where their roots differ a walk from the
top finds the ranges that do. No node gathers more than 1,024 values, and no digest runs over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.sources.staging import written

#: Rows of a leaf and children of a node, as a power of two; levels below the root (so many rows have a tree of full depth: 2 ** (BITS * LEVELS)).
BITS, LEVELS = 10, 4


def _digest(place: str, value: Column) -> Column:
    """The SHA-256 of a group's values by place, joined by commas."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), value.alias("v")))), lambda x: x["v"]), ","), 256)


def leaves(rows: DataFrame, value: str = "sha256", by: Sequence[str] = (), row_no: str = "row_no") -> DataFrame:
    """(*by, node, n, digest): a digest of each range of 1,024 row numbers. Numbers are unique within `by` and not null (ordering.numbered makes such); a null value is the empty text."""
    return rows.groupBy(*by, F.shiftright(F.col(row_no).cast("long"), BITS).alias("node")).agg(F.count("*").alias("n"), _digest(row_no, F.coalesce(value, F.lit(""))).alias("digest"))


def parents(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The level above."""
    return nodes.groupBy(*by, F.shiftright("node", BITS).alias("node")).agg(F.sum("n").alias("n"), _digest("node", F.col("digest")).alias("digest"))


def root(rows: DataFrame, value: str = "sha256", by: Sequence[str] = (), row_no: str = "row_no") -> DataFrame:
    """(*by, record_count, leaves, root), a row for each tree; without `by` always one, its root null if there are no rows."""
    nodes = leaves(rows, value, by, row_no).withColumn("leaves", F.lit(1).cast("long"))
    for _ in range(LEVELS - 2):
        nodes = nodes.groupBy(*by, F.shiftright("node", BITS).alias("node")).agg(F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), _digest("node", F.col("digest")).alias("digest"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return nodes.groupBy(*by).agg(total("n").alias("record_count"), total("leaves").alias("leaves"), F.when(F.count("*") > 0, _digest("node", F.col("digest"))).alias("root"))


def build(rows: DataFrame, value: str = "sha256", row_no: str = "row_no", path: str | None = None) -> list[DataFrame]:
    """The levels of a tree, leaves first, each read from a table: below `path`, or in the shared folder."""
    levels = []
    for level in range(LEVELS):
        nodes = leaves(rows, value, row_no=row_no) if not level else parents(levels[-1])
        if path:
            nodes.write.mode("overwrite").parquet(f"{path}/level={level}")
            levels.append(rows.sparkSession.read.parquet(f"{path}/level={level}"))
        else:
            levels.append(written(nodes))
    return levels


def stored(spark: SparkSession, path: str) -> list[DataFrame]:
    """The levels of a tree that build() has written below `path`."""
    return [spark.read.parquet(f"{path}/level={level}") for level in range(LEVELS)]


def changed_ranges(old: list[DataFrame], new: list[DataFrame]) -> DataFrame:
    """(first_row, last_row, old_rows, new_rows): the ranges in which two trees differ, rows that one lacks counted as 0.

    From the top down only the children of nodes that differ are compared.
    """
    differ = None
    for a, b in zip(reversed(old), reversed(new), strict=True):
        if differ is not None:
            above = differ.select(F.col("node").alias("__above"))
            a, b = (side.join(above, F.shiftright("node", BITS) == F.col("__above"), "left_semi") for side in (a, b))
        pairs = a.select("node", F.col("n").alias("old_rows"), F.col("digest").alias("a")).join(b.select("node", F.col("n").alias("new_rows"), F.col("digest").alias("b")), "node", "full_outer")
        differ = pairs.where("not a <=> b").select("node", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("old_rows", "new_rows")])
    first = F.shiftleft("node", BITS)
    return differ.select(first.alias("first_row"), (first + (1 << BITS) - 1).alias("last_row"), "old_rows", "new_rows")


def changed_rows(old: DataFrame, new: DataFrame, ranges: DataFrame, value: str = "sha256", row_no: str = "row_no") -> DataFrame:
    """(row_no, old, new): the rows with another value, or in one snapshot only, looked for in these ranges alone."""
    nodes = ranges.select(F.shiftright("first_row", BITS).alias("__node"))
    pick = lambda rows, name: rows.join(nodes, F.shiftright(F.col(row_no).cast("long"), BITS) == F.col("__node"), "left_semi").select(F.col(row_no).alias("row_no"), F.coalesce(value, F.lit("")).alias(name))
    both = pick(old, "old").join(pick(new, "new"), "row_no", "full_outer")
    return both.where("not old <=> new")
