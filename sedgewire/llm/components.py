"""Connected components of a link graph by repeated contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import broadcast_if_small, checkpointed


def connected_components(links: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """(node, root): every node of the links with one common root for each component.

    In each round a node takes the least name among itself and its neighbours, the links are
    renamed and repeated ones dropped; names are hashes, so each round contracts a constant
    share of what is left. Minima combine before the shuffle, and a hub's links meet only in
    joins whose skew Spark splits. No links: an empty result. Null ends are dropped. files: as checkpointed() takes it.
    """
    edges = checkpointed(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), files)
    names = None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        least = checkpointed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("name")), files)
        near = broadcast_if_small(least)
        if names is None:
            names = least.select(F.col("u").alias("node"), F.col("name").alias("root"))
        else:
            names = checkpointed(names.join(near, names.root == near.u, "left").select("node", F.coalesce("name", "root").alias("root")), files)
        left, right = near.select("u", F.col("name").alias("nu")), near.select(F.col("u").alias("v"), F.col("name").alias("nv"))
        renamed = edges.join(left, "u").join(right, "v").where("nu <> nv")
        edges = checkpointed(renamed.select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).distinct(), files)
    return names if names is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
