"""Near-duplicate embeddings: an exact metric range join with pivots.

Unit vectors with cosine >= c are at Euclidean distance <= eps = sqrt(2 - 2c). Within a label every vector
belongs to the cell of its nearest pivot. If x (nearest pivot p) and y (nearest pivot q) are within
eps, the triangle inequality gives d(x,q) <= d(y,q) + eps, which is at most the radius of q's cell + eps, and
d(y,q) + eps <= d(y,p) + eps <= d(x,p) + 2 eps. So x is copied to every lower-numbered cell q for which both hold, and
each pair meets once: in the lower of its two cells. Cells join on their own; large ones do so in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedgewire.llm.common import broadcast_if_small, checkpointed
from sedgewire.llm.components import connected_components


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


#: Distances from vectors to pivots that a task holds at once; and those that a part of a label has in all, so that its boundary copies are bounded too.
_AT_ONCE, _IN_PART = 1 << 20, 16_000_000


def _distances(own: pd.DataFrame, p: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For some vectors at a time: which, squared distances to the pivots p, the nearest one and its distance."""
    step = max(1, _AT_ONCE // len(p))
    for at in range(0, len(own), step):
        rows = slice(at, min(at + step, len(own)))
        d2 = np.maximum(2 - 2 * (_units(own["embedding"].iloc[rows]) @ p.T), 0)
        home = d2.argmin(axis=1)
        yield rows, d2, home, np.sqrt(d2[np.arange(len(home)), home])


def _radii(key: tuple, own: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Of a part of a label: the greatest distance to the pivot in each cell."""
    if not len(own):
        return pd.DataFrame({"label": [], "dim": [], "cell": [], "radius": []})
    pivots = pivots.sort_values("cell")
    radius = np.full(len(pivots), -1.0)
    for _, _, home, near in _distances(own, _units(pivots["embedding"])):
        np.maximum.at(radius, home, near)
    used = np.flatnonzero(radius >= 0)
    return pd.DataFrame({"label": key[0], "dim": key[1], "cell": pivots["cell"].to_numpy()[used], "radius": radius[used]})


def _place(key: tuple, own: pd.DataFrame, pivots: pd.DataFrame, eps: float) -> pd.DataFrame:
    """Home cell and boundary copies of each vector of a part of a label."""
    names = ["label", "dim", "cell", "home", "node", "copies", "vector"]
    if not len(own):
        return pd.DataFrame({n: [] for n in names})
    pivots = pivots.sort_values("cell")
    p, radius = _units(pivots["embedding"]), pivots["radius"].to_numpy()
    homes, ats, cells = [], [], []
    for rows, d2, home, near in _distances(own, p):
        between = np.sqrt(np.maximum(2 - 2 * (p[home] @ p.T), 0))
        d = np.sqrt(d2)
        reach = (d <= near[:, None] + 2 * eps + 1e-9) & (d <= radius[None, :] + eps + 1e-9)
        reach &= d2 - near[:, None] ** 2 <= 2 * eps * between + 1e-9  # distance to the bisector
        reach &= np.arange(len(p))[None, :] < home[:, None]
        at, cell = np.nonzero(reach)
        homes.append(home)
        ats.append((at + rows.start).astype(np.int32))
        cells.append(cell.astype(np.int32))
    index = np.concatenate([np.arange(len(own), dtype=np.int32), *ats])
    number = pivots["cell"].to_numpy()[np.concatenate([*homes, *cells])]
    rest = {c: own[f].to_numpy()[index] for c, f in (("node", "node"), ("copies", "copies"), ("vector", "embedding"))}
    return pd.DataFrame({"label": key[0], "dim": key[1], "cell": number, "home": np.arange(len(index)) < len(own), **rest})


def _cell_links(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Of one cell's pair of blocks: each linked node, the copies it links to here, and a common member of its component here."""
    x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
    u = _units(pdf["vector"])
    home, copies = pdf["home"].to_numpy(), pdf["copies"].to_numpy()
    left = np.flatnonzero(home & (pdf["block"].to_numpy() == x))
    linked = u[left] @ u.T >= cosine
    position = np.arange(len(u))
    if x == y:  # members of the block once with each other, and with every copy that shares it, wherever it stands
        linked &= ~home[None, :] | (position[None, :] > left[:, None])
    else:
        linked[:, left] = False
    count = np.zeros(len(u), np.int64)
    np.add.at(count, left, linked @ copies)
    count += copies[left] @ linked
    root = position.copy()
    while True:
        new = root.copy()
        np.minimum.at(new, left, np.where(linked, root[None, :], len(u)).min(axis=1, initial=len(u)))
        new = np.minimum(new, np.where(linked, new[left][:, None], len(u)).min(axis=0, initial=len(u)))
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = count > 0
    nodes = pdf["node"].to_numpy()
    return pd.DataFrame({"node": nodes[keep], "n": count[keep], "root": nodes[root[keep]]})


def embedding_groups(vectors: DataFrame, cosine: float = 0.93, cell_rows: int = 1024, part_rows: int = 20_000) -> DataFrame:
    """Per row of (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Vectors are compared if their labels and lengths are equal and the label is not null. A null or zero vector, or
    one with a null or non-finite component, links with nothing: n_links 0, component_id its vec_id. Equal vectors of a
    label are one node that counts its copies, so n_links is the number of other rows linked
    directly. component_id is the least vec_id reachable; null ids count as links but are never a
    component_id. Other columns are ignored; an empty table gives an empty result.

    A label has a pivot for each cell_rows vectors, but not more than the root of their number, so placing a label's vectors
    and joining its cells grow alike. part_rows: vectors of a label that a task places, fewer where it has so many pivots that
    vectors times pivots would be over 16 million; distances are made for a million pairs at a time.
    """
    kinds = dict(vectors.dtypes)
    value = "float" if kinds["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast(f"array<{value}>"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    half = lambda *seed: F.lpad(F.hex(F.xxhash64(*seed, "label", "embedding")), 16, "0")
    rows = checkpointed(rows.withColumn("node", F.when(valid, F.unhex(F.concat(half(), half(F.lit("node")))))))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("id"))
    nodes = checkpointed(nodes.withColumn("dim", F.size("embedding")))

    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("rows"), F.min("node").alias("least"))
    wanted = F.least(F.ceil(F.col("rows") / cell_rows), F.ceil(F.sqrt("rows")))
    sizes = checkpointed(sizes.withColumn("wanted", wanted).withColumn("parts", F.ceil(F.col("rows") / F.least(F.lit(part_rows), F.greatest(F.lit(1), F.floor(_IN_PART / F.col("wanted"))))).cast("int")))
    sized = nodes.join(broadcast_if_small(sizes), ["label", "dim"])
    drawn = sized.where((F.col("wanted") > 1) & ((F.col("node") == F.col("least")) | (F.pmod(F.xxhash64("node"), F.col("rows")) < F.col("wanted") - 1)))
    cell = F.row_number().over(W.partitionBy("label", "dim").orderBy("node")) - 1  # pivots only: at most the root of a label's rows
    numbered = drawn.select("label", "dim", cell.alias("cell"), "embedding", "parts")
    pivots = checkpointed(numbered.select("label", "dim", "cell", "embedding", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))).toDF("label", "dim", "cell", "embedding", "part")
    key = ["label", "dim", "part"]
    spread = sized.where("wanted > 1").select(*key[:2], F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int").alias("part"), "node", "copies", "embedding")
    eps = float(np.sqrt(2 - 2 * cosine))
    radii = spread.groupBy(*key).cogroup(pivots.groupBy(*key)).applyInPandas(lambda k, own, p: _radii(k, own, p), f"label {kinds['label']}, dim int, cell int, radius double")
    radii = checkpointed(radii.groupBy("label", "dim", "cell").agg(F.max("radius").alias("radius")))
    bounded = pivots.join(broadcast_if_small(radii), ["label", "dim", "cell"], "left").fillna(-10.0, ["radius"])  # an empty cell reaches nothing
    schema = f"label {kinds['label']}, dim int, cell int, home boolean, node binary, copies long, vector array<{value}>"
    placed = spread.groupBy(*key).cogroup(bounded.groupBy(*key)).applyInPandas(lambda k, own, p: _place(k, own, p, eps), schema)
    single = sized.where("wanted = 1").select("label", "dim", F.lit(0).alias("cell"), F.lit(True).alias("home"), "node", "copies", F.col("embedding").alias("vector"))
    placed = checkpointed(placed.union(single))

    cells = placed.groupBy("label", "dim", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    cells = cells.withColumn("hb", F.greatest(F.lit(1), F.ceil(F.col("homes") / cell_rows)).cast("int"))
    alone = F.col("homes") + F.col("guests") <= cell_rows
    cells = cells.withColumn("gb", F.when(alone, 0).otherwise(F.ceil(F.col("guests") / cell_rows)).cast("int"))
    known = placed.join(broadcast_if_small(checkpointed(cells)), ["label", "dim", "cell"]).where("homes > 0")
    hashed = F.xxhash64("node")
    block = F.when(F.col("home"), F.pmod(hashed, F.col("hb"))).when(F.col("gb") == 0, 0).otherwise(F.col("hb") + F.pmod(hashed, F.greatest("gb", F.lit(1)))).cast("int")
    known = known.withColumn("block", block)
    others = F.when(F.col("home"), F.sequence(F.lit(0), F.col("hb") + F.col("gb") - 1)).when(F.col("gb") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("hb") - 1))
    met = known.select("*", F.explode(others).alias("other"))
    met = met.select("label", "dim", "cell", "home", "node", "copies", "vector", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    found = met.groupBy("label", "dim", "cell", "x", "y").applyInPandas(lambda pdf: _cell_links(pdf, cosine), "node binary, n long, root binary")
    found = checkpointed(found)

    counts = found.groupBy("node").agg(F.sum("n").alias("others"))
    roots = connected_components(found, "node", "root")
    named = nodes.join(roots, "node", "left").select(nodes.node, "id", "copies", F.coalesce("root", nodes.node).alias("root"))
    least = named.where("id is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root", "left").join(counts, "node", "left")
    named = named.select("node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
