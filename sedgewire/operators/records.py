"""Operators over scan records (path, mime, size_bytes, sha256, metadata, warnings, errors, and row_no for order)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedgewire.functions.columns import cache_key, signed_degrees, without_keys
from sedgewire.operators import hash_tree
from sedgewire.operators.ordering import numbered
from sedgewire.schema import PRIVACY_KEYS, TIMELINE_KEYS
from sedgewire.sources.staging import checkpointed


def mime_counts(scan: DataFrame) -> DataFrame:
    return scan.groupBy(F.coalesce("mime", F.lit("")).alias("mime")).agg(F.count("*").alias("n"))


def code_counts(scan: DataFrame, column: str) -> DataFrame:
    """How often each code of an array column occurs; repeats in a record count, null arrays don't."""
    return scan.select(F.explode(column).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


#: What a report finds in metadata, by the short key or else by those that the extractors give. Fixed values.
FINDINGS = {"author": ("author", "pdf_author", "docx_author"), "producer": ("producer", "pdf_producer"), "model": ("model", "exif_model")}


def value_counts(scan: DataFrame, strict: bool = False) -> DataFrame:
    """(kind, value, n, first_row, size): all that a report counts, in one pass and one aggregation.

    Kinds: total (one value), mime, warning, error, gps (one value: records with a position), author, producer and model, as far as scan has the columns. Null codes count as empty texts, null arrays hold none;
    empty findings don't count, nor does metadata that isn't JSON. strict: short metadata keys only. first_row: the least row_no (null without that column).
    """
    have = set(scan.columns)
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    parts = [F.array(one("total", F.lit("")))]
    if "mime" in have:
        parts.append(F.array(one("mime", F.coalesce("mime", F.lit("")))))
    for column, kind in (("warnings", "warning"), ("errors", "error")):
        if column in have:
            codes = F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>"))
            parts.append(_codes(codes, kind))
    if "metadata" in have:
        v = F.try_parse_json("metadata")
        text = lambda key: F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))
        there = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "variant").isNotNull(), F.lit(False))
        gps = there("gps") if strict else there("gps") | there("gps_latitude")
        told = [one("gps", F.when(gps, F.lit("")))] + [one(kind, F.coalesce(*map(text, keys[:1] if strict else keys))) for kind, keys in FINDINGS.items()]
        parts.append(F.filter(F.array(*told), lambda x: x["value"].isNotNull()))
    size = F.col("size_bytes") if "size_bytes" in have else F.lit(None).cast("long")
    rows = scan.select(F.col("row_no") if "row_no" in have else F.lit(None).cast("long").alias("row_no"), size.alias("size"), F.inline(F.concat(*parts)))
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))


def _codes(codes: Column, kind: str) -> Column:
    return F.transform(codes, lambda c: F.struct(F.lit(kind).alias("kind"), F.coalesce(c, F.lit("")).alias("value")))


def build_report(scan: DataFrame) -> DataFrame:
    """One row: total_files and maps of mime, warning and error counts (as many entries as there are kinds), from one pass over the scan."""
    counts = value_counts(scan.select(*[c for c in scan.columns if c in ("mime", "warnings", "errors")]))
    entry = F.struct("value", "n")
    of = lambda kind, name: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry)))).alias(name)
    total = F.coalesce(F.sum(F.when(F.col("kind") == "total", F.col("n"))), F.lit(0)).cast("long").alias("total_files")
    return counts.agg(total, of("mime", "mime_counts"), of("warning", "warning_counts"), of("error", "error_counts"))


def findings(scan: DataFrame, n: int = 5, strict: bool = False) -> DataFrame:
    """(kind, value, n, rank): the report's lists from one pass. Warnings and errors in full, most frequent first, of equals the first seen; authors, producers and models so too, the first n (the report's limit);
    types by name; gps: the records with a position; distinct: how many authors, producers and models there are, by kind."""
    counts = value_counts(scan, strict)
    return ranked_findings(counts, n)


def ranked_findings(counts: DataFrame, n: int = 5) -> DataFrame:
    """findings() of value_counts()."""
    listed = counts.where("kind <> 'total'")
    by_name = F.when(F.col("kind") == "mime", F.col("value"))
    order = W.partitionBy("kind").orderBy(by_name, F.desc("n"), "first_row", "value")
    top = listed.where(F.col("kind").isin(*FINDINGS)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    rest = numbered(listed.where(~F.col("kind").isin(*FINDINGS)), "kind", by_name, F.desc("n"), "first_row", "value", name="place")
    first = F.broadcast(rest.groupBy("kind").agg(F.min("place").alias("first")))  # four rows at most
    rest = rest.join(first, "kind").select("kind", "value", "n", (F.col("place") - F.col("first") + 1).cast("int").alias("rank"))
    distinct = listed.where(F.col("kind").isin(*FINDINGS)).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("distinct").alias("kind"), F.col("kind").alias("value"), "n", F.lit(None).cast("int").alias("rank"))
    return top.select("kind", "value", "n", "rank").union(rest).union(distinct)


def last_wins(rows: DataFrame, key: str = "path", order: str = "row_no") -> DataFrame:
    """The last row of each key; a null key is the empty one. Minima and maxima combine before the shuffle, so a hot key is no hot task."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(F.coalesce(key, F.lit("")).alias(key)).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return best.select(key, *[F.col("__r")[c].alias(c) for c in rest])


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return best.select(key, *[F.col("__r")[c].alias(c) for c in rest])


def duplicate_content(scan: DataFrame, order: str = "path") -> DataFrame:
    """Records whose content came before in path order, with the first path that has it."""
    first = scan.where("sha256 <> ''").groupBy("sha256").agg(F.min(order).alias("first_path"))
    return scan.join(first, "sha256").where(F.col(order) > F.col("first_path")).select("path", "sha256", "first_path")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, removed or changed between two sets of (path, record, row_no); the last row of a path counts, unnamed rows are only compared."""
    a = last_wins(old.select("path", "record", "row_no")).select("path", F.col("record").alias("old"))
    b = last_wins(new.select("path", "record", "row_no")).select("path", F.col("record").alias("new"))
    both = a.join(b, "path", "full_outer")
    status = F.when(F.col("old").isNull() & (F.col("path") != ""), "added").when(F.col("new").isNull() & (F.col("path") != ""), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def diff_rows(changes: DataFrame, status: str) -> DataFrame:
    """The paths of one status, sorted by range: for any number of changes."""
    return changes.where(F.col("status") == status).select("path").orderBy("path")


#: The kinds of changes that a diff tells. Fixed values.
STATUSES = ("added", "removed", "changed")


def diff_summary(changes: DataFrame) -> DataFrame:
    """(status, n, digest, place, path): the sorted list of each status, a row a path with its place in the list (from 1), how many paths the status has, and the root of the Merkle tree over them in order.

    A status without changes has one row: n is 0, the rest null. No row or task holds a list, however many changes there are.
    """
    rows = numbered(changes.select("status", "path"), "status", "path")
    first = F.broadcast(rows.groupBy("status").agg(F.min("row_no").alias("first")))  # a row a status
    rows = rows.join(first, "status").withColumn("row_no", F.col("row_no") - F.col("first"))
    roots = hash_tree.root(rows, "path", by=["status"]).select("status", F.col("record_count").alias("n"), F.col("root").alias("digest"))
    kinds = changes.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = checkpointed(kinds.join(roots, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "digest"))  # three rows
    listed = rows.join(F.broadcast(counts), "status").select("status", "n", "digest", (F.col("row_no") + 1).alias("place"), "path")
    none = counts.where("n = 0").select("status", "n", "digest", F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("path"))
    return listed.union(none)


def verify(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, issue): missing or hash_mismatch of expected (path, sha256) against the files found. Names that leave the base are missing."""
    inside = ~(F.col("e.path").startswith("/") | F.col("e.path").rlike(r"(^|/)\.\.(/|$)"))
    joined = expected.alias("e").join(found.select("path", F.col("sha256").alias("actual")).alias("f"), (F.col("e.path") == F.col("f.path")) & inside, "left")
    issue = F.when(F.col("f.path").isNull(), "missing").when(~F.col("e.sha256").eqNullSafe(F.col("actual")), "hash_mismatch")
    return joined.select(F.col("e.path").alias("path"), issue.alias("issue")).where("issue is not null")


def sanitize(scan: DataFrame, remove_keys: Sequence[str] = PRIVACY_KEYS) -> DataFrame:
    """Records without these metadata keys (metadata as a JSON object or a string map)."""
    if dict(scan.dtypes)["metadata"].startswith("map"):
        return scan.withColumn("metadata", without_keys(F.col("metadata"), remove_keys))
    parsed = F.from_json("metadata", "map<string,variant>")
    return scan.withColumn("metadata", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_filter(parsed, lambda k, _: ~k.isin(*remove_keys))), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))))


def timeline(scan: DataFrame) -> DataFrame:
    """(path, key, value) of the keys that place a file in time, ordered by path and key."""
    v = F.try_parse_json("metadata")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.try_variant_get(v, f"$.{k}", "string").alias("value")) for k in TIMELINE_KEYS])
    return scan.select("path", F.inline(pairs)).where("value is not null").orderBy("path", "key")


def top_findings(values: DataFrame, n: int = 5) -> DataFrame:
    """(value, n) of the most frequent values of (value, row_no); of equals the first seen. Null and empty don't count. n: a report's limit."""
    counts = values.where("value is not null and value <> ''").groupBy("value").agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"))
    return counts.orderBy(F.desc("n"), "first_row").limit(n)


def privacy_signals(scan: DataFrame) -> DataFrame:
    """privacy_flags, risk_score and reason_codes: a position counts 40, an author 10."""
    v = F.try_parse_json("metadata")
    has = lambda *keys: F.greatest(*[F.coalesce(F.try_variant_get(v, f"$.{k}", "variant").isNotNull(), F.lit(False)) for k in keys], F.lit(False))
    gps, author = has("gps", "gps_latitude"), has("author", "pdf_author", "docx_author")
    pick = lambda a, b: F.filter(F.array(F.when(gps, a), F.when(author, b)), lambda x: x.isNotNull())
    score = F.when(gps, 40).otherwise(0) + F.when(author, 10).otherwise(0)
    return scan.select("path", pick("has_gps", "has_author").alias("privacy_flags"), score.alias("risk_score"), pick("GPS_PRESENT", "AUTHOR_PRESENT").alias("reason_codes"))


def hash_rows(scan: DataFrame) -> DataFrame:
    """The hashes in row order (h), a null as the empty text, sorted by range."""
    return scan.select("row_no", F.coalesce("sha256", F.lit("")).alias("h")).orderBy("row_no", "h").select("h")


def manifest_digest(scan: DataFrame) -> DataFrame:
    """One row: record_count, leaves and root of the hashes' Merkle tree (hash_tree.root)."""
    return hash_tree.root(scan)


def hash_lines(scan: DataFrame) -> DataFrame:
    return scan.orderBy("row_no").select(F.concat(F.coalesce("sha256", F.lit("")), F.lit("\t"), F.coalesce("path", F.lit(""))).alias("line"))


def with_cache(files: DataFrame, cache: DataFrame, mode: str = "sha256") -> DataFrame:
    """files (path, sha256, mtime, size_bytes) with their key, and cache_hit and cached: the first stored result of that key by row_no; a stored null is a hit. Only content-derived results may be kept so."""
    keyed = files.withColumn("key", cache_key(mode, F.col("sha256"), F.col("mtime"), F.col("size_bytes")))
    first = first_wins(cache.select("key", "result", "row_no"), "key", "row_no").select("key", F.col("result").alias("cached"), F.lit(True).alias("cache_hit"))
    return keyed.join(first, "key", "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("result")), F.lit(0)).cast("long").alias("size"))


def position(lat: Column, lat_ref: Column, lon: Column, lon_ref: Column) -> Column:
    """Both signed coordinates of two arrays of degrees, minutes and seconds; null unless both have three parts."""
    deg = lambda a: a[0] + a[1] / 60 + a[2] / 3600
    return F.when((F.size(lat) == 3) & (F.size(lon) == 3), F.struct(signed_degrees(deg(lat), lat_ref).alias("gps_latitude"), signed_degrees(deg(lon), lon_ref).alias("gps_longitude")))


def limited(scan: DataFrame, max_files: int = 5_000, include_hidden: bool = False) -> DataFrame:
    """The first files by path; hidden ones only if asked for. The limit is the feature."""
    seen = scan if include_hidden else scan.where(~F.col("path").rlike(r"(^|/)\."))
    return seen.orderBy("path").limit(max_files)

