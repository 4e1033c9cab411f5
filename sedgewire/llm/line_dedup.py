"""Cross-site boilerplate lines: HyperLogLog spread per line, exact counts near the threshold. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import broadcast_if_small, checkpointed, files_for, without_columns

#: Relative standard error of a sketch with 2^12 registers.
_LG_K, _ERROR = 12, 1.04 / 64


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _site(source: Column) -> Column:
    """A name for each source; null is a site of its own beside the empty one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, site, pos, line, check) for each line that isn't blank; line and check are 128 bits of hash of the trimmed line."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _site(F.col("source")).alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "raw"))
    trimmed = F.trim(F.col("raw"), F.lit(" \t\r"))
    return texts.where(trimmed != "").select("doc_id", "text_key", "site", "pos", F.xxhash64(trimmed).alias("line"), F.xxhash64(F.lit("line"), trimmed).alias("check"))


def boilerplate_lines(lines: DataFrame, min_sites: int, files: int | None = None) -> DataFrame:
    """(line, check, first): lines on at least min_sites distinct sites, and their first place by doc_id.

    Copies of one text count as one, on the least of their sites: a document that is copied everywhere is no boilerplate.
    Sketches merge by aggregation, on the map side first, so a line that a third of all rows
    hold arrives as one row per task. A line in fewer than min_sites texts can't be on so many
    sites. Estimates within five standard errors (one site at least) of the threshold are
    replaced by exact distinct counts; the others are beyond doubt. files: as checkpointed() takes it.
    """
    per_text = lines.groupBy("line", "check", "text_key").agg(F.min("site").alias("site"), F.min(F.struct("doc_id", "text_key", "pos")).alias("first"))
    spread = per_text.groupBy("line", "check").agg(
        F.count("*").alias("n"),
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(_LG_K))).alias("sites"),
        F.min("first").alias("first"),
    )
    margin = max(1.0, 5 * _ERROR * min_sites)
    spread = checkpointed(spread.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites - margin)), files)
    sure = spread.where(F.col("sites") > min_sites + margin).select("line", "check", "first")
    near = spread.where(F.col("sites") <= min_sites + margin).select("line", "check", "first")
    seen = lines.join(broadcast_if_small(near.select("line", "check")), ["line", "check"])
    pairs = seen.groupBy("line", "check", "text_key").agg(F.min("site").alias("site")).select("line", "check", "site").distinct()
    exact = pairs.groupBy("line", "check").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(near.join(exact.select("line", "check"), ["line", "check"]))


def remove_boilerplate(docs: DataFrame, min_sites: int = 8) -> DataFrame:
    """All columns of docs with the text less its boilerplate lines, plus n_lines, n_removed and text_kept.

    A line counts without the blanks at its ends; blank lines stay. The first place of a
    boilerplate line (least doc_id, null first, then position) keeps it, so its content is not lost; rows that
    repeat a doc_id and text share that place. A null source is a site of its own. A null text stays null with 0 lines; one
    without a removed line stays as it is. Order of lines is kept; an empty table gives an empty result. Columns of the added names are replaced.
    """
    docs = without_columns(docs, "n_lines", "n_removed", "text_kept")
    files, _ = files_for(docs)
    lines = checkpointed(line_table(docs), files)
    found = boilerplate_lines(lines, min_sites, files)
    places = lines.join(broadcast_if_small(checkpointed(found, files)), ["line", "check"]).where(~F.struct("doc_id", "text_key", "pos").eqNullSafe(F.col("first")))
    removed = places.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("removed")).alias("r")
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("text_key")).alias("k")  # in one column no name can clash
    joined = keyed.join(removed, F.col("k.row.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("k.text_key") == F.col("r.text_key")), "left")
    whole = F.col("k.row.text")
    all_lines = _lines(whole)
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("removed"))  # on ints: by a hash set
    text = F.when(F.col("removed").isNull(), whole).otherwise(F.array_join(F.transform(kept, lambda p: F.get(all_lines, p)), "\n"))
    return joined.select(
        *[F.col("k.row")[c].alias(c) for c in docs.columns],
        F.when(whole.isNull(), 0).otherwise(F.size(all_lines)).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
        text.alias("text_kept"),
    )


ORACLE = """
WITH docs AS (SELECT doc_id, text, source, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS raw, text FROM docs),
trimmed AS (SELECT doc_id, pos, raw, text, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines),
texts AS (SELECT text, min(coalesce('=' || source, '')) AS site FROM docs WHERE text IS NOT NULL GROUP BY text),
spread AS (
  SELECT line FROM (SELECT site, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM texts)
  WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 8),
marked AS (
  SELECT t.doc_id, t.text, t.pos, t.raw, s.line IS NOT NULL AND row_number() OVER (PARTITION BY t.line ORDER BY t.doc_id, t.pos) > 1 AS gone
  FROM trimmed t LEFT JOIN spread s ON t.line = s.line),
cut AS (
  SELECT doc_id, count(*)::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed, sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END) AS kept_sha256
FROM documents d LEFT JOIN cut USING (doc_id)
"""
