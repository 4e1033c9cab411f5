"""The reference operators as queries over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.functions import columns as C
from sedgewire.functions.patterns import excluded_by
from sedgewire.operators import case_bundle, hash_tree
from sedgewire.operators import records as R
from sedgewire.operators.normalize import normalize, normalize_json
from sedgewire.plans import documents_as_scan, table
from sedgewire.sources.cache import CacheTable
from sedgewire.sources.deflate_runs import member_lines
from sedgewire.sources.jsonl import read_jsonl, record_json, write_jsonl
from sedgewire.sources.line_table import local_path
from sedgewire.sources.staging import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SCAN = "(SELECT source || '/' || doc_id || '.' || lang AS path, lang AS mime, octet_length(encode(text))::BIGINT AS size_bytes, sha256(text) AS sha256, doc_id AS row_no FROM documents)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql.replace("SCAN", _SCAN)
        return f

    return add


@query("SELECT count(*) AS total_files, coalesce(sum(size_bytes), 0)::BIGINT AS total_size, count(DISTINCT mime) AS n_mimes, count(DISTINCT sha256) AS n_contents FROM SCAN")
def scan_summary(spark, d):
    scan = documents_as_scan(spark, d)
    return scan.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_size"), F.count_distinct("mime").alias("n_mimes"), F.count_distinct("sha256").alias("n_contents"))


@query("SELECT coalesce(lang, '') AS mime, count(*) AS n FROM documents GROUP BY 1")
def mime_counts(spark, d):
    return R.mime_counts(table(spark, d, "documents").select(F.col("lang").alias("mime")))


@query("SELECT code, count(*) AS n FROM (SELECT unnest(CASE WHEN toxic = 1 AND quality = 0 THEN ['toxic', 'low_quality'] WHEN toxic = 1 THEN ['toxic'] WHEN quality = 0 THEN ['low_quality'] ELSE [] END) AS code FROM labels) GROUP BY code")
def warning_counts(spark, d):
    codes = F.filter(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low_quality")), lambda x: x.isNotNull())
    return R.code_counts(table(spark, d, "labels").select(codes.alias("warnings")), "warnings")


@query("SELECT code, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'late' END AS code FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'O') GROUP BY code")
def error_counts(spark, d):
    code = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_linestatus") == "O", "late")
    return R.code_counts(table(spark, d, "lineitem").select(F.array_compact(F.array(code)).alias("errors")), "errors")


@query("""WITH s AS (SELECT d.lang, l.toxic, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'mime' AS kind, coalesce(lang, '') AS name, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'warning', 'low_quality', count(*) FROM s WHERE quality = 0 HAVING count(*) > 0
UNION ALL SELECT 'error', 'toxic', count(*) FROM s WHERE toxic = 1 HAVING count(*) > 0 UNION ALL SELECT 'total', '', count(*) FROM s""")
def build_report(spark, d):
    marks = table(spark, d, "labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 0, "low_quality"))).alias("warnings"), F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"))).alias("errors"))
    report = R.build_report(table(spark, d, "documents").select("doc_id", F.col("lang").alias("mime")).join(marks, "doc_id", "left"))
    counts = {"mime": F.col("mime_counts"), "warning": F.col("warning_counts"), "error": F.col("error_counts"), "total": F.create_map(F.lit(""), F.col("total_files"))}
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), of.alias("counts")) for kind, of in counts.items()])
    return report.select(F.inline(kinds)).select("kind", F.explode("counts").alias("name", "n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 5")
def top_n_findings(spark, d):
    top = R.top_findings(table(spark, d, "events").select(F.col("event_type").alias("value"), F.col("event_id").alias("row_no")))
    return top.select("value", "n")


@query("SELECT user_id, max(event_id) AS row_no, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_wins_index(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("row_no"), "event_type")
    return R.last_wins(rows).select(F.col("path").cast("long").alias("user_id"), "row_no", "event_type")


@query("SELECT key, min(event_id) AS row_no, arg_min(event_type, event_id) AS result FROM (SELECT 'u' || user_id AS key, * FROM events) GROUP BY 1")
def first_wins_lookup(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("row_no"), F.col("event_type").alias("result"))
    return R.first_wins(rows, "key", "row_no").select("key", "row_no", "result")


@query("WITH s AS (SELECT path, sha256, min(path) OVER (PARTITION BY sha256) AS first_path FROM SCAN) SELECT path, sha256, first_path FROM s WHERE path > first_path AND sha256 IS NOT NULL")
def duplicate_content(spark, d):
    return R.duplicate_content(documents_as_scan(spark, d))


_DIFF = """WITH o AS (SELECT c_custkey::VARCHAR AS path, (length(c_mktsegment) % 5)::VARCHAR AS rec FROM customer),
n AS (SELECT user_id::VARCHAR AS path, (max(event_id) % 5)::VARCHAR AS rec FROM events GROUP BY user_id)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM o FULL OUTER JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.rec <> n.rec"""


def _snapshots(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), (F.length("c_mktsegment") % 5).cast("string").alias("record"), F.col("c_custkey").alias("row_no"))
    new = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 5).cast("string").alias("record"), F.col("event_id").alias("row_no"))
    return old, new


@query(_DIFF)
def diff_snapshots(spark, d):
    return R.diff(*_snapshots(spark, d))


def _levels(source: str, value: str, by: str = "") -> str:
    """The levels l0 to l3 of a Merkle tree over source's row_no, as a WITH list."""
    key, group = (f"{by}, ", f"{by}, ") if by else ("", "")
    out = [f"l0 AS (SELECT {key}row_no // 1024 AS node, count(*) AS n, 1 AS leaves, sha256(string_agg(coalesce({value}, ''), ',' ORDER BY row_no)) AS digest FROM {source} GROUP BY {group}row_no // 1024)"]
    out += [f"l{k} AS (SELECT {key}node // 1024 AS node, sum(n)::BIGINT AS n, sum(leaves)::BIGINT AS leaves, sha256(string_agg(digest, ',' ORDER BY node)) AS digest FROM l{k - 1} GROUP BY {group}node // 1024)" for k in (1, 2, 3)]
    return ", ".join(out)


@query(f"""WITH c AS ({_DIFF}), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY path) - 1 AS row_no FROM c), {_levels('r', 'path', 'status')},
k AS (SELECT unnest(['added', 'removed', 'changed']) AS status)
SELECT k.status, coalesce(l3.n, 0) AS n, l3.digest, r.row_no + 1 AS place, r.path FROM k LEFT JOIN l3 ON k.status = l3.status LEFT JOIN r ON k.status = r.status""")
def diff_summary(spark, d):
    return R.diff_summary(R.diff(*_snapshots(spark, d)))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def paths_common(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def paths_removed(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT s.path, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'hash_mismatch' END AS issue FROM SCAN s LEFT JOIN labels l ON s.row_no = l.doc_id WHERE l.doc_id IS NULL OR l.toxic = 1")
def verify_issues(spark, d):
    scan = documents_as_scan(spark, d)
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("row_no"), "toxic")
    found = scan.join(labels, "row_no").select("path", F.when(F.col("toxic") == 1, F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    return R.verify(scan.select("path", "sha256"), found)


@query("SELECT sha256 || chr(9) || path AS line FROM SCAN WHERE sha256 IS NOT NULL AND path IS NOT NULL")
def hash_lines(spark, d):
    return R.hash_lines(documents_as_scan(spark, d).where("sha256 is not null and path is not null"))


@query("SELECT doc_id, md5(text) AS hash_hex FROM documents")
def hash_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", C.content_hash(F.col("text"), " MD5 ").alias("hash_hex"))


@query(f"WITH s AS (SELECT * FROM SCAN), {_levels('s', 'sha256')} SELECT n AS record_count, leaves, digest AS root FROM l3")
def manifest_digest(spark, d):
    return R.manifest_digest(documents_as_scan(spark, d))


_LATER = """SELECT s.row_no, CASE WHEN l.toxic = 1 THEN md5(s.path) ELSE s.sha256 END AS sha256 FROM SCAN s LEFT JOIN labels l ON s.row_no = l.doc_id WHERE l.quality IS NULL OR l.quality <> 0
UNION ALL SELECT max(row_no) + 5000, 'new' FROM SCAN HAVING count(*) > 0"""


def _later(spark, d):
    """documents_as_scan with other hashes of toxic records, without those of low quality, and with a record far behind."""
    scan = documents_as_scan(spark, d)
    joined = scan.join(table(spark, d, "labels").select(F.col("doc_id").alias("row_no"), "toxic", "quality"), "row_no", "left").where("quality is null or quality <> 0")
    rows = joined.select("row_no", F.when(F.col("toxic") == 1, F.md5("path")).otherwise(F.col("sha256")).alias("sha256"))
    return rows.union(scan.agg((F.max("row_no") + 5000).alias("row_no"), F.lit("new").alias("sha256")).where("row_no is not null"))


@query(f"""WITH a AS (SELECT row_no // 1024 AS node, count(*) AS n, string_agg(coalesce(sha256, ''), ',' ORDER BY row_no) AS v FROM SCAN GROUP BY 1),
b AS (SELECT row_no // 1024 AS node, count(*) AS n, string_agg(coalesce(sha256, ''), ',' ORDER BY row_no) AS v FROM ({_LATER}) GROUP BY 1)
SELECT coalesce(a.node, b.node) * 1024 AS first_row, coalesce(a.node, b.node) * 1024 + 1023 AS last_row, coalesce(a.n, 0) AS old_rows, coalesce(b.n, 0) AS new_rows
FROM a FULL OUTER JOIN b ON a.node = b.node WHERE a.v IS DISTINCT FROM b.v""")
def manifest_changes(spark, d):
    return hash_tree.changed_ranges(hash_tree.build(documents_as_scan(spark, d)), hash_tree.build(_later(spark, d)))


@query(f"""SELECT coalesce(o.row_no, n.row_no) AS row_no, CASE WHEN o.row_no IS NOT NULL THEN coalesce(o.sha256, '') END AS old, CASE WHEN n.row_no IS NOT NULL THEN coalesce(n.sha256, '') END AS new
FROM SCAN o FULL OUTER JOIN ({_LATER}) n ON o.row_no = n.row_no WHERE o.row_no IS NULL OR n.row_no IS NULL OR coalesce(o.sha256, '') <> coalesce(n.sha256, '')""")
def manifest_changed_rows(spark, d):
    old, new = documents_as_scan(spark, d), _later(spark, d)
    return hash_tree.changed_rows(old, new, hash_tree.changed_ranges(hash_tree.build(old), hash_tree.build(new)))


@query("""WITH s AS (
  SELECT event_id AS row_no, event_type, 'u' || user_id AS author, coalesce(json_extract_string(props, '$.k'), '') AS producer, CASE WHEN value < 5 THEN 'low' WHEN value < 10 THEN '' ELSE NULL END AS model, value > 50 AS gps FROM events),
c AS (
  SELECT 'mime' AS kind, coalesce(event_type, '') AS value, count(*) AS n, min(row_no) AS first_row FROM s GROUP BY 2 UNION ALL
  SELECT 'warning', w, count(*), min(row_no) FROM (SELECT row_no, unnest(CASE WHEN gps THEN ['far', author] ELSE ['near'] END) AS w FROM s) GROUP BY 2 UNION ALL
  SELECT 'error', 'x', count(*), min(row_no) FROM s WHERE event_type = 'error' HAVING count(*) > 0 UNION ALL SELECT 'gps', '', count(*), min(row_no) FROM s WHERE gps HAVING count(*) > 0 UNION ALL
  SELECT 'author', author, count(*), min(row_no) FROM s WHERE author <> '' GROUP BY 2 UNION ALL SELECT 'producer', producer, count(*), min(row_no) FROM s WHERE producer <> '' GROUP BY 2 UNION ALL
  SELECT 'model', model, count(*), min(row_no) FROM s WHERE model <> '' GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'mime' THEN value END, n DESC, first_row, value)::INTEGER AS rank FROM c)
SELECT kind, value, n, rank FROM r WHERE rank <= 5 OR kind NOT IN ('author', 'producer', 'model') UNION ALL SELECT 'distinct', kind, count(*), NULL FROM c WHERE kind IN ('author', 'producer', 'model') GROUP BY 2""")
def findings(spark, d):
    author, far = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("value") > 50
    model = F.when(F.col("value") < 5, "low").when(F.col("value") < 10, "")
    meta = F.to_json(F.struct(author.alias("pdf_author"), F.get_json_object("props", "$.k").alias("producer"), model.alias("exif_model"), F.when(far, F.struct(F.lit(1).alias("lat"))).alias("gps")))
    warnings = F.when(far, F.array(F.lit("far"), author)).otherwise(F.array(F.lit("near")))
    errors = F.when(F.col("event_type") == "error", F.array(F.lit("x")))
    return R.findings(table(spark, d, "events").select(F.col("event_id").alias("row_no"), F.col("event_type").alias("mime"), warnings.alias("warnings"), errors.alias("errors"), meta.alias("metadata")))


@query("SELECT page_id, lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) AS suffix FROM pages")
def suffix(spark, d):
    return table(spark, d, "pages").select("page_id", C.suffix(F.col("url")).alias("suffix"))


_NAMES = "(SELECT p_partkey, p_name || CASE p_partkey % 8 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.tar.pdf' WHEN 3 THEN '.docx' WHEN 4 THEN '.mov' WHEN 5 THEN '.' WHEN 6 THEN '' ELSE '.jpeg.txt' END AS path FROM part)"


def _names(spark, d):
    k = F.col("p_partkey") % 8
    end = F.when(k == 0, ".JPG").when(k == 1, ".png").when(k == 2, ".tar.pdf").when(k == 3, ".docx").when(k == 4, ".mov").when(k == 5, ".").when(k == 6, "").otherwise(".jpeg.txt")
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", end).alias("path"))


_MIME = "CASE p_partkey % 8 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 4 THEN 'video/mp4' ELSE 'application/octet-stream' END"


@query(f"SELECT p_partkey, {_MIME} AS mime FROM part")
def guess_mime(spark, d):
    return _names(spark, d).select("p_partkey", C.guess_mime(F.col("path")).alias("mime"))


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'pdf' WHEN 3 THEN 'docx' WHEN 4 THEN 'video' ELSE 'none' END AS extractor FROM part")
def dispatch(spark, d):
    return _names(spark, d).select("p_partkey", C.extractor(C.guess_mime(F.col("path")), F.col("path")).alias("extractor"))


@query("SELECT page_id FROM pages WHERE NOT (lower(url) LIKE '%utm_%' OR lower(url) LIKE '%/fr/%' OR regexp_full_match(lower(url), 'https://m\\..*', 's'))")
def exclude_filter(spark, d):
    return table(spark, d, "pages").where(~C.excluded(F.col("url"), ["UTM_", "/fr/", "https://m.*"])).select("page_id")


_PATTERNS = """CASE p_partkey % 6 WHEN 0 THEN '/' || p_partkey || '#' WHEN 1 THEN ' */' || p_partkey WHEN 2 THEN 'HTTP*://*/' || p_partkey || '[?#]*' WHEN 3 THEN 'en/' || p_partkey || '?PAGE=*' WHEN 4 THEN '*[!0-9]' || p_partkey || '?*[x-z]' ELSE '  ' END"""


@query(f"""WITH p AS (SELECT DISTINCT regexp_replace(lower(trim({_PATTERNS})), '^[.]/', '') AS p FROM part), t AS (SELECT p, regexp_matches(p, '[*?[]') AS wild FROM p WHERE p <> '')
SELECT page_id, EXISTS (SELECT 1 FROM t WHERE CASE WHEN wild THEN lower(url) GLOB p OR (starts_with(p, '*/') AND lower(url) GLOB p[3:]) ELSE contains(lower(url), p) END) AS excluded FROM pages""")
def excluded_by_table(spark, d):
    patterns = table(spark, d, "part").select(F.expr(_PATTERNS).alias("p"))
    return excluded_by(table(spark, d, "pages").select("page_id", "url"), "url", patterns).select("page_id", "excluded")


@query("SELECT page_id, regexp_replace(lower(replace(trim('  .\\' || url || ' '), '\\', '/')), '^\\./', '') AS pattern, regexp_matches(url, '[*?\\[]') AS is_glob FROM pages")
def normalize_pattern(spark, d):
    raw = F.concat(F.lit("  .\\"), F.col("url"), F.lit(" "))
    return table(spark, d, "pages").select("page_id", C.normalized_pattern(raw).alias("pattern"), C.is_glob(F.col("url")).alias("is_glob"))


@query("SELECT p_partkey, list_sort(list_distinct(['.' || lower(p_brand), '.' || lower(p_type)])) AS extensions FROM part")
def include_extensions(spark, d):
    raw = F.concat(F.lit(" ."), F.col("p_brand"), F.lit(", ,"), F.col("p_type"), F.lit(" ,"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.array_sort(C.include_extensions(raw)).alias("extensions"))


@query("SELECT p_partkey, [p_brand, p_type, p_name] AS patterns FROM part")
def split_patterns(spark, d):
    raw = F.array(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ,"), F.col("p_type")), F.lit(" , "), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", C.split_patterns(raw).alias("patterns"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN -(l_quantity + l_linenumber / 60.0::DOUBLE + l_linenumber / 3600.0::DOUBLE) ELSE l_quantity + l_linenumber / 60.0::DOUBLE + l_linenumber / 3600.0::DOUBLE END AS degrees, CASE WHEN l_tax = 0 THEN 0.0::DOUBLE ELSE l_discount / l_tax END AS ratio FROM lineitem")
def dms_to_deg(spark, d):
    value = C.dms_to_degrees(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_linenumber"))
    ref = F.when(F.col("l_returnflag") == "R", "s").otherwise("N")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.signed_degrees(value, ref).alias("degrees"), C.rational(F.col("l_discount"), F.col("l_tax")).alias("ratio"))


@query("SELECT event_id, 'mtime:' || floor(epoch(ts))::BIGINT || ':' || length(props) AS key FROM events")
def mtime_cache_key(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", C.cache_key("mtime", F.lit(""), seconds, F.length("props")).alias("key"))


@query("SELECT e.event_id, c.o_custkey IS NOT NULL AS cache_hit, c.result AS cached FROM events e LEFT JOIN (SELECT o_custkey, arg_min(nullif(o_orderstatus, 'P'), o_orderkey) FILTER (o_orderkey = first) AS result FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders) GROUP BY 1) c ON e.user_id = c.o_custkey")
def cache_lookup(spark, d):
    """All events against a cache of all orders by customer; some stored results are null."""
    files = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("sha256"), F.lit(0).alias("mtime"), F.lit(0).alias("size_bytes"))
    cache = table(spark, d, "orders").select(F.concat(F.lit("sha256:"), F.col("o_custkey").cast("string")).alias("key"), F.nullif("o_orderstatus", F.lit("P")).alias("result"), F.col("o_orderkey").alias("row_no"))
    return R.with_cache(files, cache).select("event_id", "cache_hit", "cached")


@query("SELECT count(*) AS entries, coalesce(sum(octet_length(encode(props))), 0)::BIGINT AS size FROM events")
def cache_stats(spark, d):
    return R.cache_stats(table(spark, d, "events").select(F.col("props").alias("result")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['has_gps', 'has_author'] WHEN doc_id % 3 = 1 THEN ['has_author'] ELSE [] END AS privacy_flags, CASE doc_id % 3 WHEN 0 THEN 50 WHEN 1 THEN 10 ELSE 0 END AS risk_score FROM documents")
def privacy_signals(spark, d):
    k = F.col("doc_id") % 3
    meta = F.when(k == 0, F.lit('{"gps":null,"docx_author":"a"}')).when(k == 1, F.lit('{"pdf_author":"b"}'))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), meta.alias("metadata"))
    return R.privacy_signals(docs).select(F.col("path").alias("doc_id"), "privacy_flags", "risk_score")


@query("SELECT event_id, '{\"mtime\":' || event_id || '}' AS metadata FROM events")
def sanitize_metadata(spark, d):
    meta = F.concat(F.lit('{"pdf_author": "x", "mtime": '), F.col("event_id").cast("string"), F.lit(', "gps_latitude": 1.5}'))
    return R.sanitize(table(spark, d, "events").select("event_id", meta.alias("metadata"))).select("event_id", "metadata")


@query("SELECT event_id AS path, 'mtime' AS key, floor(epoch(ts))::BIGINT::VARCHAR AS value FROM events")
def timeline(spark, d):
    meta = F.concat(F.lit('{"mtime":'), F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit("}"))
    return R.timeline(table(spark, d, "events").select(F.col("event_id").alias("path"), meta.alias("metadata")))


@query("SELECT doc_id, toxic, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'unknown' END AS error_code, 'label' AS stage FROM labels")
def structured_errors(spark, d):
    code = F.when(F.col("toxic") == 1, "toxic").otherwise("")
    errors = C.with_error(F.lit(None), code, F.lit("label"), F.lit("m"))
    return table(spark, d, "labels").select("doc_id", "toxic", errors[0]["error_code"].alias("error_code"), errors[0]["stage"].alias("stage"))


@query("SELECT o_orderkey, '{\"a\":' || o_orderkey || ',\"b\":{\"c\":null,\"d\":\"' || o_orderstatus || '\"}}' AS record FROM orders")
def canonical_json(spark, d):
    raw = F.concat(F.lit('{ "b": {"d": "'), F.col("o_orderstatus"), F.lit('", "c": null}, "a": '), F.col("o_orderkey").cast("string"), F.lit(" }"))
    return table(spark, d, "orders").select("o_orderkey", C.canonical_json(raw).alias("record"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", C.html_escaped(F.col("html")).alias("escaped"))


@query("SELECT o_orderkey, format('{:,}', o_orderkey) AS size FROM orders")
def size_thousands(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_number("o_orderkey", 0).alias("size"))


@query("SELECT c_custkey, c_name AS author, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '; ' || c_name ELSE 'docx' END AS software, CASE WHEN c_acctbal IS NULL THEN NULL ELSE 'unknown' END AS precision_flag FROM customer")
def normalize_identity(spark, d):
    even = F.col("c_custkey") % 2 == 0
    raw = table(spark, d, "customer").select(
        "c_custkey",
        F.when(even, F.struct(F.concat(F.lit(" "), F.col("c_name")).alias("Author"), F.col("c_mktsegment").alias("Creator"), F.col("c_name").alias("Producer"))).alias("pdf"),
        F.when(~even, F.struct(F.concat(F.col("c_name"), F.lit(" ")).alias("creator"))).alias("docx"),
        F.struct(F.col("c_acctbal").alias("lat")).alias("gps_norm"),
    )
    return normalize(raw).select("raw.c_custkey", "identity.author", "capture.software", "geo.precision_flag")


# A raw record for each order, in words that both dialects read: every field of every section, in turn as it should be, blank, of another kind, null and absent.
_KINDS = lambda good, k: f"""CASE (o_orderkey + {k}) % 7 WHEN 0 THEN '" A' || o_orderkey || ' "' WHEN 1 THEN '"  "' WHEN 2 THEN '' || o_orderkey WHEN 3 THEN 'null' WHEN 4 THEN '{{"a":1}}' WHEN 5 THEN 'true' ELSE {good} END"""
_NUMBERS = lambda k: f"""CASE (o_orderkey + {k}) % 7 WHEN 0 THEN '-' || o_orderkey WHEN 1 THEN '"7"' WHEN 2 THEN '12.25' WHEN 3 THEN 'null' WHEN 4 THEN '1.5e3' WHEN 5 THEN 'false' ELSE '' || (o_orderkey + 1) END"""
_FIELDS = {
    "exif": {"Make": 0, "Model": 1, "Software": 2}, "exif_times": {"DateTimeOriginal": 3, "DateTimeDigitized": 4}, "pdf": {"Author": 5, "Creator": 6, "Producer": 6}, "pdf_times": {"CreationDate": 8, "ModDate": 9},
    "docx": {"creator": 10, "lastModifiedBy": 11, "title": 12}, "docx_times": {"created": 13, "modified": 14}, "video": {"codec": 15, "container": 16, "container_created": 17},
}
_MEASURES = {"gps_norm": {"lat": 0, "lon": 1, "alt_m": 2, "dop": 3}, "video": {"duration_sec": 4, "width": 5, "height": 6}, "os_times": {"atime": 1, "mtime": 2, "ctime": 3}}


def _raw_record() -> str:
    sections = {}
    for fields, made in ((_FIELDS, lambda k: _KINDS("'\"docx z\"'", k)), (_MEASURES, _NUMBERS)):
        for section, own in fields.items():
            sections.setdefault(section, []).extend(f"""'"{name}":' || {made(k)}""" for name, k in own.items())
    parts = [f"""'"path":"p/' || o_orderkey || '","name":"' || o_orderstatus || '","size_bytes":' || o_custkey""", f"""'"hash_algo":' || {_KINDS("'\"sha256\"'", 3)} || ',"hash_hex":' || {_KINDS("'\"ab\"'", 4)}"""]
    for k, (section, own) in enumerate(sections.items()):
        whole = "'{' || " + " || ',' || ".join(own) + " || '}'"
        parts.append(f"""'"{section}":' || CASE (o_orderkey // 7 + {k}) % 5 WHEN 0 THEN '"text"' WHEN 1 THEN 'null' ELSE {whole} END""")
    return "CASE WHEN o_orderkey % 50 = 49 THEN 'no json' WHEN o_orderkey % 50 = 48 THEN '[1]' ELSE '{' || " + " || ',' || ".join(parts) + " || '}' END"


def _plain_sections() -> str:
    part = lambda s: f"json_type(j, '$.{s}') = 'OBJECT'"
    text = lambda *p: f"CASE WHEN json_type(j, '$.{'.'.join(p)}') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.{'.'.join(p)}'), '') END"
    trimmed = lambda *p: f"nullif(trim({text(*p)}), '')"
    number = lambda *p: f"CASE WHEN json_type(j, '$.{'.'.join(p)}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract_string(j, '$.{'.'.join(p)}')::DOUBLE END"
    whole = lambda *p: f"CASE WHEN json_type(j, '$.{'.'.join(p)}') IN ('BIGINT', 'UBIGINT') AND json_extract_string(j, '$.{'.'.join(p)}')::BIGINT > 0 THEN json_extract_string(j, '$.{'.'.join(p)}')::BIGINT END"
    times = lambda s, t, name: f"CASE WHEN {part(s)} THEN {text(t, name)} END"
    creator, producer = trimmed("pdf", "Creator"), trimmed("pdf", "Producer")
    soft = f"coalesce(CASE WHEN {creator} = {producer} THEN {creator} ELSE nullif(concat_ws('; ', {creator}, {producer}), '') END, {trimmed('exif', 'Software')})"
    lat, lon, alt, dop = (number("gps_norm", k) for k in ("lat", "lon", "alt_m", "dop"))
    columns = {
        "path": "json_extract_string(j, '$.path')", "name": "json_extract_string(j, '$.name')", "ext": "json_extract_string(j, '$.ext')", "size_bytes": "json_extract_string(j, '$.size_bytes')::BIGINT",
        "atime": number("os_times", "atime"), "mtime": number("os_times", "mtime"), "ctime": number("os_times", "ctime"), "hash_algo": f"CASE WHEN json_type(j, '$.hash_hex') = 'VARCHAR' THEN {text('hash_algo')} END", "hash_hex": f"CASE WHEN {text('hash_algo')} IS NOT NULL AND json_type(j, '$.hash_hex') = 'VARCHAR' THEN json_extract_string(j, '$.hash_hex') END",
        "make": trimmed("exif", "Make"), "model": trimmed("exif", "Model"), "software": f"CASE WHEN {part('docx')} AND NOT contains(lower(coalesce({soft}, '')), 'docx') THEN 'docx' ELSE {soft} END", "datetime_original": times("exif", "exif_times", "DateTimeOriginal"), "digitized": times("exif", "exif_times", "DateTimeDigitized"),
        "created": f"coalesce({times('pdf', 'pdf_times', 'CreationDate')}, {times('docx', 'docx_times', 'created')})", "modified": f"coalesce({times('pdf', 'pdf_times', 'ModDate')}, {times('docx', 'docx_times', 'modified')})",
        "lat": lat, "lon": lon, "alt_m": alt, "gps_dop": dop, "precision_flag": f"CASE WHEN {dop} IS NOT NULL THEN 'dop' WHEN coalesce({lat}, {lon}, {alt}) IS NOT NULL THEN 'unknown' END",
        "author": f"coalesce({trimmed('docx', 'creator')}, {trimmed('pdf', 'Author')})", "last_modified_by": trimmed("docx", "lastModifiedBy"), "title": trimmed("docx", "title"),
        "duration_sec": number("video", "duration_sec"), "width": whole("video", "width"), "height": whole("video", "height"), "codec": trimmed("video", "codec"), "container": trimmed("video", "container"), "container_created": text("video", "container_created"),
    }
    return ", ".join(f"{c} AS {name}" for name, c in columns.items())


@query(f"WITH r AS (SELECT o_orderkey, {_raw_record()} AS raw FROM orders), t AS (SELECT o_orderkey, raw, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM r) SELECT o_orderkey, raw, {_plain_sections()} FROM t")
def normalize_records(spark, d):
    raw = table(spark, d, "orders").select("o_orderkey", F.expr(_raw_record().replace("o_orderkey // 7", "(o_orderkey div 7)")).alias("raw"))
    sections = {"file": "path name ext size_bytes", "os_times": "atime mtime ctime", "capture": "make model software datetime_original", "meta_times": "digitized created modified", "geo": "lat lon alt_m gps_dop precision_flag", "identity": "author last_modified_by title", "media": "duration_sec width height codec container container_created"}
    fields = [f"{s}.{f}" for s, names in sections.items() for f in names.split()]
    return normalize_json(raw).select("o_orderkey", "raw", *fields, F.map_keys("hashes")[0].alias("hash_algo"), F.map_values("hashes")[0].alias("hash_hex"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN substr(url, 9) ELSE url END AS in_base, url AS without_base FROM pages WHERE NOT starts_with(url, 'https://') OR starts_with(url, 'https://m.')")
def relative_paths(spark, d):
    """Paths below a base, which has or hasn't a slash at its end; others stay as they are."""
    pages = table(spark, d, "pages").where(~F.col("url").startswith("https://") | F.col("url").startswith("https://m."))
    return pages.select("page_id", C.relative_path(F.col("url"), "https:/").alias("in_base"), C.relative_path(F.col("url"), None).alias("without_base")).withColumn("in_base", F.regexp_replace("in_base", "^/", ""))


@query("""WITH p AS (SELECT *, (l_quantity + l_linenumber / 60.0::DOUBLE + l_tax / 3600.0::DOUBLE) * CASE WHEN l_returnflag = 'A' THEN -1 ELSE 1 END AS lat, (l_linenumber + l_quantity / 60.0::DOUBLE + l_discount / 3600.0::DOUBLE) * CASE WHEN l_linestatus = 'O' THEN -1 ELSE 1 END AS lon FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN lat END AS gps_latitude, CASE WHEN l_returnflag <> 'R' THEN lon END AS gps_longitude FROM p""")
def positions(spark, d):
    """Degrees, minutes and seconds with their references; two parts instead of three are no position."""
    lat = F.array("l_quantity", F.col("l_linenumber").cast("double"), "l_tax")
    lat = F.when(F.col("l_returnflag") == "R", F.slice(lat, 1, 2)).otherwise(lat)
    lon = F.array(F.col("l_linenumber").cast("double"), "l_quantity", "l_discount")
    place = R.position(lat, F.when(F.col("l_returnflag") == "A", "south").otherwise("N"), lon, F.when(F.col("l_linestatus") == "O", "w"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", place.alias("p")).select("l_orderkey", "l_linenumber", "p.gps_latitude", "p.gps_longitude")


_MARKED = "SELECT s.*, l.toxic, l.quality FROM SCAN s LEFT JOIN labels l ON s.row_no = l.doc_id"


def _marked(spark, d):
    """documents_as_scan as whole records: warnings and errors by label (null without one), metadata of the size."""
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("row_no"), "toxic", "quality")
    warnings = F.when(F.col("quality").isNotNull(), F.array_compact(F.array(F.when(F.col("quality") == 0, "low"), F.when(F.col("toxic") == 1, "toxic"))))
    errors = F.array_compact(F.array(F.when(F.col("size_bytes") % 7 == 0, "e\\"))).cast("array<string>")
    metadata = F.concat(F.lit('{ "z": 1, "a": {"size": '), F.col("size_bytes").cast("string"), F.lit("} }"))
    return documents_as_scan(spark, d).join(marks, "row_no", "left").select("row_no", "path", "mime", "size_bytes", "sha256", metadata.alias("metadata"), warnings.alias("warnings"), errors.alias("errors"))


_QUOTED = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
_LINE = f"""'{{"errors":' || CASE WHEN size_bytes % 7 = 0 THEN '["e\\\\"]' ELSE '[]' END || ',"metadata":' || coalesce('{{"a":{{"size":' || size_bytes || '}},"z":1}}', '{{}}') || ',"mime":' || {_QUOTED("mime")} || ',"path":' || {_QUOTED("path")} || ',"sha256":' || {_QUOTED("sha256")}
|| ',"size_bytes":' || coalesce(size_bytes || '', 'null') || ',"warnings":' || CASE WHEN quality IS NULL THEN 'null' ELSE '[' || concat_ws(',', CASE WHEN quality = 0 THEN '"low"' END, CASE WHEN toxic = 1 THEN '"toxic"' END) || ']' END || '}}'"""


@query(f"WITH m AS ({_MARKED}) SELECT {_LINE} AS value FROM m WHERE path IS NOT NULL")
def record_lines(spark, d):
    return record_json(_marked(spark, d).where("path is not null"))


@query(f"WITH m AS ({_MARKED}) SELECT row_number() OVER (ORDER BY path) - 1 AS row_no, path, mime, size_bytes, sha256, coalesce('{{\"a\":{{\"size\":' || size_bytes || '}},\"z\":1}}', '{{}}') AS metadata, {_LINE} AS record FROM m WHERE path IS NOT NULL AND size_bytes IS NOT NULL")
def jsonl_round_trip(spark, d):
    """Records written as a folder of lines, in path order, and read with the numbers of their lines."""
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    write_jsonl(_marked(spark, d).where("path is not null and size_bytes is not null"), path)
    return read_jsonl(spark, path).select("row_no", "path", "mime", "size_bytes", "sha256", "metadata", "record")


@query("SELECT row_number() OVER (ORDER BY row_no) - 1 AS line, coalesce(sha256, '') AS sha256, coalesce(path, '') AS path FROM SCAN")
def bundle_round_trip(spark, d):
    """A case bundle of all documents, packed by tasks, and its hashes read back in parts."""
    path = f"{local_path(shared_folder(spark))}/case-{uuid.uuid4().hex}.zip"
    case_bundle.export_bundle(_marked(spark, d), path, notes="n")
    parts = F.split("value", "\\t", 2)
    return member_lines(spark, path, "hashes.txt").select(F.col("row_no").alias("line"), parts[0].alias("sha256"), parts[1].alias("path"))


@query("""WITH c AS (SELECT 'k' || o_custkey AS key, o_orderkey AS row_no, o_orderstatus AS metadata, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders)
SELECT DISTINCT e.user_id, c.row_no, c.metadata FROM events e JOIN c ON c.key = 'k' || e.user_id AND c.row_no = c.first""")
def cache_round_trip(spark, d):
    """A keyed cache with all orders' states by customer, added in two turns and merged, probed with all users of events."""
    cache = CacheTable(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}")
    orders = table(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderstatus").alias("metadata"), F.array().cast("array<string>").alias("warnings"), F.lit("r").alias("run"), F.col("o_orderkey").alias("row_no"))
    cache.add(orders.where("row_no % 2 = 1"))
    cache.add(orders.where("row_no % 2 = 0"))
    cache.compact(files=1)
    found = cache.probe(table(spark, d, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key")))
    return found.select(F.expr("substring(key, 2)").cast("long").alias("user_id"), "row_no", "metadata")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '{"kept":' || o_custkey || '}' WHEN o_orderstatus = 'O' THEN '{"a":"' || o_orderpriority || '","kept":' || o_custkey || '}' ELSE '{}' END AS metadata FROM orders""")
def sanitize_orders(spark, d):
    """Metadata of several shapes without the private keys."""
    author, gps = F.col("o_orderpriority").alias("pdf_author"), F.col("o_totalprice").alias("gps_latitude")
    kept = F.col("o_custkey").alias("kept")
    meta = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(kept, author, gps))).when(F.col("o_orderstatus") == "O", F.to_json(F.struct(kept, gps, F.col("o_orderpriority").alias("a")))).otherwise(F.to_json(F.struct(author)))
    return R.sanitize(table(spark, d, "orders").select("o_orderkey", meta.alias("metadata"))).select("o_orderkey", "metadata")


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus IN ('F', 'O') AND o_orderkey % 11 <> 0 AS gps, o_orderstatus <> 'O' AND o_orderkey % 11 <> 0 AS author FROM orders)
SELECT o_orderkey, list_filter([CASE WHEN gps THEN 'has_gps' END, CASE WHEN author THEN 'has_author' END], lambda x: x IS NOT NULL) AS privacy_flags, CASE WHEN gps THEN 40 ELSE 0 END + CASE WHEN author THEN 10 ELSE 0 END AS risk_score,
list_filter([CASE WHEN gps THEN 'GPS_PRESENT' END, CASE WHEN author THEN 'AUTHOR_PRESENT' END], lambda x: x IS NOT NULL) AS reason_codes FROM s""")
def signals_of_orders(spark, d):
    """Signals of metadata of several shapes; what isn't JSON signals nothing."""
    author, gps = F.col("o_orderpriority"), F.col("o_totalprice")
    status = F.col("o_orderstatus")
    meta = F.when(F.col("o_orderkey") % 11 == 0, "no json").when(status == "F", F.to_json(F.struct(author.alias("docx_author"), gps.alias("gps_latitude")))).when(status == "O", F.to_json(F.struct(F.struct(gps.alias("lat")).alias("gps")))).otherwise(F.to_json(F.struct(author.alias("author"))))
    return R.privacy_signals(table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), meta.alias("metadata"))).withColumnRenamed("path", "o_orderkey")
