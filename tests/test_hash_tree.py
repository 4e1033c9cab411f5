import hashlib

from pyspark.sql import functions as F

from sedgewire.operators import hash_tree, records
from sedgewire.operators.case_bundle import render_html
from sedgewire.operators.ordering import numbered


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _plain_root(values):
    level = values
    for _ in range(hash_tree.LEVELS):
        level = [_sha(",".join(level[i : i + 1024])) for i in range(0, len(level), 1024)]
    return level[0] if level else None


def test_root_equals_plain_digests(spark):
    values = [None if k % 50 == 7 else _sha(str(k)) for k in range(5000)]
    scan = spark.createDataFrame(list(enumerate(values)), "row_no long, sha256 string").repartition(7)
    assert tuple(records.manifest_digest(scan).first()) == (5000, 5, _plain_root([v or "" for v in values]))
    assert tuple(records.manifest_digest(scan.limit(0)).first()) == (0, 0, None)
    assert hash_tree.build(scan)[-1].first().digest == _plain_root([v or "" for v in values])


def test_changed_ranges_and_rows(spark, tmp_path):
    old = spark.range(3_000_000).select(F.col("id").alias("row_no"), F.md5(F.col("id").cast("string")).alias("sha256"))
    new = old.where("row_no <> 5").withColumn("sha256", F.when(F.col("row_no") == 2_000_000, "x").otherwise(F.col("sha256"))).union(spark.sql("SELECT 9000000L, 'y'"))
    a, b = hash_tree.build(old, path=str(tmp_path / "a")), hash_tree.build(new)
    ranges = hash_tree.changed_ranges(hash_tree.stored(spark, str(tmp_path / "a")), b)
    found = {r.first_row // 1024: (r.last_row - r.first_row, r.old_rows, r.new_rows) for r in ranges.collect()}
    assert found == {0: (1023, 1024, 1023), 1953: (1023, 1024, 1024), 9_000_000 // 1024: (1023, 0, 1)}
    rows = {r.row_no: (r.old, r.new) for r in hash_tree.changed_rows(old, new, ranges).collect()}
    assert rows == {5: (hashlib.md5(b"5").hexdigest(), None), 2_000_000: (hashlib.md5(b"2000000").hexdigest(), "x"), 9_000_000: (None, "y")}
    assert hash_tree.changed_ranges(a, a).count() == 0


def test_numbered_is_dense_over_many_partitions(spark):
    rows = spark.range(20_000).selectExpr("id * 7919 % 20000 AS k", "'x' AS Row_No").repartition(13)
    got = [(r.k, r.row_no) for r in numbered(rows, "k").collect()]
    assert sorted(got) == [(k, k) for k in range(20_000)]
    assert sorted(r.row_no for r in numbered(spark.range(50).selectExpr("1 AS k"), F.desc("k")).collect()) == list(range(50))
    assert numbered(rows.limit(0), "k").count() == 0


def test_findings_tolerate_anything_and_read_the_scan_once(spark):
    scan = spark.createDataFrame(
        [
            (0, "image/png", 5, '{"author":"ann","gps":null}', ["w"], None), (1, None, None, "no json", None, ["e", None]), (2, "image/png", 7, '{"docx_author":"<b>","gps_latitude":1.5}', ["w", "v"], []),
            (3, "", 1, '{"pdf_author":"","author":7,"exif_model":"m"}', [], ["e"]), (4, "a", 2, "[1]", ["v"], []),
        ],
        "row_no long, mime string, size_bytes long, metadata string, warnings array<string>, errors array<string>",
    )
    rows = sorted((r.kind, r["rank"] or 0, r.value, r.n) for r in records.findings(scan).collect())
    assert rows == [
        ("author", 1, "ann", 1), ("author", 2, "<b>", 1), ("author", 3, "7", 1), ("distinct", 0, "author", 3), ("distinct", 0, "model", 1), ("error", 1, "e", 2), ("error", 2, "", 1), ("gps", 1, "", 2),
        ("mime", 1, "", 2), ("mime", 2, "a", 1), ("mime", 3, "image/png", 2), ("model", 1, "m", 1), ("warning", 1, "w", 2), ("warning", 2, "v", 2),
    ]
    assert [r.value for r in records.findings(scan, n=1, strict=True).where("kind = 'author'").collect()] == ["ann"]
    plan = records.value_counts(scan)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1 and plan.count("HashAggregate") <= 3
    page = render_html(scan.withColumn("path", F.lit("<p>")))
    assert "Distinct authors: <b>3</b>" in page and "&lt;b&gt;: <b>1</b>" in page and "Total size: <b>15 bytes" in page and "Files with GPS: <b>2</b>" in page
    empty = render_html(scan.limit(0).withColumn("path", F.lit("p")))
    assert "Files: <b>0</b>" in empty and "<li>none</li>" in empty and records.build_report(scan.limit(0)).first().total_files == 0


def test_diff_summary_lists_every_path_in_order(spark):
    paths = [f"d/é{k}" for k in range(3_000)]
    changes = spark.createDataFrame([(p, "added") for p in paths] + [("Z", "changed"), ("a", "changed")], "path string, status string").repartition(7)
    rows = sorted((r.status, r.place or 0, r.path, r.n, r.digest) for r in records.diff_summary(changes).collect())
    listed = [("added", k, p, 3_000, _plain_root(sorted(paths))) for k, p in enumerate(sorted(paths), 1)]
    listed += [("changed", k, p, 2, _plain_root(["Z", "a"])) for k, p in enumerate(["Z", "a"], 1)]
    assert rows == [*listed, ("removed", 0, None, 0, None)]
    assert sorted(tuple(r) for r in records.diff_summary(changes.limit(0)).collect()) == [(s, 0, None, None, None) for s in ("added", "changed", "removed")]
