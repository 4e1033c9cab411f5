import hashlib
import json
import os
import tracemalloc
import zipfile
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sedgewire.operators import case_bundle
from sedgewire.sources import deflate_runs, line_table
from sedgewire.sources.deflate_runs import Member, crc_of_both, member_lines, pack_lines, staging_folder, text_run, write_zip
from sedgewire.sources.files import FileTree
from sedgewire.sources.jsonl import read_jsonl, write_jsonl
from sedgewire.sources.line_table import read_index


def _lines(spark, n, parts=5):
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("line é "), F.col("id").cast("string")).alias("value"))


def _read(spark, path):
    return [(r.row_no, r.value) for r in spark.read.format("line_table").load(path).collect()]


def test_line_table_keeps_order_and_numbers(spark, tmp_path):
    line_table.register(spark)
    path = str(tmp_path / "t")
    write = lambda df, mode: df.write.format("line_table").option("runBytes", "300").mode(mode).save(path)
    write(_lines(spark, 1000), "overwrite")
    assert _read(spark, path) == [(k, f"line é {k}") for k in range(1000)]
    assert spark.read.format("line_table").load(path).rdd.getNumPartitions() > 20  # parts are split by their runs
    write(_lines(spark, 3), "append")
    assert _read(spark, path)[998:] == [(998, "line é 998"), (999, "line é 999"), (1000, "line é 0"), (1001, "line é 1"), (1002, "line é 2")]
    write(_lines(spark, 2), "overwrite")
    assert _read(spark, path) == [(0, "line é 0"), (1, "line é 1")]
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == sorted(["_index.json", *(p["file"] for p in read_index(path))])
    write(_lines(spark, 2).limit(0), "overwrite")
    assert _read(spark, path) == []
    with pytest.raises(PySparkException):
        spark.range(1).write.format("line_table").mode("overwrite").save(path)


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    line_table.register(spark)
    path = str(tmp_path / "t")
    _lines(spark, 10).write.format("line_table").mode("overwrite").save(path)
    before = {p.name: p.read_bytes() for p in (tmp_path / "t").iterdir()}
    failing = _lines(spark, 1000).select(F.when(F.col("value").endswith("999"), F.raise_error(F.lit("no"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(PySparkException):
        failing.write.format("line_table").mode("overwrite").save(path)
    assert {p.name: p.read_bytes() for p in (tmp_path / "t").iterdir()} == before
    assert len(_read(spark, path)) == 10


def test_jsonl_folder_numbers_its_lines(spark, tmp_path):
    scan = spark.range(500).selectExpr("concat('p', lpad(id, 3, '0')) AS path", "'m' AS mime", "id AS size_bytes", "'h' AS sha256", "if(id = 3, 'no json', '{\"a\": 1}') AS metadata", "array() AS warnings", "array() AS errors").repartition(6)
    write_jsonl(scan, str(tmp_path / "s"))
    rows = read_jsonl(spark, str(tmp_path / "s")).orderBy("row_no").collect()
    assert [(r.row_no, r.path) for r in rows] == [(k, f"p{k:03}") for k in range(500)] and rows[3].metadata == "{}" and rows[4].metadata == '{"a":1}'


def test_crc_of_both():
    for a, b in ((b"", b""), (b"x", b""), (b"", b"abc"), (b"hello " * 99, b"world" * 12345)):
        assert crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_zip_of_runs_is_a_plain_zip(spark, tmp_path):
    lines = [f"{hashlib.sha256(b'%d' % k).hexdigest()}\tpath {k}" for k in range(20_000)]
    path = str(tmp_path / "a.zip")
    frame = spark.createDataFrame([(k, x + "\n") for k, x in enumerate(lines)], "k long, v string").repartition(3).orderBy("k").select("v")
    with staging_folder(spark) as folder:
        write_zip(path, [Member("empty.txt"), pack_lines(frame, "hashes.txt", folder, run_bytes=50_000), Member("ü/note.txt", [text_run("a\n"), text_run("b\n")])])
    assert not os.path.exists(folder)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == ["empty.txt", "hashes.txt", "ü/note.txt", "runs.json"]
        assert z.read("hashes.txt").decode().splitlines() == lines and z.read("ü/note.txt") == b"a\nb\n" and z.read("empty.txt") == b""
    parts = member_lines(spark, path, "hashes.txt", bytesPerPartition="60000")
    assert parts.rdd.getNumPartitions() > 5 and [(r.row_no, r.value) for r in parts.collect()] == list(enumerate(lines))
    assert member_lines(spark, path, "empty.txt").count() == 0
    with pytest.raises(PySparkException):
        member_lines(spark, path, "none").count()
    for kind in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_LZMA):  # packed by another program
        with zipfile.ZipFile(tmp_path / "b.zip", "w", kind) as z:
            z.writestr("hashes.txt", "\r\n".join(lines[:5000]) + "\n\nlast")
        assert [r.value for r in member_lines(spark, str(tmp_path / "b.zip"), "hashes.txt").collect()] == [*lines[:5000], "", "last"]
    with pytest.raises(OSError):
        write_zip(str(tmp_path / "c.zip"), [Member("x", [deflate_runs.PackedRun(0, 1, 5, 1, file=str(tmp_path / "gone"))])])
    assert sorted(p.name for p in tmp_path.glob("*.zip*")) == ["a.zip", "b.zip"]


def test_many_hashes_are_verified_without_a_driver_list(spark, tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "here").write_text("x")
    spark.dataSource.register(FileTree)
    path, n = str(tmp_path / "a.zip"), 1_000_000
    lines = spark.range(n).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("\tgone "), F.col("id").cast("string"), F.lit("\n"))).union(spark.sql("SELECT concat(sha2('x', 256), '\there\n')"))
    tracemalloc.start()
    with staging_folder(spark) as folder:
        write_zip(path, [pack_lines(lines, "hashes.txt", folder)])
    issues = case_bundle.verify_bundle(spark, path, str(tmp_path / "root")).groupBy("issue").count().collect()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [tuple(r) for r in issues] == [("missing", n)] and peak < 100 << 20


def test_bundle_with_files(spark, tmp_path):
    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    big = os.urandom(3 << 20) + b"a" * (2 << 20)
    for name, data in (("a", b"x"), ("d/é", big), ("empty", b"")):
        (root / name).write_bytes(data)
    rows = [(0, "a", "h0"), (1, "d/é", None), (2, "empty", 'q"'), (3, "gone", "h"), (4, "../x", "h"), (5, "d", "h"), (6, "a", "h0")]
    scan = spark.createDataFrame(rows, "row_no long, path string, sha256 string").selectExpr("*", "'m' AS mime", "1L AS size_bytes", "'{\"pdf_author\":\"me\"}' AS metadata", "array('w') AS warnings", "array() AS errors")
    out = str(tmp_path / "c" / "case.zip")
    case_bundle.export_bundle(scan, out, notes=None, redact=True, files_base=str(root), case_id="k")
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and {n for n in z.namelist() if n.startswith("files/")} == {"files/a", "files/d/é", "files/empty"}
        assert z.read("files/d/é") == big
        head = json.loads(z.read("manifest.json"))
        assert (head["case_id"], head["notes"], head["record_count"], head["hashes"], head["redacted"]) == ("k", None, 7, ["h0", "", 'q"', "h", "h", "h", "h0"], True)
        assert z.read("hashes.txt").decode().splitlines()[1] == "\td/é" and b"pdf_author" in z.read("scan.jsonl") and b"pdf_author" not in z.read("scan.redacted.jsonl")
        assert json.loads(z.read("reports/report.json"))["warning_counts"] == {"w": 7}
    case_bundle.export_bundle(scan.limit(0), out)
    with zipfile.ZipFile(out) as z:
        assert json.loads(z.read("manifest.json"))["hashes"] == [] and z.read("hashes.txt") == b""
    assert case_bundle.bundle_hashes(spark, out).count() == 0


def test_keyed_cache_prunes_merges_and_cleans_up(spark, tmp_path):
    from sedgewire.sources.cache import CacheTable

    cache = CacheTable(spark, str(tmp_path / "c"))
    assert cache.compact() == 0 and cache.probe(spark.createDataFrame([("x",)], "key string")).count() == 0
    made = lambda k: spark.range(20_000).select(F.concat(F.lit("sha256:"), F.sha2(F.col("id").cast("string"), 256)).alias("key"), F.lit(f"v{k}").alias("metadata"), F.array(F.lit("w")).alias("warnings"), F.lit("r").alias("run"), F.lit(k).cast("long").alias("row_no"))
    cache.add(made(2))
    cache.add(made(1).limit(10_000))
    cache.add(spark.createDataFrame([("mtime:1:2", None, None, "r", 0)], "key string, metadata string, warnings array<string>, run string, row_no long"))
    keys = made(0).select("key").orderBy("key").limit(200)  # a hundredth, by key
    found = cache.probe(keys).collect()
    assert len(found) == 200 and {r.metadata for r in found} == {"v1", "v2"}
    ranges = [r.prefix for r in keys.selectExpr("substring(key, 8, 2) AS prefix").distinct().collect()]
    all_files = len(list((tmp_path / "c" / "entries").rglob("*.parquet")))
    read = cache.entries(ranges).inputFiles()
    assert all_files > 250 and 0 < len([f for f in read if any(f"prefix={p}/" in f for p in ranges)]) < all_files / 10
    plan = cache.probe(keys)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan or "prefix" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert cache.probe(spark.createDataFrame([("mtime:1:2",)], "key string")).first().metadata is None
    before = {r.key: r.metadata for r in cache.probe(made(0)).collect()}
    assert cache.compact(files=1) > 200 and cache.stats()[0] == 20_001
    assert {r.key: r.metadata for r in cache.probe(made(0)).collect()} == before and cache.compact(files=1) == 0
    (tmp_path / "root").mkdir()
    (tmp_path / "root" / "a.txt").write_text("a")
    spark.dataSource.register(FileTree)
    with cache:
        assert cache.scan(str(tmp_path / "root")).count() == 1
    assert list((tmp_path / "c" / "runs").iterdir()) == []
