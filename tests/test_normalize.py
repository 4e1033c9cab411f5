import hashlib
import json

import pytest

from sedgewire.operators.normalize import normalize, normalize_json
from sedgewire.sources.files import RawRecords


def _one(spark, raw):
    text = raw if isinstance(raw, str) or raw is None else json.dumps(raw)
    return normalize_json(spark.createDataFrame([(text,)], "raw string")).first()


def test_wrong_kinds_give_nulls(spark):
    r = _one(spark, {"path": "p", "size_bytes": "x", "exif": {"Make": 5, "Model": "  ", "Software": ["s"]}, "gps_norm": {"lat": "1", "lon": True, "dop": 2}, "video": {"duration_sec": "abc", "width": 1.5, "height": -3, "codec": {}}, "docx": [1], "pdf": "text", "hash_algo": 1, "hash_hex": "ab", "os_times": "now"})
    assert r.file.path == "p" and r.file.size_bytes is None and tuple(r.capture) == (None,) * 4 and tuple(r.geo) == (None, None, None, 2.0, "dop")
    assert tuple(r.media) == (None,) * 6 and tuple(r.identity) == (None,) * 3 and r.hashes is None and r.os_times is None


def test_sources_of_a_field_take_turns(spark):
    pdf, docx = {"Author": " pa ", "Creator": "c", "Producer": "c"}, {"creator": " ", "title": "t"}
    r = _one(spark, {"pdf": pdf, "pdf_times": {"CreationDate": "k1", "ModDate": ""}, "docx": docx, "docx_times": {"created": "w1", "modified": "w2"}, "exif_times": {"DateTimeOriginal": "no exif"}})
    assert tuple(r.capture) == (None, None, "docx", None) and tuple(r.meta_times) == (None, "k1", "w2") and tuple(r.identity) == ("pa", None, "t")
    assert _one(spark, {"pdf": pdf | {"Producer": "Docx Maker"}, "docx": {}}).capture.software == "c; Docx Maker"
    assert _one(spark, {"pdf": {}, "exif": {"Software": " s "}}).capture.software == "s"


@pytest.mark.parametrize("raw", [None, "", "no json", "[1]", "3", "null", "{}"])
def test_what_is_no_record_has_no_sections(spark, raw):
    r = _one(spark, raw)
    assert r.raw == raw and all(v is None for part in (r.file, r.capture, r.meta_times, r.geo, r.identity, r.media) for v in part) and r.hashes is None


def test_columns_and_json_agree(spark):
    rows = spark.sql("SELECT 'p' AS path, named_struct('lat', 1.5D, 'dop', CAST(NULL AS DOUBLE)) AS gps_norm, named_struct('width', 7, 'duration_sec', 2L) AS video, 'md5' AS hash_algo, '' AS hash_hex")
    a = normalize(rows).drop("raw").first()
    b = normalize_json(rows.selectExpr("to_json(struct(*)) AS raw", "1 AS FILE", "2 AS kept")).drop("raw")
    assert b.columns[0] == "kept" and b.drop("kept").first() == a and a.media.width == 7 and a.media.duration_sec == 2.0 and a.geo.precision_flag == "unknown" and a.hashes == {"md5": ""}


def test_raw_records_of_a_tree(spark, tmp_path):
    (tmp_path / "A.TXT").write_text("x")
    (tmp_path / "ü").write_text("")
    spark.dataSource.register(RawRecords)
    read = lambda **o: spark.read.format("raw_records").options(root=str(tmp_path), **o).load()
    raw = {json.loads(r.raw)["name"]: json.loads(r.raw) for r in read(hashAlgo=" MD5 ").collect()}
    assert raw["A.TXT"]["path"] == str(tmp_path / "A.TXT") and (raw["A.TXT"]["ext"], raw["A.TXT"]["hash_algo"], raw["A.TXT"]["hash_hex"]) == (".txt", " MD5 ", hashlib.md5(b"x").hexdigest())
    assert raw["ü"]["size_bytes"] == 0 and raw["ü"]["errors"] == [] and set(raw["ü"]["os_times"]) == {"atime", "mtime", "ctime"}
    r = normalize_json(read(hashAlgo="sha256", include=".txt")).first()
    assert r.file.name == "A.TXT" and r.file.size_bytes == 1 and r.hashes == {"sha256": hashlib.sha256(b"x").hexdigest()} and r.os_times.mtime > 0
    assert "hash_hex" not in json.loads(read().first().raw)
    with pytest.raises(Exception):  # noqa: B017 whatever Spark wraps it in
        read(hashAlgo="crc").collect()
