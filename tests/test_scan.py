import hashlib
import json
import struct
import zipfile
import zlib

import pytest

from sedgewire import catalog, cli
from sedgewire.operators import case_bundle, records
from sedgewire.operators.normalize import normalize
from sedgewire.sources.cache import CacheTable
from sedgewire.sources import extractors
from sedgewire.sources.extractors import exif
from sedgewire.sources.files import FileTree
from sedgewire.sources.jsonl import read_jsonl, record_json, write_single_file


def _png(path):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 32, 8, 2, 0, 0, 0)) + chunk(b"IEND", b""))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "sub dir").mkdir(parents=True)
    (root / ".hidden.txt").write_text("hello")
    (root / "_u.txt").write_text("hello")
    (root / "empty.txt").write_text("")
    (root / "bad.jpg").write_bytes(b"no image")
    _png(root / "sub dir" / "ü%.png")
    (root / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj<</Type /Pages>>\n2 0 obj<</Type /Page>>\n3 0 obj<</Title (T\\(x\\)) /Author <FEFF00E9>>>\n")
    with zipfile.ZipFile(root / "d.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p/><w:p/></w:body></w:document>")
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>me</dc:creator></c>')
    return root


def _scan(spark, root, **options):
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").options(root=str(root), **options).load()


def test_tree_keeps_hidden_empty_and_bad_files(spark, tree):
    rows = {r.path: r for r in _scan(spark, tree).collect()}
    assert sorted(rows) == [".hidden.txt", "_u.txt", "a.pdf", "bad.jpg", "d.docx", "empty.txt", "sub dir/ü%.png"]
    assert rows["bad.jpg"].errors == ["extract_failed:ValueError"] and list(json.loads(rows["bad.jpg"].metadata)) == ["mtime"]
    assert json.loads(rows["sub dir/ü%.png"].metadata)["width"] == 64
    pdf = json.loads(rows["a.pdf"].metadata)
    assert (pdf["pages"], pdf["pdf_title"], pdf["pdf_author"]) == (1, "T(x)", "é")
    docx = json.loads(rows["d.docx"].metadata)
    assert (docx["docx_paragraphs"], docx["docx_author"], docx["docx_title"]) == (2, "me", "")
    assert _scan(spark, tree, include="PNG", exclude="*/none").count() == 1
    assert _scan(spark, tree / "missing").count() == 0
    assert [r.path for r in _scan(spark, tree / "a.pdf").collect()] == ["a.pdf"]


def test_exif_position():
    def entry(tag, kind, count, value):
        return struct.pack("<HHI", tag, kind, count) + value

    gps = struct.pack("<H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, struct.pack("<I", 100)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, struct.pack("<I", 124)) + b"\0" * 4
    block = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + entry(0x8825, 4, 1, struct.pack("<I", 26)) + b"\0" * 4
    block = (block + gps).ljust(100, b"\0") + struct.pack("<6I", 37, 1, 34, 1, 0, 0) + struct.pack("<6I", 126, 1, 58, 1, 0, 1)
    found = exif(block)
    assert found["gps_latitude"] == pytest.approx(-37.5666667) and found["gps_longitude"] == pytest.approx(126.9666667)


def test_jsonl_round_trip_diff_and_bundle(spark, tree, tmp_path):
    scan = _scan(spark, tree)
    out = tmp_path / "s.jsonl"
    write_single_file(record_json(scan), str(out))
    out.write_text(out.read_text() + "\n \t\n")
    rows = read_jsonl(spark, str(out))
    assert rows.count() == 7
    assert records.diff(rows, rows).count() == 0
    other = rows.where("path <> 'a.pdf'")
    assert [tuple(r) for r in records.diff(rows, other).collect()] == [("a.pdf", "removed")]
    assert json.loads(case_bundle.report_json(rows))["total_files"] == 7
    assert "<h2>Errors</h2>" in case_bundle.render_html(rows)
    bundle = tmp_path / "case.zip"
    case_bundle.export_bundle(rows, str(bundle), redact=True, files_base=str(tree))
    with zipfile.ZipFile(bundle) as z:
        assert {"manifest.json", "scan.jsonl", "hashes.txt", "reports/report.json", "scan.redacted.jsonl", "files/a.pdf"} <= set(z.namelist())
        assert "pdf_author" not in z.read("scan.redacted.jsonl").decode()
    assert case_bundle.bundle_hashes(spark, str(bundle)).count() == 7
    assert cli.main(["verify", str(out), "--base", str(tree)]) == 0
    (tree / "a.pdf").write_text("changed")
    assert cli.main(["verify", str(out), "--base", str(tree)]) == 2


def test_manifest_report_and_diff_by_ranges(spark, tmp_path, monkeypatch, capsys):
    lines = [(k, None if k % 50 == 7 else hashlib.sha256(b"%d" % k).hexdigest(), f"d/é{k}") for k in range(2_000)]
    scan = spark.createDataFrame(lines, "row_no long, sha256 string, path string").repartition(7)
    scan = scan.selectExpr("*", "'m' AS mime", "1L AS size_bytes", "'{}' AS metadata", "array() AS warnings", "array('e') AS errors")
    hashes = [h or "" for _, h, _ in lines]
    out = tmp_path / "s.jsonl"
    write_single_file(record_json(scan), str(out))
    none = tmp_path / "none.jsonl"
    none.write_text("")

    with monkeypatch.context() as m:
        m.setattr(case_bundle, "report_json", lambda _: "{}")
        case_bundle.export_bundle(scan, str(tmp_path / "case.zip"), notes="n")
        capsys.readouterr()
        assert cli.main(["diff", str(none), str(out)]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told == {"added": sorted(p for _, _, p in lines), "changed": [], "removed": []}
    with zipfile.ZipFile(tmp_path / "case.zip") as z:
        raw = z.read("manifest.json").decode()
    head = json.loads(raw)
    assert raw == json.dumps(head, ensure_ascii=False, indent=2) + "\n"
    assert list(head) == ["case_id", "created_at", "notes", "record_count", "hashes", "redacted"] and head["hashes"] == hashes
    assert sum(line.startswith("<tr><td>") for line in case_bundle.html_lines(scan)) == 2_000


def test_paths_outside_the_base(tmp_path):
    assert case_bundle.inside(str(tmp_path), "../x") is None and case_bundle.inside(str(tmp_path), "/etc/passwd") is None


def test_cache_saves_extraction(spark, tree, tmp_path):
    spark.dataSource.register(FileTree)
    cache = CacheTable(spark, str(tmp_path / "cache"))
    extracted = lambda: [spark.read.parquet(str(p)).count() for p in sorted((tmp_path / "cache" / "runs").glob("*/extracted"), key=lambda p: p.stat().st_mtime)][-1]

    def run():
        rows = {r.path: r for r in cache.scan(str(tree)).collect()}
        plain = {r.path: r for r in _scan(spark, tree).collect()}
        assert sorted(rows) == sorted(plain)
        for path, r in rows.items():
            told = json.loads(r.metadata)
            told.pop("cache_hit", None)
            assert (told, r.errors, r.sha256, r.size_bytes) == (json.loads(plain[path].metadata), plain[path].errors, plain[path].sha256, plain[path].size_bytes)
        return sorted(p for p, r in rows.items() if "cache_hit" in r.metadata)

    assert run() == ["_u.txt"] and extracted() == 6
    assert cache.stats()[0] == 5  # the bad file isn't kept
    assert len(run()) == 6 and extracted() == 1
    assert [r.path for r in cache.scan(str(tree / "a.pdf")).collect()] == ["a.pdf"] and extracted() == 0
    cache.purge()
    assert cache.stats() == (0, 0)


def test_last_row_wins_over_a_folder_of_unequal_files(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    row = lambda path, size: json.dumps({"path": path, "size_bytes": size}) + "\n"
    (folder / "part-0.txt").write_text(row("a", 1) + row("b", 1))
    (folder / "part-1.txt").write_text(row("a", 2) + "".join(row(f"x{i}", 0) for i in range(5_000)))
    (folder / "part-2.txt").write_text(row("a", 3))
    best = {r.path: r.size_bytes for r in records.last_wins(read_jsonl(spark, str(folder))).where("path in ('a', 'b')").collect()}
    assert best == {"a": 3, "b": 1}


def test_readable_and_limits(spark, tree):
    from sedgewire.sources.files import readable

    paths = spark.createDataFrame([(str(tree / "a.pdf"),), (str(tree),), (str(tree / "none"),), (None,)], "p string")
    assert [tuple(r) for r in paths.select(readable("p").alias("r")).select("r.*").collect()] == [(True, None), (False, "not_a_file"), (False, "missing"), (False, "missing")]
    scan = _scan(spark, tree, folders="1")
    assert [r.path for r in records.limited(scan, 2).collect()] == ["_u.txt", "a.pdf"]
    assert [r.path for r in records.limited(scan, 1, include_hidden=True).collect()] == [".hidden.txt"]
    assert sorted(r.path for r in _scan(spark, tree, folders="100").collect()) == sorted(r.path for r in scan.collect())


def test_verify_bundle_diff_out_and_case_id(spark, tree, tmp_path, capsys):
    scan, bundle, lines = tmp_path / "s.jsonl", tmp_path / "c.zip", tmp_path / "d.json"
    write_single_file(record_json(_scan(spark, tree)), str(scan))
    assert cli.main(["export-case", str(scan), "--out", str(bundle), "--case-id", "case-7"]) == 0
    with zipfile.ZipFile(bundle) as z:
        assert json.loads(z.read("manifest.json"))["case_id"] == "case-7"
    (tree / "a.pdf").write_text("changed")
    (tree / "_u.txt").unlink()
    assert [tuple(r) for r in case_bundle.verify_bundle(spark, str(bundle), str(tree)).orderBy("path").collect()] == [("_u.txt", "missing"), ("a.pdf", "hash_mismatch")]
    assert case_bundle.verify_bundle(spark, str(bundle)).count() == 0
    capsys.readouterr()
    assert cli.main(["verify", str(scan), "--base", str(tree)]) == 2
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines()] == [{"issue": "missing", "path": "_u.txt"}, {"issue": "hash_mismatch", "path": "a.pdf"}]
    assert cli.main(["diff", str(scan), str(scan), "--out", str(lines)]) == 0
    assert json.loads(lines.read_text()) == {"added": [], "changed": [], "removed": []}
    assert cli.main(["doctor"]) == 0 and "executor:" in capsys.readouterr().out


def test_video_boxes_and_jpeg(tmp_path):
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    mvhd = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 2500) + b"\0" * 80)
    tkhd = box(b"tkhd", b"\0" * 76 + struct.pack(">II", 320 << 16, 240 << 16))
    (tmp_path / "a.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"mdat", b"x" * 1000) + box(b"moov", mvhd + box(b"trak", tkhd)))
    assert extractors._boxes(str(tmp_path / "a.mp4")) == {"video_duration": 2.5, "video_width": 320, "video_height": 240}
    frame = struct.pack(">BHHB", 8, 48, 64, 3) + b"\0" * 9
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame)
    assert extractors.extract(str(tmp_path / "a.jpg"), "image/jpeg")[0] == {"format": "JPEG", "mode": "RGB", "width": 64, "height": 48}


def test_normalize_all_sections(spark):
    raw = spark.sql("""SELECT 'p' AS path, 'n' AS name, '.jpg' AS ext, 5L AS size_bytes, 'sha256' AS hash_algo, 'ab' AS hash_hex,
      named_struct('Make', ' Canon ', 'Model', 'X', 'Software', 'S') AS exif, named_struct('DateTimeOriginal', 'd1', 'DateTimeDigitized', 'd2') AS exif_times,
      named_struct('lat', 1.5D, 'lon', 2.5D, 'alt_m', CAST(NULL AS DOUBLE), 'dop', 0.5D) AS gps_norm, named_struct('Author', 'pa', 'Creator', 'c', 'Producer', 'q') AS pdf,
      named_struct('CreationDate', 'k1', 'ModDate', '') AS pdf_times, named_struct('creator', 'da', 'lastModifiedBy', 'lm', 'title', 't') AS docx, named_struct('created', 'w1', 'modified', 'w2') AS docx_times,
      named_struct('duration_sec', 3.5D, 'width', 0, 'height', 9, 'codec', 'h', 'container', 'mp4', 'container_created', 'cc') AS video""")
    r = normalize(raw).first()
    assert tuple(r.file) == ("p", "n", ".jpg", 5) and r.hashes == {"sha256": "ab"} and tuple(r.capture) == ("Canon", "X", "docx", "d1")
    assert tuple(r.meta_times) == ("d2", "k1", "w2") and tuple(r.geo) == (1.5, 2.5, None, 0.5, "dop") and tuple(r.identity) == ("da", "lm", "t")
    assert tuple(r.media) == (3.5, None, 9, "h", "mp4", "cc") and r.raw.path == "p"
