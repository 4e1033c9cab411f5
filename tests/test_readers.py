import json
import struct
import zlib

import pytest

from sedgewire.sources import extractors, pdf
from sedgewire.sources.files import FileTree

CATALOG, PAGES, PAGE = b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [3 0 R] /Count 1>>", b"<</Type /Page /Parent 2 0 R>>"
INFO = b"<</Title (The \\(right\\) one) /Author <FEFF00E9> /Producer (\\204 dash) /Creator () >>"


def _classic(objects, trailer, start=b"%PDF-1.4\n", previous=None):
    """A file, or an update of one, with a table."""
    out, places = bytearray(start), {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for number, place in places.items():
        out += b"%d 1\n%010d 00000 n \n" % (number, place)
    out += b"trailer\n<<%s%s>>\nstartxref\n%d\n%%%%EOF\n" % (trailer, b"" if previous is None else b" /Prev %d" % previous, at)
    return bytes(out), at


def _stream(body, head=b""):
    return b"<<%s /Length %d>>\nstream\n%s\nendstream" % (head, len(body), body)


def _up(rows):
    """Rows under PNG's filter Up."""
    out, above = b"", bytes(len(rows[0]))
    for row in rows:
        out += b"\2" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    return out


def _packed():
    """A file whose pages and information are in an object stream, found by a cross-reference stream with a predictor."""
    inside = {1: CATALOG, 2: PAGES, 3: PAGE, 5: INFO}
    bodies, heads, at = b"", b"", 0
    for number, body in inside.items():
        heads += b"%d %d " % (number, at)
        bodies += body + b" "
        at = len(bodies)
    raw = zlib.compress(heads + bodies)
    out = b"%PDF-1.5\n"
    place = len(out)
    out += b"7 0 obj\n" + _stream(raw, b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode" % len(heads)) + b"\nendobj\n"
    start = len(out)
    row = lambda kind, a, b: struct.pack(">BHB", kind, a, b)
    order = list(inside)
    rows = [row(2, 7, order.index(n)) if n in inside else row(1, place if n == 7 else start, 0) if n in (7, 8) else row(0, 0, 0) for n in range(9)]
    table = zlib.compress(_up(rows))
    out += b"8 0 obj\n" + _stream(table, b"/Type /XRef /Size 9 /W [1 2 1] /Root 1 0 R /Info 5 0 R /Filter [/FlateDecode] /DecodeParms [<</Predictor 12 /Columns 4>>]") + b"\nendobj\n"
    return out + b"startxref\n%d\n%%%%EOF\n" % start


def _read(tmp_path, raw):
    (tmp_path / "a.pdf").write_bytes(raw)
    return pdf.metadata(str(tmp_path / "a.pdf"))


RIGHT = {"pages": 1, "pdf_title": "The (right) one", "pdf_author": "é", "pdf_producer": "— dash"}
PLAIN = {1: CATALOG, 2: PAGES, 3: PAGE, 5: INFO}


def test_pdf_with_updates_outlines_and_streams(tmp_path):
    first, at = _classic(PLAIN | {5: b"<</Title (Old)>>"}, b"/Root 1 0 R /Info 5 0 R")
    updated, _ = _classic({3: PAGE, 5: INFO}, b"/Root 1 0 R /Info 5 0 R", first, at)
    assert _read(tmp_path, first) == {"pages": 1, "pdf_title": "Old"} and _read(tmp_path, updated) == RIGHT
    extra = {6: b"<</Title (An outline entry)>>", 7: _stream(b"9 0 obj <</Type /Page>> endobj /Type /Page trailer <</Root 9 0 R>>"), 8: b"<</Type /Page /Old true>>"}
    assert _read(tmp_path, _classic(PLAIN | extra, b"/Root 1 0 R /Info 5 0 R")[0]) == RIGHT


def test_pdf_by_cross_reference_streams(tmp_path):
    packed = _packed()
    assert _read(tmp_path, packed) == RIGHT
    updated, _ = _classic({2: b"<</Type /Pages /Kids [3 0 R 10 0 R]>>", 10: b"<</Type /Pages /Kids [11 0 R 12 0 R 2 0 R]>>", 11: PAGE, 12: PAGE}, b"/Root 1 0 R /Info 5 0 R", packed, packed.rindex(b"8 0 obj"))
    assert _read(tmp_path, updated) == RIGHT | {"pages": 3}  # a node that leads back to one above counts once
    hybrid, _ = _classic({}, b"/Root 1 0 R /Info 5 0 R /XRefStm %d" % packed.rindex(b"8 0 obj"), packed)
    assert _read(tmp_path, hybrid) == RIGHT


def test_damaged_and_locked_pdf(tmp_path):
    whole, at = _classic(PLAIN | {7: _stream(b"8 0 obj <</Type /Page>> endobj")}, b"/Root 1 0 R /Info 5 0 R")
    assert _read(tmp_path, whole.replace(b"startxref\n%d" % at, b"startxref\n77")) == RIGHT
    assert _read(tmp_path, whole[: whole.rindex(b"startxref")]) == RIGHT
    assert _read(tmp_path, b"%PDF-1.4\n% moved\n" + whole[9:]) == RIGHT
    assert _read(tmp_path, _packed().replace(b"startxref\n", b"startxref\n9")) == RIGHT
    locked, _ = _classic(PLAIN | {9: b"<</Filter /Standard>>"}, b"/Root 1 0 R /Info 5 0 R /Encrypt 9 0 R")
    for raw in (locked, locked.replace(b"startxref", b"startxxxx")):
        with pytest.raises(pdf.EncryptedPdf):
            _read(tmp_path, raw)
    for raw in (b"", b"no pdf", b"%PDF-1.4\n", b"%PDF-1.4\nstartxref\n3\n"):
        with pytest.raises(ValueError):
            _read(tmp_path, raw)


def test_pdf_strings_and_numbers():
    assert pdf.parse(b"[(a(b)\\051\\\n\\n\\7\\x) <4 1 4> /N#20m -1.5 +2 true null 3 0 R 4 0 X]".replace(b" 4 0 X", b" 4 0"), 0)[0] == [b"a(b))\n\x07x", b"A@", "N m", -1.5, 2, True, None, pdf.Ref(3, 0), 4, 0]
    assert pdf.text_of(b"\xef\xbb\xbf\xc3\xa9") == "é" and pdf.text_of(b"\xff\xfe\xe9\0") == "é" and pdf.text_of(b"\xa0\x18\xe9") == "€˘é"
    for bad in (b"(open", b"<</a", b"<41", b"[1", b"?", b"<<1 2>>", b"[" * 500):
        with pytest.raises(pdf.BrokenPdf):
            pdf.parse(bad, 0)
    row = lambda kind, values: bytes([kind, *values])
    raw = row(1, [1, 1, 1]) + row(3, [1, 1, 1]) + row(4, [1, 1, 1]) + row(0, [9, 9, 9])
    assert pdf._unpredicted(raw, {"Predictor": 15, "Columns": 3}) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 9, 9, 9])


def _png(depth, color, *chunks):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, depth, color, 0, 0, 0)) + b"".join(chunk(k, b) for k, b in chunks) + chunk(b"IEND", b"")


def _exif(tag, text):
    return b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", tag, 2, len(text), 26) + b"\0\0\0\0" + text


@pytest.mark.parametrize(("depth", "color", "mode"), [(1, 0, "1"), (4, 0, "L"), (16, 0, "I;16"), (8, 2, "RGB"), (2, 3, "P"), (8, 4, "LA"), (16, 4, "RGBA"), (8, 6, "RGBA")])
def test_png_modes(tmp_path, depth, color, mode):
    (tmp_path / "a.png").write_bytes(_png(depth, color, (b"IDAT", b"eXIf no chunk"), (b"eXIf", _exif(0x110, b"Camera\0"))))
    assert extractors.image(str(tmp_path / "a.png")) == ({"format": "PNG", "mode": mode, "width": 6, "height": 5, "exif_model": "Camera"}, [])


def test_jpeg_with_fill_bytes_and_segments(tmp_path):
    frame = b"\xff\xff\xff\xc2" + struct.pack(">HBHHB", 17, 8, 48, 64, 3) + b"\0" * 9
    app = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    raw = b"\xff\xd8" + app(0xE0, b"JFIF\0\xff\xc0") + b"\xff" + app(0xE1, b"Exif\0\0" + _exif(0x9003, b"2024:01:02 03:04:05\0")) + b"stray" + app(0xC4, b"\0" * 20) + frame
    (tmp_path / "a.jpg").write_bytes(raw)
    assert extractors.image(str(tmp_path / "a.jpg"))[0] == {"format": "JPEG", "mode": "RGB", "width": 64, "height": 48, "exif_datetime_original": "2024:01:02 03:04:05"}
    for bad in (raw[:40], b"\xff\xd8\xff\xd9", b"\xff\xd8", b"GIF89a"):
        (tmp_path / "a.jpg").write_bytes(bad)
        with pytest.raises((ValueError, struct.error)):
            extractors.image(str(tmp_path / "a.jpg"))


def test_long_times_of_a_movie(tmp_path):
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    (tmp_path / "a.mp4").write_bytes(box(b"moov", box(b"mvhd", b"\1\0\0\0" + b"\0" * 16 + struct.pack(">IQ", 600, 1500) + b"\0" * 80)))
    assert extractors._boxes(str(tmp_path / "a.mp4")) == {"video_duration": 2.5}


def test_probed_video(tmp_path, monkeypatch):
    tool = tmp_path / "ffprobe"
    tool.write_text('#!/bin/sh\ncase "$7" in *bad*) exit 3;; *odd*) echo "{";; *) echo \'{"format":{"duration":"1.5","format_name":"mov"},"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":64}]}\';; esac\n')
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tmp_path}:/bin:/usr/bin")
    assert extractors.video("a.mp4") == ({"video_duration": 1.5, "video_format_name": "mov", "video_codec": "h264", "video_width": 64, "video_height": 0}, [])
    assert extractors.video("bad.mp4") == ({}, ["ffprobe_nonzero_exit"]) and extractors.video("odd.mp4") == ({}, ["ffprobe_invalid_json"])


def test_records_have_the_keys_of_committed_samples(spark, tmp_path):
    """Files of the kinds of the committed samples give their key sets and values (but for times and hashes)."""
    frame = b"\xff\xd8\xff\xc0" + struct.pack(">HBHHB", 17, 8, 64, 64, 3) + b"\0" * 9
    (tmp_path / "sample_noexif.jpg").write_bytes(frame)
    made, _ = _classic({1: CATALOG, 2: PAGES, 3: PAGE, 5: b"<</Author (A) /Creator (C) /Producer (P) /Subject (unspecified) /Title (T) /Trapped /False>>"}, b"/Root 1 0 R /Info 5 0 R")
    (tmp_path / "sample.pdf").write_bytes(made)
    (tmp_path / "README.md").write_text("x" * 305)
    (tmp_path / "locked.pdf").write_bytes(_classic(PLAIN, b"/Root 1 0 R /Encrypt 5 0 R")[0])
    spark.dataSource.register(FileTree)
    rows = {r.path: r for r in spark.read.format("file_tree").option("root", str(tmp_path)).load().collect()}
    told = {p: json.loads(r.metadata) for p, r in rows.items()}
    assert [(rows["README.md"].mime, rows["README.md"].size_bytes, list(told["README.md"]))] == [("application/octet-stream", 305, ["mtime"])]
    assert {k: v for k, v in told["sample_noexif.jpg"].items() if k != "mtime"} == {"format": "JPEG", "height": 64, "mode": "RGB", "width": 64}
    assert {k: v for k, v in told["sample.pdf"].items() if k != "mtime"} == {"pages": 1, "pdf_author": "A", "pdf_creator": "C", "pdf_producer": "P", "pdf_subject": "unspecified", "pdf_title": "T"}
    assert rows["locked.pdf"].errors == ["extract_failed:EncryptedPdf"] and all(not r.errors and not r.warnings for p, r in rows.items() if p != "locked.pdf")


def test_readers_of_ones_own_reach_fresh_workers(spark, tmp_path, monkeypatch):
    """The option names a module; workers that start later import it there."""
    from sedgewire.sources.cache import CacheTable

    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "own_readers.py").write_text("import os\ndef size(path):\n    return {'own': os.path.getsize(path), 'worker': os.getpid()}, ['told']\ndef fails(path):\n    raise KeyError(path)\n")
    root = tmp_path / "root"
    root.mkdir()
    for name in ("a.xyz", "b.BAD", "c.txt", "d.jpg"):
        (root / name).write_bytes(b"1234")
    monkeypatch.syspath_prepend(str(tmp_path / "code"))
    spark.sparkContext.addPyFile(str(tmp_path / "code" / "own_readers.py"))
    spark.dataSource.register(FileTree)
    options = {"root": str(root), "readers": ".xyz=own_readers:size, .bad=own_readers:fails, image/*=own_readers:size"}
    import os

    rows = {r.path: r for r in spark.read.format("file_tree").options(**options).load().collect()}
    told = json.loads(rows["a.xyz"].metadata)
    assert told["own"] == 4 and told["worker"] != os.getpid() and rows["a.xyz"].warnings == ["told"] and json.loads(rows["d.jpg"].metadata)["own"] == 4
    assert rows["b.BAD"].errors == ["extract_failed:KeyError"] and "own" not in json.loads(rows["c.txt"].metadata)
    with CacheTable(spark, str(tmp_path / "cache")) as cache:
        assert json.loads({r.path: r for r in cache.scan(**options).collect()}["a.xyz"].metadata)["own"] == 4
    for bad in (".xyz=nothing", ".xyz=own_readers:none", ".xyz=no_such_module:f"):
        with pytest.raises(Exception):  # noqa: B017 whatever Spark wraps it in
            spark.read.format("file_tree").options(root=str(root), readers=bad).load().collect()
