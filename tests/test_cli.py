import json
import os

import pytest

from sedgewire import cli
from sedgewire.sources.files import FileTree


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    for name in ("a.txt", "d/b.txt", "d/c.txt"):
        (root / name).write_text(name)
    (root / "bad.jpg").write_text("no image")
    return root


def _lines(path):
    return [json.loads(x) for x in path.read_text().splitlines()]


def test_scan_report_and_purge(spark, root, tmp_path, capsys):
    cache, out = tmp_path / "cache", tmp_path / "deep" / "scan.jsonl"
    for turn in range(2):
        assert cli.main(["scan", str(root), "--out", str(out), "--cache-dir", str(cache)]) == 0
        rows = _lines(out)
        assert [r["path"] for r in rows] == ["a.txt", "bad.jpg", "d/b.txt", "d/c.txt"] and rows[1]["errors"] == ["extract_failed:ValueError"]
        assert [r["metadata"].get("cache_hit", False) for r in rows] == ([False] * 4 if not turn else [True, False, True, True])
    assert os.listdir(cache / "runs") == [] and list((cache / "entries").iterdir())
    assert cli.main(["cache", "purge", "--cache-dir", str(cache)]) == 0 and not (cache / "entries").exists()
    capsys.readouterr()
    assert cli.main(["scan", str(root), "--cache", "off", "--cache-dir", str(cache)]) == 0
    assert len(capsys.readouterr().out.splitlines()) == 4 and not (cache / "entries").exists()
    assert cli.main(["report", str(out)]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["total_files"] == 4 and told["error_counts"] == {"extract_failed:ValueError": 1} and told["mime_counts"]["image/jpeg"] == 1
    assert cli.main(["report", str(out), "--html", "--format", "json", "--out", str(tmp_path / "r.json")]) == 0
    assert json.loads((tmp_path / "r.json").read_text()) == told  # a format that is named counts
    for command in (["report", str(out), "--html"], ["report-html", str(out)]):
        assert cli.main([*command, "--out", str(tmp_path / "r.html")]) == 0
        page = (tmp_path / "r.html").read_text()
        assert page.startswith("<!doctype html>") and page.rstrip().endswith("</html>") and "Files: <b>4</b>" in page and page.count("<tr><td>") == 4


def test_folders_that_cannot_be_read_do_not_end_a_scan(spark, root, monkeypatch):
    spark.dataSource.register(FileTree)
    from sedgewire.sources import files

    real = os.scandir

    def scandir(path):
        if str(path).endswith("/d"):
            raise PermissionError(path)
        return real(path)

    reader = files.FileTreeReader({"root": str(root), "folders": "100"})
    with monkeypatch.context() as m:
        m.setattr(files.os, "scandir", scandir)
        parts = reader.partitions()
    assert sorted(os.path.basename(p) for part in parts for p in part.files) == ["a.txt", "bad.jpg"]
    assert files._entries(str(root / "gone")) == []
