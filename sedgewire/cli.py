"""Command line: scan, report, report-html, diff, verify, export-case (export-bundle), cache purge, doctor."""

from __future__ import annotations

import argparse
import contextlib
import importlib.util
import os
import platform
import shutil
import socket
import sys

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sedgewire.operators import case_bundle, records
from sedgewire.sources.cache import CacheTable
from sedgewire.sources.files import FileTree
from sedgewire.sources.jsonl import read_jsonl, record_json, write_single_file


def session() -> SparkSession:
    spark = SparkSession.builder.appName("sedgewire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.dataSource.register(FileTree)
    return spark


def _show(lines) -> None:
    for row in lines.toLocalIterator():
        print(row[0])


def scan(a) -> int:
    spark = session()
    with CacheTable(spark, a.cache_dir) as cache:
        found = cache.scan(a.path) if a.cache == "on" else spark.read.format("file_tree").option("root", a.path).load()
        lines = record_json(found)
        write_single_file(lines, a.out) if a.out else _show(lines)
        if a.cache == "on":
            cache.compact()
    return 0


def report(a) -> int:
    rows = read_jsonl(session(), a.scan)
    kind = a.format or ("html" if a.html else "json")
    lines = case_bundle.html_lines(rows) if kind == "html" else [case_bundle.report_json(rows)]
    with open(a.out, "w", encoding="utf-8") if a.out else contextlib.nullcontext(sys.stdout) as f:
        for line in lines:
            f.write(line + "\n")
    return 0


def diff(a) -> int:
    spark = session()
    changes = records.diff(read_jsonl(spark, a.old), read_jsonl(spark, a.new)).cache()
    with open(a.out, "w", encoding="utf-8") if a.out else contextlib.nullcontext(sys.stdout) as f:
        for k, status in enumerate(("added", "changed", "removed")):
            f.write(f'{"," if k else "{"}"{status}":')
            for piece in case_bundle.json_list(r.path for r in records.diff_rows(changes, status).toLocalIterator()):
                f.write(piece)
        f.write("}\n")
    changes.unpersist()
    return 0


def verify(a) -> int:
    """The issues as JSON lines, or OK; with --bundle those of a bundle's hashes."""
    spark = session()
    if a.bundle:
        issues = case_bundle.verify_bundle(spark, a.scan, a.base)
    else:
        found = spark.read.format("file_tree").options(root=a.base, content="hash").load()
        issues = records.verify(read_jsonl(spark, a.scan), found)
    n = 0
    for n, r in enumerate(issues.orderBy("path").select(F.to_json(F.struct("issue", "path"))).toLocalIterator(), 1):
        print(r[0])
    if not n:
        print("OK")
    return 2 if n else 0


def export_case(a) -> int:
    base = (a.files_base or os.path.dirname(os.path.abspath(a.scan))) if a.include_files else None
    case_bundle.export_bundle(read_jsonl(session(), a.scan), a.out, notes=a.notes, redact=a.redact, files_base=base, case_id=a.case_id)
    return 0


def purge(a) -> int:
    CacheTable(session(), a.cache_dir).purge()
    return 0


def _modules() -> list[tuple[str, bool]]:
    return [(name, importlib.util.find_spec(name) is not None) for name in ("pyspark", "pyarrow", "pandas", "PIL", "docx", "pypdf")]


def _executor_row(batches):
    for _ in batches:
        yield pd.DataFrame({"host": [socket.gethostname()], "python": [sys.version.split()[0]], "ffprobe": [bool(shutil.which("ffprobe"))]})


def doctor(a) -> int:
    """Executables, modules and environment of the driver and of executors, then warnings."""
    warnings = []
    print(f"system: {platform.system()} {platform.release()} {platform.machine()}")
    print(f"python: {sys.version.split()[0]} {sys.executable}")
    for name in ("java", "ffprobe", "ffmpeg", "exiftool"):
        print(f"{name}: {shutil.which(name) or 'not found'}")
    for name, there in _modules():
        print(f"{name}: {'found' if there else 'not found'}")
    spark = session()
    print(f"spark: {spark.version} {spark.sparkContext.master}")
    tasks = spark.range(0, 64, 1, spark.sparkContext.defaultParallelism)
    for r in tasks.mapInPandas(_executor_row, "host string, python string, ffprobe boolean").distinct().orderBy("host").collect():
        print(f"executor: {r.host} python {r.python} ffprobe {'found' if r.ffprobe else 'not found'}")
        if not r.ffprobe:
            warnings.append(f"{r.host} has no ffprobe: videos give little metadata")
        if r.python != sys.version.split()[0]:
            warnings.append(f"{r.host} runs another Python than the driver")
    for w in dict.fromkeys(warnings):
        print(f"warning: {w}")
    return 0


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sedgewire")
    commands = top.add_subparsers(required=True)

    def add(name, handler, *arguments):
        p = commands.add_parser(name)
        for flags, options in arguments:
            p.add_argument(*flags, **options)
        p.set_defaults(func=handler)
        return p

    cache_dir = (["--cache-dir"], {"default": ".scan_cache"})
    out = (["--out"], {})
    add("scan", scan, (["path"], {}), out, (["--cache"], {"choices": ["on", "off"], "default": "on"}), cache_dir)
    add("report", report, (["scan"], {}), out, (["--html"], {"action": "store_true"}), (["--format"], {"choices": ["json", "html"]}))
    add("report-html", report, (["scan"], {}), out, (["--format"], {"default": "html"}), (["--html"], {"action": "store_true"}))
    add("diff", diff, (["old"], {}), (["new"], {}), out)
    add("verify", verify, (["scan"], {}), (["--base"], {"default": "."}), (["--bundle"], {"action": "store_true"}))
    for name in ("export-case", "export-bundle"):
        add(name, export_case, (["scan"], {}), (["--out"], {"required": True}), (["--notes"], {"default": ""}), (["--case-id"], {}), (["--redact"], {"action": "store_true"}), (["--include-files"], {"action": "store_true"}), (["--files-base"], {}))
    add("cache", purge, (["action"], {"choices": ["purge"]}), cache_dir)
    add("doctor", doctor)
    return top


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    return a.func(a)


if __name__ == "__main__":
    sys.exit(main())
