"""Reports in HTML and case bundles."""

from __future__ import annotations

import datetime
import html
import itertools
import json
import os
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.functions.columns import stripped
from sedgewire.operators import records
from sedgewire.operators.ordering import numbered
from sedgewire.sources.deflate_runs import Member, inside, member_lines, pack_files, pack_lines, staging_folder, text_run, write_zip
from sedgewire.sources.jsonl import record_json
from sedgewire.sources.staging import checkpointed


def html_lines(scan: DataFrame, strict: bool = False) -> Iterator[str]:
    """The report line by line, files as they come: summary, types, findings, warnings, errors and the table of files; every value is escaped. strict: short metadata keys only.

    The scan is read twice: once for all counts, once for the table of files.
    """
    counts = checkpointed(records.value_counts(scan, strict))
    total = counts.where("kind = 'total'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    e = html.escape
    item = lambda k, n: f"<li>{e(str(k))}: <b>{n}</b></li>"
    ranked = checkpointed(records.ranked_findings(counts))
    lists = {kind: ranked.where(F.col("kind") == kind).orderBy("rank") for kind in ("mime", "warning", "error", "author", "producer", "model")}
    yield "<!doctype html><html><head><meta charset='utf-8'><title>Scan report</title></head><body><h1>Scan report</h1><h2>Summary</h2>"
    yield f"<ul><li>Files: <b>{total.n}</b></li><li>Total size: <b>{total['size']:,} bytes</b></li></ul><h3>Types</h3><ul>"
    yield from (item(r.value, r.n) for r in lists["mime"].toLocalIterator())
    gps = counts.where("kind = 'gps'").select("n").first()
    distinct = {r.kind: r.n for r in counts.where(F.col("kind").isin(*records.FINDINGS)).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    found = ([item("Files with GPS", gps.n)] if gps else []) + [item(f"Distinct {kind}s", distinct[kind]) for kind in records.FINDINGS if kind in distinct]
    yield "".join(["</ul><h2>Findings</h2><ul>", *(found or ["<li>none</li>"]), "</ul>"])
    for kind in records.FINDINGS:
        if kind in distinct:
            yield f"<h3>Top {kind}s</h3><ul>" + "".join(item(r.value, r.n) for r in lists[kind].collect()) + "</ul>"
    for kind in ("warning", "error"):
        yield f"<h2>{kind.capitalize()}s</h2><ul>"
        yield from (item(r.value, r.n) for r in lists[kind].toLocalIterator())
        yield "</ul>"
    yield "<h2>Files</h2><table><tr><th>path</th><th>mime</th><th>size</th><th>warnings</th><th>errors</th></tr>"
    cells = scan.orderBy("row_no").select("path", "mime", "size_bytes", F.array_join("warnings", "|"), F.array_join("errors", "|"))
    for row in cells.toLocalIterator():
        yield "<tr>" + "".join(f"<td>{e('' if c is None else str(c))}</td>" for c in row) + "</tr>"
    yield "</table></body></html>"


def render_html(scan: DataFrame, strict: bool = False) -> str:
    """The whole report as one text, for scans that fit the driver."""
    return "\n".join(html_lines(scan, strict))


def report_json(scan: DataFrame) -> str:
    row = records.build_report(scan).first().asDict()
    return json.dumps(row, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def json_list(values: Iterable[str], indent: str = "") -> Iterator[str]:
    """A JSON list of texts in pieces; with an indent, laid out as json.dumps does."""
    first = True
    for value in values:
        yield ("[" if first else ",") + (f"\n{indent}  " if indent else "") + json.dumps(value, ensure_ascii=False)
        first = False
    yield "[]" if first else (f"\n{indent}]" if indent else "]")


def _json_text(c):
    return F.substr(F.to_json(F.array(c)), F.lit(2), F.char_length(F.to_json(F.array(c))) - 2)


def export_bundle(scan: DataFrame, path: str, notes: str | None = "", redact: bool = False, files_base: str | None = None, case_id: str | None = None) -> str:
    """A ZIP with manifest.json, scan.jsonl, hashes.txt, reports/report.json, a redacted scan if asked for, and files below files_base. Returns the case id.

    Executors pack all members in runs (deflate_runs); the driver packs the manifest's few lines and the report, and copies the rest. The file appears when it is whole.
    """
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    case = case_id or uuid.uuid4().hex
    head = {"case_id": case, "created_at": datetime.datetime.now(datetime.UTC).replace(tzinfo=None).isoformat() + "Z", "notes": notes, "record_count": scan.count()}
    with staging_folder(scan.sparkSession) as folder:
        hashes = numbered(scan.select("row_no", F.coalesce("sha256", F.lit("")).alias("h")), "row_no", "h", name="place")
        listed = pack_lines(hashes.select(F.concat(F.when(F.col("place") == 0, "\n    ").otherwise(",\n    "), _json_text("h"))), "", folder).runs
        opened = json.dumps(head, ensure_ascii=False, indent=2).removesuffix("\n}") + ',\n  "hashes": ['
        manifest = Member("manifest.json", [text_run(opened), *listed, text_run("\n  " * bool(listed) + f'],\n  "redacted": {json.dumps(redact)}\n}}\n')])
        texts = {"scan.jsonl": record_json(scan), "hashes.txt": records.hash_lines(scan)}
        if redact:
            texts["scan.redacted.jsonl"] = record_json(records.sanitize(scan))
        packed = [pack_lines(lines.select(F.concat(F.col(lines.columns[0]), F.lit("\n"))), name, folder) for name, lines in texts.items()]
        report = Member("reports/report.json", [text_run(report_json(scan) + "\n")])
        files = pack_files(scan.where("path <> ''"), files_base, folder) if files_base else ()
        write_zip(path, itertools.chain([manifest, *packed, report], files))
    return case


def bundle_hashes(spark, path: str) -> DataFrame:
    """(sha256, path) of a bundle's hashes.txt, read in parts where the bundle lists them; blank lines don't count, a line without a tab has an empty path."""
    lines = member_lines(spark, path, "hashes.txt").where(stripped(F.col("value")) != "")
    parts = F.split("value", "\t", 2)
    return lines.select(parts[0].alias("sha256"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("path"))


def verify_bundle(spark, path: str, files_base: str | None = None) -> DataFrame:
    """(path, issue) of a bundle's hashes against the files below files_base: missing or hash_mismatch; no base, no issues. The file_tree source must be registered."""
    expected = bundle_hashes(spark, path)
    if files_base is None:
        return expected.select("path", F.lit("").alias("issue")).limit(0)
    return records.verify(expected, spark.read.format("file_tree").options(root=files_base, content="hash").load())
