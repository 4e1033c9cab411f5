"""Folders of line files that appear all at once, in order, with an index.

    lines.write.format("line_table").mode("overwrite").save(path)      # one text column
    spark.read.format("line_table").load(path)                         # row_no, value

Each task writes a part of its own; only the commit on the driver names the parts, by replacing the index in one step. A failed or repeated
task leaves nothing that a reader sees. The index has the rows and bytes of each run of lines, so a reader splits large parts and numbers
rows without reading what comes before. Driver and executors must see the same file system.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

INDEX = "_index.json"


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its file, and (offset, bytes, rows) of each run of lines."""

    number: int
    file: str
    runs: list[tuple[int, int, int]]


def read_index(path: str) -> list[dict] | None:
    """The parts that a folder's index names, or None without one."""
    try:
        with open(os.path.join(local_path(path), INDEX), encoding="utf-8") as f:
            return json.load(f)["parts"]
    except (FileNotFoundError, NotADirectoryError):
        return None


class LineWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = local_path(options["path"]), overwrite, uuid.uuid4().hex
        self.run_bytes = int(options.get("runbytes", options.get("runBytes", str(16 << 20))))
        self.staging = os.path.join(self.folder, f"_staging-{self.job}")

    def write(self, rows: Iterator) -> Part:
        os.makedirs(self.staging, exist_ok=True)
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        name = f"part-{number:06}-{uuid.uuid4().hex}.txt"
        runs, at, begun, n = [], 0, 0, 0
        with open(os.path.join(self.staging, name), "wb") as out:
            for (line,) in rows:
                raw = (line or "").replace("\n", " ").encode() + b"\n"
                out.write(raw)
                at, n = at + len(raw), n + 1
                if at - begun >= self.run_bytes:
                    runs.append((begun, at - begun, n))
                    begun, n = at, 0
            if n:
                runs.append((begun, at - begun, n))
            out.flush()
            os.fsync(out.fileno())
        return Part(number, name, runs)

    def commit(self, messages: list[Part | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        old = read_index(self.folder) or []
        parts = [] if self.overwrite else old
        row = parts[-1]["first_row"] + sum(r[2] for r in parts[-1]["runs"]) if parts else 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.number):
            if m.runs:
                os.replace(os.path.join(self.staging, m.file), os.path.join(self.folder, m.file))
                parts.append({"file": m.file, "first_row": row, "runs": m.runs})
                row += sum(r[2] for r in m.runs)
        fresh = os.path.join(self.folder, f"{INDEX}-{self.job}")
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump({"parts": parts}, f)
        os.replace(fresh, os.path.join(self.folder, INDEX))
        shutil.rmtree(self.staging, ignore_errors=True)
        named = {p["file"] for p in parts}
        for p in old:
            if p["file"] not in named:
                os.unlink(os.path.join(self.folder, p["file"]))

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class Run(InputPartition):
    def __init__(self, file: str, offset: int, size: int, first_row: int) -> None:
        self.file, self.offset, self.size, self.first_row = file, offset, size, first_row


def line_batches(lines: Iterator[bytes], first_row: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """(row_no, value) of lines, without their ends."""
    held: list[str] = []
    for line in lines:
        held.append(line.rstrip(b"\r\n").decode("utf-8"))
        if len(held) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(first_row, first_row + len(held)), pa.int64()), pa.array(held)], names=["row_no", "value"])
            first_row, held = first_row + len(held), []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(range(first_row, first_row + len(held)), pa.int64()), pa.array(held)], names=["row_no", "value"])


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = local_path(options["path"])

    def partitions(self) -> list[InputPartition]:
        parts = read_index(self.folder)
        if parts is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        out = []
        for p in parts:
            row = p["first_row"]
            for offset, size, n in p["runs"]:
                out.append(Run(p["file"], offset, size, row))
                row += n
        return out or [Run("", 0, 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        with open(os.path.join(self.folder, partition.file), "rb") as f:
            f.seek(partition.offset)
            end = partition.offset + partition.size
            yield from line_batches(iter(lambda: f.readline() if f.tell() < end else b"", b""), partition.first_row)


class LineTable(DataSource):
    """Options: path; runBytes (writing: the bytes of a run, which is what one reading task takes)."""

    @classmethod
    def name(cls) -> str:
        return "line_table"

    def schema(self) -> str:
        return "row_no long, value string"

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LineWriter:
        if [f.dataType.simpleString() for f in schema] != ["string"]:
            raise ValueError("a line table is written from one text column")
        return LineWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineTable)
