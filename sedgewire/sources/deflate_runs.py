"""ZIP files whose members are deflated in pieces by many tasks, and read back in pieces.

A run is raw deflate data that begins with nothing to look back to and ends on a byte: runs after one another, closed by an empty last block, are one
deflate stream, and each can be unpacked alone. Tasks write runs to the shared folder with their CRC and sizes; the driver only copies bytes
and writes headers. The member RUNS lists where runs begin, so that a reader takes them in parallel; other readers see plain ZIP members.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sedgewire.sources.line_table import line_batches, local_path
from sedgewire.sources.staging import shared_folder, written

RUNS = "runs.json"
_CLOSE = b"\x03\x00"  # an empty last block
_COPY = 1 << 20


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def crc_of_both(first: int, second: int, length: int) -> int:
    """The CRC-32 of two pieces in turn, from theirs and the length of the second: the first one's is carried over so many zero bytes by repeated squaring."""
    step = [0xEDB88320] + [1 << k for k in range(31)]  # over one bit
    for _ in range(3):
        step = [_times(step, row) for row in step]
    while length:
        if length & 1:
            first = _times(step, first)
        step = [_times(step, row) for row in step]
        length >>= 1
    return first ^ second


@dataclass
class PackedRun:
    """Raw deflate data in a file (or in memory) with the CRC, bytes and rows of what it stands for."""

    crc: int
    size: int
    packed: int
    rows: int = 0
    file: str | None = None
    offset: int = 0
    data: bytes = b""


@dataclass
class Member:
    name: str
    runs: list[PackedRun] = field(default_factory=list)
    indexed: bool = False  # listed in RUNS


def packed(pieces: Iterable[bytes], out) -> tuple[int, int, int]:
    """Deflate pieces to a file; the CRC, the bytes taken and written."""
    deflate, crc, size, put = zlib.compressobj(6, zlib.DEFLATED, -15), 0, 0, 0
    for piece in pieces:
        crc, size = zlib.crc32(piece, crc), size + len(piece)
        put += out.write(deflate.compress(piece))
    put += out.write(deflate.flush(zlib.Z_FULL_FLUSH))
    return crc, size, put


def text_run(text: str) -> PackedRun:
    """A run of the driver's own, for a few lines."""
    out = BytesIO()
    crc, size, put = packed([text.encode()], out)
    return PackedRun(crc, size, put, data=out.getvalue())


_RUN = "file string, offset long, crc long, size long, packed long, rows long"


def _pack_lines(batches: Iterator[pa.RecordBatch], folder: str, run_bytes: int) -> Iterator[pa.RecordBatch]:
    os.makedirs(folder, exist_ok=True)
    path, found, offset = os.path.join(folder, uuid.uuid4().hex), [], 0
    with open(path, "wb") as out:
        held: list[bytes] = []
        rows = size = 0

        def close() -> None:
            nonlocal held, rows, size, offset
            if rows:
                crc, length, put = packed(held, out)
                found.append((path, offset, crc, length, put, rows))
                held, rows, size, offset = [], 0, 0, offset + put

        for batch in batches:
            for text in batch.column(0).to_pylist():
                raw = (text or "").encode()
                held.append(raw)
                rows, size = rows + 1, size + len(raw)
                if size >= run_bytes:
                    close()
        close()
    if found:
        columns = list(zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0])] + [pa.array(c, pa.int64()) for c in columns[1:]], names=["file", "offset", "crc", "size", "packed", "rows"])


def pack_lines(lines: DataFrame, name: str, folder: str, run_bytes: int = 4 << 20) -> Member:
    """A member from a text column (line ends included) in the DataFrame's order, packed by its tasks. The driver gets a row for each run."""
    made = lines.mapInArrow(lambda it: _pack_lines(it, folder, run_bytes), _RUN)
    return Member(name, [PackedRun(r.crc, r["size"], r.packed, r.rows, r.file, r.offset) for r in made.collect()], indexed=True)


def inside(base: str, rel: str) -> str | None:
    """The path below base, or None if rel leaves it."""
    full = os.path.realpath(os.path.join(base, rel))
    return full if full.startswith(os.path.realpath(base) + os.sep) else None


def _pack_files(batches: Iterator[pa.RecordBatch], base: str, folder: str) -> Iterator[pa.RecordBatch]:
    os.makedirs(folder, exist_ok=True)
    path, found, offset = os.path.join(folder, uuid.uuid4().hex), [], 0
    with open(path, "wb") as out:
        for rel in (x for batch in batches for x in batch.column("path").to_pylist()):
            full = inside(base, rel)
            if not full or not os.path.isfile(full):
                continue
            try:
                with open(full, "rb") as f:
                    crc, size, put = packed(iter(lambda: f.read(_COPY), b""), out)  # noqa: B023
            except OSError:  # gone or closed to us
                out.seek(offset)
                out.truncate()
                continue
            found.append((rel, path, offset, crc, size, put))
            offset += put
    if found:
        columns = list(zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1])] + [pa.array(c, pa.int64()) for c in columns[2:]], names=["path", "file", "offset", "crc", "size", "packed"])


def pack_files(paths: DataFrame, base: str, folder: str) -> Iterator[Member]:
    """Members files/<path> of the distinct paths below base that are files, packed by executors; the driver takes a row for each as it writes."""
    rows = paths.select("path").distinct().mapInArrow(lambda it: _pack_files(it, base, folder), "path string, file string, offset long, crc long, size long, packed long")
    for r in written(rows).orderBy("path").toLocalIterator():
        yield Member(f"files/{r.path}", [PackedRun(r.crc, r["size"], r.packed, 0, r.file, r.offset)])


def _header(name: bytes, crc: int, packed_size: int, size: int) -> bytes:
    """A local header with 64-bit sizes."""
    extra = struct.pack("<HHQQ", 1, 16, size, packed_size)
    return struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x800, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name + extra


def _entry(name: bytes, crc: int, packed_size: int, size: int, at: int) -> bytes:
    extra = struct.pack("<HHQQQ", 1, 24, size, packed_size, at)
    return struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x800, 8, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0o600 << 16, 0xFFFFFFFF) + name + extra


def write_zip(path: str, members: Iterable[Member]) -> None:
    """Members in turn, copied as they are packed; the file appears when it is whole."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    directory, listed = bytearray(), {}
    count = 0

    def put(out, member: Member) -> None:
        nonlocal count
        crc, size = 0, 0
        for run in member.runs:
            crc, size = crc_of_both(crc, run.crc, run.size), size + run.size
        name, at, total = member.name.encode(), out.tell(), sum(r.packed for r in member.runs) + len(_CLOSE)
        out.write(_header(name, crc, total, size))
        if member.indexed:
            row, offset, listed[member.name] = 0, out.tell(), []
            for run in member.runs:
                listed[member.name].append([offset, run.packed, row])
                row, offset = row + run.rows, offset + run.packed
        for run in member.runs:
            if run.file is None:
                out.write(run.data)
            else:
                with open(run.file, "rb") as f:
                    f.seek(run.offset)
                    left = run.packed
                    while left and (piece := f.read(min(_COPY, left))):
                        left -= out.write(piece)
                if left:
                    raise OSError(f"{run.file} is shorter than it was")
        out.write(_CLOSE)
        directory.extend(_entry(name, crc, total, size, at))
        count += 1

    try:
        with open(fresh, "wb") as out:
            for member in members:
                put(out, member)
            put(out, Member(RUNS, [text_run(json.dumps(listed, separators=(",", ":")) + "\n")]))
            at = out.tell()
            out.write(directory)
            end = out.tell()
            out.write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, len(directory), at) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            out.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(len(directory), 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0))
        os.replace(fresh, path)
    finally:
        if os.path.exists(fresh):
            os.unlink(fresh)


class staging_folder:
    """A folder of the shared one for the runs of a ZIP, removed at the end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{local_path(shared_folder(spark))}/runs-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        os.makedirs(self.folder, exist_ok=True)
        return self.folder

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


# reading


class MemberRange(InputPartition):
    def __init__(self, offset: int, size: int, first_row: int, kind: str) -> None:
        self.offset, self.size, self.first_row, self.kind = offset, size, first_row, kind


def _lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Lines of pieces, one piece and one line at a time in memory; blank ones too."""
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _inflated(f, size: int) -> Iterator[bytes]:
    inflate, left = zlib.decompressobj(-15), size
    while left and (raw := f.read(min(_COPY, left))):
        left -= len(raw)
        while raw:
            if piece := inflate.decompress(raw, _COPY):
                yield piece
            raw = inflate.unconsumed_tail
    if piece := inflate.flush():
        yield piece


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.member = local_path(options["path"]), options["member"]
        self.per_part = int(options.get("bytesperpartition", options.get("bytesPerPartition", str(16 << 20))))

    def partitions(self) -> list[InputPartition]:
        """The runs that the file lists, some together; or the whole member in one task if another program packed it."""
        with zipfile.ZipFile(self.path) as z:
            info = z.getinfo(self.member)
            runs = json.loads(z.read(RUNS)).get(self.member) if RUNS in z.namelist() else None
        if runs is not None:
            out: list[MemberRange] = []
            for offset, size, row in runs:
                if out and out[-1].size + size <= self.per_part:
                    out[-1].size += size
                else:
                    out.append(MemberRange(offset, size, row, "runs"))
            return out or [MemberRange(0, 0, 0, "none")]
        with open(self.path, "rb") as f:
            f.seek(info.header_offset + 26)
            begin = info.header_offset + 30 + sum(struct.unpack("<2H", f.read(4)))
        if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            return [MemberRange(0, 0, 0, "zipfile")]
        if info.compress_type == zipfile.ZIP_DEFLATED:
            return [MemberRange(begin, info.compress_size, 0, "deflated")]
        return [MemberRange(begin, info.compress_size, 0, "stored")]

    def read(self, partition: MemberRange) -> Iterator[pa.RecordBatch]:
        if partition.kind == "zipfile":
            with zipfile.ZipFile(self.path) as z, z.open(self.member) as f:
                yield from line_batches(iter(f.readline, b""), 0)
            return
        if partition.kind == "none":
            return
        with open(self.path, "rb") as f:
            f.seek(partition.offset)
            if partition.kind == "stored":
                left = partition.size

                def pieces() -> Iterator[bytes]:
                    nonlocal left
                    while left and (piece := f.read(min(_COPY, left))):
                        left -= len(piece)
                        yield piece

                yield from line_batches(_lines(pieces()), 0)
            else:
                yield from line_batches(_lines(_inflated(f, partition.size)), partition.first_row)


class BundleMember(DataSource):
    """The lines of a member of a ZIP file as (row_no, value). Options: path, member, bytesPerPartition (packed bytes that a task takes at least)."""

    @classmethod
    def name(cls) -> str:
        return "bundle_member"

    def schema(self) -> str:
        return "row_no long, value string"

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


def member_lines(spark: SparkSession, path: str, member: str, **options: str) -> DataFrame:
    spark.dataSource.register(BundleMember)
    return spark.read.format("bundle_member").options(**options, path=path, member=member).load()
