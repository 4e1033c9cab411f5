"""A file tree as a DataFrame source: every file, hidden and empty ones too, with its stat, hash and metadata.

    spark.dataSource.register(FileTree)
    spark.read.format("file_tree").option("root", path).load()

Executors must see the same file system. A missing root gives no rows; a file that can't be read gives a row with errors.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sedgewire.schema import MIME_BY_SUFFIX, OTHER_MIME
from sedgewire.sources.extractors import extract, parse_readers, resolved

_CHUNK = 1 << 20


def list_files(root: str) -> Iterator[str]:
    """A file stands for itself; a directory for all files below it, names sorted, links to directories not followed."""
    if os.path.isfile(root):
        yield root
    for folder, folders, names in os.walk(root):
        folders.sort()
        for name in sorted(names):
            yield os.path.join(folder, name)


def _entries(folder: str) -> list[os.DirEntry]:
    """What a folder holds by name; one that can't be read, or is gone, holds nothing."""
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def path_is_readable_file(path: str) -> tuple[bool, str | None]:
    """Whether a file can be read, and if not the first reason: missing, not_a_file, not_readable or error:<type>."""
    try:
        tests = ((os.path.exists, "missing"), (os.path.isfile, "not_a_file"), (lambda p: os.access(p, os.R_OK), "not_readable"))
        reason = next((name for test, name in tests if not test(path)), None)
    except (OSError, ValueError) as e:
        reason = f"error:{type(e).__name__}"
    return reason is None, reason


@F.pandas_udf(StructType().add("ok", "boolean").add("reason", "string"))
def readable(paths: pd.Series) -> pd.DataFrame:
    """path_is_readable_file of a column of paths; null is missing."""
    return pd.DataFrame([path_is_readable_file(p) if p is not None else (False, "missing") for p in paths], columns=["ok", "reason"])


def extracted(path: str, mime: str, readers: dict[str, str] | None = None) -> tuple[dict, list[str], list[str]]:
    """Metadata, warnings and errors of a file: any bad file gives an error code. readers: those of one's own (extractors.parse_readers)."""
    try:
        return *extract(path, mime, readers), []
    except Exception as e:  # whatever a reader meets in a broken file
        return {}, [], [f"extract_failed:{type(e).__name__}"]


def content_digest(path: str, algorithm: str) -> str | None:
    """Lower-case hex by sha256 or md5, read in chunks; None for none or blank. Another algorithm is an error."""
    name = algorithm.strip().lower()
    if name in ("", "none"):
        return None
    if name not in ("sha256", "md5"):
        raise ValueError(f"unsupported hash algorithm: {algorithm}")
    digest = hashlib.new(name)
    with open(path, "rb") as f:
        while chunk := f.read(_CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def _skipped(rel: str, patterns: list[str]) -> bool:
    low = rel.lower()
    for p in patterns:
        if any(c in p for c in "*?["):
            if fnmatch.fnmatchcase(low, p) or (p.startswith("*/") and fnmatch.fnmatchcase(low, p[2:])):
                return True
        elif p in low:
            return True
    return False


class FilePart(InputPartition):
    """Files, and folders that the executor walks."""

    def __init__(self, files: list[str], folders: list[str] | None = None) -> None:
        self.files, self.folders = files, folders or []


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["root"]
        self.content = options.get("content", "true").lower()
        self.per_part = max(1, int(options.get("filesPerPartition", "256")))
        self.least_folders = max(1, int(options.get("folders", "64")))
        self.readers = parse_readers(options.get("readers", ""))  # names travel to the executors, which import them there
        for name in self.readers.values():
            resolved(name)
        split = lambda k: [x.strip().lower() for x in options.get(k, "").split(",") if x.strip()]
        self.include = {x if x.startswith(".") else f".{x}" for x in split("include")}
        self.exclude = [x.replace("\\", "/").removeprefix("./") for x in split("exclude")]

    def relative(self, path: str) -> str:
        return os.path.basename(path) if path == self.root else os.path.relpath(path, self.root)

    def chosen(self, path: str) -> bool:
        return (not self.include or Path(path).suffix.lower() in self.include) and not _skipped(self.relative(path), self.exclude)

    def partitions(self) -> list[FilePart]:
        """The driver opens folders level by level until it has enough to hand out; executors walk those."""
        if not os.path.isdir(self.root):
            return [FilePart([self.root] if os.path.isfile(self.root) and self.chosen(self.root) else [])]
        files, level = [], [self.root]
        while level and len(level) < self.least_folders:
            below = []
            for folder in level:
                for e in _entries(folder):
                    (below if e.is_dir(follow_symlinks=False) else files).append(e.path)
            level = below
        files = [p for p in files if not os.path.isdir(p) and self.chosen(p)]
        parts = [FilePart(files[i : i + self.per_part]) for i in range(0, len(files), self.per_part)]
        return parts + [FilePart([], [folder]) for folder in level] or [FilePart([])]

    def read(self, partition: FilePart):
        for path in partition.files:
            yield self.record(path)
        for folder in partition.folders:
            for path in list_files(folder):
                if self.chosen(path):
                    yield self.record(path)

    def record(self, path: str) -> tuple:
        rel, kind = self.relative(path), Path(path).suffix.lower()
        mime, errors, warnings, metadata, digest, size, times = MIME_BY_SUFFIX.get(kind, OTHER_MIME), [], [], {}, "", None, (None, None, None)
        try:
            stat = os.stat(path)
            size, times = stat.st_size, (stat.st_atime, stat.st_mtime, stat.st_ctime)
            metadata["mtime"] = int(stat.st_mtime)
        except OSError as e:
            return rel, mime, size, *times, "", "{}", [], [f"stat_failed:{type(e).__name__}"]
        if self.content != "false":
            try:
                digest = content_digest(path, "sha256")
            except OSError as e:
                errors.append(f"hash_failed:{type(e).__name__}")
        if self.content == "true":
            found, warnings, failed = extracted(path, mime, self.readers)
            metadata, errors = found | metadata, errors + failed
        return rel, mime, size, *times, digest, json.dumps(metadata, sort_keys=True, ensure_ascii=False, separators=(",", ":")), warnings, errors


class FileTree(DataSource):
    """Options: root; content (true; hash: no metadata but mtime; false: stat only, files are not opened); folders (so many are handed out at least); include (extensions); exclude (patterns); filesPerPartition;
    readers (.suffix=module:function, type/subtype=module:function or type/*=module:function, by commas: functions of a path that give metadata and warnings, in modules that executors can import)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, mime string, size_bytes long, atime double, mtime double, ctime double, sha256 string, metadata string, warnings array<string>, errors array<string>"

    def reader(self, schema) -> FileTreeReader:
        return FileTreeReader(dict(self.options))


class RawRecordReader(FileTreeReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.algorithm = options.get("hashalgo", options.get("hashAlgo", "none"))
        if self.algorithm.strip().lower() not in ("", "none", "sha256", "md5"):
            raise ValueError(f"unsupported hash algorithm: {self.algorithm}")

    def record(self, path: str) -> tuple[str]:
        """A file's raw record as JSON: path, name, ext, size and times, the hash if one is asked for, and errors."""
        out: dict = {"path": path, "name": os.path.basename(path), "ext": Path(path).suffix.lower(), "errors": []}
        try:
            stage = "stat"
            stat = os.stat(path)
            out |= {"size_bytes": stat.st_size, "os_times": {"atime": stat.st_atime, "mtime": stat.st_mtime, "ctime": stat.st_ctime}}
            stage = "hash"
            if (digest := content_digest(path, self.algorithm)) is not None:
                out |= {"hash_algo": self.algorithm, "hash_hex": digest}
        except OSError as e:
            out["errors"].append({"error_code": type(e).__name__, "stage": stage, "message_short": e.strerror or ""})
        return (json.dumps(out, sort_keys=True, ensure_ascii=False, separators=(",", ":")),)


class RawRecords(DataSource):
    """Raw records of a tree's files, a JSON text each, for normalize_json. Options: root, hashAlgo (none, sha256 or md5), include, exclude, folders, filesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "raw_records"

    def schema(self) -> str:
        return "raw string"

    def reader(self, schema) -> RawRecordReader:
        return RawRecordReader(dict(self.options))
