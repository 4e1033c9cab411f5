"""A table of extraction results by content: results that follow from the bytes alone are kept, path, time and size are not."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.operators.records import first_wins
from sedgewire.sources.extractors import parse_readers
from sedgewire.sources.files import extracted
from sedgewire.sources.staging import remove_folder

_ENTRY = "key string, metadata string, warnings array<string>, run string, row_no long"
#: Leading hexadecimal digits of a key's hash that name its folder: 256 folders.
_DIGITS = 2


def _extract(batches: Iterator[pa.RecordBatch], readers: dict[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extracted(p, m, readers) for p, m in zip(batch.column("full").to_pylist(), batch.column("mime").to_pylist(), strict=True)]
        text = pa.array([json.dumps(f[0], sort_keys=True, ensure_ascii=False) for f in found], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("key"), text, pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array([f[2] for f in found], pa.list_(pa.string()))], names=["key", "metadata", "warnings", "errors"])


def prefix(key: Column) -> Column:
    """The folder of a key: the first digits of the content hash that it holds, or else of its own."""
    own = F.regexp_extract(key, f"^sha256:([0-9a-f]{{{_DIGITS}}})", 1)
    return F.when(own != "", own).otherwise(F.substring(F.sha2(key, 256), 1, _DIGITS))


class CacheTable:
    """Parquet below a folder of any file system that Spark reads: entries by key, in folders by the key's prefix and sorted by key in their files.

    A scan adds entries of keys that the table lacks. Where two scans at a time add the same key, its first entry counts, and compact() drops the others:
    it rewrites the folders that hold many files and then removes those it has read, so that a reader at any moment finds each key.
    A probe opens the folders of its keys only, and in them the parts whose key ranges can hold them. The tables of a scan's steps are removed by close(), or at the end of a `with` block.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = f"{self.folder}/entries"
        self.runs: list[str] = []

    def __enter__(self) -> CacheTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Remove what the scans made by this object have written on the way; their results can't be read any more."""
        while self.runs:
            remove_folder(self.spark, self.runs.pop())

    def entries(self, prefixes: Sequence[str] | None = None) -> DataFrame:
        """The entries; those of some prefixes only, if they are given."""
        try:
            rows = self.spark.read.schema(f"{_ENTRY}, prefix string").parquet(self.path)
        except AnalysisException:  # nothing is stored yet
            rows = self.spark.createDataFrame([], f"{_ENTRY}, prefix string")
        return rows if prefixes is None else rows.where(F.col("prefix").isin(list(prefixes)))

    def probe(self, keys: DataFrame) -> DataFrame:
        """The first entry of each of these keys (a column key) that is stored. Only the folders of their prefixes are listed and read: 256 names at most pass the driver."""
        ranges = keys.where("key is not null").groupBy(prefix(F.col("key")).alias("prefix")).agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
        rows = self.entries([r.prefix for r in ranges])
        if ranges:  # within a folder the files' statistics cut by the least and the greatest key
            rows = rows.where(F.col("key").between(min(r.low for r in ranges), max(r.high for r in ranges)))
        return first_wins(rows.join(keys.select("key").distinct(), "key", "left_semi"), "key", "row_no")

    def add(self, entries: DataFrame) -> None:
        """Append entries to their folders, a file for each folder."""
        placed = entries.withColumn("prefix", prefix(F.col("key")))
        placed.repartition("prefix").sortWithinPartitions("prefix", "key").write.mode("append").partitionBy("prefix").parquet(self.path)

    def compact(self, files: int = 8) -> int:
        """Merge on key the folders with more than so many files: one sorted file for each, its keys' first entries. How many folders were rewritten."""
        at = F.col("_metadata.file_path")
        stored = self.entries()
        if not stored.columns or stored.isEmpty():
            return 0
        names = stored.select("prefix", at.alias("file")).distinct()
        many = [r.prefix for r in names.groupBy("prefix").count().where(F.col("count") > files).collect()]  # 256 at most
        if not many:
            return 0
        old = [r.file for r in names.where(F.col("prefix").isin(many)).collect()]
        merged = first_wins(self.entries(many).drop("prefix"), "key", "row_no")
        staged = f"{self.folder}/runs/{uuid.uuid4().hex}"
        merged.write.parquet(staged)
        self.add(self.spark.read.parquet(staged))
        for file in old:
            remove_folder(self.spark, file)
        remove_folder(self.spark, staged)
        return len(many)

    def scan(self, root: str, **options: str) -> DataFrame:
        """Scan records of a tree. Files are hashed first; only contents that are neither stored nor met earlier in the scan (by path) are extracted, and then
        stored unless that failed. cache_hit is in the metadata of the others. The steps run at once, into tables that the result is read from until close()."""
        run = uuid.uuid4().hex
        where = f"{self.folder}/runs/{run}"
        self.runs.append(where)
        hashed = self.spark.read.format("file_tree").options(**options, root=root, content="hash").load()
        hashed.withColumn("key", F.when(F.col("sha256") != "", F.concat(F.lit("sha256:"), F.col("sha256")))).write.parquet(f"{where}/files")
        files = self.spark.read.parquet(f"{where}/files")
        first = files.where("key is not null").groupBy("key").agg(F.min(F.struct("path", "mime")).alias("f")).select("key", F.col("f.path").alias("first_path"), "f.mime")
        self.probe(first).select("key", "run", "metadata", "warnings").write.parquet(f"{where}/known")
        known = self.spark.read.parquet(f"{where}/known")
        full = F.when(F.lit(root).endswith(F.concat(F.lit("/"), F.col("first_path"))), F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("first_path")))
        todo = first.join(known.select("key"), "key", "left_anti").select("key", full.alias("full"), F.coalesce("mime", F.lit("")).alias("mime"))
        readers = parse_readers(options.get("readers", ""))
        todo.mapInArrow(lambda it: _extract(it, readers), "key string, metadata string, warnings array<string>, errors array<string>").write.parquet(f"{where}/extracted")
        fresh = self.spark.read.parquet(f"{where}/extracted")
        good = fresh.where(F.size("errors") == 0).select("key", "metadata", "warnings", F.lit(run).alias("run"), F.unix_micros(F.current_timestamp()).alias("row_no"))
        if not good.isEmpty():
            self.add(good)
        results = known.withColumn("failed", F.array().cast("array<string>")).unionByName(fresh.select("key", F.lit(run).alias("run"), "metadata", "warnings", F.col("errors").alias("failed")))
        results = results.select("key", "run", F.col("metadata").alias("found"), F.col("warnings").alias("told"), "failed")
        joined = files.join(first.select("key", "first_path"), "key", "left").join(results, "key", "left")
        hit = F.col("key").isNotNull() & (F.size("failed") == 0) & ((F.col("run") != run) | (F.col("path") != F.col("first_path")))
        inner = lambda c: F.regexp_replace(F.coalesce(c, F.lit("{}")), r"^\{\s*|\s*\}$", "")
        parts = F.array_compact(F.array(F.when(hit, '"cache_hit":true'), F.nullif(inner(F.col("found")), F.lit("")), F.nullif(inner(F.col("metadata")), F.lit(""))))
        metadata = F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
        changed = {"metadata": metadata, "warnings": F.coalesce("told", "warnings"), "errors": F.concat("errors", F.coalesce("failed", F.array().cast("array<string>")))}
        return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in files.columns if c != "key"])

    def stats(self) -> tuple[int, int]:
        """Entries, and bytes of their results."""
        r = self.entries().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("metadata")), F.lit(0)).alias("size")).first()
        return r.n, r["size"]

    def purge(self) -> None:
        for name in ("entries", "runs"):
            remove_folder(self.spark, f"{self.folder}/{name}")
