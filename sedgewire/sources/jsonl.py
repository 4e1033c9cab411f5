"""Canonical JSON lines: reading keeps line order, writing sorts keys."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.functions.columns import canonical_json, stripped
from sedgewire.sources import line_table
from sedgewire.sources.line_table import read_index


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, path, mime, size_bytes, sha256, metadata, warnings, errors, record): blank lines skipped, any invalid line fails the read,
    missing fields are null. record is the whole line in canonical form. row_no (file, start of its block, number) grows with the line, and over
    the files of a folder with their names, however Spark packs them into tasks. In a folder that write_jsonl made it is the line's number, by the folder's index."""
    if read_index(path) is not None:
        line_table.register(spark)
        lines = spark.read.format("line_table").load(path).where(stripped(F.col("value")) != "")
        return _parsed(lines)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("number"))
    lines = spark.read.text(path).select(place.alias("row_no"), "value").where(stripped(F.col("value")) != "")
    return _parsed(lines)


def _parsed(lines: DataFrame) -> DataFrame:
    v = F.parse_json("value")
    get = lambda key, kind: F.try_variant_get(v, f"$.{key}", kind)
    return lines.select(
        "row_no",
        get("path", "string").alias("path"),
        get("mime", "string").alias("mime"),
        get("size_bytes", "long").alias("size_bytes"),
        get("sha256", "string").alias("sha256"),
        F.to_json(F.try_variant_get(v, "$.metadata", "variant")).alias("metadata"),
        get("warnings", "array<string>").alias("warnings"),
        get("errors", "array<string>").alias("errors"),
        canonical_json(F.col("value")).alias("record"),
    )


def record_json(scan: DataFrame) -> DataFrame:
    """One canonical line for each scan record, ordered by path."""
    whole = F.struct("errors", F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("{}"))).alias("metadata"), "mime", "path", "sha256", "size_bytes", "warnings")
    return scan.orderBy("path").select(F.to_json(F.parse_json(F.to_json(whole, {"ignoreNullFields": "false"}))).alias("value"))


def write_jsonl(scan: DataFrame, path: str) -> None:
    """A folder of line files in path order with an index; it replaces what was there in one step, when all parts are written."""
    line_table.register(scan.sparkSession)
    record_json(scan).write.format("line_table").mode("overwrite").save(path)


def write_single_file(lines: DataFrame, path: str) -> None:
    """One file on the driver, streamed a partition at a time."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        for row in lines.toLocalIterator():
            out.write(row[0] + "\n")


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """read_jsonl, or None where there is no such file or folder, on whichever file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return read_jsonl(spark, path) if there else None
