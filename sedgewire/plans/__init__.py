"""Adapters: the driver's tables in the shape of scan records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: path source/doc_id with the language as suffix, size in bytes, hash of the text."""
    path = F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang"))
    return table(spark, sf_dir, "documents").select(
        path.alias("path"),
        F.col("lang").alias("mime"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.sha2("text", 256).alias("sha256"),
        F.col("doc_id").alias("row_no"),
    )
