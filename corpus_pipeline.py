"""The corpus pipeline: STAGES in order, each a function of (spark, docs, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.llm import byte_bpe, line_dedup, mixing, near_duplicates, toxicity
from sedgewire.llm.common import read_table, remove_folder, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the network learns from the labelled rows of the stage's own input.

    Null, empty and wordless texts score 0 and stay; repeated rows share their fate; where no labels can be learned from, all stay. An empty table stays empty.
    """
    net = toxicity.fit_on(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, "__toxicity").where(F.col("__toxicity") < 0.3).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that eight or more sources share (their first place keeps them); n_chars follows. No document goes.

    A null source is one of its own; copies of a whole text count as one, so that copied documents stay whole for the next stage. Null texts stay null (n_chars null), repeated rows
    share a first place. Near copies on eight or more sources do lose what they share but for its first place. An empty table stays empty.
    """
    cut = line_dedup.remove_boilerplate(docs, min_sites=8)
    return cut.select(*[F.col("text_kept").alias("text") if c == "text" else F.char_length("text_kept").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of 5-word shingles are linked at 0.8 or more: the one with the least doc_id.

    Null, empty and wordless texts are in no group and stay; rows that repeat id and text count as one. Of a group without ids all stay. An empty table stays empty.
    """
    return near_duplicates.drop_near_duplicates(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0 to 2 times) as the mix of sources takes it.

    Null is a source; texts without words have size 0 and are taken as often as the whole passes over their source; repeated rows share their fate. An empty table stays empty.
    """
    return mixing.take_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (null or empty: none), and whether they decode to it. One row for each row of docs."""
    both = byte_bpe.transcode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return both.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("exact").alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: A trained network decides the first stage, which SQL can't express; tests/llm compare the others with a plain version, and the first with held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written as Parquet in the shared folder and read again. A stage's table goes once the next one's is complete."""
    docs = read_table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
