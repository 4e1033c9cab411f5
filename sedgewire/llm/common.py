"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but ASCII white space, in every operator here.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(table: DataFrame) -> DataFrame:
    """A scanned table with at least as many partitions as there are cores: one small file is dealt out, a large table stays as it is split."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where nobody set one, a folder of its own on one machine (tests); on a cluster that is an error, as executors don't share local folders."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def files_for(docs: DataFrame, rows: int = 20_000, most: int = 16 << 20) -> tuple[int, int]:
    """How many partitions a table made of these texts needs: one as wide as they are (so many rows and bytes of text each), and one of short rows (so many each). The cores at least."""
    n, size = docs.select(F.octet_length("text").cast("long").alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    short = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // rows))
    return max(short, -(-size // most)), short


def gathered(df: DataFrame, files: int | None) -> DataFrame:
    """At most so many partitions, if the shuffles make at least twice as many; otherwise df as it is, as gathering forgets how rows are dealt out.

    Each partition that is written costs two files (one of checksums) and, where Hadoop has no native library, a process for the mode of each: for a moment that counts an executor's memory twice.
    """
    return df.coalesce(files) if files and 2 * files <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def checkpointed(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage in the shared folder, in at most so many files where that are far fewer than df's partitions."""
    shared_folder(df.sparkSession)
    return gathered(df, files).checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder: compressed, and read by column, which a checkpoint isn't; its partitioning is not kept."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Hint a broadcast if a count shows at most this many (narrow) rows; otherwise the planner joins by shuffle and splits skew at run time."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bitmap_of(keys: DataFrame, column: str, width: int) -> np.ndarray:
    """A bitmap of 2 ** width bits (15 or more) with those set that the leading `width` bits of the keys name. Executors set the bits; the driver puts the pieces together."""
    bit, piece = F.shiftrightunsigned(column, 64 - width), 1 << 15
    parts = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("at")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(piece))).alias("bits"))
    out = np.zeros((1 << width) // 8, np.uint8)
    for r in parts.collect():
        own = np.frombuffer(bytes(r.bits), np.uint8)
        out[r["at"] * (piece // 8) :][: len(own)] = own
    return out


def without_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names would clash with those an operator adds (names match without case, as Spark resolves them)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def with_fields(fields: Iterable[T.StructField], added: str) -> T.StructType:
    """The schema of these fields and then of those that a DDL text adds; fields may have any names and types."""
    return T.StructType([*fields, *T.StructType.fromDDL(added)])


def map_arrow(df: DataFrame, function, schema: T.StructType) -> DataFrame:
    """mapInArrow of a frame whose columns may have any names: Spark's own can't resolve those with a dot. The function sees such columns under other names."""
    other = {c: f"__column_{i}" for i, c in enumerate(df.columns) if "." in c}
    if not other:
        return df.mapInArrow(function, schema)
    inner = T.StructType([T.StructField(other.get(f.name, f.name), f.dataType, f.nullable) for f in schema])
    return df.toDF(*[other.get(c, c) for c in df.columns]).mapInArrow(function, inner).toDF(*schema.names)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(4095, 0xD6E8FEB86659FD93, dtype=np.uint64)]))


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a string column without copying; a null counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    buffers = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about so many bytes together (one row at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in these bytes."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: spans are disjoint, in order and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.arange(total, dtype=np.int64) - np.repeat(firsts, lengths)
    codes = _BYTE_CODES[data[inside + np.repeat(starts, lengths)]]
    codes *= _POWERS[inside & 4095]
    if int(lengths.max()) > 4096:
        codes = mix64(codes ^ (inside >> 12).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
    return mix64(np.add.reduceat(codes, firsts) + lengths.astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _bytes_before(column: pa.Array) -> np.ndarray | None:
    """For each row of a column of texts, bytes or lists the bytes (of a list: its values, at 8 bytes) before it, and all at the end; None for other kinds."""
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) or pa.types.is_large_list(kind)
    if not wide and not (pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_list(kind)) or not len(column):
        return None
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)[column.offset :]
    return (offsets - offsets[0]).astype(np.int64) * (8 if pa.types.is_list(kind) or pa.types.is_large_list(kind) else 1)


def in_batches(function, batches: Iterable[pa.RecordBatch], rows: int = 1024, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Apply a function to the batches of mapInArrow, in pieces of at most so many rows and bytes of text (one row at least), so that what Python holds stays bounded."""
    for batch in batches:
        known = [x for x in map(_bytes_before, batch.columns) if x is not None]
        before = np.sum(known, axis=0) if known else np.zeros(batch.num_rows + 1, np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(before, before[at] + most, side="right")) - 1))
            yield function(batch.slice(at, to - at))
            at = to
