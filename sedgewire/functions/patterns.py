"""Many exclude patterns at once: one automaton over their literal parts, in one expression; more than a task should hold are joined with the paths by hashes of literal parts."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.sources.staging import written

_GLOB = re.compile(r"[*?\[]")
#: A wildcard of a glob; a [ that nothing closes is a character.
_WILD = re.compile(r"[*?]|\[(?:!.|[^!])[^\]]*\]", re.DOTALL)

#: Lengths of the pieces of literal text by which patterns meet paths. Tests whose best piece is no longer than _SHORT would meet too many.
_SIZES = (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32)
_SHORT = 2
#: Characters of one pattern of a held set, on average, at most.
_HELD_CHARS = 32
#: Leading bits of a piece's hash that tell how many tests share it, and at most so many (64 MB) that tell whether any test is known by it.
_COUNT_BITS, _MOST_BITS = 20, 29
U64 = np.uint64


def normalized(pattern: str | None) -> str:
    """Trimmed, with slashes, lower case, without one leading ./"""
    return (pattern or "").strip().replace("\\", "/").lower().removeprefix("./")


def _runs(glob: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of the runs of characters that every match of a glob holds; some may be empty."""
    at = 0
    for wild in _WILD.finditer(glob):
        yield at, wild.start()
        at = wild.end()
    yield at, len(glob)


def literal_part(glob: str) -> str:
    """The longest run of characters that every match of a glob holds; empty if there is none."""
    return max((glob[a:b] for a, b in _runs(glob)), key=len)


def tests_of(pattern: str | None) -> list[tuple[str, bool]]:
    """What a pattern asks of a lower-case path: to match a text as a whole (true), or to hold it. A blank pattern asks nothing."""
    p = normalized(pattern)
    if not p or not _GLOB.search(p):
        return [(p, False)] if p else []
    return [(p, True), (p[2:], True)] if p.startswith("*/") else [(p, True)]


class PatternSet:
    """Whether any pattern matches a lower-case path: globs as a whole (* crosses slashes; */x also stands for x), others as a part.

    A path is read once by the automaton. A literal pattern that it meets decides; a glob is tried only where its longest literal part occurs. Globs without
    one (such as * or ??) are tried together by one expression.
    """

    def __init__(self, patterns: Iterable[str | None] = (), tests: Iterable[tuple[str, bool]] = ()) -> None:
        words: dict[str, list[str] | None] = {}  # by literal: the globs to try, or None where it decides by itself
        bare: list[str] = []
        for p, whole in sorted({*tests, *(t for pattern in patterns for t in tests_of(pattern))}):
            if not whole:
                words[p] = None
            elif part := literal_part(p):
                if words.setdefault(part, []) is not None:
                    words[part].append(p)
            else:
                bare.append(p)
        self.words, self.bare = words, bare
        self._ready: tuple | None = None

    def __getstate__(self) -> dict:
        return {"words": self.words, "bare": self.bare, "_ready": None}

    def _built(self) -> tuple:
        if self._ready is None:
            automaton = ahocorasick.Automaton()
            for word, globs in self.words.items():
                automaton.add_word(word, None if globs is None else tuple(re.compile(fnmatch.translate(g)).match for g in globs))
            if self.words:
                automaton.make_automaton()
            self._ready = automaton if self.words else None, re.compile("|".join(map(fnmatch.translate, self.bare))).match if self.bare else None
        return self._ready

    def __call__(self, path: str) -> bool:
        low = path.lower()
        automaton, bare = self._built()
        if bare and bare(low):
            return True
        return automaton is not None and any(tests is None or any(t(low) for t in tests) for _, tests in automaton.iter(low))


def _matching(shared) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tests = [block.value for block in shared]
        for paths in batches:
            yield paths.map(lambda p: None if p is None else any(test(p) for test in tests)).astype("object")

    return matches


def _portions(texts: list[str], most: int = 1 << 18) -> Iterator[list[str]]:
    """The texts in lists of about so many characters (one text at least)."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _hashes(texts: list[str], sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size a 64-bit hash of the so many characters from every place of the joined texts on (where there are so many)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(U64)
    h, wanted = np.zeros(len(codes), U64), set(sizes)
    for size in range(1, min(max(wanted, default=0), len(codes)) + 1):
        h = h[: len(codes) - size + 1] * U64(0x9E3779B97F4A7C15) + codes[size - 1 :]
        if size in wanted:
            x = h ^ U64(size << 56)
            x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
            yield size, x ^ (x >> U64(31))


def _pieces(test: str) -> Iterator[tuple[int, int]]:
    """Starts and sizes of pieces that cover the literal runs of a test."""
    for a, b in _runs(test):
        if b > a:
            size = max(n for n in _SIZES if n <= b - a)
            yield from ((at, size) for at in range(a, b - size + 1, size))
            if (b - a) % size:
                yield b - size, size


def _known_by(patterns: list[str]) -> tuple[list[tuple[str, bool]], np.ndarray, np.ndarray, np.ndarray]:
    """The tests of these patterns; for each piece of a test the test's place, its size and its hash."""
    tests = [t for p in patterns for t in tests_of(p)]
    of, at, size = np.array([(k, *piece) for k, (test, _) in enumerate(tests) for piece in _pieces(test)], np.int64).reshape(-1, 3).T
    first = np.cumsum([0, *(len(test) for test, _ in tests)])
    out = np.zeros(len(of), U64)
    for n, hashes in _hashes([test for test, _ in tests], size.tolist()):
        own = size == n
        out[own] = hashes[first[of[own]] + at[own]]
    return tests, of, size, out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pieces of tests share the leading bits of their hashes."""
    counts = np.zeros(1 << _COUNT_BITS, np.int64)
    for batch in batches:
        for part in _portions(batch.column(0).to_pylist()):
            counts += np.bincount((_known_by(part)[3] >> U64(64 - _COUNT_BITS)).astype(np.int64), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])


def _keyed(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each test with the hash of the piece that it shares with the fewest others, the longest of these; size 0 if it has no literal text."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for part in _portions(batch.column(0).to_pylist()):
                tests, of, size, hashes = _known_by(part)
                cost = np.log2(1 + counts[(hashes >> U64(64 - _COUNT_BITS)).astype(np.int64)] / 32).astype(np.int64)
                order = np.lexsort((-size, cost, of))
                own, firsts = np.unique(of[order], return_index=True)
                sizes, keys = np.zeros(len(tests), np.int32), np.zeros(len(tests), U64)
                sizes[own], keys[own] = size[order[firsts]], hashes[order[firsts]]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in tests], pa.string()), pa.array([w for _, w in tests], pa.bool_()), pa.array(sizes), pa.array(keys.view(np.int64))], ["test", "whole", "size", "key"])

    return keyed


def _bits(tests: DataFrame, width: int) -> np.ndarray:
    """A bitmap of 2 ** width bits (15 or more) with those set that the first and the second `width` bits of a key name."""
    bit, piece = F.explode(F.array(F.shiftrightunsigned("key", 64 - width), F.shiftrightunsigned(F.shiftleft("key", width), 64 - width))), 1 << 15
    parts = tests.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("at")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(piece))).alias("bits"))
    out = np.zeros((1 << width) // 8, np.uint8)
    for r in parts.collect():
        own = np.frombuffer(bytes(r.bits), np.uint8)
        out[r["at"] * (piece // 8) :][: len(own)] = own
    return out


def _met(bitmap, width: int, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each path with the keys that its pieces have in common with tests (and a few others)."""

    def told(bit: np.ndarray) -> np.ndarray:
        return (bitmap.value[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8) & 1).astype(bool)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch.column(0).to_pylist()):
                low = [p.lower() for p in part]
                lengths = np.array([len(p) for p in low], np.int64)
                of, ends = np.repeat(np.arange(len(low)), lengths), np.repeat(np.cumsum(lengths), lengths)
                found = [np.zeros((2, 0), U64)]
                for size, hashes in _hashes(low, sizes):
                    at = np.flatnonzero(np.arange(size, size + len(hashes)) <= ends[: len(hashes)])
                    at = at[told(hashes[at] >> U64(64 - width))]
                    at = at[told(hashes[at] << U64(width) >> U64(64 - width))]
                    found.append(np.stack([of[at].astype(U64), hashes[at]]))
                paths, keys = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()).take(pa.array(paths.astype(np.int64))), pa.array(keys.view(np.int64))], ["path", "key"])

    return met


@lru_cache(maxsize=10_000)
def _whole(glob: str) -> Callable:
    return re.compile(fnmatch.translate(glob)).match


def _holds(path: str, test: str, whole: bool) -> bool:
    low = path.lower()
    return _whole(test)(low) is not None if whole else test in low


def _tried() -> Callable[..., Column]:
    @F.pandas_udf("boolean")
    def tried(paths: pd.Series, tests: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series(map(_holds, paths, tests, whole), dtype=bool)

    return tried


def _joined(rows: DataFrame, path: str, patterns: DataFrame, name: str, held: int) -> DataFrame:
    """excluded_by for more patterns than a task should hold: paths meet tests by a join on pieces of literal text, and each pair is tried. Memory doesn't grow with the patterns, but for
    one bitmap of at most 64 MB, which only keeps pieces that no test is known by out of the join.

    Tests with hardly any literal text are asked of all paths: by one automaton as long as there are no more than `held`, otherwise by the join too, and those without any by a cross join.
    """
    spark = rows.sparkSession
    counted = patterns.mapInArrow(_counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << _COUNT_BITS, np.int64)
    counts[counted["at"].to_numpy()] = counted["n"].to_numpy()
    tests = written(patterns.mapInArrow(_keyed(spark.sparkContext.broadcast(counts)), "test string, whole boolean, size int, key long"))
    by_size = {r["size"]: r for r in tests.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.length("test")).alias("chars")).collect()}

    short = [r for size, r in by_size.items() if size <= _SHORT]
    few = sum(r.n for r in short) <= held and sum(r.chars for r in short) <= held * _HELD_CHARS
    own, asked = tests.where(F.col("size") > (_SHORT if few else 0)), F.lit(False)
    if short and few:
        own_tests = [(r.test, r.whole) for r in tests.where(F.col("size") <= _SHORT).toLocalIterator()]
        asked = _matching([spark.sparkContext.broadcast(PatternSet(tests=own_tests))])(F.col(f"`{path}`"))
    sizes = [size for size in by_size if size > (_SHORT if few else 0)]
    width = min(_MOST_BITS, max(15, (32 * sum(by_size[size].n for size in sizes)).bit_length()))
    bitmap = spark.sparkContext.broadcast(_bits(own, width))

    paths = rows.select(F.col(f"`{path}`").alias("path")).where("path is not null").distinct()
    # a merge join, as the planner can't know that a path becomes several rows and might broadcast them
    pairs = paths.mapInArrow(_met(bitmap, width, sizes), "path string, key long").hint("merge").join(own, "key").select("path", "test", "whole")
    if not few and 0 in by_size:
        # for each test all paths of a partition follow, so that its glob is compiled once for them
        bare = tests.where("size = 0").select("test", "whole").repartition(max(spark.sparkContext.defaultParallelism, -(-by_size[0].n // 10_000)))
        pairs = pairs.union(bare.hint("shuffle_replicate_nl").crossJoin(paths).select("path", "test", "whole"))
    hit = "hit"
    while hit in {c.lower() for c in [*rows.columns, name]}:
        hit += "_"
    hits = pairs.where(_tried()("path", "test", "whole")).select(F.col("path").alias(hit)).distinct()
    answer = F.when(F.col(f"`{path}`").isNotNull(), F.col(hit).isNotNull() | asked)
    return rows.join(hits, F.col(f"`{path}`") == F.col(hit), "left").withColumn(name, answer).drop(hit)


def excluded_by(rows: DataFrame, path: str, patterns: DataFrame | Iterable[str], name: str = "excluded", block: int = 100_000, held: int = 100_000) -> DataFrame:
    """rows with a boolean column: whether any pattern (of a list, or of the first column of a table) matches the path; null for a null path.

    Up to `held` distinct patterns go to tasks in blocks of about so many, each an automaton of its own; all are asked in one node of the plan. More, or very long ones, are joined with the paths.
    Blank and null patterns match nothing. A column of rows with that name is replaced.
    """
    context = rows.sparkSession.sparkContext
    if not isinstance(patterns, DataFrame):
        patterns = list(dict.fromkeys(patterns))
        if len(patterns) > held or sum(len(p or "") for p in patterns) > held * _HELD_CHARS:
            patterns = rows.sparkSession.createDataFrame([(p,) for p in patterns], "p string")
    if isinstance(patterns, DataFrame):
        distinct = patterns.select(F.col(f"`{patterns.columns[0]}`").cast("string").alias("p")).where("p is not null").distinct()
        n, chars = distinct.agg(F.count("*"), F.coalesce(F.sum(F.length("p")), F.lit(0))).first()
        if n > held or chars > held * _HELD_CHARS:
            return _joined(rows, path, distinct, name, held)
        blocks = max(1, -(-n // block))
        parts = ([r.p for r in distinct.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b).toLocalIterator()] for b in range(blocks))
    else:
        parts = (patterns[at : at + block] for at in range(0, max(1, len(patterns)), block))
    return rows.withColumn(name, _matching([context.broadcast(PatternSet(part)) for part in parts])(F.col(f"`{path}`")))
