import fnmatch
import random
import time

import pytest
from pyspark.sql import functions as F

from sedgewire.functions import columns as C
from sedgewire.functions import patterns as P
from sedgewire.functions.patterns import PatternSet, excluded_by, literal_part, normalized


def _plain(path, patterns):
    """The rule for one path, a pattern at a time."""
    low = path.lower()
    for p in map(normalized, patterns):
        if p and (p in low if not any(c in p for c in "*?[") else fnmatch.fnmatchcase(low, p) or p.startswith("*/") and fnmatch.fnmatchcase(low, p[2:])):
            return True
    return False


def test_literal_parts():
    assert [literal_part(g) for g in ("*.jpg", "a?bcd*", "[abc]x", "[!]]yy", "*", "x[", "[]a]b")] == [".jpg", "bcd", "x", "yy", "", "x[", "b"]


def test_pattern_set_equals_one_by_one():
    r = random.Random(5)
    for _ in range(3000):
        patterns = ["".join(r.choices("ab/*?[]!.A ", k=r.randint(0, 6))) for _ in range(r.randint(0, 6))]
        path = "".join(r.choices("ab/[].B!", k=r.randint(0, 9)))
        assert PatternSet(patterns)(path) == _plain(path, patterns), (patterns, path)


@pytest.mark.parametrize("block", [100_000, 3000])
def test_ten_thousand_patterns_in_one_node(spark, block):
    patterns = [f"*/dir{k}/*.[jp]*" if k % 3 == 0 else f"name{k}." if k % 3 == 1 else f"*x{k}?" for k in range(10_000)] + ["", None, " "]
    rows = spark.range(2001).select(F.when(F.col("id") < 2000, F.concat(F.lit("/a/DIR"), F.col("id").cast("string"), F.lit("/name"), (F.col("id") * 7).cast("string"), F.lit(".jpg"))).alias("path"), F.lit(1).alias("Excluded"))
    table = spark.createDataFrame([(p,) for p in patterns], "p string")
    got = excluded_by(rows, "path", table, block=block)
    began = time.time()
    told = {r.path: r.excluded for r in got.collect()}
    assert time.time() - began < 30 and told.pop(None) is None
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    sample = list(told)[::97]
    assert [told[p] for p in sample] == [_plain(p, [x for x in patterns if x]) for p in sample] and 0 < sum(told.values()) < 2000


def test_column_form_and_set_agree(spark):
    patterns = ["UTM_", "*/fr/*", "https://m.*", "[ab]*", "*/x.png"]
    rows = spark.createDataFrame([("https://m.a/",), ("http://b/FR/1",), ("x.png",), ("d/x.png",), ("axe",), ("see?utm_=1",), ("other",)], "path string")
    both = excluded_by(rows, "path", patterns).withColumn("other", C.excluded(F.col("path"), patterns)).collect()
    assert [r.excluded for r in both] == [r.other for r in both] == [True, True, True, True, True, True, False]
    assert {r.excluded for r in excluded_by(rows, "path", []).collect()} == {False}


def test_a_large_table_of_patterns_is_not_held_by_tasks(spark, monkeypatch):
    held, matching = [], P._matching
    monkeypatch.setattr(P, "_matching", lambda shared: held.extend(len(b.value.words) + len(b.value.bare) for b in shared) or matching(shared))
    text = "CASE id % 6 WHEN 0 THEN '/' || id || '#' WHEN 1 THEN ' */' || id WHEN 2 THEN 'HTTP*://*/' || id || '[?#]*' WHEN 3 THEN 'en/' || id || '?PAGE=*' WHEN 4 THEN '*[!0-9]' || id || '?*[x-z]' ELSE '  ' END"
    table = spark.range(150_000).selectExpr(f"{text} p")
    paths = [f"{start}/{k}{end}" for k in (5, 14, 77, 1236, 44_446, 149_998, 150_001) for start in ("http://a.example/en", "en", "", "HTTPS://B") for end in ("", "#top", "?page=2", "?x=z")]
    rows = spark.createDataFrame([(p,) for p in [*paths, paths[0], None]], "path string")
    told = [(r.path, r.excluded) for r in excluded_by(rows, "path", table).collect()]
    assert sum(held) < 1000
    every = PatternSet(r.p for r in table.collect())
    assert sorted(told, key=str) == sorted(((p, None if p is None else every(p)) for p in [*paths, paths[0], None]), key=str)
    assert 0 < sum(bool(x) for _, x in told) < len(paths)


@pytest.mark.parametrize("held", [0, 250])
def test_joined_patterns_equal_one_by_one(spark, held):
    r = random.Random(5)
    long = ["".join(r.choices("ab/.", k=r.randint(12, 90))) for _ in range(200)]
    paths = ["".join(r.choices("abAB/.é[]x", k=r.randint(0, 12))) for _ in range(200)] + [r.choice("ab/") + p.upper() + "b" for p in long[::9]] + ["", "İ[", "ab", "ab"]
    short = ["".join(r.choices("ab/*?[]!.A é", k=r.randint(1, 6))) for _ in range(200)] + [f"*{k}ab/*b[.a]" for k in "/.ab"] + ["*/", "*/b/a", "x[", "i\u0307[", "??[!b]", "[[]?[ab]", "[ab]"]
    patterns = [*long, *(p for p in short if sum(_plain(x, [p]) for x in paths) < 7), "", None]  # the others would decide nearly all
    rows = spark.createDataFrame([(k, p, "x") for k, p in enumerate([*paths, None])], "id int, `a.path` string, HIT string")
    for given in (patterns, spark.createDataFrame([(p,) for p in patterns], "`p.q` string")):
        out = excluded_by(rows, "a.path", given, name="hit_", held=held)
        assert out.columns == ["id", "a.path", "HIT", "hit_"]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("Cartesian" in plan or "NestedLoop" in plan, "matches(" in plan) == ((True, False) if held == 0 else (False, True))
        told = {x.id: x.hit_ for x in out.collect()}
        assert told == {k: _plain(p, [x for x in patterns if x]) for k, p in enumerate(paths)} | {len(paths): None}
        assert 40 < sum(map(bool, told.values())) < 200


def test_few_very_long_patterns_are_joined(spark, monkeypatch):
    made = []
    monkeypatch.setattr(P, "_joined", lambda *args, f=P._joined: made.append(args) or f(*args))
    rows = spark.createDataFrame([("x" * 9000 + "1/y",), ("x" * 9000 + "3/y",)], "path string")
    given = ["x" * 9000 + f"{k}/" for k in range(3)]
    assert [x.excluded for x in excluded_by(rows, "path", given, held=500).orderBy("path").collect()] == [True, False] and len(made) == 1


def test_pieces_cover_what_is_literal():
    r = random.Random(7)
    for _ in range(500):
        test = "".join(r.choices("abcd*", (9, 9, 9, 9, 1), k=r.randint(0, 150)))
        pieces = list(P._pieces(test))
        assert {k for at, size in pieces for k in range(at, at + size)} == {k for k, c in enumerate(test) if c != "*"}
        tests, of, size, hashes = P._known_by([test, "z" + test])
        for k, n, h in zip(of, size, hashes, strict=True):
            assert h in dict(P._hashes(["q" + tests[k][0]], [int(n)]))[n]
