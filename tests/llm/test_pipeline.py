from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import corpus_pipeline as P
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_pairs import _groups, _shingles

from sedgewire.llm.byte_bpe import read_ranks
from sedgewire.llm.common import files_for, gathered, shared_folder
from sedgewire.llm.mixing import ORACLE
from sedgewire.oracle import duck

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _without_boilerplate(rows, min_sites=8):
    """Plain line dedup of (doc_id, text, lang, source) with different ids."""
    site, sites, first = {}, defaultdict(set), {}
    for i, text, _, source in rows:
        if text is not None:
            site[text] = min(site.get(text, "~"), "" if source is None else "=" + source)
    for text, s in site.items():
        for line in text.split("\n"):
            sites[line.strip(" \t\r")].add(s)
    for i, text, _, _ in sorted(rows):
        for p, line in enumerate((text or "").split("\n")):
            first.setdefault(line.strip(" \t\r"), (i, p))
    gone = lambda i, p, line: line and len(sites[line]) >= min_sites and first[line] != (i, p)
    cut = lambda i, text: "\n".join(x for p, x in enumerate(text.split("\n")) if not gone(i, p, x.strip(" \t\r")))
    return [(i, text if text is None else cut(i, text), lang, source) for i, text, lang, source in rows]


def _group_heads(rows, k=5, percent=80):
    sets, places = {r[0]: _shingles(r[1], k) for r in rows}, defaultdict(list)
    for i, own in sets.items():
        for x in own:
            places[x].append(i)
    shared = Counter((a, b) for ids in places.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    root = _groups(sets, [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)])
    return [r for r in rows if root[r[0]] == r[0]]


def test_run_equals_a_plain_version(spark, tmp_path):
    names = "doc_id text lang source".split()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = P.drop_toxic(spark, docs, DATA).checkpoint()
    assert clean.columns == docs.columns and 0.6 * docs.count() < clean.count() <= docs.count()
    rows = _without_boilerplate([tuple(r) for r in clean.select(names).collect()])
    rows = _group_heads(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duck(DATA)
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    mixed = con.sql(f"SELECT doc_id, size, taken FROM ({ORACLE})").fetchall()
    copies = {i: taken // size for i, size, taken in mixed if size}
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter((i, source, lang, tuple(real.encode_ordinary(text or ""))) for i, text, lang, source in rows for _ in range(copies.get(i, 0)))
    done = clean
    for _, stage in P.STAGES[1:]:
        done = stage(spark, done, DATA).checkpoint()
    got = Counter((r.doc_id, r.source, r.lang, tuple(r.ids)) for r in done.collect())
    assert done.where("not round_trip or n_tokens <> size(ids)").count() == 0
    assert {k: n for k, n in got.items() if k[3] and k[0] in copies} == dict(want)
    assert P.run(spark, DATA).count() == done.count()


def test_stages_on_odd_rows(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "mixing", "byte_bpe"]
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "w " * 3000, None, None, 6000), (3, "same text here now ok yes", "en", "b", 1), (4, "same text here now ok yes", "en", None, 1), (4, "same text here now ok yes", "en", None, 1)]
    odd = spark.createDataFrame(rows, SCHEMA)
    ids = lambda frame: sorted((r.doc_id is None, r.doc_id or 0) for r in frame.collect())
    every = ids(odd)
    assert ids(P.drop_toxic(spark, odd, DATA)) == every  # too few labels: nothing is learned, nothing goes
    assert ids(P.drop_boilerplate(spark, odd, DATA)) == every
    assert ids(P.drop_near_copies(spark, odd, DATA)) == [(False, 1), (False, 2), (False, 3), (True, 0)]  # repeated rows count as one
    mixed = P.mix_sources(spark, odd, DATA)
    assert mixed.columns == odd.columns and set(ids(mixed)) <= set(every)
    assert {r.doc_id: (r.n_tokens, r.round_trip) for r in P.tokenize(spark, odd, DATA).where("doc_id is null or doc_id < 2").collect()} == {None: (0, True), 1: (0, True)}
    for _, stage in P.STAGES:
        assert stage(spark, odd.limit(0), DATA).count() == 0


def test_stages_write_few_files_of_small_tables(spark):
    near = [f"a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} {end}" for k in range(100) for end in ("i", "i j")]  # 5 of 6 shingles are shared
    rows = [(i, f"one line for all sites\n{t}", "en", f"s{i % 12}", 0) for i, t in enumerate(near)]
    top, before = Path(urlparse(shared_folder(spark)).path), set()
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    past = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        done = spark.createDataFrame(rows, SCHEMA).repartition(40).localCheckpoint()
        for name, stage in P.STAGES[:-1]:
            before = set(top.rglob("rdd-*"))
            done = stage(spark, done, DATA).localCheckpoint()
            made = {x: len(list(x.glob("part-*"))) for x in set(top.rglob("rdd-*")) - before}
            assert made and max(made.values()) <= 4, (name, made)  # as many as there are cores
            if name == "minhash_near_dedup":
                assert sorted(r.doc_id for r in done.collect()) == [0, 1, *range(2, 200, 2)]  # the first keeps the line, and so is no near copy
    finally:
        for k, v in past.items():
            spark.conf.set(k, v)


def test_large_tables_keep_their_partitions(spark):
    docs = spark.createDataFrame([(1, "x" * 3000), (2, None), (3, "y")], "doc_id long, text string").repartition(7)
    assert files_for(docs) == (4, 4) and files_for(docs, most=500) == (7, 4) and files_for(docs.limit(0)) == (4, 4)
    assert files_for(spark.range(90).select(F.lit("z").alias("text")), rows=10) == (9, 9)
    assert [gathered(docs, n).rdd.getNumPartitions() for n in (None, 2, 3)] == [7, 2, 7]  # 4 partitions in a shuffle
