import itertools
import random
from collections import Counter

import numpy as np
import pytest

from sedgewire.llm import superminhash
from sedgewire.llm.common import arrow_bytes, bitmap_of
from sedgewire.llm.components import connected_components
from sedgewire.llm.embedding_groups import _cell_links, embedding_groups
from sedgewire.llm.near_duplicates import drop_near_duplicates, near_duplicate_groups
from sedgewire.llm.repeated_spans import remove_repeats
from sedgewire.llm.run_length_index import build

DOC = "doc_id long, text string"


def _groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    chain = rng.sample(range(500, 530), 30)  # names in no order, as hashes are
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + list(zip(chain[:-1], chain[1:], strict=True)) + [(900, 900)]
    want = _groups({x for p in links for x in p} - {900}, [p for p in links if p[0] != p[1]])
    want = {n: r for n, r in want.items() if any(n in p and p[0] != p[1] for p in links)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == len(want) and {(got[a], want[a]) for a in want}.__len__() == len(set(want.values())) == len(set(got.values()))


def test_superminhash_is_the_sequential_one_and_estimates():
    rng = np.random.default_rng(1)
    m = 48
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 60, 0, 200)]
    firsts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = superminhash.signatures(np.concatenate(sets), firsts, m)
    for s, row in zip(sets, got, strict=True):
        best = [2**64 - 1] * m
        for e in s:
            p = list(range(m))
            for rank in range(m):
                value, draw = superminhash._draw(np.array([e]), rank)
                k = rank + int(draw[0]) % (m - rank)
                p[rank], p[k] = p[k], p[rank]
                best[p[rank]] = min(best[p[rank]], int(value[0]))
        assert row.tolist() == best
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    both = superminhash.signatures(np.concatenate([a[:800], a[100:]]), np.array([0, 800, 1600]), 512)
    assert (both[0] == both[1]).mean() == pytest.approx(700 / 900, abs=0.08)


def _shingles(text, k):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def _near_texts():
    rng = random.Random(4)
    out = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 8, 60, 120]))]
        out.append(base)
        for _ in range(rng.randrange(8)):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(400)}"
            out.append(copy)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, k, percent):
    texts = _near_texts() + ["", None, " \n", "One two", "one  TWO", "one two"]
    rows = list(enumerate(texts))
    sets = [_shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = _groups(range(len(texts)), links)
    docs = spark.createDataFrame(rows, DOC)
    got = near_duplicate_groups(docs, k=k, percent=percent, block_rows=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i, _ in rows}
    assert sorted(r.doc_id for r in drop_near_duplicates(docs.union(docs), k=k, percent=percent).collect()) == sorted(set(want.values()))
    assert near_duplicate_groups(docs.limit(0)).count() == 0


def test_near_duplicates_of_the_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets, places = {r.doc_id: _shingles(r.text, 3) for r in rows}, {}
    for i, own in sets.items():
        for x in own:
            places.setdefault(x, []).append(i)
    shared = Counter(p for ids in places.values() for p in itertools.combinations(ids, 2))
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    want = _groups(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_groups(docs, k=3, percent=85).collect()}
    assert links and got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_embedding_groups_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, centers = [], rng.standard_normal((6, 8))
    for i in range(240):
        v = centers[i % 6] + rng.standard_normal(8) * rng.choice([0.0, 0.1, 0.4])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2)))
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] + [1.0] * 7, 1), (303, rows[0][1], None), (304, [None] + [1.0] * 7, 0), (305, [float("inf")] * 8, 0), (306, rows[0][1], 0), (307, [x * 2 for x in rows[0][1]], 0)]
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    u = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in ok}
    links = [(a[0], b[0]) for i, a in enumerate(ok) for b in ok[:i] if a[2] == b[2] and u[a[0]] @ u[b[0]] >= 0.93]
    want, n = _groups([r[0] for r in rows], links), Counter(x for p in links for x in p)
    got = embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cell_rows=16).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {r[0]: (n[r[0]], want[r[0]], want[r[0]] == r[0]) for r in rows}


def test_embedding_links_of_boundary_copies_in_any_order():
    import pandas as pd

    near = [np.array([1.0, 0.01 * k]) for k in range(3)]
    rows = [(b"home", True, 2, near[0]), (b"copy", False, 3, near[1]), (b"more", True, 5, near[2])]
    for order in itertools.permutations(rows):
        cell = pd.DataFrame(order, columns=["node", "home", "copies", "vector"]).assign(x=0, y=0, block=0)
        cell["vector"] = [v / np.linalg.norm(v) for v in cell["vector"]]
        got = _cell_links(cell, 0.93)
        assert dict(zip(got["node"], got["n"], strict=True)) == {b"home": 8, b"copy": 7, b"more": 5}
        assert got["root"].nunique() == 1


def test_embedding_groups_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    u = rng.standard_normal((600, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    label = np.arange(600) % 6
    near = np.triu((u @ u.T >= 0.93) & (label[:, None] == label), 1)
    links, n = np.argwhere(near).tolist(), (near + near.T).sum(axis=1)
    want = _groups(range(600), links)
    rows = spark.createDataFrame([(i, v.tolist(), i % 6) for i, v in enumerate(u)], "vec_id long, embedding array<double>, label int").repartition(9)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = embedding_groups(rows, cell_rows=16, part_rows=40).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (n[i], want[i]) for i in range(600)}


def test_clustered_embeddings_and_the_table(spark):
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((40, 16))
    x = centers[rng.integers(40, size=900)] + rng.standard_normal((900, 16)) * rng.choice([0.02, 0.1, 0.25], size=(900, 1))
    made = spark.createDataFrame([(i, [float(a) for a in v.astype(np.float32)], f"l{i % 2}") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label string")
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    for frame, cosine in ((made, 0.93), (table, 0.93), (table, 0.5)):
        rows = frame.select("vec_id", "label", "embedding").where("embedding is not null").orderBy("vec_id").toPandas()
        u = np.stack(rows["embedding"]).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        same = rows["label"].to_numpy()[:, None] == rows["label"].to_numpy()
        near = np.triu((u @ u.T >= cosine) & same, 1)
        ids = rows["vec_id"].tolist()
        want, n = _groups(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)]), (near + near.T).sum(axis=1)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(frame, cosine=cosine, cell_rows=40, part_rows=100).collect()}
        assert got == {i: (k, want[i]) for i, k in zip(ids, n, strict=True)} and (frame is table or near.any())


def test_run_length_index_against_brute_force():
    rng = random.Random(3)
    for alphabet in (b"ab", b"abcd", bytes(range(256))):
        base = bytes(rng.choice(alphabet) for _ in range(300))
        strings = [base[(a := rng.randint(0, 200)) : a + rng.randint(0, 80)] + bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(6)]
        index = build(strings)
        got = index.matching()
        places = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
        for k, i in places:
            best = 0
            for k2, j in places:
                if (k, i) != (k2, j):
                    n = 0
                    while strings[k][i + n : i + n + 1] and strings[k][i + n : i + n + 1] == strings[k2][j + n : j + n + 1]:
                        n += 1
                    best = max(best, n)
            assert got[index.starts[k] + i] == best


def _removed(texts, window):
    seen = Counter(b[i : i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for b in texts:
        cover = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                cover[i : i + window] = b"\1" * window
        out.append(bytes(x for x, c in zip(b, cover, strict=True) if not c))
    return out


@pytest.mark.parametrize("group", [2_000, 2])
def test_repeats_against_brute_force(spark, group):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(2, 9)))
    passage = "".join(word() for _ in range(120))
    texts = ["".join(word() for _ in range(rng.randint(0, 60))) + passage[(a := rng.randint(0, 200)) : a + rng.randint(100, 420)] + "".join(word() for _ in range(40)) for _ in range(25)]
    texts += [word() + passage[100:293] + word() for _ in range(8)]  # a shared passage under 200 bytes within longer common ones
    texts += [texts[0], "a" * 500, "ab" * 120, "", None, "z" * 199, "y" * 200, "y" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).selectExpr("*", "1 AS ranges", "2 AS text_key", "3 AS N_Spans")
    cut = remove_repeats(docs, group=group, share=5)
    assert cut.columns == ["doc_id", "text", "ranges", "text_key", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    got = {r.doc_id: r for r in cut.collect()}
    raw = [(t or "").encode() for t in texts]
    for i, kept in enumerate(_removed(raw, 200)):
        assert (got[i].n_bytes, bytes(got[i].kept), got[i].n_removed, got[i].ranges) == (len(raw[i]), kept, len(raw[i]) - len(kept), 1), i
    if group == 2_000:
        assert remove_repeats(docs.limit(0)).count() == 0


def test_repeats_of_the_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs).collect()}
    assert got == {r.doc_id: kept for r, kept in zip(rows, _removed([(r.text or "").encode() for r in rows], 200), strict=True)}


def test_nulls_in_arrow_columns():
    import pyarrow as pa

    data, offsets = arrow_bytes(pa.array(["é", None, "b"])[1:])
    assert [bytes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [b"", b"b"]


def test_placing_many_vectors_among_many_pivots_takes_bounded_memory():
    import subprocess
    import sys

    code = (
        "import resource, numpy as np, pandas as pd; from sedgewire.llm import embedding_groups as E; r = np.random.default_rng(1)\n"
        "own = pd.DataFrame({'node': [b'n'] * 20_000, 'copies': 1, 'embedding': list(r.normal(size=(20_000, 16)))})\n"
        "pivots = pd.DataFrame({'cell': range(3_000), 'embedding': list(r.normal(size=(3_000, 16))), 'radius': 0.3})\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "E._radii(('l', 16), own, pivots); out = E._place(('l', 16), own, pivots, 0.37)\n"
        "print(len(out), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    rows, mb = map(int, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, timeout=300).stdout.split())
    assert rows >= 20_000 and mb < 400, (rows, mb)


def _shuffled(spark):
    """Bytes that this session's stages have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_of_near_duplicates_are_not_shuffled(spark):
    near = [f"a{k} b{k} c{k} d{k} {end}" for k in range(2_600) for end in ("x", "y")]  # 5,200 candidates: 2 of 4 shingles are shared
    rng = random.Random(8)
    lone = [" ".join(rng.randbytes(250).hex() for _ in range(200)) for _ in range(300)]  # 30 MB
    docs = spark.createDataFrame(list(enumerate(near + lone)), DOC).repartition(6).localCheckpoint()
    before = _shuffled(spark)
    got = near_duplicate_groups(docs, k=3, percent=50, bands=24, rows=1)
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: k - k % 2 if k < 5_200 else k for k in range(5_500)}
    assert _shuffled(spark) - before < 25e6


@pytest.mark.parametrize("width", [15, 20])
def test_bitmap_has_the_leading_bits_of_keys(spark, width):
    rng = np.random.default_rng(3)
    keys = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 300), [0, -1, 2**63 - 1, -(2**63)]])
    got = bitmap_of(spark.createDataFrame([(int(x),) for x in keys], "k long").repartition(5), "k", width)
    want = np.zeros(1 << width, bool)
    want[(keys.view(np.uint64) >> np.uint64(64 - width)).astype(int)] = True
    assert (np.unpackbits(got, bitorder="little").astype(bool) == want).all()
