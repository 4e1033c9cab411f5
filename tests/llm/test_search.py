import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sedgewire.llm import lexical_search, pii, queries, resampling
from sedgewire.llm.pii_samples import sample_texts
from sedgewire.llm.terms import terms_of
from sedgewire.oracle import difference, duck

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = [
    (1, "Red fox, red FOX; red"), (2, None), (3, ""), (4, "red fox red fox red"), (5, "Éa éa fox_fox 12"), (6, "..."), (7, "fox " * 3000 + "den"), (8, "red"), (9, "red"), (9, "red"), (10, "a b c den den " * 40),
]
ITEMS = [(1, "red fox Red"), (2, None), (3, "???"), (4, "den a éa"), (5, "nowhere"), (1, "red fox Red")]


def words_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    lists = [(d, Counter(words_of(t))) for d, t in docs]
    lists = [(d, c) for d, c in lists if c]
    n, length = len(lists), sum(sum(c.values()) for _, c in lists)
    df = Counter(t for _, c in lists for t in c)
    out = []
    for item, text in dict(items).items():
        scored = []
        for d, c in lists:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words_of(text) if t in c)
            scored += [(-s, d)] * (s > 0)
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_terms_in_parts_equal_terms_of_the_whole():
    texts = ["One two", None, "", "x" * 500, "Three-four " * 90 + "fünf", "...", "Seven"]
    whole = [(r, w) for r, t in enumerate(texts) for w in words_of(t)]
    for most in (40, 64, 700, 1 << 20):
        for overlap in (0, 2):
            got = []
            for t in terms_of(pa.array(texts), most, overlap):
                got += [(int(t.row[i]), t.data[t.starts[i] : t.ends[i]].tobytes().decode()) for i in range(t.fresh)]
            assert got == whole, (most, overlap)


@pytest.mark.parametrize("block", [1_000_000, 2])
def test_search_equals_brute_force(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS CODES", "2 AS score")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS term")
    got = sorted(tuple(r) for r in lexical_search.search(docs, items, k=3, block=block).collect())
    assert got == plain_search(DOCS, ITEMS, 3)


def test_search_with_text_ids_and_without_rows(spark):
    docs, items = spark.createDataFrame([("a", "red"), (None, "red")], "doc_id string, text string"), spark.createDataFrame([("q", "red")], "item_id string, text string")
    found = lexical_search.search(docs, items).orderBy("rank").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in found] == [("q", 1, None), ("q", 2, "a")] and found[0].score == found[1].score > 0
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert lexical_search.search(d, i).collect() == []


def test_pruned_search_finds_the_same():
    """Thresholds prune terms and the rest is still exact: one part of an index against plain sums."""
    rng = np.random.default_rng(4)
    docs, terms, items, k = 3000, 60, 12, 5
    chance = 1 / np.arange(1, terms + 1)
    rows = [np.flatnonzero(rng.random(terms) < chance) for _ in range(docs)]
    tf = [rng.integers(1, 6, len(r)) for r in rows]
    df = np.bincount(np.concatenate(rows), minlength=terms)
    length = np.array([t.sum() for t in tf])
    impacts = lexical_search.Impacts(docs, int(length.sum()), np.floor(1000 * np.log((2.0 * docs + 2) / (2.0 * df + 1))).astype(np.int64))
    lists = lambda x: pa.array([v.tolist() for v in x], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(docs)), pa.array(length), lists(rows), lists(tf)], names=["doc_id", "n", "codes", "tfs"])
    part = next(lexical_search._top_impacts(iter([batch]), impacts, k))
    top, kth = np.zeros(terms, np.int64), np.zeros(terms, np.int64)
    for c in range(terms):
        own = np.sort(part.column("impact").to_numpy()[part.column("code").to_numpy() == c])[::-1]
        top[c], kth[c] = own[0], own[k - 1] if len(own) == k else 0
    item = np.repeat(np.arange(items), 9)
    code = np.concatenate([rng.choice(terms, 9, replace=False) for _ in range(items)])
    repeats = rng.integers(1, 3, len(item))
    plan = lexical_search.Plan(pa.array(np.arange(items)), item, code, repeats, top, kth, impacts, k)
    assert plan.pruned > 10
    found = next(lexical_search._search(iter([batch.slice(0, 1000), batch.slice(1000)]), plan)).to_pylist()
    row, c, value = lexical_search._postings(batch, impacts)
    score = np.zeros((docs, terms), np.int64)
    score[row, c] = value
    for i in range(items):
        total = score[:, code[item == i]] @ repeats[item == i]
        want = sorted((-s, d) for d, s in enumerate(total.tolist()) if s > 0)[:k]
        assert [(-r["score"], r["doc_id"]) for r in found if r["item_id"] == i] == want


def test_search_of_the_table_equals_its_sql(spark):
    assert difference(queries.op11_lexical_search(spark, SMALL), duck(SMALL), queries.ORACLE_SQL["op11_lexical_search"]) == ""


def plain_resample(docs, items, percent, least, buckets=10_000):
    def features(text):
        w = words_of(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    met = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, _, f in met for b in f), Counter(b for _, text in items for b in features(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for d, n, f in met:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    can = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0]))
    drawn = {r[0]: k for k, r in enumerate(can[: percent * len(can) // 100], 1)}
    return sorted((r[:4] + (drawn.get(r[0]),) for r in rows), key=str)


def test_resampling_equals_brute_force(spark, monkeypatch):
    docs = [(i, t) for i, (_, t) in enumerate(DOCS)] + [(100 + i, f"red fox w{i} " * (i + 1)) for i in range(30)] + [(200, "Wörter " + "lang" * 300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS WEIGHT", "2 AS Rank", "'y' AS other")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = terms_of
    for most in (1 << 20, 50):
        monkeypatch.setattr(resampling, "terms_of", lambda column, overlap, most=most: whole(column, most, overlap))
        got = resampling.resample(frame, items, percent=40, min_words=5)
        assert "other" in got.columns and len(got.columns) == 7
        rows = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
        assert rows == plain_resample(docs, ITEMS, 40, 5)
        if most == 50:  # the same in parts, in one process
            batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs]})
            parts = resampling._weigh(batch, np.arange(10_000)), resampling._bucket_counts(iter([batch]), 10_000)
            monkeypatch.setattr(resampling, "terms_of", lambda column, overlap: whole(column, 1 << 20, overlap))
            again = resampling._weigh(batch, np.arange(10_000)), resampling._bucket_counts(iter([batch]), 10_000)
            assert parts[0].equals(again[0]) and next(parts[1]).equals(next(again[1]))


def test_resampling_without_rows(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert resampling.resample(docs.limit(0), items).collect() == []
    assert {r.rank for r in resampling.resample(docs, items.limit(0)).collect()} == {None}
    odd = spark.createDataFrame([(None, "a b c"), ("x", None)], "doc_id string, text string")
    assert sorted(tuple(r) for r in resampling.resample(odd, items, percent=100, min_words=3).select("n_features", "rank").collect() if r.rank) == [(6, 1)]


def test_resampling_of_the_table_equals_brute_force(spark):
    table = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(key, "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_importance_resampling(spark, SMALL).collect()), key=str)
    assert got == plain_resample(table("documents", "doc_id"), table("benchmark", "item_id"), 5, 20)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def right(kind, m):
        d = re.sub("[^0-9]", "", m)
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, text) if right(k, m[0])] for k, p in PLAIN.items()}


def test_strict_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(9)
    for n in range(20_000):
        text = "".join(rng.choice(list("a@.-+ 0123456789()é_%"), rng.integers(1, 50)))
        assert pii.strict_spans(text) == plain_spans(text), text
    for text, _ in sample_texts(300, 1):
        assert pii.strict_spans(text) == plain_spans(text), text


def test_chosen_spans_on_held_out_texts():
    model, counts = pii.fitted(), Counter()
    for text, truth in sample_texts(1200, 99):
        strict = pii.strict_spans(text)
        got = {(k, s, e) for k, s, e, _ in pii.chosen(text, strict, model)}
        wanted = set(truth) - {(k, s, e) for k in pii.KINDS for s, e in strict[k]}
        for kind in pii.KINDS:
            for what, spans in (("right", got & wanted), ("wrong", got - wanted), ("missed", wanted - got)):
                counts[kind, what] += sum(x[0] == kind for x in spans)
    for kind in pii.KINDS:
        right = counts[kind, "right"]
        assert right > 100 and right / (right + counts[kind, "wrong"]) >= 0.96 and right / (right + counts[kind, "missed"]) >= 0.9, counts


def test_pii_query_and_odd_texts(spark):
    clean = ["", None, "plain words at the end. The dot", "2024-01-15 12:30:45, pages 10-20", "x" * 20_000, "1 " * 4000, "@" * 3000, "1." * 3000, "+1(" * 3000]
    told = ["a@b.co and 10.0.0.1", "4111 1111 1111 1111", "+1 (743) 555-3824", "mail: anna [at] foo [dot] com", "call (743) 555-3824 now", "é a@b.co"]
    docs = spark.createDataFrame(list(enumerate(clean + told + told)), "doc_id long, text string").selectExpr("*", "1 AS SPANS", "2 AS n_email")
    rows = sorted(pii.span_digests(docs).collect())
    for r, text in zip(rows, clean + told + told, strict=True):
        want = plain_spans(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in want[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(want[k]) for k in pii.KINDS) and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(",")) and (text in told or r.n_added == 0), (text or "")[:50]
    assert [r.n_added for r in rows[-6:]] == [0, 0, 0, 1, 1, 0] and rows[-1].spans == "email:2:8"
    cut = {r.doc_id: r.text for r in pii.find(docs, redact=True).collect()}
    n = len(clean)
    assert [cut[n + k] for k in (0, 3, 4)] == ["[EMAIL] and [IP]", "mail: [EMAIL]", "call [PHONE] now"] and cut[1] is None
    assert pii.span_digests(docs.limit(0)).collect() == []


def test_pii_on_the_table_leaves_clean_texts_alone(spark):
    rows = queries.op12_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and sum(r.n_added > 0 for r in rows) <= 2
