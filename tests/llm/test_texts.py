import hashlib
import html
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from layouts import PAGES

from sedgewire.llm import byte_bpe, html_extraction, language_id, mixing, pii, queries, resampling, toxicity, transport_stream
from sedgewire.llm.common import in_batches
from sedgewire.llm.near_duplicates import drop_near_duplicates
from sedgewire.llm.page_samples import sample_pages
from sedgewire.llm.page_tree import AT, features, read_page
from sedgewire.llm.repeated_spans import remove_repeats

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "a", "Hello   world!!\n\n  it's 2024", "é" * 300, "日本語 text \U0001f600", "x" * 5000, " \t\n ", "<|endoftext|>", "thentlytionor " * 50]


def test_transport_stream_round_trip_and_faults():
    for n in (64, 128, 192, 32_768, 32_704, 65_600, 300_032):
        payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        media = transport_stream.write_stream(payload, first_pts=(1 << 33) - 3600)
        assert len(media) % 188 == 0
        found = transport_stream.read_stream(media)
        assert found.payload == {0x100: payload} and found.streams == {0x100: 6} and not (found.continuity_errors or found.bad_packets or found.table_errors)
        assert found.units[0x100][0] == (0, (1 << 33) - 3600, True) and (n <= 32_768 or found.units[0x100][1][1] == 0)
    lost = media[: 188 * 10] + media[188 * 11 :]
    assert transport_stream.read_stream(lost).continuity_errors == 1
    broken = bytearray(media)
    broken[188 * 12] = 0
    broken[20] ^= 1
    told = transport_stream.read_stream(bytes(broken) + b"x")
    assert told.bad_packets == 2 and transport_stream.read_stream(b"").packets == 0


def test_media_digests(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in transport_stream.media_digests(docs).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.slot(k) for k in keys) == list(range(3000))


def test_bpe_equals_tiktoken(spark):
    ranks = byte_bpe.read_ranks(PATH)
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("doc_id", "text", "1 as IDS")
    encoded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    for r in byte_bpe.decode(encoded, PATH).collect():
        assert r.ids == real.encode_ordinary(TEXTS[r.doc_id] or "") and bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode()
    both = byte_bpe.transcode(docs.selectExpr("*", "0 as DECODED", "doc_id as other"), PATH, public_tokenizers.PATTERN)
    assert both.columns == ["doc_id", "other", "ids", "decoded", "exact"]
    for r in both.collect():
        assert r.exact and r.ids == real.encode_ordinary(TEXTS[r.doc_id] or "") and bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode()
    small = byte_bpe.Encoder(byte_bpe.Vocabulary(ranks), public_tokenizers.PATTERN, kept_bytes=900)
    assert [np.frombuffer(small(t or ""), np.int32).tolist() for t in TEXTS] == [real.encode_ordinary(t or "") for t in TEXTS]
    assert small.held <= 450 + 6 * max(len(t or "") for t in TEXTS)
    odd = spark.createDataFrame([([1, None, 10**6, -3],), (None,)], "ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(odd, PATH).collect()] == [next(t for t, k in ranks.items() if k == 1), b""]


def test_two_vocabularies_in_one_worker():
    ranks = {bytes([b]): b for b in range(256)}
    one, two = byte_bpe.Vocabulary(ranks | {b"ab": 256, b"cd": 257}), byte_bpe.Vocabulary(ranks | {b"ab": 257, b"cd": 256})
    ids = lambda v: np.frombuffer(byte_bpe._encoder(v, public_tokenizers.PATTERN)("abcd"), np.int32).tolist()
    assert (ids(one), ids(two)) == ([256, 257], [257, 256])


def test_pieces_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 10] * 5 + ["y" * 100, None, ""], "k": list(range(8))}).slice(1)
    got = list(in_batches(lambda b: b, [batch, batch.slice(0, 0)], rows=3, most=25))
    assert [b.num_rows for b in got] == [2, 2, 1, 2] and pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language_id.identify(docs, language_id.fit_on(docs)).withColumn("held", language_id.held_out(F.col("doc_id"), 3, 1))
    rows = told.where("held and lang is not null and lang_pred <> 'und'").selectExpr("avg(int(lang = lang_pred)) a", "min(lang_score) s").first()
    assert rows.a >= 0.98 and 0 <= rows.s <= 1
    odd = spark.createDataFrame([(1, None), (2, "123 !?"), (3, "")], "doc_id long, text string")
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit_on(docs)).collect()} == {"und"}
    assert language_id.identify(odd, None).count() == 3


def test_every_language_is_learned(spark):
    rows = [(8 * k + i, f"{chr(0x4E00 + 40 * k)}{chr(0x4E00 + 40 * k + i)} " * 9, f"l{k:03}") for k in range(230) for i in range(8)]
    known = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(known) > 200 and set(language_id.fit_on(docs).languages) == known


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "fit", lambda texts, langs: (len(texts), len(set(texts)), sorted(set(langs))))
    docs = spark.range(3000).selectExpr("id % 600 AS doc_id", "concat('text ', id % 600) AS text", "if(id % 600 < 30, 'xx', 'yy') AS lang")
    n, different, langs = language_id.fit_on(docs, sample=100)
    assert n == different and 50 < n <= 100 and langs == ["xx", "yy"]
    assert language_id.fit_on(docs.withColumn("lang", F.lit(None).cast("string"))) is None


def test_codewords_differ():
    for n in (1, 2, 4, 30):
        code = language_id.codewords(n)
        assert len({tuple(w) for w in code}) == n and (n == 1 or all(len(set(c)) == 2 for c in code.T))


def test_toxicity_gradients():
    net = toxicity.Network(np.arange(toxicity._SLOTS + 1) % toxicity.KEPT)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = np.frombuffer(b"the moron of and\na b c d e f\n", np.uint8)
    starts, ends = toxicity.words_of(data)
    lengths = np.array([4, 6])
    places = np.where(np.arange(toxicity.WORDS) < lengths[:, None], (np.cumsum(lengths) - lengths)[:, None] + np.arange(toxicity.WORDS), -1)
    y = np.array([1.0, 0.0])
    hashes = toxicity.hash_spans(data, starts, ends)

    def loss():
        logits, _ = net.forward(net.vectors(data, starts, ends, hashes)[0], places)
        return (np.logaddexp(0, logits) - y * logits).sum()

    x, words = net.vectors(data, starts, ends, hashes, keep=True)
    logits, inner = net.forward(x, places, keep=True)
    grads = net.gradients(x, places, inner, toxicity._sigmoid(logits) - y, words)
    assert {"byte", "byte_wf", "byte_ub", "word_cb"} <= set(grads)
    for name, g in grads.items():
        at, step = np.abs(g).argmax(), 1e-4
        net.p[name].flat[at] += step
        up = loss()
        net.p[name].flat[at] -= 2 * step
        down = loss()
        net.p[name].flat[at] += step
        assert (up - down) / (2 * step) == pytest.approx(float(g.flat[at]), rel=0.02, abs=1e-4), name


def test_toxicity_on_held_out_rows_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = queries.op7_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9 and n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) >= 0.8, n


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, **_: (len(texts), int(sum(toxic))))
    docs = spark.range(400).selectExpr("id % 100 AS doc_id", "concat('text ', id % 100) AS text")
    labels = spark.range(100).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    assert toxicity.fit_on(docs, labels, sample=20) == (20, 8)
    assert toxicity.fit_on(docs.limit(0), labels) is None and toxicity.fit_on(docs, labels.where("toxic = 1")) is None
    assert toxicity.fit_on(docs.selectExpr("doc_id", "'' AS text"), labels) is None


def test_toxicity_learns_and_handles_edges():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    make = lambda bad: " ".join([*(word() for _ in range(rng.integers(5, 90))), *(["zorkly" + word()] * bad), *(word() for _ in range(rng.integers(5, 90)))])
    labels = np.arange(200) % 2
    net = toxicity.fit([make(y).encode() for y in labels], labels)
    held = [make(y) for y in labels]
    score = toxicity.score_texts(net, *toxicity._texts([t.encode() for t in held]))
    assert ((score >= 0.3) == labels).mean() > 0.95
    long = (" ".join(word() for _ in range(3000)) + " zorklyab " + " ".join(word() for _ in range(3000))).encode()
    edges = toxicity._texts([b"", b" ... ", long, b"glued", b"words"])
    assert np.allclose(toxicity.score_texts(net, *edges, chunk=4000), toxicity.score_texts(net, *edges), atol=0.2)
    one_word = toxicity._texts([b"x" * 100_000])
    assert toxicity.score_texts(net, *one_word, chunk=4000).shape == (1,) and len(list(toxicity._long(one_word[0], 4000))) < 40
    assert toxicity.score_texts(net, *edges)[:2].tolist() == [0, 0]


def test_extraction_on_held_out_pages():
    model, wrong = html_extraction.fitted(), 0
    for source in sample_pages(120, 991):
        page, inside, _ = html_extraction._labels(source)
        x = features(page, model.odds)
        keep = html_extraction.decode(page, model.logits(x), np.expm1(x[:, AT["log_chars"]]))
        assert all(keep[b.parent] for b, k in zip(page.blocks[1:], keep[1:], strict=True) if k)
        wrong += [t for b, t in page.runs if keep[b]] != [t for b, t in page.runs if inside[b]]
    assert wrong <= 6


def test_extraction_on_the_pages(spark):
    got = {r.page_id: r.text for r in html_extraction.main_texts(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for page_id, source in duckdb.sql("SELECT page_id, html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*)</article>", source, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[page_id] == "\n".join(b for b in blocks if b)
    odd = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "", "just text &amp; more"), (4, "", "<div><p>unclosed <b>bold")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.main_texts(odd).collect()}[3] == "just text & more"


def test_extraction_keeps_loose_articles(spark):
    told = "The harbour was closed for a week, and the boats stayed in. Nobody could say when it would open again, not even the port office. "
    nav, foot, ad = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>", "<footer>&copy; example.com</footer>", "<div class='ad'>Buy our boats now.</div>"
    one = " ".join((told * 3).split())
    pages = {
        1: (f"<body>{nav}{told * 3}<br><br>{told}<br>{told * 2}{foot}</body>", [" ".join((told * 6).split())]),
        2: (f"<body>{nav}<span>{told * 3}</span>{ad}<font size=2>{told * 3}</font>{foot}</body>", [one, one]),
        3: (f"<body>{ad}<my-story>{told}<br>{told * 2}</my-story><hr>{told * 3}{foot}", [one, one]),
        4: (f"<body>{nav}<article><h1>Harbour closed</h1><p>{told * 3}</p></article>&copy; 2024 example.com &middot; All rights reserved.</body>", ["Harbour closed", one]),
    }
    got = html_extraction.main_texts(spark.createDataFrame([(k, "", v[0]) for k, v in pages.items()], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text.split("\n") for r in got} == {k: v[1] for k, v in pages.items()}


def test_extraction_on_other_layouts(spark):
    rows = [(k, name, source) for k, (name, (source, _)) in enumerate(PAGES.items())]
    got = {r.url: r.text.split("\n") for r in html_extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {name: want for name, (_, want) in PAGES.items()}


def test_page_tree_takes_linear_time():
    for bad in ("<a '", "<a b='", "<a b=\">'", "<button>", "<select><p>", "<noscript>", "<script>", "<!--", "<p>", "<b>", "<div>", "</b>", "<x a=' "):
        began = time.process_time()
        read_page(bad * (1_000_000 // len(bad)))
        assert time.process_time() - began < 8, bad


def test_page_tree_closes_what_html_closes():
    page = read_page("<p>a<p>b<ul><li>c<li>d</ul>e<script>x<p></script><!-- <p>no --><td>f")
    assert [t for _, t in page.runs] == ["a", "b", "c", "d", "e", "f"]


def test_extraction_of_loose_deep_and_unnamed_pages(spark):
    told = "For many years the old lighthouse stood empty above the bay, and nobody in the village could say who owned it. Last spring the council sold it, for a single coin, to a teacher from the city."
    german = "Viele Jahre lang stand der alte Leuchtturm leer über der Bucht, und niemand im Dorf wusste, wem er gehörte. Im Frühling verkaufte ihn der Rat für eine Münze an eine Lehrerin aus der Stadt."
    comments = "<div class='x3'><h3>3 comments</h3><div><b>Ann</b> <p>I love this place, thanks for the story!</p></div><div><b>Bob</b><p>Me too. When does it open?</p></div></div>"
    deep = "<div class='ad'>" + "<div>" * 600 + "Buy our boats now." + "</div>" * 601
    pages = {
        1: (f"<body><a href='/'>Home</a> | <a href='/n'>News</a> | <a href='/s'>Sport</a> <hr> {told}<br>{told} {told} <hr> &copy; 2024 Bay Press. <a href='/p'>Privacy</a></body>", [f"{told} {told} {told}"]),
        2: (f"<body><article><h1>Sold</h1><p>{told}</p><p>{told}</p></article>{deep}</body>", ["Sold", told, told]),
        3: (f"<body><div class='x1'><a href='/'>Home</a> <a href='/n'>News</a></div><div class='x2'><h1>The lighthouse is sold</h1><p>{told}</p><p>{told}</p></div>{comments}<div class='x4'>&copy; 2024</div></body>", ["The lighthouse is sold", told, told]),
        4: (f"<body><div class='kopf'><a href='/'>Start</a> <a href='/a'>Über uns</a></div><main><h1>Der Leuchtturm ist verkauft</h1><p>{german}</p><p>{german}</p></main><footer>&copy; 2024 Buchtbote. Alle Rechte vorbehalten.</footer></body>", ["Der Leuchtturm ist verkauft", german, german]),
        5: ("<body>just text", ["just text"]),
    }
    frame = spark.createDataFrame([(k, "", v[0]) for k, v in pages.items()] * 2, "page_id long, url string, html string").selectExpr("*", "1 AS `Main_Text`", "named_struct('a b', 2) AS `odd.one`")
    rows = html_extraction.extract(frame).collect()
    assert len(rows) == 10 and all(r.main_text.split("\n") == pages[r.page_id][1] and r["odd.one"]["a b"] == 2 for r in rows)
    assert html_extraction.main_texts(frame.limit(0)).collect() == []


def test_deeply_nested_pages_take_linear_time():
    for one, many in (("<div>", 60_000), ("<td>", 40_000), ("<table><td>", 20_000), ("</x>", 50_000), ("<li><div><b>", 20_000), ("<b class=q><hr>", 20_000)):
        began = time.process_time()
        read_page(one * many + "</li></tr>" * 5_000 + "text")
        assert time.process_time() - began < 12, one
    page = read_page("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>next</p>")
    assert page.runs[0] == (3000, "deep") and page.blocks[page.runs[1][0]].depth == 1


def test_odd_columns_repeats_and_empty_tables(spark):
    """Dotted names, nested fields with blanks, clashes, repeated rows and no rows, for the operators on texts."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(40).selectExpr("*", "1 AS `a.b`", "named_struct('x y', doc_id) AS nested")
    odd = odd.union(odd)
    net = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    known = language_id.fit_on(docs)
    applied = {
        "toxicity": lambda d: toxicity.score(d, net), "language": lambda d: language_id.identify(d, known), "bpe": lambda d: byte_bpe.encode(d, PATH, public_tokenizers.PATTERN),
        "repeats": lambda d: remove_repeats(d), "near": lambda d: drop_near_duplicates(d, k=3, percent=85), "mix": lambda d: mixing.mix(d), "pii": lambda d: pii.find(d), "weights": lambda d: resampling.weighed(d, docs.limit(5)),
    }
    for name, apply in applied.items():
        rows = apply(odd).collect()
        assert all(r["a.b"] == 1 and r["nested"]["x y"] == r.doc_id for r in rows), name
        assert len(rows) == 80 or name == "near" and len(rows) <= 40, name
        if name not in ("near", "mix", "repeats"):
            by_id = {}
            assert all(by_id.setdefault(r.doc_id, r) == r for r in rows), name
        assert apply(odd.limit(0)).collect() == [], name
    assert transport_stream.media_digests(odd).count() == 80 and transport_stream.media_digests(odd.limit(0)).collect() == []
