import pytest
from pyspark.sql import functions as F

from sedgewire.llm import line_dedup, mixing, queries
from sedgewire.oracle import difference, duck

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, DATA), duck(DATA), queries.ORACLE_SQL[name]) == ""


def test_line_dedup_edges(spark):
    rows = [(i, "shared line\nown %d\n\n" % i, "en", f"s{i}", 0) for i in range(9)] + [(20, None, None, None, None), (None, "", None, None, None), (21, " shared line \t", None, None, 0), (21, " shared line \t", None, None, 0)]
    docs = spark.createDataFrame(rows, DOC).withColumn("N_LINES_x", F.lit(1))
    got = {(r.doc_id, r.text): r for r in line_dedup.remove_boilerplate(docs, 8).collect()}
    assert got[(0, rows[0][1])].text_kept == rows[0][1]  # the first place keeps the line
    assert got[(3, rows[3][1])].text_kept == "own 3\n\n" and got[(3, rows[3][1])].n_removed == 1
    assert got[(20, None)].text_kept is None and got[(20, None)].n_lines == 0
    assert got[(None, "")].text_kept == "" and got[(21, " shared line \t")].text_kept == ""
    assert line_dedup.remove_boilerplate(docs.limit(0), 8).count() == 0


def test_line_dedup_counts_the_null_source_and_replaces_added_names(spark):
    rows = [(i, f"shared\nown {i}", "en", s, 0) for i, s in enumerate(["", None, "a", "b", "c", "d", "e", "f"])]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "7 AS N_Lines", "'x' AS text_kept", "1 AS removed", "2 AS text_key", "3 AS row")
    got = line_dedup.remove_boilerplate(docs, 8)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "removed", "text_key", "row", "n_lines", "n_removed", "text_kept"]
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text_kept, r.removed) for r in got.collect()} == {i: (2, int(i > 0), f"own {i}" if i else rows[0][1], 1) for i in range(8)}
    assert line_dedup.remove_boilerplate(docs, 9).where("n_removed > 0").count() == 0


def test_copies_of_a_whole_text_are_no_boilerplate(spark):
    rows = [(i, "one line\nanother line", "en", f"s{i}", 0) for i in range(40)] + [(100 + i, f"menu\nown {i}", "en", f"s{i}", 0) for i in range(8)]
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, DOC), 8).collect()}
    assert got == {**{i: 0 for i in range(40)}, **{100 + i: int(i > 0) for i in range(8)}}


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(100 * k + i, f"line {k}\nown {k} {i}", "en", f"s{i % k}", 0) for k in range(6, 12) for i in range(24)]
    lines = line_dedup.line_table(spark.createDataFrame(rows, DOC))
    assert line_dedup.boilerplate_lines(lines, 8).count() == 4


def test_mixing_edges(spark):
    rows = [(i, "w " * (1 + i % 7), None, ["a", "b", None][i % 3], 0) for i in range(300)] + [(1000, None, None, "empty", 0), (None, "x y", None, "a", 0), (None, "x y", None, "a", 0)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOC).withColumn("SIZE", F.lit("clash")))
    by = {r.source: r for r in mixed.groupBy("source").agg(F.max("target").alias("t"), F.max("source_size").alias("s"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()}
    total = sum(r.s for r in by.values())
    assert sum(r.t for r in by.values()) == pytest.approx(1.5 * total)
    assert all(r.t <= 2 * r.s and abs(r.n - r.t) <= 7 for r in by.values())
    assert mixed.where("copies > 2 or copies < 0").count() == 0
    assert mixing.mix(spark.createDataFrame([], DOC)).count() == 0
    assert mixing.take_mix(spark.createDataFrame(rows, DOC)).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_capped_source_takes_empty_texts_as_often_as_the_others(spark):
    capped = [(i, "x" if i == 44 else None, None, "a", 0) for i in range(60)]  # the one with the highest hash has a word
    rows = capped + [(100 + i, "w " * 50, None, s, 0) for i in range(40) for s in "bc"] + [(900, " ", None, "d", 0)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOC))
    assert {r.copies for r in mixed.where("source = 'a'").collect()} == {2}
    assert [r.copies for r in mixed.where("source = 'd'").collect()] == [1]
    taken = mixing.take_mix(spark.createDataFrame(rows, DOC)).where("source = 'a'").groupBy("doc_id").count()
    assert {r["count"] for r in taken.collect()} == {2}
