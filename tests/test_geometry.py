from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from lexmine.operators import geometry as G
from lexmine.plans import QUERIES

DATA = "/root/testdata/sf0.001"


def table(spark, rows, schema):
    return spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows], schema)


def test_quad_box(spark):
    row = spark.createDataFrame([([10.0, 90.0, 50.0, 90.0, 10.0, 80.0, 50.0, 80.0],)], "q array<double>").select(G.quad_box(F.col("q"), F.lit(0.0), F.lit(0.0), F.lit(100.0))).first()[0]
    assert tuple(row) == (10.0, 10.0, 50.0, 20.0)


def test_overlap_over_several_bands_counts_once(spark):
    schema = "id long, document_id long, page int, target string, x1 double, y1 double, x2 double, y2 double"
    a = table(spark, [(1, 1, 1, "t", 0, 0, 10, 200), (2, 1, 1, "t", 500, 0, 510, 10)], schema)
    b = table(spark, [(9, 1, 1, "t", 0, 50, 10, 200), (8, 1, 2, "t", 0, 0, 10, 200)], schema)
    assert [tuple(r) for r in G.overlapping(a, b, ["document_id", "page", "target"]).collect()] == [(1, 9)]


def test_imported_highlight_over_a_reader_one_is_dropped_and_import_is_idempotent(spark):
    schema = "id string, document_id long, page int, target string, x1 double, y1 double, x2 double, y2 double"
    new = table(spark, [("a", 1, 1, "word", 82, 191, 119, 204), ("b", 1, 1, "word", 300, 191, 340, 204), ("c", 1, 1, "gone", 0, 0, 9, 9)], schema)
    old = table(spark, [("r", 1, 1, "word", 80, 190, 120, 205)], schema)
    dead = spark.createDataFrame([("c",)], "id string")
    added = G.import_highlights(new, old, dead)
    assert [r["id"] for r in added.collect()] == ["b"]
    assert G.import_highlights(new, old.unionByName(added.select(old.columns)), dead).count() == 0


WORDS = "doc_id long, page int, word_id int, word string, x1 double, y1 double, x2 double, y2 double, selected boolean"


@pytest.mark.parametrize(
    ("words", "want"),
    [
        ([("by", 0, 0, 1), ("and", 20, 0, 1), ("large", 40, 0, 1), ("(+)", 60, 0, 0), ("far", 100, 0, 1)], [["by", "and", "large", "far"]]),
        ([("by", 0, 0, 1), ("(1)", 20, 0, 0), ("far", 40, 0, 1)], [["by"], ["far"]]),  # what is skipped holds a digit
        ([("by", 0, 0, 1), ("far", 100, 0, 1)], [["by"], ["far"]]),  # too much room
        ([("trail", 100, 0, 1), ("behind", 0, 12, 1)], [["trail", "behind"]]),
        ([("trail", 100, 0, 1), ("behind", 0, 30, 1)], [["trail"], ["behind"]]),  # more than 1.6 heights down
        ([("trail", 0, 0, 1), ("behind", 40, 12, 1)], [["trail"], ["behind"]]),  # not further left
        ([("trail.", 100, 0, 1), ("behind", 0, 12, 1)], [["trail."], ["behind"]]),  # a sentence ends
        ([("attri-", 0, 0, 1), ("buted", 40, 30, 1)], [["attri-", "buted"]]),  # a hyphen holds on
        ([("and", 0, 0, 1), ("so", 20, 0, 1), ("on", 40, 0, 1)], [["so", "on"]]),
        ([("“But", 0, 0, 1), ("so", 20, 0, 1), ("on", 40, 0, 1)], [["so", "on"]]),
        ([("or", 0, 0, 1), ("so", 20, 0, 1)], [["or", "so"]]),
    ],
)
def test_phrases(spark, words, want):
    df = spark.createDataFrame([(1, 1, k, w, float(x), float(y), x + 15.0, y + 11.0, bool(s)) for k, (w, x, y, s) in enumerate(words)], WORDS)
    got = {}
    for r in G.phrase_groups(df).orderBy("word_id").collect():
        got.setdefault(r["group_id"], []).append(r["word"])
    assert list(got.values()) == want


def test_highlights_are_extracted_with_sentence_and_boxes(spark):
    line = lambda k0, y, ws: [(1, 1, k0 + k, w, 20.0 * k, float(y), 20.0 * k + 15, y + 11.0, 0.0, 0.0) for k, w in enumerate(ws)]
    words = line(0, 5, ["head"]) + line(1, 100, ["One", "ends.", "They", "trail"]) + line(5, 112, ["behind,", "us.", "They", "trail", "off."])
    df = spark.createDataFrame(words, "doc_id long, page int, word_id int, word string, x1 double, y1 double, x2 double, y2 double, coverage double, spill double")
    regions = spark.createDataFrame([(1, 1, 60.0, 100.0, 75.0, 111.0), (1, 1, 0.0, 112.0, 15.0, 123.0), (1, 1, 60.0, 112.0, 75.0, 123.0), (2, 1, 0.0, 0.0, 900.0, 900.0)], "doc_id long, page int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["target"], r["occurrence"], r["sentence"], len(r["rects"])) for r in G.extract_highlights(df, regions, 50.0, 400.0).collect())
    assert got == [("trail", 0, "They trail off.", 1), ("trail behind", 0, "They trail behind, us.", 2)]
    assert G.extract_highlights(df.limit(0), regions, 50.0, 400.0).count() == 0


def test_highlights_shuffle_words_by_document_only(spark):
    """Words and regions meet in windows of one partitioning: without joins of words with words, and with five exchanges instead of over ten."""
    words = spark.createDataFrame([(1, 1, 0, "One", 0.0, 100.0, 15.0, 111.0, 0.9, 0.0)], "doc_id long, page int, word_id int, word string, x1 double, y1 double, x2 double, y2 double, coverage double, spill double")
    regions = spark.createDataFrame([(1, 1, 60.0, 100.0, 75.0, 111.0)], "doc_id long, page int, x1 double, y1 double, x2 double, y2 double")
    plan = G.extract_highlights(words, regions, 50.0, 400.0)._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    assert initial.count("Exchange hashpartitioning") <= 5
    assert initial.count("Join ") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_highlights_of_documents_shuffle_texts_and_no_words(spark):
    found = QUERIES["pip6_extract_highlights"](spark, DATA)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert final.count("ReusedExchange") == 2
    assert set(re.findall(r"Exchange hashpartitioning\(.*?\), (\w+)", final)) == {"REPARTITION_BY_NUM"}  # of documents, used three times


def test_highlights_are_the_same_however_words_are_dealt(spark):
    """Over pages and paragraph breaks, with a group of two lines that loses its first word, and marks alone, which are no target."""
    text = [(1, 1, "He said: and more over"), (1, 2, "there, again. More"), (1, 3, "-- was over -"), (1, 9, "there And no end"), (2, 1, "of it over. Done")]
    words, k = [], 0
    for page, line, said in text:
        for place, w in enumerate(said.split()):
            words.append((7, page, k, w, 20.0 * place, 100.0 + 12 * line, 20.0 * place + 15, 111.0 + 12 * line, float(w.strip(".,") in {"and", "more", "over", "there", "--"}), 0.0))
            k += 1
    df = spark.createDataFrame(words, "doc_id long, page int, word_id int, word string, x1 double, y1 double, x2 double, y2 double, coverage double, spill double")
    regions = spark.createDataFrame([(7, 1, 40.0, 124.0, 55.0, 135.0)], "doc_id long, page int, x1 double, y1 double, x2 double, y2 double")
    rows = lambda found: sorted((r["page"], r["target"], r["occurrence"], r["sentence"], [tuple(x) for x in r["rects"]]) for r in found.collect())
    got = rows(G.extract_highlights(df, regions, 50.0, 400.0))
    assert got == rows(G.extract_highlights(df.repartition(3, "doc_id"), regions.repartition(3, "doc_id"), 50.0, 400.0, dealt=True))
    assert got == [
        (1, "More", 0, "More -was over -", [(40.0, 124.0, 55.0, 135.0)]),
        (1, "more over there", 0, "He said: and more over there, again.", [(60.0, 112.0, 95.0, 123.0), (0.0, 124.0, 15.0, 135.0)]),
        (1, "over", 0, "More -was over -", [(40.0, 136.0, 55.0, 147.0)]),
        (1, "there", 0, "there And no end of it over.", [(0.0, 208.0, 15.0, 219.0)]),
        (2, "over", 0, "there And no end of it over.", [(40.0, 112.0, 55.0, 123.0)]),
    ]


def test_valid_rects(spark):
    r = lambda *v: dict(zip(("x1", "y1", "x2", "y2"), map(float, v), strict=True))
    df = spark.createDataFrame([([r(0, 0, 1, 1)],), ([],), ([r(0, 0, 0.0001, 1)],), ([r(0, 0, float("nan"), 1)],), ([r(0, 0, 200000, 1)],), ([r(0, 0, 1, 1)] * 17,)], "r array<struct<x1:double,y1:double,x2:double,y2:double>>")
    assert [x[0] for x in df.select(G.valid_rects(F.col("r"))).collect()] == [True, False, False, False, False, False]


def test_region_overlap_shuffles_once(spark):
    words = spark.createDataFrame([(1, 1, 0, 0.0, 30.0, 10.0, 40.0), (1, 1, 1, 50.0, 30.0, 60.0, 40.0), (2, 1, 0, 0.0, 0.0, 1.0, 1.0)], "doc_id long, page int, word_id int, x1 double, y1 double, x2 double, y2 double")
    regions = spark.createDataFrame([(1, 1, 5.0, 0.0, 100.0, 35.0), (1, 1, 0.0, 0.0, 2.0, 100.0)], "doc_id long, page int, x1 double, y1 double, x2 double, y2 double")
    found = G.region_overlap(words, regions)
    assert sorted((r["doc_id"], r["word_id"], r["overlap"]) for r in found.collect()) == [(1, 0, 0.25), (1, 1, 0.5), (2, 0, 0.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
