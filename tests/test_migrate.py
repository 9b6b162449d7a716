"""Contexts from notes, and the migration of a deck to clusters."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexmine.operators import migrate as M

NOTES = "note_id long, front string, back string, tags string, learned int"


def test_contexts_of_notes(spark):
    rows = [
        (5, "We <b>trail</b> behind ( far ) &amp; away .", "• отставать<br>- Отставать<BR/>· плестись &eacute;", "card::meaning article::x page::2", 1),
        (2, "We <B class='t'>тянемся</B> behind (far) &amp; away.<br><small>hint <b>no</b></small>", "<b>trail</b>", "direction::recall page::3", 2),
        (7, "no bold", "x", "card::meaning", 1), (8, "<b> </b> gone", "x", "card::meaning", 1), (9, "<b>x</b> y", "z", "other", 1), (10, None, None, "card::recall", 1), (11, "a <b>b</b>", None, "card::meaning", None),
    ]
    got = {r["target"]: r.asDict() for r in M.source_contexts(spark.createDataFrame(rows, NOTES)).collect()}
    one = got.pop("trail")
    assert one.pop("id").startswith("source:") and one == {"target": "trail", "sentence": "We trail behind (far) & away.", "translations": ["отставать", "плестись é"], "replacement": "тянемся", "source": "article::x · page::2 | page::3", "note_ids": [2, 5], "learned_cards": 3}
    assert got["b"]["sentence"] == "a b" and got["b"]["translations"] == [] and got["b"]["source"] == "original_deck" and len(got) == 1
    assert M.source_contexts(spark.createDataFrame([], NOTES)).collect() == []


def tables(spark, lose=False):
    at = lambda n: datetime(2024, 1, n)
    sources = [("s1", "Trail ", "We trail .", [10, 11]), ("s2", "other", "x", [12]), ("s3", "late", "y", [13, 14]), ("s4", "none", "z", [15, 16] if not lose else [15, 16, 99])]
    highlights = [(1, "trail", "we trail.", "reader", at(1)), (2, "gone", "nothing like it", "pdf", at(2)), (3, "TRAIL", "We  trail.", "pdf", at(3))]
    links = [(12, 1), (13, 2), (14, 2), (11, 2), (10, 77)]
    context = lambda i, s: {"id": i, "source": s, "target": "t", "sentence": "old"}
    clusters = [("a", ["s1", "s2"], [10, 11, 12], [context("s1", "user"), context("generated:s1", "llm"), context("s2", "user")]), ("b", ["s3"], [13, 14, 11], [context("s3", "user")]), ("c", ["s4"], [15, 16], [context("s4", "user")])]
    notes = [(n, "card::meaning" if n % 2 else "card::recall", n, 2, 1) for n in (10, 11, 12, 13, 14, 15, 16)]
    return (
        spark.createDataFrame(clusters, "cluster_id string, source_ids array<string>, note_ids array<long>, contexts array<struct<id:string,source:string,target:string,sentence:string>>"),
        spark.createDataFrame(sources, "id string, target string, sentence string, note_ids array<long>"),
        spark.createDataFrame(highlights, "highlight_id long, target string, sentence string, source string, created_at timestamp"),
        spark.createDataFrame(links, "note_id long, highlight_id long"),
        spark.createDataFrame(notes, "note_id long, tags string, ivl int, reps int, lapses int"),
    )


def test_migration_accounts_for_all(spark):
    out = M.migrate(*tables(spark))
    assert {tuple(r) for r in out["mapping"].collect()} == {(1, "s1"), (3, "s1"), (2, "s1")}  # 2 is linked to s1 and s3; s1 has the lower note
    assert [r[0] for r in sorted(out["shadowed"].collect())] == ["s2", "s3"]
    assert sorted((r["cluster_id"], r["id"], r["target"], r["source"]) for r in out["contexts"].collect()) == [("a", "3", "TRAIL", "pdf"), ("a", "generated:3", "t", "llm")]
    assert sorted(tuple(r) for r in out["survivors"].collect()) == [("a", "meaning", 11, 2, 1, 0), ("a", "recall", 12, 4, 2, 1)]
    numbers = out["accounting"].first().asDict()
    assert numbers == {"sources": 4, "highlights": 3, "chosen": 1, "shadowed": 2, "known_clusters": 1, "unknown_clusters": 2, "survivors": 2, "removed": 1, "added": 0, "unknown_notes": 5, "contexts": 2}


def test_a_lost_note_or_highlight_is_an_error(spark):
    with pytest.raises(ValueError, match="99"):
        M.migrate(*tables(spark, lose=True))
    clusters, sources, highlights, links, notes = tables(spark)
    with pytest.raises(ValueError, match="no source fits"):
        M.migrate(clusters, sources, highlights, links.where(F.col("highlight_id") != 2), notes)


def test_mapped_cards_are_dealt_and_not_broadcast(spark, monkeypatch):
    """a task has ROWS notes or so, however many there are, and the cards of these only."""
    from lexmine.plans import QUERIES, base

    monkeypatch.setattr(base, "ROWS", 10)
    assert base.dealt(spark.range(95), "id").rdd.getNumPartitions() == 10
    assert base.dealt(spark.range(5), "id").rdd.getNumPartitions() == 4
    plan = QUERIES["joi22_map_sources"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "ShuffledHashJoin" in plan


def test_what_notes_say_is_made_once_over_all_tasks(spark):
    """notes lie in few tasks by their bytes, and what they say was made anew by each branch that reads it."""
    notes = spark.createDataFrame([(k, "Say <b>a</b> &hearts; b", "c", "card::meaning", 0) for k in range(40)], NOTES).coalesce(1)
    said = M.note_contexts(notes)
    assert "front" not in said._jdf.queryExecution().executedPlan().toString()
    assert M._spread(notes, "note_id").rdd.getNumPartitions() == 4
    assert {(r["target"], r["sentence"]) for r in said.collect()} == {("a", "Say a ♥ b")} and said.count() == 40
