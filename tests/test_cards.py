"""Rendered cards, their export, and the dashboard."""

from __future__ import annotations

import html
import json
import re
from datetime import datetime

from pyspark.sql import functions as F

from lexmine.operators import dashboard as B
from lexmine.operators import notes as N
from lexmine.sources import files

CARDS = "card_id string, family string, sense string, translations array<string>, exported_at timestamp"
CONTEXTS = "card_id string, place int, target string, sentence string, replacement string, source string, directions array<string>, valid array<string>, related array<string>"


def tables(spark):
    cards = [("a", "trail behind!", "be < last", ["отставать", "<b>"], None), ("b", None, None, ["x"], None), ("c", "", "s", [], datetime(2024, 1, 1)), ("d", "none", "s", ["y"], None)]
    contexts = [
        ("a", 2, "trail", "They trail & fall.", "плестись", "pdf", None, ["lag"], ["Lag", "drag"]),
        ("a", 1, "trail", "We TRAIL.", "one two three four five six", 'a "b"', ["meaning", "recall"], None, None),
        ("a", 3, "trail", "Only recall trail.", "да", "pdf", ["recall"], [], []),
        ("b", 1, "x", "x y", "z", "s", ["meaning"], [], []),
        ("c", 1, "x", "x y", "z", "s", [], [], []),
    ]
    return spark.createDataFrame(cards, CARDS), spark.createDataFrame(contexts, CONTEXTS)


def payload(side: str) -> list[dict]:
    return json.loads(html.unescape(re.search('data-contexts="([^"]*)"', side)[1]))


def test_semantic_cards(spark):
    got = {(r["card_id"], r["direction"]): r for r in N.semantic_cards(*tables(spark)).collect()}
    assert set(got) == {("a", "meaning"), ("a", "recall"), ("c", "meaning"), ("c", "recall")}  # b has no recall context, d has none at all
    meaning, recall = got["a", "meaning"], got["a", "recall"]
    assert [c["front"] for c in payload(meaning["front"])] == ["We <b>TRAIL</b>.", "They <b>trail</b> &amp; fall."]
    hint = "<br><small>Подходит, но не целевой ответ: lag<br>Близко по смыслу: drag</small>"
    assert [c["recall"] for c in payload(recall["front"])] == ["We <b>отставать</b>.", f"They <b>плестись</b> &amp; fall.{hint}", "Only recall <b>да</b>."]
    assert payload(meaning["back"])[0]["source"] == "a &quot;b&quot;" and payload(meaning["back"])[0]["answer"] == "trail"
    assert meaning["front"].endswith(">We <b>TRAIL</b>.</div>") and recall["front"].endswith(">We <b>отставать</b>.</div>")
    assert meaning["back"].endswith("><b>trail</b><br>• отставать<br>• &lt;b&gt;<br><small>be &lt; last</small></div>") and recall["back"].endswith("><b>trail</b></div>")
    assert meaning["tags"] == "site::a semantic::v1 family::trail_behind card::meaning" and "family::word " in got["c", "recall"]["tags"]


def test_pending_cards_are_exported_and_marked(spark, tmp_path):
    cards, contexts = tables(spark)
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    out = {r["card_id"]: r["exported_at"] for r in N.export_pending(cards, contexts, "exported_at", now, f"{tmp_path}/csv").collect()}
    assert out == {"a": datetime(2030, 1, 1), "b": None, "c": datetime(2024, 1, 1), "d": None}
    rows = files.read_cards_csv(spark, [f"{tmp_path}/csv"], ["Front", "Back", "Tags"]).collect()
    want = {(r["front"], r["back"], r["tags"]) for r in N.semantic_cards(cards.where("card_id = 'a'"), contexts).collect()}
    assert {(r["Front"], r["Back"], r["Tags"]) for r in rows} == want and len(rows) == 2


def test_status_of_users(spark):
    at = lambda n: datetime(2024, 1, n)
    users = spark.createDataFrame([(k,) for k in range(1, 6)], "user_id long")
    docs = spark.createDataFrame([(10, 1, at(1), at(1)), (11, 1, None, at(2)), (20, 2, at(3), at(1)), (40, 4, at(1), at(1))], "document_id long, user_id long, opened_at timestamp, created_at timestamp")
    cards = spark.createDataFrame([(1, 1, 10, None), (2, 1, 10, at(5)), (3, 1, 99, None), (4, 2, 20, None), (5, 4, 40, None)], "card_id long, user_id long, document_id long, synced_at timestamp")
    jobs = spark.createDataFrame([(1, 1, "done", None, at(1)), (2, 1, "queued", None, at(2)), (3, 1, "running", None, at(3)), (4, 2, "failed", "auth:denied", at(1)), (5, 3, "failed", "temporary", at(1)), (6, 3, "done", None, at(2))], "job_id long, user_id long, state string, error_code string, created_at timestamp")
    got = {r["user_id"]: r for r in B.sync_status(users, cards, docs, jobs).collect()}
    assert {u: r["status"] for u, r in got.items()} == {1: "syncing", 2: "error", 3: "idle", 4: "pending", 5: "idle"}
    assert (got[1]["documents"], got[1]["cards"], got[1]["pending"], got[1]["active_job"], got[1]["latest_job"]) == (2, 2, 1, 2, 3)
    assert got[2]["latest_error"] == "auth" and got[5]["documents"] == 0
    marks = spark.createDataFrame([(10, 1), (10, 1), (10, 2)], "document_id long, user_id long")
    assert [(r["document_id"], r["highlight_count"]) for r in B.documents_of(docs.where("user_id = 1"), marks).collect()] == [(10, 2), (11, 0)]
