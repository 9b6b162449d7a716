from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from lexmine.operators import notes as N
from lexmine.operators.graph import components


def test_merge_is_idempotent_and_skips_repeats(spark):
    schema = "note_id long, front string, back string, tags string"
    notes = spark.createDataFrame([(1, "Card A", "x", "site::a card::meaning mine"), (2, "Plain", "y", "")], schema)
    incoming = spark.createDataFrame(
        [(1, "Card A2", "x", "site::a card::meaning"), (2, "plain ", "z", ""), (3, "New <b>w</b> one", "q", "article::p site::b card::meaning"), (4, "New <b>w</b> one", "q", "article::p site::b card::meaning"), (5, "Other", "q", "")], "row_id long, front string, back string, tags string"
    )
    got = {r["row_id"]: (r["action"], r["note_id"]) for r in N.merge_notes(notes, incoming).collect()}
    assert got == {1: ("update", 1), 2: ("skip", None), 3: ("insert", 3), 4: ("skip", None), 5: ("insert", 4)}
    after = spark.createDataFrame([(1, "Card A2", "x", "site::a card::meaning mine"), (2, "Plain", "y", ""), (3, "New <b>w</b> one", "q", "article::p site::b card::meaning"), (4, "Other", "q", "")], schema)
    again = {r["row_id"]: r["action"] for r in N.merge_notes(after, incoming).collect()}
    assert again == {1: "same", 2: "skip", 3: "same", 4: "same", 5: "skip"}


def test_a_skipped_row_keeps_nobody_out(spark):
    notes = spark.createDataFrame([], "note_id long, front string, back string, tags string")
    row = lambda k, site, word: (k, f"See <b>{word}</b> here", "q", f"article::p site::{site} card::meaning")
    incoming = spark.createDataFrame([row(1, 1, "p"), row(2, 1, "q"), row(3, 3, "q")], "row_id long, front string, back string, tags string")
    assert {r["row_id"]: r["action"] for r in N.merge_notes(notes, incoming).collect()} == {1: "insert", 2: "skip", 3: "insert"}


def test_merge_equals_row_by_row_version(spark):
    rng = random.Random(2)
    norm = lambda t: " ".join(re.sub("<[^>]+>", "", t).lower().split())

    def known_by(front, back, tags):
        kind = "recall" if "card::recall" in tags.split() else "meaning" if "card::meaning" in tags.split() else ""
        site = [t[6:] for t in tags.split() if t.startswith("site::")]
        out = set()
        if kind and any(t.startswith("article::") for t in tags.split()):
            out |= {("site", kind, x) for x in site}
            core = re.sub(r"<br><small>.*?</small>$", "", front) if kind == "recall" else front
            bold = re.search("<b>(.*?)</b>", core)
            if bold and kind == "meaning":
                out.add((kind, norm(bold[1]), norm(front)))
            elif bold:
                out.add((kind, norm(back), norm(core[: bold.start()]) + "_" + norm(core[bold.end() :])))
        return out or {("front", norm(front))}

    def made(k):
        kind = rng.choice(["card::meaning", "card::recall", "x"])
        front = f"See <b>{rng.choice('abc')}</b> {rng.choice('mn')}" + rng.choice(["", "<br><small>hint</small>"])
        tags = " ".join(x for x in (kind, rng.choice(["", "article::p", "article::p"]), rng.choice(["", f"site::{rng.randint(1, 6)}"])) if x)
        return k, front, rng.choice(["u", "v <i>w</i>"]), tags

    for _ in range(3):
        notes, rows = [made(k) for k in range(1, 6)], [made(k) for k in range(60)]
        key = lambda tags: (tags.split()[0], [t for t in tags.split() if t.startswith("site::")][0]) if "card::" in tags and "site::" in tags else None
        seen, old, pending, want, last = set(), {}, set(), {}, 5
        for k, front, back, tags in notes:
            seen |= known_by(front, back, tags)
            if key(tags):
                old.setdefault(key(tags), (k, front, back))
        for k, front, back, tags in rows:
            if key(tags) in old:
                want[k] = old[key(tags)][0]
                continue
            skip = key(tags) is not None and key(tags) in pending
            pending.add(key(tags))
            if skip or known_by(front, back, tags) & seen:
                want[k] = None
            else:
                seen |= known_by(front, back, tags)
                last += 1
                want[k] = last
        frame = lambda r, k: spark.createDataFrame(r, f"{k} long, front string, back string, tags string")
        assert {r["row_id"]: r["note_id"] for r in N.merge_notes(frame(notes, "note_id"), frame(rows, "row_id")).collect()} == want


def test_reconcile_uses_a_note_once(spark):
    cards = spark.createDataFrame([(1, "same"), (2, "same"), (3, "solo")], "card_id long, front string")
    notes = spark.createDataFrame([(10, "same", "card::meaning"), (11, "x", "card::2 direction::recall"), (12, "solo", "card::recall"), (13, "y", "")], "note_id long, front string, tags string")
    links = spark.createDataFrame([(3, "meaning", 13), (1, "recall", 99)], "card_id long, direction string, note_id long")
    got = {(r["card_id"], r["direction"]): (r["note_id"], r["stage"]) for r in N.reconcile(cards, notes, links).collect()}
    assert got == {(1, "meaning"): (10, 2), (1, "recall"): (None, None), (2, "meaning"): (None, None), (2, "recall"): (11, 1), (3, "meaning"): (13, 0), (3, "recall"): (12, 2)}


def test_schedules_are_carried_exactly(spark):
    cards = spark.createDataFrame([(1,), (2,)], "card_id long")
    notes = spark.createDataFrame([(5, 1, "meaning", 7, 2500, 42, 10, 4), (6, 1, "meaning", 7, 1, 1, 1, 1), (7, 2, "recall", 8, 9, 9, 9, 9)], "note_id long, card_id long, direction string, deck_id long, due long, ivl long, reps long, lapses long")
    got = {(r["card_id"], r["direction"]): (r["due"], r["ivl"], r["reps"], r["lapses"], r["is_new"]) for r in N.carry_schedules(cards, notes, spark.createDataFrame([(7,)], "deck_id long")).collect()}
    assert got == {(1, "meaning"): (2500, 42, 10, 4, False), (1, "recall"): (0, 0, 0, 0, True), (2, "meaning"): (0, 0, 0, 0, True), (2, "recall"): (0, 0, 0, 0, True)}


def test_ordered_distinct_keeps_first_spelling_and_limit(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([" Дом", "дом", "", "изба", "хата", "Изба "])], "key long, o int, v string")
    assert N.ordered_distinct(df, ["key"], ["o"], "v", 2).first()["v"] == ["Дом", "изба"]


def test_numbers_follow_without_gaps_on_any_partitioning(spark):
    rows, last = spark.range(100).withColumnRenamed("id", "k"), spark.createDataFrame([(41,)], "note_id long")
    for n in (1, 7):
        got = N.number_after(rows.repartition(n), last, "k", "note_id").orderBy("k").collect()
        assert [r["note_id"] for r in got] == list(range(42, 142))


def test_numbers_of_wide_rows_are_complete(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.range(20_000).select(F.col("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("wide"))
        got = N.number_after(rows, spark.createDataFrame([(0,)], "note_id long"), "k", "note_id")
        assert got.where("note_id = k + 1 AND length(wide) = 1280").count() == 20_000 == got.count()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_delete_cascade(spark):
    h = spark.createDataFrame([(1, 10, 5), (2, 20, 5), (3, 5, 6)], "highlight_id long, created_at long, document_id long")
    links = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "card_id long, highlight_id long")
    out = N.delete_cascade(spark.createDataFrame([(1,)], "highlight_id long"), h, links)
    assert [tuple(r) for r in out["tombstones"].collect()] == [(1, 5)]
    assert [tuple(r) for r in out["removed_cards"].collect()] == [(2,)]
    assert [tuple(r) for r in out["moved_cards"].collect()] == [(1, 3)]


def test_distractor_hint_drops_overlap(spark):
    df = spark.createDataFrame([(["Hut"], ["hut", "shed <x>"]), ([], [])], "v array<string>, r array<string>")
    got = [r[0] for r in df.select(N.distractor_hint(F.col("v"), F.col("r"))).collect()]
    assert got == ["<br><small>Подходит, но не целевой ответ: Hut<br>Близко по смыслу: shed &lt;x&gt;</small>", ""]


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(3000)] + [(5000, k) for k in range(5001, 5400)] + [(7, 7), (9000, 9000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for x in list(root)} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_long_chain_of_rows_is_decided_in_few_rounds(spark):
    """10,000 rows that each share an identity with the next: every second one is inserted, walked in one place or in rounds."""
    chain = [(k, f"i{k}") for k in range(10_000)] + [(k, f"i{k + 1}") for k in range(10_000)] + [(20_000, "alone")]
    start = time.time()
    got = N._inserted(spark.createDataFrame(chain, "row_id long, identity string"), N.WALKED)
    assert sorted(r[0] for r in got.collect()) == [*range(0, 10_000, 2), 20_000]
    assert time.time() - start < 120
    short = [(k, i) for k, i in chain if k < 12 or k == 20_000]
    rounds = N._inserted(spark.createDataFrame(short, "row_id long, identity string"), 3)
    assert sorted(r[0] for r in rounds.collect()) == [*range(0, 12, 2), 20_000]


def test_a_deck_is_dealt_over_many_tasks(spark):
    """Notes meet their decks by deck and share, so one deck isn't one task; the result is the first note's schedule."""
    notes = spark.range(1000).selectExpr("id AS note_id", "id div 4 AS card_id", "'recall' AS direction", "id % 2 AS deck_id", "id AS due", "id AS ivl", "id AS reps", "id AS lapses")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = N.carry_schedules(spark.range(251).selectExpr("id AS card_id"), notes, spark.createDataFrame([(1,), (1,)], "deck_id long"))
        keys = re.findall(r"hashpartitioning\((deck_id[^)]*)\)", out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString())
        assert any("_share" in k for k in keys)
        got = {(r["card_id"], r["direction"]): (r["due"], r["is_new"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {(c, d): (4 * c + 1, False) if d == "recall" and c < 250 else (0, True) for c in range(251) for d in N.DIRECTIONS}


def test_parts_of_an_identity_are_computed_once(spark):
    """The regular expressions of an identity appear once each in the plan, however often what they find is used."""
    rows = spark.createDataFrame([("Say <b>Word</b> of X<br><small>h</small>", "<b>Ans</b>", "article::a site::7 card::recall"), ("No bold", "b", "article::a card::meaning"), (None, None, None)], "f string, b string, t string")
    made = rows.select(N.identities(F.col("f"), F.col("b"), F.col("t")).alias("all"))
    assert [r["all"] for r in made.collect()] == [["site|recall|7", "context|recall|ans|say \u2063 of x"], ["front|no bold"], ["front"]]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</b>, 0)") == 1 and plan.count("<small>") == 1 and plan.count("split(t") == 1
