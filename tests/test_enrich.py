from __future__ import annotations

import json
import random
import time
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmine.functions.fuzzy import Leaders, weighted_ratio
from lexmine.operators import clusters as C
from lexmine.operators import dictionary as D
from lexmine.operators import enrich as E
from lexmine.sources.files import classify_uploads


def test_second_run_calls_nothing(spark):
    targets = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "b", "s")], "id long, target string, sentence string")
    empty = spark.createDataFrame([], "key string, value string, written_at long")
    calls = spark.sparkContext.accumulator(0)

    def infer(batches):
        for b in batches:
            calls.add(len(b))
            yield b.assign(value=b["target"] + "!")[["key", "value"]]

    rows, made = E.enrich(targets, empty, infer)
    assert sorted((r["id"], r["value"]) for r in rows.collect()) == [(1, "a!"), (2, "a!"), (3, "b!")]
    assert calls.value == 2
    cache = spark.createDataFrame([(r["key"], r["value"], 1) for r in made.collect()], "key string, value string, written_at long")
    calls.value = 0
    rows, _ = E.enrich(targets, cache, infer)
    assert sorted((r["id"], r["value"]) for r in rows.collect()) == [(1, "a!"), (2, "a!"), (3, "b!")]
    assert calls.value == 0


def test_retries_until_ids_agree():
    seen = []

    def call(batch, attempt):
        seen.append(attempt)
        return batch.assign(value="v") if attempt == 3 else batch.head(1).assign(value="v")

    batch = pd.DataFrame({"key": ["a", "b"]})
    assert list(next(E.retried(call)(iter([batch])))["key"]) == ["a", "b"] and seen == [1, 2, 3]
    with pytest.raises(RuntimeError):
        list(E.retried(lambda b, n: b.head(0).assign(value="v"))(iter([batch])))


def test_fuzzy_top_five(spark):
    leaders = spark.createDataFrame([(1, k, "train") for k in range(6)] + [(1, 9, "zzzz"), (2, 10, "training")], "user_id long, cluster_id long, leader string")
    marks = spark.createDataFrame([(7, 1, "training")], "highlight_id long, user_id long, text string")
    got = E.fuzzy_top(marks, leaders).orderBy("rank").collect()
    assert [r["cluster_id"] for r in got] == [0, 1, 2, 3, 4] and got[0]["score"] == pytest.approx(90.0)


def test_replay_does_not_depend_on_partitions(spark):
    rows = [(k, k % 3, w, k) for k, w in enumerate(["train", "trains", "training", "robust", "robustly", "model"] * 4)]
    df = spark.createDataFrame(rows, "highlight_id long, user_id long, text string, created_at long")
    runs = [sorted(tuple(r) for r in E.replay_clusters(df.repartition(n)).collect()) for n in (1, 8)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    assert all(r[3] == r[2] or r[3] in ("train", "trains", "training", "robust", "robustly") for r in runs[0])


def test_lookup_groups_and_caps(spark):
    entries = spark.createDataFrame([("paper", "noun", k, v) for k, v in enumerate(["бумага", "Бумага", "газета", "a", "b", "c", "d", "e"])] + [("paper", "verb", 0, "оклеить")], "word string, pos string, ord long, value string")
    got = {r["pos"]: r["value"] for r in D.lookup(spark.createDataFrame([("papers",)], "word string"), entries).collect()}
    assert got == {"noun": ["бумага", "газета", "a", "b", "c", "d"], "verb": ["оклеить"]}


def test_violations(spark):
    ok = ("объяснение", ["дом"], "дом", ["hut"])
    bad = ("explanation", ["дом", "Дом ", "house", "изба."], "x", ["1", "hut", "HUT"])
    df = spark.createDataFrame([ok, bad], "explanation string, translations array<string>, replacement string, alternatives array<string>")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(E.violations(F.struct("*"))).collect()]
    assert got[0] == []
    assert set(got[1]) == {"explanation", "translation_script", "translation_repeats", "translation_mark", "replacement", "alternative_script", "alternative_repeats"}


def _names(rng, n):
    words = ["train", "training", "robust", "model", "models", "ñandú", "a", "of", "the", "large", "larger", "x" * 300, "be", "tie", "ties", "network", "net"]
    return [" ".join(rng.choices(words, k=rng.randint(1, 4)))[: rng.choice([400, 400, 5])].strip() for _ in range(n)]


def test_bound_is_never_below_the_ratio():
    rng = random.Random(3)
    index = Leaders()
    leaders = [*_names(rng, 120), "", "  two  spaces ", "b a", "a b"]
    for text in leaders:
        index.add(text)
    for text in [*_names(rng, 60), "", "a  b", "ab"]:
        want = [weighted_ratio(text, x) for x in leaders]
        assert all(b >= w for b, w in zip(index.bounds(text), want, strict=True))
        for cutoff, limit in ((45.0, 5), (90.0, 1)):
            best = sorted(((w, k) for k, w in enumerate(want) if w >= cutoff), key=lambda x: (-x[0], x[1]))[:limit]
            assert index.best(text, cutoff, limit) == best


def test_far_fewer_pairs_are_scored_than_there_are():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    index = Leaders()
    for _ in range(1000):
        index.add("".join(rng.choices(letters, k=rng.randint(4, 14))))
    for _ in range(50):
        index.best("".join(rng.choices(letters, k=rng.randint(4, 14))), 90.0)
    assert index.scored < 1000 * 50 / 50


def test_weighted_top_equals_all_pairs(spark):
    rng = random.Random(5)
    marks = [(k, k % 3 if k % 9 else None, t) for k, t in enumerate([*_names(rng, 60), None, ""])]
    heads = [(1000 - k, k % 3, t) for k, t in enumerate([*_names(rng, 80), "", None])]
    want = set()
    for i, u, t in marks:
        scored = [(weighted_ratio(t or "", x or ""), c, x) for c, v, x in heads if v == u and t and x]
        for rank, (s, c, x) in enumerate(sorted((p for p in scored if p[0] >= 45), key=lambda p: (-p[0], p[1]))[:5], 1):
            want.add((i, c, x, s, rank))
    h = spark.createDataFrame(marks, "highlight_id long, user_id long, text string")
    c = spark.createDataFrame(heads, "cluster_id long, user_id long, leader string")
    for texts, most in ((5000, 20000), (4, 7)):
        assert {tuple(r) for r in E.weighted_top(h, c, texts=texts, most=most).collect()} == want
    assert E.weighted_top(h.limit(0), c).collect() == [] == E.weighted_top(h, c.limit(0)).collect()


def test_replay_equals_the_plain_walk(spark):
    rng = random.Random(6)
    rows = [(k, k % 2, t, 100 - k % 50) for k, t in enumerate(_names(rng, 150))] + [(900, 7, None, 1), (901, 7, "", 2)]
    want, leaders = {}, {}
    for i, u, t, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        known = leaders.setdefault(u, [])
        if (u, t) not in want:
            best = max(((weighted_ratio(t or "", x), -k) for k, x in enumerate(known)), default=(0, 0))
            want[u, t] = known[-best[1]] if best[0] >= 90 else t
            if best[0] < 90:
                known.append(t or "")
    got = E.replay_clusters(spark.createDataFrame(rows, "highlight_id long, user_id long, text string, created_at long")).collect()
    assert len(got) == len(rows) and all(r["cluster"] == want[r["user_id"], r["text"]] for r in got)


def test_a_user_of_many_texts_finishes(spark):
    """20,000 different texts of one user; the walk over all pairs would take 200 million ratios."""
    rows = spark.range(20_000).select(F.col("id").alias("highlight_id"), F.lit(1).alias("user_id"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12).alias("text"), F.col("id").alias("created_at"))
    start = time.time()
    assert E.replay_clusters(rows).select("cluster").distinct().count() > 19_000
    assert time.time() - start < 120


def _assigned(spark, chooser=None):
    at = lambda n: datetime(2024, 1, 1, 0, 0, n)
    highlights = spark.createDataFrame([(1, 7, "Training", "A training run.", at(1)), (2, 7, "trains", "It trains  now.", at(2)), (3, 7, "zebra", "A zebra.", at(3)), (4, 7, "Zebra", "The zebra ran.", at(4)), (5, 8, "train", "Other user.", at(5)), (6, 7, "training", "A  training run.", at(6))], "highlight_id long, user_id long, target string, sentence string, created_at timestamp")
    cards = spark.createDataFrame([("c1", 7, "train", "They train.", ["учить", "поезд"]), ("c2", 7, "model", "A model.", [])], "card_id string, user_id long, target string, sentence string, translations array<string>")
    links = spark.createDataFrame([("c1", "train", "We train.", at(0)), ("c1", "Train", "we  TRAIN.", at(1))], "card_id string, target string, sentence string, created_at timestamp")
    contexts = spark.createDataFrame([("c1", 1, "x", "train", "it trains now.")], "card_id string, place int, context_id string, target string, sentence string")
    return {k: v.collect() for k, v in C.assign_clusters(highlights, cards, links, contexts, chooser).items()}


def test_clusters_by_default_take_the_likest_card(spark):
    got = _assigned(spark)
    card = {r["highlight_id"]: (r["card_id"], r["is_new"]) for r in got["assigned"]}
    assert card[1] == card[2] == card[6] == ("c1", False) and card[3] == card[4] and card[3][1] and card[5][1] and card[5] != card[3]
    assert sorted((r["card_id"] == "c1", r["context_id"]) for r in got["contexts"]) == [(False, "3"), (False, "4"), (False, "5"), (True, "1")]
    assert {(r["target"], r["is_new"]) for r in got["cards"]} == {("train", False), ("zebra", True), ("train", True)}


def test_chooser_is_asked_once_a_key_and_retried(spark):
    asked, tries = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def chooser(batch, attempt):
        tries.add(1)
        if attempt == 1:
            return batch.head(0).assign(value="")[["key", "value"]]
        asked.add(len(batch))
        answers = []
        for text, found in zip(batch["text"], batch["candidates"], strict=True):
            ids = [c["cluster_id"] for c in json.loads(found)]
            assert all(c["examples"] for c in json.loads(found))
            answers.append(json.dumps({"cluster_id": ids[0] if ids else "gone", "leader": "Beast" if text == "zebra" else "", "translations": ["Учить ", "обучение", text]}))
        return batch.assign(value=answers)[["key", "value"]]

    got = _assigned(spark, chooser)
    assert asked.value == 5  # highlights 1 and 6 ask alike but for white space
    cards = {r["target"]: r["translations"] for r in got["cards"] if r["target"] != "train" or not r["is_new"]}
    assert cards == {"train": ["учить", "поезд", "обучение", "training", "trains"], "beast": ["Учить", "обучение", "zebra"]}
    assert tries.value >= 2


def test_examples_of_clusters(spark):
    at = datetime(2024, 1, 1)
    cards = spark.createDataFrame([("a", "Deep", "A  deep one."), ("b", "x", "only me")], "card_id string, target string, sentence string")
    links = spark.createDataFrame([("a", "Deep", "first", at), ("a", "deep", "FIRST ", at), ("a", "", "none", at)], "card_id string, target string, sentence string, created_at timestamp")
    contexts = spark.createDataFrame([("a", k, f"c{k}", "deep", f"context {k}") for k in (10, 2, 3, 4, 5)], "card_id string, place int, context_id string, target string, sentence string")
    got = {r["card_id"]: [tuple(e) for e in r["examples"]] for r in C.cluster_examples(cards, links, contexts).collect()}
    assert [c.lower() for _, c in got["a"]] == ["first", "context 2", "context 3", "context 4", "context 5"] and got["b"] == [("x", "only me")]


def test_uploads_are_known_by_their_first_bytes_alone(spark, tmp_path):
    """A file over 2 GB (here with a hole) can't be read whole into a row."""
    for name, head, size in (("a b%20.parquet", b"PAR1", 10), ("huge.parquet", b"PAR1", 2_200_000_000), ("tiny", b"P", 1)):
        with open(tmp_path / name, "wb") as file:
            file.write(head)
            file.truncate(size)
    rows = classify_uploads(spark, str(tmp_path), {"parquet": b"PAR1"}, 50).collect()
    assert sorted((r["name"], r["length"], r["kind"], r["accepted"]) for r in rows) == [
        ("a b%20.parquet", 10, "parquet", True), ("huge.parquet", 2_200_000_000, "parquet", False), ("tiny", 1, None, False),
    ]


def test_pairs_of_all_scores_are_dealt_by_user(spark):
    """F30, F32: a small table of leaders is not broadcast to the few tasks that read the highlights."""
    h = spark.createDataFrame([(k, k % 5, f"text {k % 7}") for k in range(40)], "highlight_id long, user_id long, text string").coalesce(1)
    c = spark.createDataFrame([(k, k % 5, f"text {k % 3}") for k in range(20)], "cluster_id long, user_id long, leader string").coalesce(1)
    same = lambda a, b: F.when(a == b, 100.0).otherwise(0.0)
    found = E.fuzzy_top(h, c, score=lambda a, b: same(F.col(a), F.col(b)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(user_id#") >= 2 and "REPARTITION_BY_NUM" in plan
    want = {(k, c_) for k in range(40) for c_ in range(20) if k % 5 == c_ % 5 and k % 7 == c_ % 3}
    assert {(r["highlight_id"], r["cluster_id"]) for r in found.collect()} == want
