"""Streams in several runs over one checkpoint, with late rows, against plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from lexmine.operators import concordance as C
from lexmine.operators import text as X
from lexmine.streaming import jobs as J
from lexmine.streaming import timers as T

START = datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, event_id long, event_type string"


def events(seed: int, n: int = 160) -> list[tuple]:
    rng = random.Random(seed)
    return [(rng.randrange(3), START + timedelta(seconds=rng.randrange(6000)), k, rng.choice(["error", "error", "signup", "view"])) for k in range(n)]


def run_in_parts(spark, tmp_path, rows, job):
    """Rows in order of time but each up to nine minutes late, in five runs of one checkpoint; then a row of another user, so late that all timers are past."""
    rng = random.Random(0)
    rows = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(540)))
    size = -(-len(rows) // 4)
    parts = [rows[k : k + size] for k in range(0, len(rows), size)] + [[(99, START + timedelta(days=9), 9999, "view")]]
    out = None
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        out = J.run_available(job(stream), to=f"{tmp_path}/out")
    return sorted(tuple(r) for r in out.collect())


def by_user(rows):
    users = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        users.setdefault(r[0], []).append(r)
    return users


def test_silence_over_runs_and_late_rows(spark, tmp_path):
    rows, want = events(1), []
    for user, own in by_user(rows).items():
        for a, b in zip(own, [*own[1:], None], strict=True):
            if b is None or b[1] > a[1] + timedelta(seconds=90):
                want.append((user, a[1] + timedelta(seconds=90), "gone"))
                want += [(user, b[1], "back")] if b else []
    assert run_in_parts(spark, tmp_path, rows, lambda s: T.silence(s, "user_id")) == sorted(want)


def test_standstill_over_runs_and_late_rows(spark, tmp_path):
    rows, want = events(2), []
    for user, own in by_user([r for r in rows if r[3] != "error"]).items():
        for a, b in zip(own, [*own[1:], None], strict=True):
            if a[3] == "view" and (b is None or b[1] > a[1] + timedelta(seconds=300)):
                want.append((user, a[1] + timedelta(seconds=300), a[2]))
    assert run_in_parts(spark, tmp_path, rows, lambda s: T.standstill(s, "user_id", ("view",), ("signup",)).where("user_id < 99")) == sorted(want)


def test_retries_over_runs_and_late_rows(spark, tmp_path):
    rows, want = events(3), []
    for user, own in by_user(rows).items():
        attempt, due = 0, None
        for _, ts, event, kind in [*own, (user, datetime.max, None, None)]:
            if due and due[0] < ts:
                want.append((user, *due, "retry"))
                due = None
            if kind == "signup":
                attempt, due = 0, None
            if kind == "error":
                attempt += 1
                if attempt == 5:
                    want.append((user, ts, event, 5, "failed"))
                    attempt, due = 0, None
                else:
                    late = ts + timedelta(minutes=[1, 5, 15, 60][attempt - 1])
                    want.append((user, late, event, attempt, "coalesced" if due else "queued"))
                    due = (late, event, attempt)
    got = run_in_parts(spark, tmp_path, rows, lambda s: T.retries(s, "user_id", "error", "signup"))
    assert got == sorted(want) and {r[-1] for r in got} == {"retry", "failed", "coalesced", "queued"}


def test_row_behind_the_watermark_is_left_out(spark, tmp_path):
    rows = [(1, START, 1, "view"), (1, START + timedelta(hours=1), 2, "view")]
    for k, part in enumerate([rows, [(1, START + timedelta(minutes=1), 3, "view")], [(2, START + timedelta(days=1), 4, "view")]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = J.run_available(T.silence(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "user_id"), to=f"{tmp_path}/out")
    assert sorted(r["at"] for r in out.where("user_id = 1").collect()) == [START + timedelta(seconds=90), START + timedelta(hours=1), START + timedelta(hours=1, seconds=90)]


@pytest.mark.parametrize("first", ["rows", "tombstones"])
def test_tombstones_in_either_order(spark, tmp_path, first):
    at = lambda m: START + timedelta(minutes=m)
    tables = {"rows": ([("a", at(0)), ("b", at(0)), ("c", at(1))], "id string, ts timestamp"), "tombstones": ([("a", at(2)), ("c", at(60))], "id string, deleted_at timestamp")}
    ends = {"rows": [("y", at(500))], "tombstones": [("z", at(500))]}
    order = [first, *(n for n in tables if n != first)]
    steps = [{order[0]: tables[order[0]][0]}, {order[1]: tables[order[1]][0]}, ends]
    for n in tables:
        spark.createDataFrame([], tables[n][1]).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    for step in steps:
        for n, rows in step.items():
            spark.createDataFrame(rows, tables[n][1]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n}")
        r, t = (spark.readStream.schema(tables[n][1]).parquet(f"{tmp_path}/{n}") for n in ("rows", "tombstones"))
        out = J.run_available(J.not_deleted_within(r, t, "id"), to=f"{tmp_path}/out")
    assert sorted(r["id"] for r in out.collect()) == ["b", "c"]  # c's tombstone is an hour late


def test_tables_are_written_once_though_the_run_breaks_between_them(spark, tmp_path):
    texts = [[(1, "We trail behind. They trail off."), (2, "Nobody.")], [(3, "I trail behind too. A robust plan."), (4, None)], [(5, "Robust again.")]]
    targets = spark.createDataFrame([("trail",), ("robust",)], "target string")
    source, to = f"{tmp_path}/in", f"{tmp_path}/out"
    tables = J.mined_tables(targets)
    broken = {"left": 2}

    def fails(docs, there):
        if broken["left"]:
            broken["left"] -= 1
            raise RuntimeError("power cut")
        return tables["highlights"](docs, there)

    for part in texts:
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        for _ in range(3):
            stream = spark.readStream.schema("doc_id long, text string").parquet(source)
            try:
                J.write_tables(stream, to, tables | {"highlights": fails})
                break
            except Exception as e:
                assert "power cut" in str(e)
    assert broken["left"] == 0
    docs = spark.createDataFrame([r for part in texts for r in part], "doc_id long, text string")
    said = X.sentences(docs)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(J.read_table(spark, to, "sentences"), said)
    assert same(J.read_table(spark, to, "highlights"), C.concordance(said, said, targets))
    assert sorted((r["target"], r["doc_id"]) for r in J.read_table(spark, to, "cards").collect()) == [("robust", 3), ("trail", 1)]
    assert J.read_table(spark, to, "nothing") is None


def test_sessions_are_appended_when_they_are_over(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    schema = "conv_id long, role string, turn long, text string, ts timestamp"
    parts = [[(1, "a", 2, "c", at(5)), (1, "a", 0, "a", at(0))], [(1, "a", 1, "b", at(3)), (1, "b", 0, "x", at(9))], [(1, "a", 3, "next", at(200))], [(9, "z", 0, "end", at(9000))]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = J.run_available(J.assemble_sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), to=f"{tmp_path}/out")
    assert sorted((r["conv_id"], r["role"], r["text"], r["chunks"]) for r in out.collect()) == [(1, "a", "abc", 3), (1, "a", "next", 1), (1, "b", "x", 1)]


def test_a_key_without_events_is_forgotten_and_late_rows_stay_out(spark, tmp_path):
    at = lambda d, m=0: START + timedelta(days=d, minutes=m)
    parts = [[(1, at(0), 1, "view")], [(2, at(50), 2, "view")], [(2, at(200), 3, "view")], [(1, at(199), 4, "view")], [(1, at(201), 5, "view")], [(2, at(300), 6, "view")]]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = J.run_available(T.silence(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "user_id"), to=f"{tmp_path}/out")
    got = sorted((r["at"], r["state"]) for r in out.where("user_id = 1").collect())
    assert got == [(at(0, 1.5), "gone"), (at(201, 1.5), "gone")]  # forgotten after 90 days, so no "back"; the row of day 199 came behind the watermark
