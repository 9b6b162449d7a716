"""Conversation tries and repairs against plain versions, with odd rows, hot conversations and small limits."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexmine.llm import conversation_repair as repair
from lexmine.llm import conversation_trie as trie
from lexmine.llm.ordered import running

SCHEMA = "conv_id long, turn long, role string, text string, place long, a long, h long, shard int, first long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, 9, 1, 2) for r in rows], SCHEMA)


def chats(seed: int = 3) -> list[tuple]:
    """Conversations with shared beginnings, copies, one very long one, null and negative turns, null roles and texts, missing bases."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, 60), 101, 102, 103, 9_007_199_254_740_993]:
        turns = rng.sample(range(-3, 30), rng.randint(1, 12))
        for k, t in enumerate(sorted(turns)):
            rows.append((c, None if k == 0 and c % 4 == 0 else t, rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "hé there", None, "", "x" * 50])))
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(5)]  # copies
    rows += [(300, t, "user", f"long {t % 7}") for t in range(700)]
    rows += [(301, t, "user", f"long {t % 7}") for t in range(400)] + [(305, 1, "user", "hi"), (None, 1, "user", "nobody")]
    return rows


def plain_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [y[1:] for y in sorted(v)] for c, v in own.items()}
    base = lambda c: c - (c % 5 if c >= 0 else -(-c % 5))
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(base(c), [])[:h] + v[h:]
    nodes = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = {}
    for key, members in nodes.items():
        ends = sorted(c for c in members if len(made[c]) == len(key))
        out[key] = [min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), 0, 0, 0, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()]
    for key in sorted(out, key=len, reverse=True):
        one = out[key]
        one[5] = one[5] or 1
        one[6] += (one[3] - 1) * (len(key[-1][1].encode()) if key else 0)
        if key:
            above = out[key[:-1]]
            above[4] += 1
            above[5] += one[5]
            above[6] += one[6]
    return sorted(map(tuple, out.values()), key=str)


def test_running_counts_over_cut_keys(spark):
    rows = [(1, k, k % 250 * 2**55) for k in range(500)] + [(2, 1, 5), (3, 1, 7), (3, 2, -9)]
    out = running(spark.createDataFrame(rows, "k long, o long, v long").repartition(5), "k", ["o"], ("v",)).collect()
    assert len(out) == len(rows)
    total = {}
    for r in sorted(out, key=lambda r: (r["k"], r["o"])):
        n, t = total.get(r["k"], (0, 0))
        assert r["before_v"] % 2**64 == t % 2**64
        total[r["k"]] = n, t = n + 1, t + r["v"]
        assert (r["n"], r["run_v"] % 2**64) == (n, t % 2**64)


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    queue, held, out, want = trie.SpillingQueue(most=20, block=3), [], [], []
    for _ in range(3000):
        if rng.random() < 0.6 or not held:
            item = (rng.randrange(1000), rng.randrange(9))
            queue.push(item)
            held.append(item)
        else:
            assert queue.first() == min(held)
            out.append(queue.pop())
            want.append(min(held))
            held.remove(min(held))
    assert out == want and queue.runs


@pytest.mark.parametrize("shuffle", [4, 30])
def test_trie_equals_plain_version(spark, shuffle, monkeypatch):
    monkeypatch.setattr(trie, "BROADCAST_ROWS", 100_000 if shuffle == 4 else 0)
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        got = trie.conversation_trie(frame(spark, chats())).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(chats())


def test_trie_of_odd_tables(spark):
    assert trie.conversation_trie(frame(spark, [])).collect() == []
    assert trie.conversation_trie(frame(spark, [(None, 1, "user", "x")])).collect() == []
    for rows in ([(3, 1, "user", "x")], [(5, 1, None, None), (5, 1, None, None)], [(11, 2, "user", "y"), (11, None, "user", "z")]):
        assert sorted((tuple(r) for r in trie.conversation_trie(frame(spark, rows)).collect()), key=str) == plain_trie(rows)
    assert trie.conversation_trie(frame(spark, chats())).where(F.col("depth") == 0).count() == 1


FAULTS = ["", " ", "ok.", "ok", "what?\n", "no !", "…", "x" * 300 + "."]


def talks(seed: int = 11) -> list[tuple]:
    """Short conversations of every kind, one of 900 rows, one all blank, one all alike, null ids, turns, roles and texts."""
    rng = random.Random(seed)
    rows = []
    for c in range(250):
        turns = [None if rng.random() < 0.1 else rng.randint(-2, 9) for _ in range(rng.randint(1, 6))]
        rows += [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "u", "User"]), rng.choice([*FAULTS, None])) for t in set(turns)]
    rows += [(500, t, rng.choice(["user", "assistant", "assistant", "system"]), f"line {rng.randrange(600)}{rng.choice('.. x')}") for t in range(900)]
    rows += [(501, t, "user", " \n") for t in range(40)] + [(502, t, "user", "alike.") for t in range(60)] + [(503, 4, "user", "twice."), (503, 4, "user", "twice."), (503, 4, "assistant", "twice.")]
    return rows + [(None, t, ("user", "assistant")[t % 2], f"nobody {t}.") for t in range(4)]


def plain_damage(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, [])
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if fault == 0:
            continue
        x = "" if fault == 1 else "".join(y for y in x if y not in ".!?") if fault == 2 else x
        out[c] += [(t, "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """Least cost and audit by trying a row's edits and inserts from every state, one row after the other."""
    blank = duplicate = truncated = illegal = 0
    seen, kinds = set(), []
    for _, r, x in rows:
        bare = x.strip(" \t\n\x0b\f\r")
        kind = 0 if not bare else 1 if (r, x) in seen else 2 if bare[-1] not in ".!?" else 3
        seen.add((r, x))
        kinds.append(kind)
    blank, duplicate, truncated = (kinds.count(k) for k in range(3))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    role = {"u": "user", "a": "assistant"}

    def widen(ways):
        while True:
            more = dict(ways)
            for s, (cost, audit, said) in ways.items():
                for to in (t for t in step[s].values() if t != "s"):
                    one = (cost + 2, audit + "I", (*said, f"{role[to]}:"))
                    if to not in more or one[:2] < more[to][:2]:
                        more[to] = one
            if more == ways:
                return ways
            ways = more

    ways = widen({"": (0, "", ())})
    for (_, r, x), kind in zip(rows, kinds, strict=True):
        after = {}
        for s, (cost, audit, said) in ways.items():
            edits = [(s, cost + 3, audit + "D", said)]
            if kind > 1:
                edits += [(t, cost + 2 + (kind == 2), audit + "R", (*said, f"{role[t]}:{x}")) for t in step[s].values() if t != "s"]
                if r[:1] in step[s]:
                    edits.append((step[s][r[:1]], cost + (kind == 2), audit + "K", (*said, f"{r}:{x}")))
            for to, *one in edits:
                if to not in after or tuple(one[:2]) < after[to][:2]:
                    after[to] = tuple(one)
        ways = widen(after)
    cost, audit, said = min((ways[s] for s in ("", "a") if s in ways), key=lambda w: w[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, "\n".join(said)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("block, shuffle", [(256, 4), (3, 24)])
def test_repairs_equal_plain_version(spark, block, shuffle):
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    try:
        table = repair.damage(frame(spark, talks()).repartition(3))
        got = {r["conv_id"]: tuple(r)[1:] for r in repair.repairs(table, block).collect()}
        turns = {}
        for r in sorted(repair.repaired_turns(table, block).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["place"])):
            turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = plain_damage(talks())
    assert set(got) == set(want)
    for c, rows in want.items():
        *counts, said = plain_repair(in_order(rows))
        assert got[c] == (*counts, hashlib.sha256(said.encode()).hexdigest()), c
        assert "\n".join(turns.get(c, [])) == said


def test_search_equals_trying_all_edits():
    """Every audit of up to n edits is tried on small conversations."""
    rng = random.Random(4)
    for _ in range(150):
        rows = [(rng.choice("sua?"), gone := rng.random() < 0.3, not gone and rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        best, ways = (3 * len(rows) + 1, ""), [(0, "", 0, 0)]
        while ways:
            cost, audit, i, s = ways.pop()
            if i == len(rows) and s in repair.ACCEPT:
                best = min(best, (cost, audit))
            lattice = repair.Rows(rows)
            ways += [(cost + c, audit + e, *to) for to, c, e in lattice.after((i, s)) if cost + c <= best[0]]
        assert repair.repair(rows) == best
        assert len(rows) < 2 or repair.repair(rows, block=1) == best


def test_repairs_of_odd_tables(spark):
    assert repair.repairs(frame(spark, [])).collect() == []
    assert repair.repaired_turns(frame(spark, [])).collect() == []
    gone = spark.createDataFrame([("x", 1, "user", "hi.", 0)], "conv_id string, turn int, role string, text string, copies int")
    assert [tuple(r) for r in repair.repairs(gone).collect()] == [("x", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
