"""Archives against a plain version of their contract, the index against a sort, and the merge on its own."""

from __future__ import annotations

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from lexmine.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, size int, digest int, first int, archive int"


def pages(n: int = 60) -> list[tuple]:
    """Copies, short ones, odd texts, null ids, urls and payloads, repeated rows, one URL many times."""
    rng = random.Random(5)
    body = lambda k: "".join(rng.choices("<p>é日 \r\n\0 x", k=k))
    copy, short = body(300), "s" * 99
    rows = [(k, f"https://www.Site{k % 3}.example.org:443/a/{k % 7}?q={k % 2}#top", body(rng.randint(0, 400))) for k in range(n)]
    rows += [(1000 - k, "http://hot.example/", copy) for k in range(40)] + [(2000 + k, f"u{k}", short) for k in range(5)] + [(3000, None, "e" * 100), (2999, "x\r\nWARC-Type: no", "e" * 100)]
    rows += [(None, "http://n.example/1", "n" * 150), (None, "http://n.example/2", "n" * 150), (None, "http://n.example/3", copy), (7, "http://null.example/", None), (4000, "", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9)]
    return rows + [(5000, "http://twice.example/", "t" * 120)] * 2 + [(5001, "http://twice.example/", "t" * 120), (-4, "http://long.example/", "L" * 3_000_000), (-3, "http://long.example/", "L" * 3_000_000)]


def plain(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = least.get(h or "") if len(data) >= 100 else None
        to = None if to == i else to
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], SCHEMA)


@pytest.mark.parametrize("most", [100_000, 0])
def test_archives_come_back_in_order(spark, most, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    monkeypatch.setattr(warc, "PER_FILE", 9)
    monkeypatch.setattr(warc, "BLOCK", 4)
    path = str(tmp_path / "archives")
    warc.write_archives(frame(spark, pages()).repartition(3), path, per_file=9)
    captures = warc.read_archives(spark, path)
    got = warc.capture_histories(captures).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == plain(pages())
    order = [warc._order(tuple(r)) for r in got]
    assert order == sorted(order)
    keys = {r["url"]: r["urlkey"] for r in got}
    assert keys["https://www.Site1.example.org:443/a/1?q=1#top"] == "org,example,site1)/a/1?q=1" and keys["xWARC-Type:no"] == "xwarc-type)/"
    one = next(r for r in got if r["page_id"] == 4000)
    import glob
    import gzip

    raw = gzip.open(glob.glob(f"{path}/{one['archive']}")[0]).read()[one["offset"] : one["offset"] + one["length"]]
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")


def test_odd_tables(spark):
    assert warc.archived(frame(spark, [])).collect() == []
    named = spark.createDataFrame([("b", "u", "x" * 100), ("a", "u", "x" * 100)], "page_id string, url string, html string")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archived(named).collect()) == [("a", "response", None), ("b", "revisit", "a")]


def test_damage_is_told(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(frame(spark, pages(3)[:3]), path)
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "sha256:.", "sha256:g").alias("value"))
    text.write.option("compression", "gzip").text(path + "2")
    with pytest.raises(Exception, match="is damaged"):
        warc.read_archives(spark, path + "2").collect()
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def test_loser_tree_merges_any_runs():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted(((f"u{rng.randrange(5)}", "d", rng.choice([None, rng.randrange(50)]), None, "", 0, "", None, f"a{r}", n, 0) for n in range(rng.randrange(30))), key=warc._order) for r in range(k)]
        blocks = sorted(((r, run[i : i + 4]) for r, run in enumerate(runs) for i in range(0, len(run), 4)), key=lambda b: warc._order(b[1][0]))
        assert list(warc.merged(iter(blocks))) == sorted((c for run in runs for c in run), key=warc._order)
