"""The pipeline against a plain version of its five stages."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from tests.llm.test_operators import BPE, corpus, plain_components, plain_line_dedup, plain_quality


def test_pipeline_equals_plain_version(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    item = " ".join("".join(rng.choices("mnopq", k=5)) for _ in range(30))
    rows = [(i, t) for i, t in corpus(2, 50) if len(t or "") < 5000]
    rows += [(200, (rows[5][1] or "") + " tail"), (201, " ".join(f"q{j}" for j in range(60)) + " " + item), (202, " ".join(f"r{j}" for j in range(80)))]
    made = [(i, t, "en", None if i == 3 else f"s{i % 2}", len(t or "")) for i, t in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = plain_quality(rows, 20, 0.1)
    left = [(i, t) for i, t in rows if good[i][-1]]
    lines = plain_line_dedup(left)
    left = [(i, lines[i][0]) for i, _ in left]
    low = plain_components(left)
    left = [(i, t) for i, t in left if low[i][1] == i and item not in (t or "")]
    t = Tokenizer.from_file(BPE)
    want = {}
    for i, text in left:
        ids = t.encode(text, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 202 in got and 201 not in got


def test_quality_stage_carries_texts_without_boilerplate(spark, tmp_path):
    import corpus_pipeline

    own = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(40)]
    made = [(k, "all rights reserved\n" + t, "en", "s", 0) for k, t in enumerate(own)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == [(k, t, len(t)) for k, t in enumerate(own)]


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, ld_id int, q_set string, kept_id int, `a.b` int"
    good, other = (" ".join(f"{p}{j}" for j in range(80)) for p in "vw")
    rows = [(None, None, None, None, None, 1, "x", 2, 3), (4, good, "en", None, 1, 1, "x", 2, 3), (4, good, "en", None, 1, 1, "x", 2, 3), (4, other, None, "s", None, 1, "x", 2, 3), (7, "", "en", "s", 0, 1, "x", 2, 3)]
    for k, (made, items) in enumerate([(rows, [(None, None), (1, "")]), ([], [])]):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.createDataFrame(made, schema)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, folder)
            if name != "bpe":
                assert got.columns == docs.columns
            ids = sorted(str(r["doc_id"]) for r in got.collect())
            want = {"quality_rules": ["4", "4", "4"], "simhash_near_dedup": ["4", "4", "4", "7"]}.get(name, ["4", "4", "4", "7", "None"])
            assert ids == (want if made else []), name
