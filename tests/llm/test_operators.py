"""The text operators against plain versions, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import json
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmine.llm import bpe, decontaminate, line_dedup, lm, quality, simhash, substring_dedup, suffix_dedup, token_counts, toxicity
from lexmine.llm.graph import components

BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp long, bucket int, h string, train boolean, ld_id int, q_id int, seed int"


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)] + ["The", "#tag", "x|y", "ß"]
    say = lambda k: " ".join(rng.choices(words, k=k))
    lines = lambda k: "\n".join(say(rng.randint(3, 12)) for _ in range(k))
    shared, passage = lines(4), say(60)
    texts = [lines(rng.randint(1, 9)) for _ in range(n)]
    texts += [texts[0], texts[1] + " more", shared + "\n" + lines(3), lines(2) + "\n" + shared, say(20) + " " + passage + " " + say(9), passage + "\n" + say(5), passage]
    texts += [None, "", "   \n\t ", "one", "a b c", "In. " * 80, "long " * 3 + say(30_000), "word" * 20_000, "\n".join(["same line here"] * 9), "e" + "́ " * 5 + " \x85 x<|endoftext|>y"]
    return [(k, t) for k, t in enumerate(texts)]


def frame(spark, rows):
    wide = [(i, t, "en", f"s{(i or 0) % 2}" if i != 3 else None, len(t or ""), "x", 1, 2, "y", True, 3, 4, 5) for i, t in rows]
    return spark.createDataFrame(wide, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def words_of(text):
    return (text or "").encode().split()


ODD = [(None, "a b"), (None, None), (5, "same text " * 15), (5, "same text " * 15), (5, "other"), (7, "same text " * 15)]


def calls(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f g"), (None, None), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    return {
        "substring": lambda d: substring_dedup.substring_dedup(d),
        "lines": lambda d: line_dedup.line_dedup(d),
        "bpe": lambda d: bpe.encode_decode(d, BPE),
        "digests": lambda d: bpe.digests(d, BPE),
        "counts": lambda d: token_counts.token_counts(d, BPE),
        "quality": lambda d: quality.quality(d),
        "lm": lambda d: lm.lm_scores(d, F.col("doc_id") > 4, BPE),
        "clean": lambda d: decontaminate.decontaminate(d, benchmark),
        "simhash": lambda d: simhash.simhash_components(d),
        "near": lambda d: simhash.near_dedup(d),
        "toxicity": lambda d: toxicity.toxicity(d, toxicity.train(d, labels)),
    }


@pytest.mark.parametrize("name", ["substring", "lines", "bpe", "digests", "counts", "quality", "lm", "clean", "simhash", "near", "toxicity"])
def test_odd_rows_and_empty_tables(spark, name):
    call = calls(spark)[name]
    got = call(frame(spark, ODD)).collect()
    ids = sorted(str(r["doc_id"]) for r in got)
    if name == "near":  # the null ids' "a b" and empty text are alone, and 5's "other"; 7 repeats a text of 5
        assert ids == sorted(["None", "None", "5", "5", "5"])
    else:
        assert ids == sorted(str(i) for i, _ in ODD)
    twice = [tuple(str(r[c]) for c in r.asDict()) for r in got if r["doc_id"] == 5]
    assert len(set(twice)) < len(twice)  # repeated rows get the same result
    assert call(frame(spark, [])).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark, rows):
    names = ["ld_all", "ld_rid", "ld_gone", "c0", "a.b", "ld_lines"]
    docs = spark.createDataFrame([(t, *"uvwxyz", i) for i, t in rows], f"text string, {', '.join(f'`{n}` string' for n in names)}, doc_id long")
    got = line_dedup.line_dedup(docs)
    assert got.columns == ["text", *names[:-1], "doc_id", "ld_lines", "ld_removed"]
    assert {r["doc_id"]: (r["text"], r["ld_lines"], r["ld_removed"]) for r in got.collect()} == plain_line_dedup(rows)
    assert {tuple(r)[1:6] for r in got.collect()} == {tuple("uvwxy")}


def test_near_dedup_judges_texts_of_one_id_apart(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = frame(spark, [(3, text), (5, text), (5, "another text of its own")])
    assert sorted((r["doc_id"], r["text"]) for r in simhash.near_dedup(docs).collect()) == sorted([(3, text), (5, "another text of its own")])


@pytest.mark.parametrize("kind", ["int", "string", "bigint"])
def test_decontamination_takes_item_ids_of_any_type(spark, kind):
    item = "seven words that nobody else would write"
    benchmark = spark.createDataFrame([("4", item)], "item_id string, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
    got = decontaminate.contaminated(frame(spark, [(1, f"x {item} y")]), benchmark)
    assert [str(r["item_id"]) for r in got.collect()] == ["4"] and dict(got.dtypes)["item_id"] == kind


def test_odd_rows_without_match_have_no_row(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, ODD), benchmark).count() == 0
    assert suffix_dedup.repeats(frame(spark, ODD)).count() == 0  # 30 words are too few
    assert suffix_dedup.repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("bucket_bytes", [2_000, 4_000_000])
def test_substring_dedup_is_exact(spark, docs, rows, bucket_bytes):
    seen, want = {}, {}
    for i, t in rows:
        w = words_of(t)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 19):
            key = b" ".join(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = True
            seen.setdefault(key, (i, p))
        want[i] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    got = substring_dedup.substring_dedup(docs, bucket_bytes=bucket_bytes, sketch_width=1 << 16)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()} == want


def plain_line_dedup(rows):
    seen, out = {}, {}
    for i, t in rows:
        full = (t or "").split("\n")
        at = [k for k, x in enumerate(full) if x.encode().split()]
        gone = set()
        for p in range(len(at) - 2):
            key = tuple(full[k] for k in at[p : p + 3])
            if key in seen:
                gone.update(at[p : p + 3])
            seen.setdefault(key, i)
        out[i] = (None if t is None else "\n".join(x for k, x in enumerate(full) if k not in gone), len(at), len(gone))
    return out


def test_line_dedup_is_exact(docs, rows):
    got = line_dedup.line_dedup(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    assert {r["doc_id"]: (r["text"], r["ld_lines"], r["ld_removed"]) for r in got.collect()} == plain_line_dedup(rows)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(spark, docs, rows, file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(file))
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, public_tokenizers.path(file)).collect()}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)
    sha = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in bpe.digests(docs, public_tokenizers.path(file)).collect()}
    assert sha == {i: (len(r["ids"]), hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()) for i, r in got.items()}


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_of_repeated_white_space(spark, file):
    """Chunks without ids are shared like others."""
    from tokenizers import Tokenizer

    texts = [" " * 70, " " * 70, "a b", "\n" * 200, "\n" * 200, "\t " * 64, None, ""]
    t = Tokenizer.from_file(public_tokenizers.path(file))
    got = {r["doc_id"]: r for r in bpe.encode_decode(frame(spark, list(enumerate(texts))), public_tokenizers.path(file)).collect()}
    for k, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert (list(got[k]["ids"]), got[k]["decoded"]) == (ids, t.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_repairs_joins_that_disagree(monkeypatch, file):
    rng = random.Random(3)
    monkeypatch.setattr(bpe.cuts, "__defaults__", (64,))
    texts = [" ".join("".join(rng.choices("abcdefgéñ'", k=rng.randint(1, 12))) + rng.choice(["", ",", "  \n", "\t ", "<|endoftext|>"]) for _ in range(600)).encode() for _ in range(5)]
    e = bpe.Encoder(public_tokenizers.path(file))
    want = e.ids(texts)
    parts = [[t[a:b] for a, b in zip([0, *s], s, strict=False)] for t in texts for s in [bpe.cuts(t)[0]]]
    assert min(map(len, parts)) > 10 and all(b"".join(e.ids(p)) != w for p, w in zip(parts, want, strict=True))  # joins do differ
    assert e.encode(texts) == want
    assert e.encode(texts, dict.fromkeys([]) | {p[1]: e.ids([p[1]])[0] for p in parts}) == want
    fits, asked = bpe.Encoder._fits, []

    def refuse(self, left, right, pair):
        asked.append(pair)
        return pair is not None and len(asked) % 3 == 0 and fits(self, left, right, pair)

    monkeypatch.setattr(bpe.Encoder, "_fits", refuse)  # more words, and at last whole chunks, are taken
    assert e.encode(texts) == want


def test_bpe_shares_repeated_chunks(spark):
    rng = random.Random(5)
    passage = " ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(6000))
    docs = frame(spark, [(k, f"own{k} start {passage} and own{k} end") for k in range(20)] + [(50, None), (51, "short"), (None, passage)])
    shared = bpe.shared_chunks(docs, BPE, "doc_id", "text")
    e = bpe.Encoder(BPE)
    assert len(shared) >= 5 and all(e.ids([c]) == [i] and c.decode() in passage for c, i in shared.items())
    assert len(bpe.shared_chunks(docs, BPE, "doc_id", "text", most=2)) == 2


def test_token_counts_equal_greedy_matching(docs, rows):
    from tokenizers import pre_tokenizers

    with open(BPE, encoding="utf-8") as f:
        tokens = {t.removesuffix("</w>") for t in json.load(f)["model"]["vocab"]}
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    byte = {s: b for k in [*range(0x800), *range(0x800, 0x110000, 0x1000)] if not 0xD800 <= k < 0xE000 for s, b in zip(level.pre_tokenize_str(chr(k))[0][0], chr(k).encode(), strict=True)}
    vocabulary = {bytes(byte[c] for c in t) for t in tokens if all(c in byte for c in t)}
    longest = max(map(len, vocabulary))

    def greedy(w):
        i = n = 0
        while i < len(w):
            k = next((k for k in range(min(len(w), i + longest), i, -1) if w[i:k] in vocabulary), 0)
            if not k:
                return 0
            i, n = k, n + 1
        return n

    small = [(i, t) for i, t in rows if len(t or "") < 5000]
    want = {i: (len(words_of(t)), sum(greedy(w.lower()) for w in words_of(t)), 0) for i, t in small}
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in token_counts.token_counts(docs, BPE).collect()}
    assert {i: got[i] for i in want} == want


def test_continuation_pieces():
    c = token_counts.PieceCounter([b"un", b"##aff", b"##able", b"a"], b"##")
    assert [c.count(w) for w in (b"unaffable", b"un", b"affable", b"a", b"xx", b"unx")] == [3, 1, 0, 1, 0, 0]


def plain_quality(rows, least, share):
    host = lambda i: None if i == 3 else f"s{i % 2}"
    normal = lambda x: b" ".join(x.lower().encode().split())
    texts, held = defaultdict(set), defaultdict(set)
    for i, t in rows:
        texts[host(i)].add(t or "")
        for x in (t or "").split("\n"):
            if x.encode().split():
                held[host(i), normal(x)].add(t or "")
    out = {}
    for i, t in rows:
        t = t or ""
        w = t.encode().split()
        tri = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        cover = {p + k for p in range(len(w) - 2) if tri[tuple(w[p : p + 3])] > 1 for k in range(3)}
        full = [x for x in t.split("\n") if x.encode().split()]
        gone = sum(len(x.encode().split()) for x in full if len(held[host(i), normal(x)]) > max(least, share * len(texts[host(i)])))
        bad = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out[i] = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(cover), bad, gone, not bad and 100 * (len(w) - gone) >= 50 * len(w))
    return out


def test_quality_equals_plain_version(spark, rows):
    extra = [(1000 + k, "boiler plate line\n" + " ".join(f"w{k}x{j}" for j in range(60 if k % 2 else 2))) for k in range(60)]
    every = rows + extra
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.quality(frame(spark, every), least_docs=5, share=0.1).collect()}
    assert got == plain_quality(every, 5, 0.1)
    assert any(v[6] for v in got.values())


@pytest.mark.parametrize("broadcast_lines", [100_000, 0])
def test_clean_removes_lines_above_the_limit(spark, rows, monkeypatch, broadcast_lines):
    monkeypatch.setattr(quality, "BROADCAST_LINES", broadcast_lines)
    extra = [(1000 + k, f"Boiler  plate line\n\nown{k}\n" + " ".join(f"w{k}x{j}" for j in range(60 if k % 2 else 2)) + "\nboiler plate LINE") for k in range(60)]
    extra += [(1060, "boiler plate line\n" * 30 + " ".join(f"v{j}" for j in range(60)))]
    good = plain_quality(rows + extra, 5, 0.1)
    got = {r["doc_id"]: r["text"] for r in quality.clean(frame(spark, rows + extra), least_docs=5, share=0.1).collect()}
    assert got.keys() == {i for i, v in good.items() if v[-1]} and 1001 in got and 1060 not in got
    assert all(got[1000 + k] == f"\nown{k}\n" + " ".join(f"w{k}x{j}" for j in range(60)) for k in range(1, 60, 2))
    assert all(got[i] == t for i, t in rows if i in got and not good[i][6])


def test_lm_base_figures(spark, rows):
    docs = frame(spark, [r for r in rows if len(r[1] or "") < 5000])
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, ~held, BPE).collect()}
    count = Counter()
    tokens = {i: [*words_of((t or "").encode().lower().decode() if t and t.isascii() else (t or "")), b"\n"] for i, t in rows if len(t or "") < 5000}
    tokens = {i: [w.lower() for w in x] for i, x in tokens.items()}
    for i, x in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(x)
    n, v = sum(count.values()), len(count)
    for i, x in tokens.items():
        assert got[i]["n_tokens"] == len(x) and got[i]["train_tokens"] == n and got[i]["n_known"] == sum(count[w] > 0 for w in x)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in x))
        assert np.isfinite(got[i]["score"]) and got[i]["score"] < 0


def made_words(seed, n_texts, length=60):
    """Texts of words put together from the same few parts, so that unseen words look like seen ones."""
    rng = random.Random(seed)
    parts = ["tion", "er", "an", "the", "ing", "ou", "en", "st", "ri"]
    return [" ".join("".join(rng.choices(parts, weights=range(9, 0, -1), k=rng.randint(1, 4))) for _ in range(length)) for _ in range(n_texts)]


def test_lm_beats_base_on_held_out_documents(spark):
    """On the whole table of a scale; on tables of a few texts base_score gives unseen words more than is left for them."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    from lexmine.llm.queries import op6_language_model

    got = op6_language_model(spark, folder).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 1000 and got[0] > 0.98 * got[1]  # log chances, so both are below 0


def test_lm_weights_do_not_depend_on_partitions(spark):
    docs = frame(spark, list(enumerate(made_words(1, 100))))
    one, many = (lm.train(docs.select("text").repartition(k), BPE, 10**6) for k in (1, 7))
    assert (one.levels == many.levels).all() and (one.logits == many.logits).all()
    assert one.levels.any() and (one.logits != lm.Model(one.levels).logits).any()


def test_lm_adds_up_counts_in_steps(spark, monkeypatch):
    rows = frame(spark, list(enumerate(made_words(2, 40)))).select("text").repartition(6)
    want = lm.train(rows, BPE, 1)
    monkeypatch.setattr(lm, "FAN", 2)
    assert (lm.train(rows, BPE, 20 * lm.COUNT_BYTES).levels == want.levels).all()


def test_lm_score_equals_plain_version(spark):
    texts = made_words(3, 60, 25)
    texts += [texts[0] + " " + texts[0], "", "one"]
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(frame(spark, list(enumerate(texts))), F.col("doc_id") < 40, BPE).collect()}
    cut, model = lm.pieces(BPE), lm.train(frame(spark, list(enumerate(texts[:40]))).select("text"), BPE, 10**6)
    w = model.logits
    streams = [[int(x) for x in cut.stream(lm.Texts([t.encode()]))[0]] for t in texts]
    pair, pair_place, piece, piece_place, every = (Counter() for _ in range(5))
    for s in streams[:40]:
        for k in range(1, len(s)):
            two, one, x = s[max(k - 2, 0)], s[k - 1], s[k]
            pair[two, one, x // 64] += 1
            pair_place[two, one, x] += 1
            piece[one, x // 64] += 1
            piece_place[one, x] += 1
            every[x] += 1
    level = lambda n: float(lm.LEVELS[np.searchsorted(lm.LEVELS, n, "right") - 1])
    row = lambda table, key: {k: level(n) for k, n in table.items() if k[: len(key)] == key}
    total_any = sum(level(every[x]) + 0.5 for x in range(4096))

    def share(table, key, x, among=lambda k: True):
        own = {k: n for k, n in row(table, key).items() if among(k)}
        return (own.get((*key, x), 0) / sum(own.values()), sum(own.values())) if own else (1 / 64, 0)

    for i in (41, 45, 60, 61, 62):
        s, log = streams[i], 0.0
        step = lm.WINDOW - lm.CONTEXT
        for k in range(1, len(s)):
            two, one, x = s[max(k - 2, 0)], s[k - 1], s[k]
            begin = max(0, -(-(k - lm.WINDOW) // step)) * step
            same = lambda key: lambda k_: k_[len(key)] // 64 == x // 64
            c, seen = share(pair, (two, one), x // 64)
            v2 = c * share(pair_place, (two, one), x, same((two, one)))[0]
            v1 = share(piece, (one,), x // 64)[0] * share(piece_place, (one,), x, same((one,)))[0]
            v0 = (level(every[x]) + 0.5) / total_any
            first = [j for j in range(begin, k - 1) if s[j] == one]
            both = [j for j in first if j > begin and s[j - 1] == two]
            weights = [np.exp(w[min(int(np.log2(seen + 1)), 13)]) if seen else 0, np.exp(w[14]), 1, *[np.exp(w[15])] * len(first), *[np.exp(w[16])] * len(both)]
            values = [v2, v1, v0, *(s[j + 1] == x for j in first), *(s[j + 1] == x for j in both)]
            log += np.log10(sum(a * b for a, b in zip(weights, values, strict=True)) / sum(weights))
        assert got[i] == pytest.approx(log, rel=1e-3)


def test_lm_chances_add_up_and_the_gradient_is_right():
    rng = np.random.default_rng(4)
    levels = (rng.random(lm.CELLS) < 0.02).astype(np.uint8) * rng.integers(1, 9, lm.CELLS).astype(np.uint8)
    model = lm.Model(levels)
    whole = np.array([[5, 7, 9, 5, 7, x] for x in range(lm.CLASSES * lm.PLACES)], np.uint16)
    last = np.concatenate([model.log_chances(*windows_of(s))[-1:] for s in whole])
    assert np.exp(last).sum() == pytest.approx(1, abs=1e-4)
    values, step = (rng.random(50), rng.random(50), rng.random(50)), rng.integers(0, lm.STEPS[3], 50)
    matches = [np.array([3] * 50), rng.integers(0, 3, 50), np.array([2] * 50), rng.integers(0, 2, 50)]
    share = rng.random(50)
    value = lambda w: (share * np.log(lm.mixed(w, values, step, matches))).sum()
    g = lm.gradient(model.logits, values, step, matches, share)
    for k in range(len(g)):
        up, down = model.logits.copy(), model.logits.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        assert g[k] == pytest.approx((value(up) - value(down)) / 2e-4, abs=1e-4)


def test_attention_equals_plain_version():
    z = np.random.default_rng(1).integers(0, 6, size=(20, lm.WINDOW + 1)).astype(np.int16)
    got = lm.attend(z)
    for w, row in enumerate(z.tolist()):
        for t in range(lm.WINDOW):
            one = [i for i in range(t) if row[i] == row[t]]
            two = [i for i in one if i and row[i - 1] == row[t - 1]]
            hits = [sum(row[i + 1] == row[t + 1] for i in m) for m in (one, two)]
            assert [int(g[w, t]) for g in got] == [len(one), hits[0], len(two), hits[1]]


def windows_of(stream):
    return next(lm.Windows(np.asarray(stream), np.array([len(stream)])).blocks(10**6))[:2]


def test_windows_score_every_piece_once():
    sizes = np.array([2, 32, 33, 34, 57, 200, 2])
    stream = np.arange(sizes.sum())
    scored = []
    for w, first, text in lm.Windows(stream, sizes).blocks(3):
        scored += [(int(x), int(t)) for row, f, x in zip(w, first, text, strict=True) for k, t in enumerate(row[1:]) if k >= f and t >= 0]
    begins = set((np.cumsum(sizes) - sizes).tolist())
    assert scored == [(int(np.searchsorted(np.cumsum(sizes), k, "right")), k) for k in stream.tolist() if k not in begins]


def test_pieces_are_the_longest_ones(rows):
    cut = lm.pieces(BPE)
    words = sorted({w.lower() for _, t in rows for w in words_of(t)} | {b"x" * 500, "größer".encode(), b"the", b"\xff\xfe"})

    def greedy(w):
        w, out = w + b" ", []
        while w:
            k = next(k for k in range(min(len(w), 40), 0, -1) if w[:k] in cut.numbers)
            out.append(cut.numbers[w[:k]])
            w = w[k:]
        return out

    flat, count = cut.cut_all(words)
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == [greedy(w) for w in words]
    stream, sizes = cut.stream(lm.Texts([b"the x\n the", b"", b"  ", b"x"]))
    the, x = greedy(b"the"), greedy(b"x")
    want = [[cut.start, *the, *x, *the, cut.stop], [cut.start, cut.stop], [cut.start, cut.stop], [cut.start, *x, cut.stop]]
    assert [y.tolist() for y in np.split(stream, np.cumsum(sizes)[:-1])] == want


def test_pieces_are_cut_in_bounded_blocks(monkeypatch):
    """What cutting holds grows with the block of words, not with the bucket's distinct words."""
    cut, words, sizes = lm.Pieces(BPE), [b"word%d" % k for k in range(5000)] + [b"x" * 3000, b"the"], []
    longest = cut.longest
    monkeypatch.setattr(cut, "longest", lambda raw: sizes.append(len(raw)) or longest(raw))
    want = cut.cut_all(words, 10**9)
    assert sizes.pop() == sum(len(w) + 1 for w in words)
    got = cut.cut_all(words, 1000)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, want, strict=True))
    assert 3001 in sizes and all(n <= 1000 for n in sizes if n != 3001)
    flat, count = cut.cut_all([])
    assert len(flat) == len(count) == 0


def test_pieces_are_looked_up_where_words_are_cut(monkeypatch):
    """Only places where a piece begins are looked up, each once; not every byte of the words."""
    cut, words, asked = lm.Pieces(BPE), [b"the", b"wording", b"word", b"", b"gr\xc3\xb6\xc3\x9fer", b"a" * 39, b"\0\0"], []
    longest = cut.longest

    def spied(raw):
        find = longest(raw)
        return lambda at: asked.extend(at.tolist()) or find(at)

    monkeypatch.setattr(cut, "longest", spied)
    _, count = cut.cut_all(words)
    assert len(asked) == len(set(asked)) == count.sum() < sum(len(w) + 1 for w in words)


def test_histogram_steps_are_those_of_the_logarithm():
    x = np.concatenate([2.0 ** np.arange(-30, 1), np.random.default_rng(1).random(5000) ** 8, [0.0]]).astype(np.float32)
    want = [0 if y == 0 else min(9, max(1, int(np.floor(1 - np.log2(y) / 2)))) for y in x.astype(float)]
    assert lm._chance_step(x, 10).tolist() == want


def test_the_library_gets_a_bounded_number_of_texts(monkeypatch):
    """What the library returns holds far more than ids, so it gets CALL texts at once."""
    e, sizes = bpe.Encoder(BPE), []
    texts = [b"word%d" % k for k in range(50)]
    want = e.library(texts)

    class Spied:
        def encode_batch_fast(self, some, **options):
            sizes.append(len(some))
            return real.encode_batch_fast(some, **options)

    real, e.tokenizer = e.tokenizer, Spied()
    monkeypatch.setattr(bpe, "CALL", 16)
    assert e.library(texts) == want and e.library([]) == []
    assert sizes == [16, 16, 16, 2]


def test_fingerprints_hold_some_texts_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(range(9)), pa.array(["ab cd " * 60_000] * 8 + [None])], names=["id", "key", "text"])
    got = list(simhash._fingerprinted([batch]))
    assert max(b.num_rows for b in got) <= 3
    assert [f for b in got for f in b.column(2).to_pylist()] == [simhash.fingerprint(b"ab cd " * 60_000)] * 8 + [0]


def test_a_worker_gives_the_library_each_word_once(monkeypatch):
    """Words that a worker remembers aren't encoded again, and ids stay those of the whole text."""
    e, rng = bpe.Encoder(BPE), random.Random(8)
    assert e.by_word
    some = ["don't", "IT'S", "e\u0301te\u0301", "\u0301x", "\u03a3\u03a3", "<|endoftext|>", "\u4e2d\u6587", "a\u2003b", "12,5", "x" * 100, "..."]
    texts = ["".join(rng.choice(some) + rng.choice([" ", "  ", "\n", "\t \u2003", "", " \u0301", "\x1f "]) for _ in range(300)) for _ in range(40)] + ["", " ", "word"]
    sent, library = [], e.library
    monkeypatch.setattr(e, "library", lambda x: sent.extend(x) or library(x))
    raw = [t.encode() for t in texts]
    assert e.ids(raw) == library(raw)
    assert e.encode([b" ".join(raw)]) == library([b" ".join(raw)])
    assert all(b"".join(bpe.words(t)) == t for t in raw)
    once = [w for w in sent if len(w) <= bpe.WORD_LONG]
    assert len(once) == len(set(once))


def test_a_worker_gives_the_library_forms_and_parts_of_words_once(monkeypatch):
    """Words that differ in A-Z, white space before them or marks around them cost no more encoding; those met lately outlive a full memory."""
    e, sent = bpe.Encoder(BPE), []
    library = e.library
    monkeypatch.setattr(e, "library", lambda x: sent.extend(x) or library(x))
    raw = [b"Word word, (WORD) word; don't DON'T", b"\tdon't-word"]
    assert e.ids(raw) == library(raw)
    assert sorted(sent) == sorted({b"word", b",", b"(", b")", b";", b"don", b"'t", b"-"})
    odd = ["H\u0331 h\u0331 J\u030c T\u0308\u0301x W\u030a", "<|ENDOFTEXT|> <|endoftext|> A<|endoftext|>'S <|EndOfText", "\u212a\u0130 \u00c9'S X'\u00c9 A\u00a0 B", "a\x0bb\x1cc \x85d", "'' 's ''s -'s 'S 1a'LL"]
    raw = [x.encode() for x in odd] + [b" ".join(x.encode() for x in odd)]
    assert e.ids(raw) == library(raw)
    monkeypatch.setattr(bpe, "WORD_BYTES", 4000)
    for k in range(200):
        sent.clear()
        assert e.ids([b"common rare%s" % (b"x" * k)]) == library([b"common rare%s" % (b"x" * k)])
        assert k == 0 or b"common" not in sent
    assert len(e.words) + len(e.before) < 60


def test_only_known_tokenizers_take_words_apart():
    with open(BPE, encoding="utf-8") as f:
        whole = json.load(f)
    assert bpe.by_word(whole)
    for change in ({"normalizer": {"type": "Prepend", "prepend": "_"}}, {"pre_tokenizer": {"type": "Metaspace"}}, {"pre_tokenizer": None}, {"post_processor": {"type": "ByteLevel"}}, {"added_tokens": [{"lstrip": True, "rstrip": False, "single_word": False, "content": "<s>"}]}):
        assert not bpe.by_word(whole | change)


def test_decontamination_finds_copies_and_edits(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    say = lambda k: rng.choices(words, k=k)
    items = [say(40) for _ in range(20)]
    edited = [w if k % 8 else "changed" for k, w in enumerate(items[2])]
    texts = [say(300), say(50) + items[0] + say(50), say(9) + [w.upper() + "," for w in items[1]], say(80) + edited + say(9), say(20) + items[3][:8] + say(200)]
    docs = frame(spark, [(k, " ".join(t)) for k, t in enumerate(texts)] + [(9, None)])
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 700):
        got = {(r["doc_id"], r["item_id"]): (round(r["score"], 3), r["start_word"], r["end_word"]) for r in decontaminate.contaminated(docs, benchmark, block_bytes=block).collect()}
        assert set(got) == {(1, 0), (2, 1), (3, 2)}
        assert got[1, 0] == (1.0, 50, 90) and got[2, 1] == (1.0, 9, 49) and got[3, 2][0] > 0.7
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, benchmark).collect()) == [0, 4, 9]


def test_decontamination_finds_every_alignment(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    say = lambda k: rng.choices(words, k=k)
    items = [["lone"], ["two", "some"], *(say(k) for k in (3, 4, 5, 8, 15, 15, 20, 20, 40))]
    texts = [" ".join(say(30))] + [" ".join(w if k % 4 else "changed" for k, w in enumerate(items[-1]))]
    texts += [" ".join(v for w in items[8] for v in (w, "filler"))]
    for x in items * 12:
        gone = set(rng.sample(range(len(x)), len(x) // 3))
        edited = [v for k, w in enumerate(x) for v in ([rng.choice(["changed", *words])] if k in gone and rng.random() < 0.7 else [] if k in gone else [w, "in"] if rng.random() < 0.1 else [w])]
        texts.append(" ".join(say(rng.randint(0, 60)) + edited + say(rng.randint(0, 60))))
    texts += texts[:1] * 30 + [" ".join(items[6][:4])] * 30
    hashed = lambda t: decontaminate.Texts([t.encode()]).hash
    want = {}
    for r, t in enumerate(texts):
        for i, x in enumerate(items):
            score = decontaminate.align(hashed(" ".join(x)), hashed(t))[0]
            if score >= 0.5 * len(x):
                want[r, i] = score / len(x)
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(frame(spark, list(enumerate(texts))), benchmark).collect()}
    assert got == want and (1, 10) in got and (2, 8) in got and {i for _, i in got} == set(range(11))


def plain_components(rows):
    def fingerprint(t):
        w = t.encode().lower().split()
        if not w:
            return 0
        grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fingerprint(t or "") for i, t in rows}
    low = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and low[b] > low[a]:
                    low[b] = low[a]
    return {i: (f"{fps[i]:016x}", low[i]) for i in fps}


def test_simhash_equals_plain_version(spark, rows):
    near = [(100 + k, " ".join(f"w{j}" if j != k else "z" for j in range(150))) for k in range(12)]
    every = [r for r in rows if len(r[1] or "") < 5000] + near
    want = plain_components(every)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(frame(spark, every)).collect()} == want
    assert sorted(r["doc_id"] for r in simhash.near_dedup(frame(spark, every)).collect()) == sorted(i for i in want if want[i][1] == i)


def test_links_of_every_distance_are_found(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(30)]
    for base in fps[:10]:
        for d in range(1, 6):
            fps.append(base ^ sum(1 << b for b in rng.sample(range(64), d)))
    signed = [x - (1 << 64) if x >> 63 else x for x in dict.fromkeys(fps)]
    got = {r["fp"]: r["m"] for r in simhash.clusters(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    low = {x: x for x in signed}
    for _ in range(6):
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                    low[a] = low[b] = min(low[a], low[b])
    same = lambda labels: {frozenset(x for x in signed if labels[x] == m) for m in labels.values()}
    assert same(got) == same(low)


def test_thresholds_cover_the_radius():
    costs = [[0.0, 1, 5, 50, 500, 5000], [0.0, 2, 3, 40, 400, 4000], [0.0, 1, 9, 90, 900, 9000]]
    total, chosen = simhash.allocate(costs, 4)
    assert sum(t + 1 for t in chosen) == 5 and total == min(costs[0][a] + costs[1][b] + costs[2][5 - a - b] for a in range(6) for b in range(6 - a))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1001 + k) for k in range(40)] + [(7, 7)]
    got = {r["u"]: r["m"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(1, 51), 0), **dict.fromkeys(range(1001, 1041), 1000)}


def plain_repeats(rows):
    grams, cover = defaultdict(set), {}
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - 49):
            grams[b" ".join(w[p : p + 50])].add(i)
    for i, t in rows:
        w = words_of(t)
        own = {k for p in range(len(w) - 49) if len(grams[b" ".join(w[p : p + 50])]) > 1 for k in range(p, p + 50)}
        if own:
            cover[i] = own
    return cover


def repeats_of(docs, **settings):
    return {r["doc_id"]: {k for s in r["spans"] for k in range(s["start"], s["end"])} for r in suffix_dedup.repeats(docs, **settings).collect()}


def test_repeats_equal_plain_version(docs, rows):
    cover = plain_repeats(rows)
    assert repeats_of(docs) == cover and cover


@pytest.mark.parametrize("part_bytes", [1_500, 32_000_000])
def test_repeats_are_found_among_decoys(spark, part_bytes):
    """Passages of just 50 words whose seeds other documents share with more words to one side, but too few in all."""
    rng = random.Random(part_bytes)
    say = lambda k: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(k)]
    texts = []
    for _ in range(8):
        passage, after, before = say(50), say(30), say(30)
        texts += [before + passage + after, say(30) + passage + say(30), say(rng.randint(0, 9)) + passage]
        for _ in range(12):  # to the right they agree with the first document longer than the second does
            k = rng.randint(8, 40)
            texts.append(say(rng.randint(0, 20)) + (passage + after)[k : k + 49] + say(rng.randint(0, 20)))
        for _ in range(6):
            k = rng.randint(8, 30)
            texts.append(say(9) + (before + passage)[-k - 20 : -k] + passage[: 49 - 20] + say(20))
    texts += [texts[0]] * 3
    rng.shuffle(texts)
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = plain_repeats(rows)
    assert repeats_of(frame(spark, rows), part_bytes=part_bytes) == want and len(want) >= 24


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(11)
    words, bad = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)], ["vile", "nasty", "foul!", "Rotten"]
    texts, labels = [], []
    for k in range(400):
        w = rng.choices(words, k=rng.randint(20, 90))
        toxic = k % 5 == 0
        for _ in range(4 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs, table = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, table.where("doc_id < 300"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    right = sum(got[k]["predicted"] == y for k, y in labels if k >= 300)
    assert right >= 97
    spans = {texts[k][1][s["start"] : s["end"]] for k, y in labels if y for s in got[k]["spans"]}
    assert any("vile" in s for s in spans)


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(2)
    chain = np.array([0, 0, 0, 0, -1.0, 0.7])
    for n in (1, 2, 5):
        e = rng.normal(size=n).astype(np.float32)
        p0, p1 = 1 / (1 + np.exp(-chain[4:6]))
        first = 1 / (1 + np.exp(4.0))
        total, marks = 0.0, np.zeros(n)
        for path in range(1 << n):
            y = [path >> k & 1 for k in range(n)]
            q = first if y[0] else 1 - first
            for a, b in zip(y, y[1:], strict=False):
                p = p1 if a else p0
                q *= p if b else 1 - p
            q *= np.exp(sum(x for x, k in zip(e, y, strict=True) if k))
            total += q
            marks += q * np.array(y)
        assert toxicity.marginals([e], chain)[0] == pytest.approx(marks / total, abs=1e-4)
