from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.functions.fuzzy import weighted_ratio
from lexmine.functions.porter import stem
from lexmine.functions.text import STOPWORDS
from lexmine.operators import concordance as C
from lexmine.operators import contexts as M
from lexmine.operators import text as X


def tables(spark, texts, targets):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, X.sentences(docs), spark.createDataFrame([(t,) for t in targets], "target string")


def test_longest_match_wins(spark):
    docs, sents, targets = tables(spark, ["It works as well as before, and as well here."], ["as well", "as well as"])
    got = [(r["target"], r["surface"]) for r in C.concordance(docs, sents, targets).orderBy("place").collect()]
    assert got == [("as well as", "as well as"), ("as well", "as well")]
    taken = C.longest_first(C.exact_matches(sents, targets)).orderBy("start").collect()
    assert [(r["target"], r["start"]) for r in taken] == [("as well as", 9), ("as well", 32)]


def test_phrase_needs_white_space_only(spark):
    _, sents, targets = tables(spark, ["They trail, behind us. They Trail\n behind us."], ["trail behind"])
    got = C.exact_matches(sents, targets).collect()
    assert [(r["sent_id"], r["start"], r["end"]) for r in got] == [(1, 5, 17)]


def test_limit_a_target_is_tested_before_overlap(spark):
    _, sents, targets = tables(spark, ["a b. " * 5], ["a b", "b"])
    got = C.longest_first(C.exact_matches(sents, targets), limit=2).collect()
    assert sorted((r["sent_id"], r["target"]) for r in got) == [(0, "a b"), (1, "a b"), (2, "b"), (3, "b")]


def test_variants_by_stem_and_spelling_not_the_exact_form(spark):
    _, sents, targets = tables(spark, ["It impaired vision. The impairment grew. They impair it. He trailed behind her. It trails behind now."], ["impair", "trail behind"])
    got = sorted({(r["target"], r["surface"].lower()) for r in C.variant_concordance(sents, targets).collect()})
    assert got == [("impair", "impaired"), ("impair", "impairment"), ("trail behind", "trailed behind"), ("trail behind", "trails behind")]


def test_caps_equal_the_greedy_walk(spark):
    rows = [(t, d, k, (t * 7 + d * 5 + k * 3) % 11) for t in range(3) for d in range(5) for k in range(4)]
    df = spark.createDataFrame([(str(t), d, k, 0, s) for t, d, k, s in rows], "target string, doc_id long, sent_id int, place long, score int")
    want = set()
    for t in range(3):
        per, n = {}, 0
        for _, d, k, _s in sorted((r for r in rows if r[0] == t), key=lambda r: (-r[3], r[1], r[2])):
            if per.get(d, 0) < 2 and n < 4:
                per[d] = per.get(d, 0) + 1
                n += 1
                want.add((str(t), d, k))
    assert {(r["target"], r["doc_id"], r["sent_id"]) for r in M.two_caps(df).collect()} == want


def test_refresh_adds_variants_and_is_idempotent(spark):
    known = "The new model was able to trail behind every other strong system in the long test."
    texts = [(1, known), (2, "Nobody saw a strong system trail behind the new model in such a long test before."), (3, "A strong system that trails badly failed the long test of every new model again."), (4, "To trail behind is short.")]
    sents = spark.createDataFrame([(i, 0, t) for i, t in texts], "doc_id long, sent_id int, sentence string")
    targets = spark.createDataFrame([("trail",), ("absent",)], "target string")
    anchors = spark.createDataFrame([("trail", known)], "target string, anchor string")
    none = spark.createDataFrame([], "target string, id string, sentence string")
    first = M.refresh(sents, targets, anchors, none).collect()
    assert sorted(r["sentence"] for r in first) == sorted(t for _, t in texts[:3]) and all(r["is_new"] for r in first)
    kept = spark.createDataFrame([(r["target"], r["id"], r["sentence"]) for r in first], "target string, id string, sentence string")
    assert not any(r["is_new"] for r in M.refresh(sents, targets, anchors, kept).collect())
    approved = spark.createDataFrame([(3,)], "doc_id long")
    assert [r["sentence"] for r in M.refresh(sents, targets, anchors, none, approved).collect()] == [texts[2][1]]


def test_one_pass_equals_a_search_for_each_target(spark):
    """5,000 targets with marks, digits, accents, letters of several cases, repeated parts and odd white space."""
    rng = random.Random(9)
    pieces = ["a", "b,", "c-d", "É", "ß", "İx", "ſ", "K", "(e)", "f.g", "9", "a.a", "x!", "µ", "Σς"]
    targets = {" ".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(9000)} | {"a.a.a", " b,  a ", "", "  "}
    targets = sorted(targets)[:5000]
    texts = ["".join(rng.choice([*pieces, *map(str.upper, pieces), *map(str.lower, pieces)]) + rng.choice([" ", "  ", "\n\t", "", "z"]) for _ in range(rng.randint(0, 120))) for _ in range(40)] + [None, "", " \n ", "a.a.a.a.a.a"]
    want = set()
    for t in targets:
        if t.split():
            p = re.compile("(?<![A-Za-z])" + "\\s+".join(map(re.escape, t.split())) + "(?![A-Za-z])", re.IGNORECASE)
            want |= {(k, m.start(), m.end(), t) for k, text in enumerate(texts) for m in p.finditer(text or "")}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = spark.createDataFrame([(t,) for t in targets], "target string")
    for most in (8_000_000, 9_000):  # one automaton, several
        got = C.pattern_matches(docs, wanted, most).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert len(want) > 1000
    assert C.pattern_matches(docs, wanted.limit(0)).collect() == []


def test_variants_equal_a_plain_walk(spark):
    """Porter stems and the weighted ratio over whole sentences, one word after the other."""
    rng = random.Random(4)
    words = "train trains training trainer trained traine trend robust robustly robustness roboust model models modelling modeled trail trails behind behinds be of general generally generalize generalise generic".split()
    texts = [" ".join(rng.choice(words).capitalize() + rng.choice(["", "", ",", "-"]) for _ in range(rng.randint(1, 14))) + "." for _ in range(80)] + ["", None, "They trail behind, it trails  behinds. Trails, behind; trail-behind."]
    targets = ["train", "robust", "model", "trail behind", "general", "ab"]
    _, sents, wanted = tables(spark, texts, targets)
    want = set()
    for r in sents.collect():
        found = [(m.start(), m.end(), m.group().lower()) for m in re.finditer("[A-Za-z]+", r["sentence"])]
        for t in targets:
            parts = t.split()
            for k in range(len(found)):
                run = found[k : k + len(parts)]
                if len(run) < len(parts) or any(len(w) < 3 for *_, w in run) or any(len(p) < 3 for p in parts):
                    continue
                joined = all(r["sentence"][a[1] : b[0]].isspace() for a, b in zip(run, run[1:], strict=False))
                same = joined and all(stem(w) == stem(p) for (*_, w), p in zip(run, parts, strict=True))
                w = run[0][2]
                near = len(parts) == 1 and len(w) >= 4 and w != t and w[:4] == t[:4] and abs(len(w) - len(t)) <= 4 and not same and weighted_ratio(t, w) >= 78
                if same or near:
                    want.add((r["doc_id"], r["sent_id"], run[0][0], run[-1][1], t, int(near)))
    got = C.variant_matches(sents, wanted).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {k for *_, k in want} == {0, 1} and any(t == "trail behind" for *_, t, _ in want)


def test_refresh_equals_its_parts_done_plainly(spark):
    """One round over random documents: literal and variant contexts, scores, caps and approval, walked target by target."""
    rng = random.Random(12)
    common = "system model strong paper result method value other large small".split()
    forms = ["train", "trains", "training", "robust", "robustly"]
    texts = [" ".join(" ".join(rng.choices(common, k=9)).capitalize() + f" {rng.choice(forms)} " + " ".join(rng.choices(common, k=5)) + "." for _ in range(rng.randint(1, 9))) for _ in range(25)]
    docs, sents, wanted = tables(spark, texts, ["train", "robust"])
    anchors = spark.createDataFrame([("train", "A strong system with large value."), ("robust", "Other small paper result.")], "target string, anchor string")
    none = spark.createDataFrame([], "target string, id string, sentence string")
    approved = {d for d in range(25) if d % 3}
    both = {}
    for found in (C.concordance(docs, sents, wanted), C.variant_concordance(sents, wanted)):
        for r in found.collect():
            both.setdefault((r["target"], r["id"]), r)
    words = lambda s, t: {w for w in re.findall("[a-z]+", s.lower()) if len(w) >= 3 and w not in STOPWORDS and w != t}
    want = set()
    for t, anchor in (("train", "A strong system with large value."), ("robust", "Other small paper result.")):
        rows = sorted((r for (u, _), r in both.items() if u == t), key=lambda r: (r["doc_id"], r["sent_id"], r["place"]))
        first = [r for k, r in enumerate(rows) if sum(x["doc_id"] == r["doc_id"] for x in rows[:k]) < 6]
        scored = [(len(words(anchor, t) & words(r["sentence"], t)), r) for r in first if len(r["sentence"]) >= 45]
        best = sorted((x for x in scored if x[0] >= 2), key=lambda x: (-x[0], x[1]["doc_id"], x[1]["sent_id"], x[1]["place"]))[:14]
        per = {}
        for _, r in best:
            if r["doc_id"] in approved and per.get(r["doc_id"], 0) < 2 and sum(per.values()) < 4:
                per[r["doc_id"]] = per.get(r["doc_id"], 0) + 1
                want.add((t, r["id"]))
    ok = spark.createDataFrame([(d,) for d in approved], "doc_id long")
    got = {(r["target"], r["id"]) for r in M.refresh(sents, wanted, anchors, none, ok).collect()}
    assert got == want and want


def test_longest_first_equals_the_greedy_walk(spark):
    rng = random.Random(7)
    rows = {(rng.randrange(6), rng.randrange(3), s := rng.randrange(40), s + rng.randint(1, 9), rng.choice(["a", "b", "c d"])) for _ in range(900)}
    want = set()
    for d in range(6):
        counts, taken = {}, []
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], r[2], -r[3], r[4])):
            if counts.get(r[4], 0) < 5 and not any(t[1] == r[1] and t[2] < r[3] and r[2] < t[3] for t in taken):
                counts[r[4]] = counts.get(r[4], 0) + 1
                taken.append(r)
        want |= set(taken)
    df = spark.createDataFrame(list(rows), "doc_id long, sent_id int, start long, end long, target string")
    got = C.longest_first(df.repartition(5), 5).select("doc_id", "sent_id", "start", "end", "target").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) < len(rows) / 4


def test_candidates_are_found_in_one_reading(spark):
    """Exact and inflected forms as the two operators find them, with one pass over the text instead of several."""
    said = spark.createDataFrame([(1, 0, "Walks, WALK walking; a talk."), (2, 0, "walked walk")], "doc_id long, sent_id int, sentence string")
    targets = spark.createDataFrame([("walk",), ("talking",)], "target string")
    stem = lambda w: T.suffix_stem(F.col(w))
    found = C.single_word_candidates(said, targets, stem)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "sent_id", "start", "end", "target").collect()))
    assert rows(found.where("kind = 'exact'")) == rows(C.exact_matches(said, targets, longest=1))
    assert rows(found) == rows(C.variant_matches(said, targets, stem=stem, ratio=lambda a, b: F.lit(0.0)).where("kind = 0"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
