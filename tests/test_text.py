from __future__ import annotations

import html
import random
import re
import unicodedata

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.functions import udfs
from lexmine.functions.fuzzy import partial_ratio, ratio, weighted_ratio
from lexmine.functions.porter import stem
from lexmine.operators import text as X
from lexmine.plans.base import ROLES


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("“IT’S\n worth!!!", "it's worth"), ("attrib-\nuted", "attributed"), ("(Train),", "train"), ("a--b", "a-b"), ("Straße", "strasse"), ("  -x- ", "x")],
)
def test_normalize_selection(spark, raw, want):
    assert one(spark, T.normalize_selection(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One two. Three four! Five?", ["One two.", "Three four!", "Five?"]),
        ("See Fig. 3 and e.g. this. Next", ["See Fig. 3 and e.g. this.", "Next"]),
        ("Version 1.2.3 works. Yes", ["Version 1.2.3 works.", "Yes"]),
        ("We set: x = 3 and go. Note: nothing", ["We set:", "x = 3 and go.", "Note: nothing"]),
        ('He said "stop." Then left', ['He said "stop."', "Then left"]),
        ("e.g. v.s. no end", ["e.g. v.s. no end"]),
        ("Etc.. done. (e.g. this, i.e., that", ["Etc.. done.", "(e.", "g. this, i.", "e., that"]),
        ("  ", []),
    ],
)
def test_sentences(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r["sentence"] for r in X.sentence_spans(docs).orderBy("sent_id").collect()] == want


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("This is a plain sentence of prose that is long enough to keep.", True),
        ("Too short.", False),
        ("1 2.3 Introduction to the subject and other parts of the book", False),
        ("Model | 12 | 13 | 14 and other parts of a long table row here", False),
        ("a 1 2 3 4 5 6 7 8 numbers in a row that no reader would want to see", False),
        ("It grew by 5% and 6% and then 7% in the years that followed the war.", False),
    ],
)
def test_readable(spark, sentence, want):
    assert one(spark, T.is_readable(F.col("t")), t=sentence) is want


def test_trim_window_keeps_the_target_and_marks_cuts(spark):
    sentence = " ".join(f"word{k}" for k in range(200))
    at = sentence.index("word100")
    got = one(spark, T.trim_window(F.col("s"), F.col("a"), F.col("b")), s=sentence, a=at, b=at + 7)
    assert len(got["sentence"]) <= T.CONTEXT_CHARS + 4
    assert got["sentence"].startswith("… word") and got["sentence"].endswith(" …")
    assert got["sentence"][got["start"] : got["end"]] == "word100"


def test_emphasize_escapes_around_the_first_match(spark):
    assert one(spark, T.emphasize(F.col("s"), F.col("t")), s="a < Big big", t="big") == "a &lt; <b>Big</b> big"
    assert one(spark, T.emphasize(F.col("s"), F.col("t")), s="none & such", t="big") == "none &amp; such"


def test_clean_documents_drops_numbers_links_headings(spark):
    pages = spark.createDataFrame([(1, 1, "Title\nAbstract\nFirst part and\n(4)\n1 https://a.b/c\n10\n2 Methods Here"), (1, 2, "co-\noperate again")], "doc_id long, page_no int, raw_text string")
    row = X.clean_documents(pages).first()
    assert row["text"] == "First part and (4) cooperate again"
    assert [(r["start"], r["end"]) for r in row["page_ranges"]] == [(0, 18), (19, 34)]
    asked = X.clean_documents(pages).select(X.page_of(F.lit(5), F.col("page_ranges")), X.page_of(F.lit(20), F.col("page_ranges")), X.page_of(F.lit(999), F.col("page_ranges"))).first()
    assert list(asked) == [1, 2, 2]


@pytest.mark.parametrize(("word", "want"), [("impaired", "impair"), ("impairment", "impair"), ("trails", "trail"), ("relational", "relat"), ("hopping", "hop"), ("flies", "fli"), ("dies", "die"), ("sky", "sky"), ("at", "at")])
def test_porter(word, want):
    assert stem(word) == want


def test_fuzzy_ratios():
    assert ratio("this is a test", "this is a test!") == pytest.approx(96.55, abs=0.01)
    assert partial_ratio("test", "this is a test!") == 100.0
    assert weighted_ratio("training", "train") == pytest.approx(90.0)
    assert weighted_ratio("", "x") == 0.0
    assert weighted_ratio("fuzzy was a bear", "bear a was fuzzy") == pytest.approx(95.0)


def test_udfs_keep_nulls(spark):
    df = spark.createDataFrame([("ﬁne Straße", "a &amp; b &eacute;"), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(udfs.nfkc_fold("a"), udfs.html_unescape("b"), udfs.porter_stem("a")).collect()][0][:2] == ("fine strasse", "a & b é")
    assert tuple(df.select(udfs.nfkc_fold("a"), udfs.html_unescape("b"), udfs.weighted_ratio("a", "b")).collect()[1]) == (None, None, None)


def test_sentence_spans_meet_page_breaks(spark):
    """Sentence ends and hard page starts are merged, and spans cut from the text equal the sentences."""
    pages = [(1, 1, "One two. Three", False), (1, 2, "Four goes on. Five", True), (1, 3, "", True), (1, 4, "g., six ends. Seven", False), (2, 1, "", False), (3, 1, None, True)]
    docs = X.joined_pages(spark.createDataFrame([(d, n, t or "", h) for d, n, t, h in pages], "doc_id long, page_no int, t string, h boolean"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = sorted((r["doc_id"], r["sent_id"], r["page"], r["start"], r["end"], r["sentence"]) for r in X.page_sentences(docs).collect())
    assert all(text[d][a:b] == s for d, _, _, a, b, s in got)
    assert [(n, p, s) for _, n, p, *_, s in got] == [(0, 1, "One two."), (1, 1, "Three Four goes on."), (1, 2, "Four goes on."), (2, 2, "Five g., six ends."), (2, 4, "Five g., six ends."), (3, 4, "Seven")]
    places = spark.createDataFrame([(1, 1, 9), (1, 2, 15), (1, 4, 40), (1, 4, 999)], "doc_id long, page int, position int")
    found = sorted((r["position"], r["sentence"]) for r in X.sentence_at(places, X.page_sentences(docs)).collect())
    assert found == [(9, "Three Four goes on."), (15, "Four goes on."), (40, "Five g., six ends.")]


def test_dangling_abbreviation_goes(spark):
    docs = X.joined_pages(spark.createDataFrame([(1, 1, "One. g., two is here.", False)], "doc_id long, page_no int, t string, h boolean"))
    cut = X.page_sentences(docs).orderBy("sent_id").collect()
    assert [(r["start"], r["sentence"]) for r in cut] == [(0, "One."), (9, "two is here.")]


def plain_selection(value: str) -> str:
    """FUN1 letter by letter."""
    value = unicodedata.normalize("NFKC", value)
    value = re.sub("[-‐-―−­]\\s*\r?\n\\s*", "", value).replace("­", "")
    out = ""
    for c in value:
        kind = unicodedata.category(c)
        out += "'" if c in "'’‘ʼ＇" else "-" if kind == "Pd" or c == "−" else c.casefold() if kind[0] in "LMN" else " "
    out = re.sub("'{2,}", "'", re.sub("-{2,}", "-", " ".join(out.split())))
    return out.strip(" -'")


def test_selections_with_compatibility_characters(spark):
    """Every character that the JVM keeps to itself, and texts with others; only different texts that need it go to Python."""
    letters = [chr(c) for c in [*range(1, 0x860), *range(0x1E00, 0x2300)] if c != 0xAD]  # blocks that no later Unicode has added to
    texts = [f"x{c}y" for c in letters] + ["ﬁne ﬆone", "ＦＵＬＬ　width", "Café au", "ς Σ ΟΔΟΣ", "½ ℡ ①", "ǆungla", None, ""] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: r["t"] for r in X.normalize_selections(df, "t").collect()}
    wrong = {texts[k]: v for k, v in got.items() if v != (None if texts[k] is None else plain_selection(texts[k]))}
    assert not wrong
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(values: pd.Series) -> pd.Series:
        asked.add(len(values))
        return values

    rows = df.where("id % 50 = 0 OR t LIKE '%ne%' OR t LIKE '%width%'")
    assert len(X.through_python(rows, "t", T.has_compatibility(F.col("t")), counted).collect()) == rows.count()
    assert asked.value == rows.where(T.has_compatibility(F.col("t"))).select("t").distinct().count() < rows.count()


def test_entities_from_the_full_table(spark):
    texts = ["&eacute;&#x3c;", "&amp;lt;", "&lt;b&gt;", "AT&T &notin; x", "&copy 2024", None, "", "&amp;amp;"]
    got = {r["id"]: r["t"] for r in X.unescape_texts(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "t").collect()}
    assert got == {k: None if t is None else html.unescape(t) for k, t in enumerate(texts)}


def test_nearest_occurrence(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choices("abc", k=rng.randint(0, 12))), rng.choice(["a", "ab", "abc"]), rng.randint(0, 14)) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string, w string, h int")
    for r in df.select("*", T.nearest_occurrence(F.col("t"), F.col("w"), F.col("h")).alias("n")).collect():
        at = max(1, r["h"])
        places = [k + 1 for k in range(len(r["t"])) if r["t"].startswith(r["w"], k)]
        assert r["n"] == min(places, key=lambda p: (abs(p - at), p), default=None), r


#: Words of the published description of the algorithm with their stems.
PUBLISHED = """caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True)))
def test_published_stems(word, want):
    assert stem(word) == want


def plain_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence, by a table, over both lengths."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return 200 * rows[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def plain_weighted(a: str, b: str) -> float:
    """The weighted ratio put together from its definition."""
    if not a or not b:
        return 0.0
    ordered = lambda words: " ".join(sorted(words))

    def partial(x, y):
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if not x:
            return 0.0 if y else 100.0
        return max(plain_ratio(x, y[max(0, k) : k + len(x)]) for k in range(1 - len(x), len(y)))

    x, y = set(a.split()), set(b.split())
    both, left, right = ordered(x & y), ordered(x - y), ordered(y - x)
    token = plain_ratio(ordered(a.split()), ordered(b.split()))
    if both:
        token = 100.0 if not left or not right else max(token, plain_ratio(both, f"{both} {left}"), plain_ratio(both, f"{both} {right}"), plain_ratio(f"{both} {left}", f"{both} {right}"))
    times = max(len(a), len(b)) / min(len(a), len(b))
    if times < 1.5:
        return max(plain_ratio(a, b), 0.95 * token)
    scale = 0.9 if times <= 8 else 0.6
    part = 100.0 if both else max(partial(ordered(a.split()), ordered(b.split())), partial(left, right))
    return max(plain_ratio(a, b), scale * partial(a, b), scale * 0.95 * part)


def test_weighted_ratio_equals_its_definition():
    rng = random.Random(1)
    words = ["train", "training", "a", "robust", "model", "ñandú", "models", "of", "xyz"]
    for _ in range(600):
        a, b = (" ".join(rng.choices(words, k=rng.randint(0, 5))) for _ in range(2))
        assert weighted_ratio(a, b) == pytest.approx(plain_weighted(a, b)), (a, b)


def test_sentence_rule_is_the_same_in_sql():
    """A run of marks that begins with an abbreviation's full stop ends nothing as a whole: the SQL twin cut "ST.!! X" in two."""
    pick = random.Random(5)
    bits = ["e", "g", "v", "s", "st", "No", "etc", "i", "é", "ſt", "3", "²", ".", ".", ".", "!", "?", ":", ":", " ", " ", "=", "- a", '"', "”", ")", "\n", "\x0b", "ab cd"]
    texts = ["", "One. ST.!! NEXT!! e.g. x", "x!e.g. y e.!g. a", "no.no.no.no. st.!no. e.g.e.g. v.e.g. y", *("".join(pick.choices(bits, k=pick.randint(1, 40))) for _ in range(3000))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = con.execute(f"WITH {ROLES['corpus']},\n{ROLES['sentences']} SELECT doc_id, sent_id, sentence FROM sentences ORDER BY 1, 2").fetchall()
    squeezed = [re.sub("\\s+", " ", t, flags=re.ASCII).strip(" ") for t in texts]
    assert want == [(k, n, t[a:b]) for k, t in enumerate(squeezed) for n, (a, b) in enumerate(X.spans(t))]
    assert [t for k, _, t in want if k == 1] == ["One.", "ST.!! NEXT!!", "e.g. x"]


def test_texts_are_split_by_small_slices():
    """What a Python worker holds at once follows from the slice, not from the batch."""
    batch = pa.record_batch({"text": ["x" * 5000] * 1000})
    parts = list(X._slices(batch, 0))
    assert sum(p.num_rows for p in parts) == 1000
    assert max(p.num_rows for p in parts) * 5000 <= 600_000


def test_a_tag_is_computed_once(spark):
    """The long replacement stands once in the plan; a null stays one."""
    df = spark.createDataFrame([("  ",), (None,), ("a b__",), ("_x",)], "t string").select(T.safe_tag(F.col("t")).alias("tag"))
    assert [r["tag"] for r in df.collect()] == ["article", None, "a_b", "x"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("[^A-Za-z0-9_:-]+") == 1


def test_texts_pass_python_without_a_shuffle(spark):
    """Normalising sends no row to another task, and leaves nulls and the others as they are."""
    df = spark.createDataFrame([(1, "ﬁn"), (2, "fin"), (3, None), (4, "ﬁn")], "i int, t string")
    out = X.normalize_selections(df, "t")
    assert sorted((r["i"], r["t"]) for r in out.collect()) == [(1, "fin"), (2, "fin"), (3, None), (4, "fin")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
