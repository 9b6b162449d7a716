"""Queries over occurrences of targets and their contexts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.functions import udfs
from lexmine.operators import concordance as C
from lexmine.operators import contexts as M
from lexmine.operators import text as X
from lexmine.plans.base import corpus, query, table, targets

_HITS = "hits AS (SELECT w.doc_id, w.sent_id, w.pos, w.start, w.start + length(w.token) AS \"end\", t.target, w.token AS surface FROM words w JOIN targets t ON lower(w.token) = t.target)"
#: The trimming of long sentences in SQL: from {0} (s, t0, t1) to t_f, with the bounds a2 and b2.
_TRIM = """t_a AS (SELECT *, length(s) AS n, greatest(0, t0 - CAST(floor(greatest(40, 420 - (t1 - t0) - 4) * 0.45) AS BIGINT)) AS a0 FROM {0}),
t_b AS (SELECT *, least(n, a0 + 420) AS b0 FROM t_a),
t_c AS (SELECT *, CASE WHEN b0 = n THEN greatest(0, b0 - 420) ELSE a0 END AS a1 FROM t_b),
t_d AS (SELECT *, strpos(substring(s, a1 + 1), ' ') AS g FROM t_c),
t_e AS (SELECT *, CASE WHEN a1 > 0 AND g > 0 AND a1 + g - 1 < t0 THEN a1 + g ELSE a1 END AS a2, strpos(reverse(substring(s, t1 + 1, greatest(b0 - t1, 0))), ' ') AS r FROM t_d),
t_f AS (SELECT *, CASE WHEN b0 < n AND r > 0 AND b0 - r > t1 THEN b0 - r ELSE b0 END AS b2 FROM t_e)"""
_TEXT = "CASE WHEN n > 420 THEN CASE WHEN a2 > 0 THEN '… ' ELSE '' END || trim(substring(s, a2 + 1, b2 - a2)) || CASE WHEN b2 < n THEN ' …' ELSE '' END ELSE s END"
_PLACE = "CASE WHEN n > 420 THEN CASE WHEN a2 > 0 THEN 2 ELSE 0 END + t0 - a2 ELSE t0 END"
_FIRST = f""", hits AS (SELECT w.doc_id, w.sent_id, w.start, w.token AS surface, t.target, s.sentence AS s, w.start AS t0, w.start + length(w.token) AS t1 FROM words w JOIN targets t ON lower(w.token) = t.target JOIN sentences s ON s.doc_id = w.doc_id AND s.sent_id = w.sent_id),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target ORDER BY sent_id, start) AS c FROM hits) WHERE c <= 12),
{_TRIM.format("capped")},
placed AS (SELECT doc_id, sent_id, start, surface, target, {_TEXT} AS sentence, {_PLACE} AS p FROM t_f),
seen AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target, replace(lower(sentence), 'ß', 'ss') ORDER BY sent_id, start) AS k FROM placed)"""

_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


def _sents(spark, d):
    return X.sentences(corpus(spark, d))


@query("SELECT doc_id, sent_id, pos, start, token FROM words", "corpus", "sentences", "words")
def agg11_word_index(spark, d):
    return X.word_index(_sents(spark, d)).drop("follows")


@query("SELECT substring(lower(token), 1, 4) AS prefix, count(*) AS postings, count(DISTINCT doc_id) AS docs, count(DISTINCT lower(token)) AS forms FROM words WHERE length(token) >= 4 GROUP BY 1", "corpus", "sentences", "words")
def agg11_prefix_index(spark, d):
    w = X.word_index(_sents(spark, d)).where("length(token) >= 4")
    return w.groupBy(F.substr(F.lower("token"), F.lit(1), F.lit(4)).alias("prefix")).agg(F.count("*").alias("postings"), F.count_distinct("doc_id").alias("docs"), F.count_distinct(F.lower("token")).alias("forms"))


@query(f', {_HITS} SELECT doc_id, sent_id, start, "end", target FROM hits', "corpus", "targets", "sentences", "words")
def joi12_exact_matches(spark, d):
    return C.exact_matches(_sents(spark, d), targets(spark, d), longest=1)


@query(
    """, pairs AS (SELECT a.doc_id, a.sent_id, a.start, b.start + length(b.token) AS "end", lower(a.token) || ' ' || lower(b.token) AS gram FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.pos = a.pos + 2 JOIN tokens m ON m.doc_id = a.doc_id AND m.sent_id = a.sent_id AND m.pos = a.pos + 1 AND regexp_matches(m.token, '^\\s+$')),
top AS (SELECT gram FROM pairs GROUP BY gram ORDER BY count(*) DESC, gram LIMIT 10)
SELECT p.doc_id, p.sent_id, p.start, p."end", p.gram AS target FROM pairs p JOIN top USING (gram)""",
    "corpus", "sentences", "words",
)
def joi12_phrase_matches(spark, d):
    sents = _sents(spark, d)
    top = X.phrases(sents, 2).groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(10).select(F.col("gram").alias("target"))
    return C.exact_matches(sents, top, longest=2)


@query(
    r""", stems AS (SELECT target, regexp_replace(target, '^([a-z]{3,}?)(ments|ment|ings|ing|edly|ed|es|ly|s)$', '\1') AS stem FROM targets)
SELECT w.doc_id, w.sent_id, w.start, s.target FROM words w JOIN stems s ON regexp_replace(lower(w.token), '^([a-z]{3,}?)(ments|ment|ings|ing|edly|ed|es|ly|s)$', '\1') = s.stem WHERE length(w.token) >= 3""",
    "corpus", "targets", "sentences", "words",
)
def joi13_stem_matches(spark, d):
    found = C.variant_matches(_sents(spark, d), targets(spark, d), stem=lambda w: T.suffix_stem(F.col(w)), ratio=lambda a, b: F.lit(0.0))
    return found.where("kind = 0").select("doc_id", "sent_id", "start", "target")


@query(
    r""", vocabulary AS (SELECT DISTINCT lower(token) AS w FROM words WHERE length(token) >= 4),
near AS (SELECT v.w, t.target, levenshtein(v.w, t.target) AS d FROM vocabulary v JOIN targets t ON substring(v.w, 1, 4) = substring(t.target, 1, 4) WHERE v.w <> t.target AND abs(length(v.w) - length(t.target)) <= 4
 AND regexp_replace(v.w, '^([a-z]{3,}?)(ments|ment|ings|ing|edly|ed|es|ly|s)$', '\1') <> regexp_replace(t.target, '^([a-z]{3,}?)(ments|ment|ings|ing|edly|ed|es|ly|s)$', '\1'))
SELECT w.doc_id, w.sent_id, w.start, n.target FROM words w JOIN near n ON lower(w.token) = n.w WHERE 100.0 - 100.0 * n.d / greatest(length(n.w), length(n.target)) >= 70""",
    "corpus", "targets", "sentences", "words",
)
def joi14_near_spellings(spark, d):
    likeness = lambda a, b: 100.0 - 100.0 * F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    found = C.variant_matches(_sents(spark, d), targets(spark, d), stem=lambda w: T.suffix_stem(F.col(w)), ratio=likeness, cutoff=70.0)
    return found.where("kind = 1").select("doc_id", "sent_id", "start", "target")


@query(None)
def pip4_variant_concordance(spark, d):
    return C.variant_concordance(_sents(spark, d), targets(spark, d))


@query(None)
def fun26_porter_stems(spark, d):
    return X.word_index(_sents(spark, d)).select(F.lower("token").alias("w")).distinct().select("w", udfs.porter_stem("w").alias("stem"))


@query(f", {_HITS} SELECT doc_id, sent_id, start, target, row_number() OVER (PARTITION BY doc_id, target ORDER BY sent_id, start) - 1 AS occurrence FROM hits", "corpus", "targets", "sentences", "words")
def win1_occurrence(spark, d):
    found = C.exact_matches(_sents(spark, d), targets(spark, d), longest=1)
    return found.select("doc_id", "sent_id", "start", "target", (F.row_number().over(W.partitionBy("doc_id", "target").orderBy("sent_id", "start")) - 1).cast("long").alias("occurrence"))


@query(f', {_HITS} SELECT doc_id, sent_id, start, "end", target FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target ORDER BY sent_id, start) AS n FROM hits) WHERE n <= 12', "corpus", "targets", "sentences", "words")
def win7_longest_first(spark, d):
    return C.longest_first(C.exact_matches(_sents(spark, d), targets(spark, d), longest=1), 12)


@query(f"{_FIRST} SELECT doc_id, sent_id, start AS place, target FROM seen WHERE k = 1", "corpus", "targets", "sentences", "words")
def win18_first_seen(spark, d):
    return C.concordance(corpus(spark, d), _sents(spark, d), targets(spark, d)).select("doc_id", "sent_id", "place", "target")


@query(
    f"""{_FIRST}, esc AS (SELECT *, substring(sentence, 1, p) AS b, substring(sentence, p + length(surface) + 1) AS a FROM seen WHERE k = 1)
SELECT doc_id, sent_id, target, surface, sentence, replace(replace(replace(replace(replace(b, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '<b>' || surface || '</b>' || replace(replace(replace(replace(replace(a, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS sentence_html,
substring(sha256(doc_id || '|' || sent_id || '|' || start || '|' || surface || '|' || sentence), 1, 16) AS id FROM esc""",
    "corpus", "targets", "sentences", "words",
)
def pip3_concordance(spark, d):
    found = C.concordance(corpus(spark, d), _sents(spark, d), targets(spark, d))
    return found.select("doc_id", "sent_id", "target", "surface", "sentence", "sentence_html", "id")


@query(
    f""", base AS (SELECT doc_id, squeezed AS s, length(squeezed) // 2 AS t0, length(squeezed) // 2 + 7 AS t1 FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed FROM corpus) WHERE length(squeezed) > 20),
{_TRIM.format("base")} SELECT doc_id, {_TEXT} AS sentence, CAST({_PLACE} AS INTEGER) AS start FROM t_f""",
    "corpus",
)
def fun7_trim_window(spark, d):
    s = corpus(spark, d).select("doc_id", T.squeeze(F.col("text")).alias("s")).where(F.length("s") > 20).withColumn("t", F.floor(F.length("s") / 2).cast("int"))
    return s.select("doc_id", T.trim_window(F.col("s"), F.col("t"), F.col("t") + 7).alias("w")).select("doc_id", "w.sentence", "w.start")


@query(
    f""", f AS (SELECT doc_id, sent_id, sentence, lower(regexp_extract(sentence, '[A-Za-z]{{6,}}')) AS target FROM sentences WHERE regexp_matches(sentence, '[A-Za-z]{{6,}}')), g AS (SELECT *, strpos(lower(sentence), target) AS p FROM f)
SELECT doc_id, sent_id, target, {_ESC.format("substring(sentence, 1, p - 1)")} || '<b>' || substring(sentence, p, length(target)) || '</b>' || {_ESC.format("substring(sentence, p + length(target))")} AS html FROM g""",
    "corpus", "sentences",
)
def fun8_emphasize(spark, d):
    """The first long word of each sentence is its target."""
    s = _sents(spark, d).withColumn("target", F.lower(F.regexp_extract("sentence", "[A-Za-z]{6,}", 0))).where("target <> ''")
    return s.select("doc_id", "sent_id", "target", T.emphasize(F.col("sentence"), F.col("target")).alias("html"))


@query(f', {_HITS} SELECT doc_id, sent_id, start, "end", target FROM hits ORDER BY doc_id, sent_id, start, "end" - start DESC, target', "corpus", "targets", "sentences", "words")
def srt4_match_order(spark, d):
    return C.exact_matches(_sents(spark, d), targets(spark, d), longest=1).orderBy("doc_id", "sent_id", "start", F.desc(F.col("end") - F.col("start")), "target")


_WORDS_OF = f"list_sort(list_distinct(list_filter(regexp_extract_all(replace(lower({{0}}), 'ß', 'ss'), '[a-z]+'), lambda w: length(w) >= 3 AND NOT list_contains({T.STOPWORDS}, w) AND w <> {{1}})))"
_ANCHORS = f"{_FIRST}, c AS (SELECT doc_id, sent_id, start AS place, target, sentence FROM seen WHERE k = 1), anchors AS (SELECT target, sentence AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY doc_id, sent_id, place) AS o FROM c) WHERE o = 1)"


def _scored(spark, d):
    found = C.concordance(corpus(spark, d), _sents(spark, d), targets(spark, d))
    anchors = found.groupBy("target").agg(F.min_by("sentence", F.struct("doc_id", "sent_id", "place")).alias("anchor"))
    return M.score(found, anchors)


@query(f"{_ANCHORS} SELECT c.doc_id, c.sent_id, c.place, c.target, CASE WHEN len(list_intersect({_WORDS_OF.format('a.anchor', 'c.target')}, {_WORDS_OF.format('c.sentence', 'c.target')})) >= 2 THEN len(list_intersect({_WORDS_OF.format('a.anchor', 'c.target')}, {_WORDS_OF.format('c.sentence', 'c.target')})) END AS score FROM c JOIN anchors a USING (target)", "corpus", "targets", "sentences", "words")
def fun34_context_score(spark, d):
    return _scored(spark, d).select("doc_id", "sent_id", "place", "target", F.col("score").cast("long").alias("score"))


@query(f"{_ANCHORS} SELECT c.doc_id, c.sent_id, c.place, c.target, len(list_intersect({_WORDS_OF.format('a.anchor', 'c.target')}, {_WORDS_OF.format('c.sentence', 'c.target')})) AS overlap FROM c JOIN anchors a USING (target)", "corpus", "targets", "sentences", "words")
def agg12_overlap(spark, d):
    return _scored(spark, d).select("doc_id", "sent_id", "place", "target", F.size(F.array_intersect("anchor_words", "words")).cast("long").alias("overlap"))


_READABLE = r"(length(sentence) >= 45 AND NOT suffix(sentence, ' .') AND NOT contains(sentence, '|') AND NOT regexp_matches(sentence, '^(…\s*)?[0-9]+\s+[0-9]+(\.[0-9]+)+\s+') AND len(regexp_extract_all(regexp_replace(sentence, '([A-Za-z])[0-9]', '\1', 'g'), '[0-9]+(?:\.[0-9]+)?%?')) < 8 AND len(list_filter(regexp_extract_all(sentence, '[0-9]+(?:\.[0-9]+)?%?'), lambda x: suffix(x, '%'))) < 3 AND length(regexp_replace(sentence, '[^\p{S}]', '', 'g')) < 5)"
_MINED = f"""{_ANCHORS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, doc_id ORDER BY sent_id, place) AS r FROM c) WHERE r <= 6),
sc AS (SELECT k.*, len(list_intersect({_WORDS_OF.format('a.anchor', 'k.target')}, {_WORDS_OF.format('k.sentence', 'k.target')})) AS o FROM k JOIN anchors a USING (target) WHERE {_READABLE}),
ok AS (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS approved FROM sc WHERE o >= 2)"""


@query(f"{_ANCHORS} SELECT doc_id, sent_id, place, target FROM (SELECT *, row_number() OVER (PARTITION BY target, doc_id ORDER BY sent_id, place) AS r FROM c) WHERE r <= 6", "corpus", "targets", "sentences", "words")
def win9_cap_before_filters(spark, d):
    return M.cap(_scored(spark, d), ["target", "doc_id"], ["sent_id", "place"], 6).select("doc_id", "sent_id", "place", "target")


@query(f"{_MINED} SELECT doc_id, sent_id, place, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY o DESC, doc_id, sent_id, place) AS r14 FROM ok) WHERE r14 <= 14", "corpus", "targets", "sentences", "words")
def win11_approval_cap(spark, d):
    return M.candidates(_scored(spark, d)).select("doc_id", "sent_id", "place", "target")


@query(
    f"{_MINED}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY o DESC, doc_id, sent_id, place) AS r14 FROM ok) WHERE r14 <= 14 AND approved), g AS (SELECT *, row_number() OVER (PARTITION BY target, doc_id ORDER BY o DESC, sent_id, place) AS rd FROM f) SELECT doc_id, sent_id, place, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY o DESC, doc_id, sent_id, place) AS rt FROM g WHERE rd <= 2) WHERE rt <= 4",
    "corpus", "targets", "sentences", "words",
)
def pip5_mine_contexts(spark, d):
    approved = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return M.mine(_scored(spark, d), approved).select("doc_id", "sent_id", "place", "target")


@query(None)
def pip5_refresh_contexts(spark, d):
    """The whole round, with inflected and near-spelled forms: literal contexts of a target's first document are its known ones."""
    sents, wanted = _sents(spark, d), targets(spark, d)
    found = C.concordance(sents, sents, wanted)
    anchors = found.groupBy("target").agg(F.min_by("sentence", F.struct("doc_id", "sent_id", "place")).alias("anchor"), F.min("doc_id").alias("doc_id"))
    retained = found.join(anchors.select("target", "doc_id"), ["target", "doc_id"], "left_semi").select("target", "id", "sentence")
    return M.refresh(sents, wanted, anchors.select("target", "anchor"), retained, table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query(
    f"{_MINED}, g AS (SELECT *, row_number() OVER (PARTITION BY target, doc_id ORDER BY o DESC, sent_id, place) AS rd FROM ok) SELECT doc_id, sent_id, place, target FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY o DESC, doc_id, sent_id, place) AS rt FROM g WHERE rd <= 2) WHERE rt <= 4",
    "corpus", "targets", "sentences", "words",
)
def win10_two_level_cap(spark, d):
    kept = M.cap(_scored(spark, d), ["target", "doc_id"], ["sent_id", "place"], 6).where("readable AND score IS NOT NULL")
    return M.two_caps(kept).select("doc_id", "sent_id", "place", "target")


@query(f"{_MINED} SELECT doc_id, sent_id, place, target, approved, o AS score FROM ok ORDER BY target, approved DESC, o DESC, doc_id, sent_id, place", "corpus", "targets", "sentences", "words")
def srt3_candidate_order(spark, d):
    kept = M.cap(_scored(spark, d), ["target", "doc_id"], ["sent_id", "place"], 6).where("readable AND score IS NOT NULL")
    marked = kept.join(table(spark, d, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("approved")), "doc_id", "left").withColumn("approved", F.coalesce("approved", F.lit(False)))
    return marked.orderBy("target", F.desc("approved"), F.desc("score"), "doc_id", "sent_id", "place").select("doc_id", "sent_id", "place", "target", "approved", F.col("score").cast("long").alias("score"))


@query(
    r""", stems AS (SELECT target, regexp_replace(target, '^([a-z]{3,}?)(ments|ment|ings|ing|edly|ed|es|ly|s)$', '\1') AS stem FROM targets),
u AS (SELECT w.doc_id, w.sent_id, w.start, t.target, 'exact' AS kind FROM words w JOIN targets t ON lower(w.token) = t.target
UNION ALL SELECT w.doc_id, w.sent_id, w.start, s.target, 'variant' FROM words w JOIN stems s ON regexp_replace(lower(w.token), '^([a-z]{3,}?)(ments|ment|ings|ing|edly|ed|es|ly|s)$', '\1') = s.stem WHERE length(w.token) >= 3 AND lower(w.token) <> s.target)
SELECT target, kind, count(*) AS candidates, count(DISTINCT doc_id) AS docs FROM u GROUP BY target, kind""",
    "corpus", "targets", "sentences", "words",
)
def set1_union_candidates(spark, d):
    sents, wanted = _sents(spark, d), targets(spark, d)
    found = C.single_word_candidates(sents, wanted, lambda w: T.suffix_stem(F.col(w)))
    return found.groupBy("target", "kind").agg(F.count("*").alias("candidates"), F.count_distinct("doc_id").alias("docs"))


@query(
    """, cand AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+, [a-z]+')) AS target FROM corpus), top AS (SELECT target FROM cand WHERE split_part(target, ', ', 1) <> split_part(target, ', ', 2) GROUP BY target ORDER BY count(*) DESC, target LIMIT 5),
ws AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS w FROM corpus)),
p AS (SELECT doc_id, regexp_extract(w, '[a-z]+,$') || ' ' || regexp_extract(lead(w) OVER (PARTITION BY doc_id ORDER BY i), '^[a-z]+') AS target FROM ws)
SELECT doc_id, target, count(*) AS n FROM p JOIN top USING (target) GROUP BY doc_id, target""",
    "corpus",
)
def joi12_pattern_matches(spark, d):
    """Targets with a comma inside."""
    c = corpus(spark, d)
    top = c.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+, [a-z]+"), F.lit(0))).alias("target")).where("split_part(target, ', ', 1) <> split_part(target, ', ', 2)").groupBy("target").count().orderBy(F.desc("count"), "target").limit(5).select("target")
    return C.pattern_matches(c, top).groupBy("doc_id", "target").agg(F.count("*").alias("n"))


@query(f", {_HITS} SELECT h.doc_id, h.sent_id, h.start, h.target, length(s.sentence) AS sentence_chars FROM hits h JOIN sentences s ON h.doc_id = s.doc_id AND h.sent_id = s.sent_id AND h.start BETWEEN 0 AND length(s.sentence)", "corpus", "targets", "sentences", "words")
def joi15_match_in_sentence(spark, d):
    """Matches are found inside their sentence's row, so an equi join takes the place of a range join."""
    sents = _sents(spark, d)
    found = C.exact_matches(sents, targets(spark, d), longest=1)
    return found.join(sents, ["doc_id", "sent_id"]).select("doc_id", "sent_id", "start", "target", F.length("sentence").alias("sentence_chars"))


_STEM = r"regexp_replace({0}, '^([a-z]{{3,}}?)(ments|ment|ings|ing|edly|ed|es|ly|s)$', '\1')"


@query(
    f""", stems AS (SELECT target, {_STEM.format("target")} AS stem FROM targets),
vocabulary AS (SELECT DISTINCT lower(token) AS w FROM words WHERE length(token) >= 4),
near AS (SELECT v.w, s.target FROM vocabulary v JOIN stems s ON substring(v.w, 1, 4) = substring(s.target, 1, 4) WHERE v.w <> s.target AND abs(length(v.w) - length(s.target)) <= 4 AND {_STEM.format("v.w")} <> s.stem AND 100.0 - 100.0 * levenshtein(v.w, s.target) / greatest(length(v.w), length(s.target)) >= 70),
u AS (SELECT w.doc_id, w.sent_id, w.start, s.target, 0 AS kind FROM words w JOIN stems s ON {_STEM.format("lower(w.token)")} = s.stem WHERE length(w.token) >= 3 UNION ALL SELECT w.doc_id, w.sent_id, w.start, n.target, 1 FROM words w JOIN near n ON lower(w.token) = n.w)
SELECT doc_id, sent_id, start, target, kind FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target ORDER BY kind, sent_id, start) AS k FROM u) WHERE k <= 8""",
    "corpus", "targets", "sentences", "words",
)
def win8_variant_cap(spark, d):
    likeness = lambda a, b: 100.0 - 100.0 * F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    found = C.variant_matches(_sents(spark, d), targets(spark, d), stem=lambda w: T.suffix_stem(F.col(w)), ratio=likeness, cutoff=70.0)
    return M.cap(found, ["doc_id", "target"], ["kind", "sent_id", "start"], 8).select("doc_id", "sent_id", "start", "target", "kind")
