"""Queries over text: cleaning, normalising, splitting (projections and scalar functions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.operators import text as X
from lexmine.plans.base import ROLES, SQL, corpus, query, table

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM corpus)"


def _lines(spark, d):
    return corpus(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


@query("SELECT doc_id, text, source FROM documents WHERE lang = 'de' ORDER BY doc_id")
def src1_scan(spark, d):
    return table(spark, d, "documents").where("lang = 'de'").select("doc_id", "text", "source").orderBy("doc_id")


@query(f", {_LINES} SELECT doc_id, n, regexp_matches(line, '^([\\p{{L}}\\p{{N}}_]+([''’-][\\p{{L}}\\p{{N}}_]+)*)(\\s+[\\p{{L}}\\p{{N}}_]+([''’-][\\p{{L}}\\p{{N}}_]+)*){{0,3}}$') AND length(line) <= 100 AS selectable FROM lines", "corpus")
def fil2_selectable(spark, d):
    return _lines(spark, d).select("doc_id", "n", T.is_selectable(F.col("line")).alias("selectable"))


@query(
    r"""SELECT doc_id, sent_id, length(s) >= 45 AND NOT suffix(s, ' .') AND NOT contains(s, '|') AND NOT regexp_matches(s, '^(…\s*)?[0-9]+\s+[0-9]+(\.[0-9]+)+\s+') AND n < 8 AND p < 3 AND NOT (starts_with(s, '…') AND n >= 4) AND length(regexp_replace(s, '[^\p{S}]', '', 'g')) < 5 AS readable
FROM (SELECT doc_id, sent_id, s, len(ns) AS n, len(list_filter(ns, lambda x: suffix(x, '%'))) AS p FROM (SELECT doc_id, sent_id, sentence AS s, regexp_extract_all(regexp_replace(sentence, '([A-Za-z])[0-9]', '\1', 'g'), '[0-9]+(?:\.[0-9]+)?%?') AS ns FROM sentences))""",
    "corpus", "sentences",
)
def fil3_readable(spark, d):
    return X.sentences(corpus(spark, d)).select("doc_id", "sent_id", T.is_readable(F.col("sentence")).alias("readable"))


@query(f", {_LINES}, t AS (SELECT doc_id, n, trim(line) AS line FROM lines) SELECT doc_id, n, line FROM t WHERE line <> '' AND NOT regexp_matches(line, '^[0-9]{{1,3}}$') AND NOT regexp_matches(line, '(?i)^[0-9]*\\s*(https?://|www\\.)\\S+$') AND NOT (length(line) <= 120 AND regexp_matches(line, '^([0-9]+(\\.[0-9]+)*\\.?|[A-Z]\\.?)\\s+[A-Z][A-Za-z0-9 :,\\-/()]+$'))", "corpus")
def fil4_prose_lines(spark, d):
    line = F.trim("line")
    return _lines(spark, d).withColumn("line", line).where((F.col("line") != "") & ~F.col("line").rlike("^[0-9]{1,3}$") & ~F.col("line").rlike("(?i)^[0-9]*\\s*(https?://|www\\.)\\S+$") & ~T.is_heading(F.col("line"))).select("doc_id", "n", "line")


@query(r"SELECT doc_id, sent_id FROM sentences WHERE NOT regexp_matches(sentence, 'Figure\s+[0-9]+\s*[|:]')", "corpus", "sentences")
def fil6_no_captions(spark, d):
    return X.sentences(corpus(spark, d)).where(~F.col("sentence").rlike("Figure\\s+[0-9]+\\s*[|:]")).select("doc_id", "sent_id")


@query(f"SELECT doc_id, sent_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(replace(lower(sentence), 'ß', 'ss'), '[a-z]+'), lambda w: length(w) >= 3 AND NOT list_contains({T.STOPWORDS}, w)))), ' ') AS content FROM sentences", "corpus", "sentences")
def fil19_content_words(spark, d):
    return X.sentences(corpus(spark, d)).select("doc_id", "sent_id", F.array_join(T.content_words(F.col("sentence")), " ").alias("content"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '-\s*\r?\n\s*', '', 'g'), '[’‘ʼ]', chr(39), 'g'), '[\p{Pd}−]', '-', 'g'), '[^\p{L}\p{M}\p{N}''\-]', ' ', 'g')), 'ß', 'ss'), '\s+', ' ', 'g')), '-{2,}', '-', 'g'), '''{2,}', chr(39), 'g'), '^[ \-'']+|[ \-'']+$', '', 'g') AS target FROM documents"""
)
def fun1_normalize_selection(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_selection(F.col("text")).alias("target"))


@query(SQL["fun1_normalize_selection"])
def fun1_compatibility(spark, d):
    """Every third text with full-width letters, ligatures and wide spaces, every third one decomposed to letter and accent: normalising gives what the plain text gives."""
    wide = F.translate(F.regexp_replace(F.regexp_replace("text", "fi", "ﬁ"), "st", "ﬆ"), "aeT ", "ａｅＴ　")
    parted = F.regexp_replace(F.regexp_replace("text", "é", "é"), "ü", "ü")
    odd = F.when(F.col("doc_id") % 3 == 0, wide).when(F.col("doc_id") % 3 == 1, parted).otherwise(F.col("text"))
    return X.normalize_selections(table(spark, d, "documents").select("doc_id", odd.alias("target")), "target")


@query("SELECT p_partkey, p_name || ' é — ' || p_brand || ' <&> ' || p_type AS text FROM part")
def fun9_entities(spark, d):
    """Entities by name, by number and in hexadecimal, in every second row only the usual ones."""
    rare = F.concat("p_name", F.lit(" &eacute; &#8212; "), "p_brand", F.lit(" &lt;&amp;&#x3e; "), "p_type")
    usual = F.concat("p_name", F.lit(" é — "), "p_brand", F.lit(" &lt;&amp;&gt; "), "p_type")
    return X.unescape_texts(table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, rare).otherwise(usual).alias("text")), "text")


@query(r"SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS key FROM documents")
def fun2_target_key(spark, d):
    return table(spark, d, "documents").select("doc_id", T.target_key(F.col("text")).alias("key"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+([,;:.!?%)\]}])', '\1', 'g'), '([(\[{])\s+', '\1', 'g'), '\s+([''’])s\b', '\1s', 'g'), '\s+', ' ', 'g')) AS repaired FROM corpus", "corpus")
def fun3_repair_spacing(spark, d):
    return corpus(spark, d).select("doc_id", T.repair_spacing(F.col("text")).alias("repaired"))


@query("SELECT doc_id, sent_id, sentence FROM sentences", "corpus", "sentences")
def fun4_sentences(spark, d):
    return X.sentences(corpus(spark, d))


@query(
    rf"""SELECT doc_id, p, regexp_matches(core, '[.!?]$') AND NOT list_contains({T.ABBREVIATIONS}, lower(core)) AND NOT regexp_matches(core, '^[0-9]+\.[0-9]+$') AS ends FROM (SELECT doc_id, p, regexp_replace(trim(w), '["''”’)\]}}]+$', '') AS core FROM (SELECT doc_id, unnest(string_split(s, ' ')) AS w, generate_subscripts(string_split(s, ' '), 1) - 1 AS p FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM corpus)))""",
    "corpus",
)
def fun5_sentence_end(spark, d):
    return corpus(spark, d).select("doc_id", F.posexplode(F.split(T.squeeze(F.col("text")), " ")).alias("p", "w")).select("doc_id", "p", T.is_sentence_end(F.col("w")).alias("ends"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '([a-z])- *\n *([a-z])', '\1\2', 'g'), '\s+', ' ', 'g')) AS joined FROM corpus", "corpus")
def fun6_dehyphenate(spark, d):
    return corpus(spark, d).select("doc_id", T.dehyphenate(F.col("text")).alias("joined"))


@query(
    r"""SELECT doc_id, p, regexp_extract(w, '^(["''“‘(\[{]*)(.*?)(["''”’)\]},;:.!?]*)$', 1) AS prefix, regexp_extract(w, '^(["''“‘(\[{]*)(.*?)(["''”’)\]},;:.!?]*)$', 2) AS core, regexp_extract(w, '^(["''“‘(\[{]*)(.*?)(["''”’)\]},;:.!?]*)$', 3) AS suffix
FROM (SELECT doc_id, unnest(string_split(s, ' ')) AS w, generate_subscripts(string_split(s, ' '), 1) - 1 AS p FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM corpus))""",
    "corpus",
)
def fun10_outer_punctuation(spark, d):
    words = corpus(spark, d).select("doc_id", F.posexplode(F.split(T.squeeze(F.col("text")), " ")).alias("p", "w"))
    return words.select("doc_id", "p", T.split_outer_punctuation(F.col("w")).alias("s")).select("doc_id", "p", "s.*")


@query(r"SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), ' '), '- ([a-z])', '\1', 'g') AS joined FROM corpus", "corpus")
def fun11_join_words(spark, d):
    return corpus(spark, d).select("doc_id", T.join_words(F.filter(F.split("text", "\\s+"), lambda x: x != "")).alias("joined"))


@query(f", {_LINES} SELECT doc_id, n, length(line) <= 120 AND regexp_matches(line, '^([0-9]+(\\.[0-9]+)*\\.?|[A-Z]\\.?)\\s+[A-Z][A-Za-z0-9 :,\\-/()]+$') AS heading FROM lines", "corpus")
def fun12_heading(spark, d):
    return _lines(spark, d).select("doc_id", "n", T.is_heading(F.col("line")).alias("heading"))


@query("SELECT doc_id, CASE WHEN t = '' THEN 'article' ELSE t END AS tag FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z0-9_:-]+', '_', 'g'), '^_+|_+$', '', 'g') AS t FROM documents)")
def fun22_safe_tag(spark, d):
    return table(spark, d, "documents").select("doc_id", T.safe_tag(F.col("text")).alias("tag"))


@query(r"SELECT event_id, CAST(json_extract(regexp_extract(f, '(?s)^```[A-Za-z]*\s*(.*?)\s*```$', 1), '$.k') AS BIGINT) AS k FROM (SELECT event_id, '```json' || chr(10) || props || chr(10) || '```' AS f FROM events)")
def fun23_code_fence(spark, d):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.get_json_object(T.strip_code_fence(fenced), "$.k").cast("bigint").alias("k"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS letters FROM documents")
def fun24_letters_only(spark, d):
    return table(spark, d, "documents").select("doc_id", T.letters_only(F.col("text")).alias("letters"))


@query("SELECT doc_id, len(string_split(text, ' ')) AS parts, string_split(text, ' ')[1] AS first, string_split(text, ' ')[-1] AS last FROM documents")
def fun35_split_fields(spark, d):
    parts = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.size(parts).cast("long").alias("parts"), F.element_at(parts, 1).alias("first"), F.element_at(parts, -1).alias("last"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def fun36_tolerant_json(spark, d):
    broken = F.when(F.col("event_id") % 5 == 0, F.substr("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.from_json(broken, "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


_DOCS = r""", pg AS (SELECT doc_id // 20 AS doc_id, doc_id AS page_no, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, doc_id % 3 = 0 AS hard FROM corpus),
run AS (SELECT *, row_number() OVER o AS page, sum(length(t)) OVER o + greatest(count(*) FILTER (t <> '') OVER o - 1, 0) AS b FROM pg WINDOW o AS (PARTITION BY doc_id ORDER BY page_no)),
whole AS (SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY page_no) FILTER (t <> ''), '') AS text FROM pg GROUP BY doc_id),
"""


@query(
    _DOCS + ROLES["sentences"].replace("FROM corpus", "FROM whole") + r""", placed AS (SELECT doc_id, n AS k, part, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY n) - length(part) AS off_ FROM parts),
spans AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sent_id, off_ + length(part) - length(ltrim(part)) AS s, off_ + length(rtrim(part)) AS e FROM placed WHERE trim(part) <> ''),
said AS (SELECT spans.doc_id, sent_id, page, CAST(CASE WHEN hard THEN greatest(s, b - length(t)) ELSE s END AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM spans JOIN run ON spans.doc_id = run.doc_id AND t <> '' AND b - length(t) < e AND b > s),
cut AS (SELECT said.*, text, length(regexp_extract(substring(text, s + 1, e - s), '^[a-z]\.,\s+')) AS dangling FROM said JOIN whole USING (doc_id))
SELECT doc_id, CAST(sent_id AS INTEGER) AS sent_id, CAST(page AS INTEGER) AS page, CAST(s + dangling AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", substring(text, s + dangling + 1, e - s - dangling) AS sentence FROM cut""",
    "corpus",
)
def pip2_sentence_report(spark, d):
    """Twenty documents are the pages of one; every third begins hard."""
    pages = corpus(spark, d).select(F.expr("doc_id div 20").alias("doc_id"), F.col("doc_id").alias("page_no"), T.squeeze(F.col("text")).alias("t"), (F.col("doc_id") % 3 == 0).alias("h"))
    return X.page_sentences(X.joined_pages(pages))


@query(
    r""", pages_ AS (SELECT doc_id // 20 AS doc, doc_id AS page_no, trim(regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]{1,3}$') AND NOT regexp_matches(x, '(?i)^[0-9]*\s*(https?://|www\.)\S+$') AND NOT (length(x) <= 120 AND regexp_matches(x, '^([0-9]+(\.[0-9]+)*\.?|[A-Z]\.?)\s+[A-Z][A-Za-z0-9 :,\-/()]+$'))), chr(10)), '([a-z])- *\n *([a-z])', '\1\2', 'g'), '\s+', ' ', 'g')) AS t FROM corpus)
SELECT doc AS doc_id, count(*) AS pages, sha256(coalesce(string_agg(t, ' ' ORDER BY page_no) FILTER (t <> ''), '')) AS text_sha, sum(length(t)) + greatest(count(*) FILTER (t <> '') - 1, 0) AS last_end FROM pages_ GROUP BY doc""",
    "corpus",
)
def pip1_clean_documents(spark, d):
    pages = corpus(spark, d).select(F.expr("doc_id div 20").alias("doc_id"), F.col("doc_id").alias("page_no"), F.col("text").alias("raw_text"))
    out = X.clean_documents(pages)
    return out.select("doc_id", F.size("page_ranges").cast("long").alias("pages"), F.sha2("text", 256).alias("text_sha"), F.element_at("page_ranges", -1)["end"].cast("long").alias("last_end"))


@query(
    _DOCS.rstrip().rstrip(",") + r""", q AS (SELECT doc_id, unnest([0, 1000, 5000, 20000, 10000000]) AS position FROM whole)
SELECT q.doc_id, q.position, coalesce(min(CASE WHEN q.position BETWEEN b - length(t) AND b THEN page END), max(page)) AS page FROM q JOIN run USING (doc_id) GROUP BY q.doc_id, q.position""",
    "corpus",
)
def joi16_page_of_position(spark, d):
    pages = corpus(spark, d).select(F.expr("doc_id div 20").alias("doc_id"), F.col("doc_id").alias("page_no"), T.squeeze(F.col("text")).alias("t"), F.lit(False).alias("h"))
    asked = X.joined_pages(pages).select("doc_id", "page_ranges", F.explode(F.array(*map(F.lit, [0, 1000, 5000, 20000, 10000000]))).alias("position"))
    return asked.select("doc_id", "position", X.page_of(F.col("position"), F.col("page_ranges")).cast("long").alias("page"))
