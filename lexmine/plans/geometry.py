"""Queries over word boxes, regions and rectangles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.operators import geometry as G
from lexmine.plans.base import corpus, query, rects, table, targets

_BOXES = """, boxes AS (SELECT doc_id, p - 1 AS word_id, w AS word, (p - 1) // 300 AS page, (p - 1) // 12 AS line, CAST((p - 1) % 12 * 45 AS DOUBLE) AS x1, CAST(50 + (p - 1) // 12 % 25 * 14 AS DOUBLE) AS y1, CAST((p - 1) % 12 * 45 + 5 * length(w) AS DOUBLE) AS x2, CAST(61 + (p - 1) // 12 % 25 * 14 AS DOUBLE) AS y2
FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM corpus)))"""
_CHOSEN = _BOXES + ", marked AS (SELECT *, regexp_replace(lower(word), '[^a-z]', '', 'g') IN (SELECT target FROM targets) OR length(word) >= 12 AS selected FROM boxes)"
_ENDS = f"(regexp_matches(regexp_replace(trim({{0}}), '[\"''”’)\\]}}}}]+$', ''), '[.!?]$') AND NOT list_contains({T.ABBREVIATIONS}, lower(regexp_replace(trim({{0}}), '[\"''”’)\\]}}}}]+$', ''))) AND NOT regexp_matches(regexp_replace(trim({{0}}), '[\"''”’)\\]}}}}]+$', ''), '^[0-9]+\\.[0-9]+$'))"
_CORE = "regexp_extract({0}, '^([\"''“‘(\\[{{]*)(.*?)([\"''”’)\\]}},;:.!?]*)$', 2)"
_GROUPED = f""", counted AS (SELECT *, CASE WHEN regexp_matches(word, '[A-Za-z0-9]') THEN 1 ELSE 0 END AS own, sum(CASE WHEN regexp_matches(word, '[A-Za-z0-9]') THEN 1 ELSE 0 END) OVER o AS plain, row_number() OVER o AS place FROM marked WINDOW o AS (PARTITION BY doc_id, page ORDER BY word_id)),
lagged AS (SELECT *, place - lag(place) OVER o - 1 AS skipped, plain - own = lag(plain) OVER o AS no_plain, y1 - lag(y1) OVER o AS down, greatest(y2 - y1, lag(y2 - y1) OVER o) AS height, x1 - lag(x2) OVER o AS room, x1 < lag(x1) OVER o AS left_of, lag(word) OVER o AS before FROM counted WHERE selected WINDOW o AS (PARTITION BY doc_id, page ORDER BY word_id)),
flagged AS (SELECT *, CASE WHEN (skipped = 0 OR (skipped BETWEEN 1 AND 2 AND no_plain)) AND ((abs(down) <= greatest(2, 0.25 * height) AND (room <= 8 OR (skipped BETWEEN 1 AND 2 AND no_plain AND room <= 60))) OR (down > 2 AND down <= 1.6 * height AND left_of AND NOT {_ENDS.format("before")}) OR (suffix(before, '-') AND down > 2)) THEN 0 ELSE 1 END AS starts FROM lagged),
islands AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY doc_id, page ORDER BY word_id) AS BIGINT) AS group_id FROM flagged),
groups AS (SELECT * FROM islands QUALIFY NOT (row_number() OVER (PARTITION BY doc_id, page, group_id ORDER BY word_id) = 1 AND count(*) OVER (PARTITION BY doc_id, page, group_id) >= 3 AND lower({_CORE.format("word")}) IN ('and', 'but', 'or')))"""
_GROUPS = _CHOSEN + _GROUPED
_PAIR = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"

#: Characters of text whose words a task lays out and sorts at once.
CHARS = 4_000_000


def _boxes(spark, d):
    return G.word_boxes(corpus(spark, d))


def _chosen(spark, d):
    """Boxes of targets and of long words are selected; the targets are 20 at most, so a literal list."""
    words = [r["target"] for r in targets(spark, d).collect()]
    return _boxes(spark, d).withColumn("selected", T.letters_only(F.col("word")).isin(words) | (F.length("word") >= 12))


@query(_BOXES + " SELECT doc_id, word_id, word, page FROM boxes WHERE y1 >= 60 AND y2 <= 380 AND trim(word) <> ''", "corpus")
def fil5_inside_margins(spark, d):
    return _boxes(spark, d).where("y1 >= 60 AND y2 <= 380 AND trim(word) <> ''").select("doc_id", "word_id", "word", "page")


@query(
    _BOXES + ", c AS (SELECT *, (word_id * 7 % 100) / 100.0 AS coverage, (word_id * 3 % 40) / 100.0 AS spill, (word_id * 11 % 90) / 100.0 AS overlap FROM boxes) SELECT doc_id, word_id, regexp_matches(word, '\\p{L}') AND ((y2 - y1 >= 8 AND ((coverage >= 0.60 AND spill < 0.30) OR (coverage >= 0.32 AND spill <= 0.22))) OR overlap >= 0.45) AS selected FROM c",
    "corpus",
)
def fil7_selected_words(spark, d):
    k = F.col("word_id")
    return _boxes(spark, d).select("doc_id", "word_id", G.selected(F.col("word"), F.col("y2") - F.col("y1"), k * 7 % 100 / 100.0, k * 3 % 40 / 100.0, k * 11 % 90 / 100.0).alias("selected"))


@query("SELECT highlight_id, x2 > x1 AND y2 > y1 AND abs(x1) <= 100000 AND abs(x2) <= 100000 AND highlight_id % 13 <> 0 AND highlight_id % 17 <> 0 AS ok FROM (SELECT highlight_id, CASE WHEN highlight_id % 11 = 0 THEN x1 * 1000 ELSE x1 END AS x1, y1, CASE WHEN highlight_id % 7 = 0 THEN x1 WHEN highlight_id % 11 = 0 THEN x1 * 1000 + 1 ELSE x2 END AS x2, y2 FROM rects)", "rects")
def fil8_valid_rects(spark, d):
    """Every seventh rectangle is made empty, every eleventh moved far to the right; every 13th highlight has 17 of them, every 17th one without a number, every 19th 16."""
    far = F.col("highlight_id") % 11 == 0
    x2 = F.when(F.col("highlight_id") % 7 == 0, F.col("x1")).when(far, F.col("x1") * 1000 + 1).otherwise(F.col("x2"))
    x1 = F.when(far, F.col("x1") * 1000).otherwise(F.col("x1"))
    x1 = F.when(F.col("highlight_id") % 17 == 0, float("nan")).otherwise(x1)
    times = F.when(F.col("highlight_id") % 13 == 0, 17).when(F.col("highlight_id") % 19 == 0, 16).otherwise(1)
    return rects(spark, d).select("highlight_id", G.valid_rects(F.array_repeat(F.struct(x1.alias("x1"), "y1", x2.alias("x2"), "y2"), times)).alias("ok"))


@query("SELECT highlight_id, document_id, page, target, source, x1 || ',' || y1 || ',' || x2 || ',' || y2 AS rect FROM rects", "rects")
def fil18_highlight_projection(spark, d):
    return rects(spark, d).select("highlight_id", "document_id", "page", "target", "source", F.concat_ws(",", "x1", "y1", "x2", "y2").alias("rect"))


@query("SELECT highlight_id, page || ':' || target || ':' || x1 || ',' || y1 || ',' || x2 || ',' || y2 AS signature FROM rects", "rects")
def fun37_signature(spark, d):
    return rects(spark, d).select("highlight_id", G.signature(F.col("page"), F.col("target"), F.array(F.struct("x1", "y1", "x2", "y2"))).alias("signature"))


@query("SELECT highlight_id, x1 - 5 AS x0, 1000 - (y2 - 3) AS top, x2 - 5 AS x1, 1000 - (y1 - 3) AS bottom FROM rects", "rects")
def fun28_quad_box(spark, d):
    quad = F.array("x1", "y2", "x2", "y2", "x1", "y1", "x2", "y1")
    return rects(spark, d).select("highlight_id", G.quad_box(quad, F.lit(5.0), F.lit(3.0), F.lit(1000.0)).alias("b")).select("highlight_id", "b.*")


@query(f"SELECT a.highlight_id AS id, b.highlight_id AS other, {_PAIR} AS shared FROM rects a JOIN rects b ON a.document_id = b.document_id AND a.page = b.page AND a.target = b.target AND a.source = 'reader' AND b.source <> 'reader' WHERE {_PAIR} > 0", "rects")
def fun27_intersections(spark, d):
    return G.shared_areas(_highlights(spark, d, "reader"), rects(spark, d).where("source <> 'reader'").withColumnRenamed("highlight_id", "id"), ["document_id", "page", "target"])


def _highlights(spark, d, source):
    return rects(spark, d).where(f"source = '{source}'").withColumnRenamed("highlight_id", "id")


_SIZE = "(SELECT highlight_id, sum((x2 - x1) * (y2 - y1)) AS size FROM rects WHERE source = '{}' GROUP BY highlight_id)"
_OVER = f"""both_ AS (SELECT a.highlight_id AS id, b.highlight_id AS other, sum({_PAIR}) AS shared FROM rects a JOIN rects b ON a.document_id = b.document_id AND a.page = b.page AND a.target = b.target AND a.source = 'pdf_import' AND b.source = 'reader' AND a.highlight_id <> b.highlight_id WHERE {_PAIR} > 0 GROUP BY 1, 2),
over_ AS (SELECT id, other FROM both_ JOIN {_SIZE.format("pdf_import")} s ON s.highlight_id = id JOIN {_SIZE.format("reader")} t ON t.highlight_id = other WHERE shared / least(s.size, t.size) >= 0.6)"""


@query(f", {_OVER} SELECT id, other FROM over_", "rects")
def joi9_overlapping_highlights(spark, d):
    return G.overlapping(_highlights(spark, d, "pdf_import"), _highlights(spark, d, "reader"), ["document_id", "page", "target"])


@query(f", {_OVER}, dead AS (SELECT highlight_id AS id FROM rects WHERE document_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT highlight_id AS id, document_id, page FROM rects WHERE source = 'pdf_import' AND highlight_id NOT IN (SELECT id FROM dead) AND highlight_id NOT IN (SELECT id FROM over_)", "rects")
def pip7_import_highlights(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    dead = _highlights(spark, d, "pdf_import").join(toxic, "document_id", "left_semi")
    return G.import_highlights(_highlights(spark, d, "pdf_import"), _highlights(spark, d, "reader"), dead).select("id", "document_id", "page")


@query("SELECT highlight_id AS id FROM rects WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "rects")
def joi7_not_deleted(spark, d):
    return rects(spark, d).join(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id")), "document_id", "left_anti").select(F.col("highlight_id").alias("id"))


_REGIONS = ", regions AS (SELECT doc_id, page, x1 + 10 AS x1, y1 + 2 AS y1, x2 + 40 AS x2, y2 + 8 AS y2 FROM boxes WHERE word_id % 17 = 3)"


def _regions(boxes):
    """An annotation about every seventeenth word, moved to the right and made wider."""
    return boxes.where("word_id % 17 = 3").select("doc_id", "page", (F.col("x1") + 10).alias("x1"), (F.col("y1") + 2).alias("y1"), (F.col("x2") + 40).alias("x2"), (F.col("y2") + 8).alias("y2"))


@query(_BOXES + _REGIONS + f" SELECT a.doc_id, a.word_id, coalesce(max(CASE WHEN b.doc_id IS NOT NULL THEN {_PAIR} / ((a.x2 - a.x1) * (a.y2 - a.y1)) END), 0) AS overlap FROM boxes a LEFT JOIN regions b ON a.doc_id = b.doc_id AND a.page = b.page AND a.y1 < b.y2 AND b.y1 < a.y2 AND a.x1 < b.x2 AND b.x1 < a.x2 GROUP BY a.doc_id, a.word_id", "corpus")
def joi10_region_overlap(spark, d):
    boxes = _boxes(spark, d)
    return G.region_overlap(boxes, _regions(boxes)).select("doc_id", "word_id", "overlap")


@query(_GROUPS + " SELECT doc_id, page, word_id, word, group_id FROM groups", "corpus", "targets")
def win2_phrase_groups(spark, d):
    return G.phrase_groups(_chosen(spark, d)).select("doc_id", "page", "word_id", "word", "group_id")


_LINES = ", lined AS (SELECT *, CAST(sum(m) OVER (PARTITION BY doc_id, page, group_id ORDER BY word_id) AS BIGINT) AS line_id FROM (SELECT *, CASE WHEN abs(y1 - lag(y1) OVER (PARTITION BY doc_id, page, group_id ORDER BY word_id)) > greatest(2, 0.25 * (y2 - y1)) THEN 1 ELSE 0 END AS m FROM groups))"


@query(_GROUPS + _LINES + " SELECT doc_id, page, word_id, group_id, line_id FROM lined", "corpus", "targets")
def win3_line_groups(spark, d):
    return G.line_groups(G.phrase_groups(_chosen(spark, d))).select("doc_id", "page", "word_id", "group_id", "line_id")


@query(_GROUPS + _LINES + " SELECT doc_id, page, group_id, line_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_words FROM lined GROUP BY doc_id, page, group_id, line_id", "corpus", "targets")
def agg9_group_boxes(spark, d):
    return G.group_boxes(G.phrase_groups(_chosen(spark, d)))


@query(
    _BOXES + _REGIONS + f""", margins AS (SELECT *, (word_id * 7 % 100) / 100.0 AS coverage, (word_id * 3 % 40) / 100.0 AS spill FROM boxes WHERE y1 >= 60 AND y2 <= 380 AND trim(word) <> ''),
over_ AS (SELECT a.doc_id, a.word_id, max({_PAIR} / ((a.x2 - a.x1) * (a.y2 - a.y1))) AS overlap FROM margins a JOIN regions b ON a.doc_id = b.doc_id AND a.page = b.page AND a.y1 < b.y2 AND b.y1 < a.y2 AND a.x1 < b.x2 AND b.x1 < a.x2 GROUP BY a.doc_id, a.word_id),
marked AS (SELECT m.*, regexp_matches(word, '\\p{{L}}') AND ((y2 - y1 >= 8 AND ((coverage >= 0.60 AND spill < 0.30) OR (coverage >= 0.32 AND spill <= 0.22))) OR coalesce(overlap, 0) >= 0.45) AS selected,
  coalesce(y1 - lag(y1) OVER p > 1.8 * greatest(y2 - y1, 1) OR y1 - lag(y1) OVER p < -1, false) AS break_before FROM margins m LEFT JOIN over_ USING (doc_id, word_id) WINDOW p AS (PARTITION BY doc_id, page ORDER BY word_id))"""
    + _GROUPED + _LINES + f""", boxed AS (SELECT doc_id, page, group_id, line_id, min(x1) || ',' || min(y1) || ',' || max(x2) || ',' || max(y2) AS box FROM lined GROUP BY doc_id, page, group_id, line_id),
rects AS (SELECT doc_id, page, group_id, string_agg(box, ';' ORDER BY line_id) AS rects FROM boxed GROUP BY doc_id, page, group_id),
phrase AS (SELECT doc_id, page, group_id, regexp_replace(string_agg(word, ' ' ORDER BY word_id), '- ([a-z])', '\\1', 'g') AS joined, min(word_id) AS first, max(word_id) AS last FROM groups GROUP BY doc_id, page, group_id),
named AS (SELECT *, {_CORE.format("joined")} AS target FROM phrase WHERE {_CORE.format("joined")} <> ''),
counted_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, replace(lower(target), 'ß', 'ss') ORDER BY first) - 1 AS occurrence FROM named),
ended AS (SELECT doc_id, word_id, word, CASE WHEN {_ENDS.format("word")} OR coalesce(lead(break_before) OVER (PARTITION BY doc_id ORDER BY word_id), false) THEN 1 ELSE 0 END AS e FROM marked),
said AS (SELECT doc_id, word_id, word, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM ended),
context AS (SELECT c.doc_id, c.page, c.group_id, regexp_replace(string_agg(s.word, ' ' ORDER BY s.word_id), '- ([a-z])', '\\1', 'g') AS sentence FROM counted_ c JOIN said a ON a.doc_id = c.doc_id AND a.word_id = c.first JOIN said z ON z.doc_id = c.doc_id AND z.word_id = c.last JOIN said s ON s.doc_id = c.doc_id AND s.sid BETWEEN a.sid AND z.sid GROUP BY c.doc_id, c.page, c.group_id)
SELECT doc_id, page, group_id, target, CAST(occurrence AS INTEGER) AS occurrence, sentence, rects FROM counted_ JOIN context USING (doc_id, page, group_id) JOIN rects USING (doc_id, page, group_id)""",
    "corpus",
)
def pip6_extract_highlights(spark, d):
    """Documents are dealt before their words are boxed, as a word's row takes many times its text."""
    k = F.col("word_id")
    docs = corpus(spark, d)
    held = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // CHARS))
    words = G.word_boxes(docs.repartition(n, "doc_id")).withColumns({"coverage": k * 7 % 100 / 100.0, "spill": k * 3 % 40 / 100.0})
    found = G.extract_highlights(words, _regions(words), 60.0, 380.0, dealt=True)
    return found.withColumn("rects", F.array_join(F.transform("rects", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("x1", "y1", "x2", "y2")])), ";"))


@query(_BOXES + " SELECT doc_id, word_id, coalesce(y1 - lag(y1) OVER o > 1.8 * greatest(y2 - y1, 1) OR y1 - lag(y1) OVER o < -1, false) AS break_before FROM boxes WINDOW o AS (PARTITION BY doc_id, page ORDER BY word_id)", "corpus")
def win4_paragraph_breaks(spark, d):
    return G.paragraph_breaks(_boxes(spark, d)).select("doc_id", "word_id", "break_before")


@query(_BOXES + " SELECT doc_id, page, word_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, y1, x1) AS global_index FROM boxes", "corpus")
def win5_global_index(spark, d):
    return _boxes(spark, d).select("doc_id", "page", "word_id", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "y1", "x1")).cast("long").alias("global_index"))


@query(_BOXES + " SELECT doc_id, word_id, CAST(coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY word_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence_id FROM boxes", "corpus")
def win6_sentence_ids(spark, d):
    return G.sentence_ids(_boxes(spark, d), F.col("word").rlike("[.!?]$")).select("doc_id", "word_id", F.col("sentence_id").cast("long").alias("sentence_id"))


@query(
    ", h AS (SELECT doc_id, text, length(text) // 3 AS hint, 'th' AS target FROM corpus WHERE contains(text, 'th')), o AS (SELECT doc_id, hint, unnest(list_filter(range(1, length(text)), lambda i: substring(text, i, 2) = 'th')) AS p FROM h) SELECT doc_id, min_by(p, abs(p - hint) * 1000000 + p) AS nearest FROM o GROUP BY doc_id",
    "corpus",
)
def win19_nearest_occurrence(spark, d):
    near = T.nearest_occurrence(F.col("text"), F.lit("th"), F.floor(F.length("text") / 3))
    return corpus(spark, d).select("doc_id", near.cast("long").alias("nearest")).where("nearest IS NOT NULL")
