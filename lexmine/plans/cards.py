"""Queries over cards, notes and schedules."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.operators import enrich as E
from lexmine.operators import migrate as R
from lexmine.operators import notes as N
from lexmine.plans.base import cards, dealt, notes, query, table
from lexmine.sources.shared import shared_folder


@query("SELECT card_id, user_id, created_at FROM cards WHERE exported_at IS NULL ORDER BY created_at, card_id", "cards")
def fil1_pending(spark, d):
    return cards(spark, d).where("exported_at IS NULL").select("card_id", "user_id", "created_at").orderBy("created_at", "card_id")


@query("SELECT p_partkey, CASE WHEN len(string_split(p_name, ' ')) <= least(8, greatest(5, 2 * len(string_split(p_brand, ' ')) + 1)) AND NOT regexp_matches(p_name, '[.!?;:]') THEN p_name ELSE p_type END AS replacement FROM part")
def fil12_compact_phrase(spark, d):
    return table(spark, d, "part").select("p_partkey", N.compact_replacement(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("replacement"))


@query("SELECT p_partkey, lower(p_name) = lower(p_type) OR lower(p_name) = lower(p_brand) OR list_contains(list_transform(string_split(p_name, ' '), lambda x: lower(x)), lower(p_brand)) AS repeats FROM part")
def fil13_distractor_repeats(spark, d):
    values = F.concat(F.array("p_name", "p_type"), F.array("p_name", "p_brand"))
    same = (T.target_key(F.col("p_name")) == T.target_key(F.col("p_type"))) | (T.target_key(F.col("p_name")) == T.target_key(F.col("p_brand")))
    return table(spark, d, "part").where(F.size(values) > 0).select("p_partkey", (same | F.exists(F.split("p_name", " "), lambda x: T.target_key(x) == T.target_key(F.col("p_brand")))).alias("repeats"))


@query("SELECT note_id, CASE WHEN contains(tags, 'direction::meaning') THEN 'meaning' ELSE 'recall' END AS direction, CAST(regexp_extract(tags, 'card::([0-9]+)', 1) AS BIGINT) AS card FROM notes", "notes")
def fil14_tag_keys(spark, d):
    return notes(spark, d).select("note_id", N.direction_of(F.col("tags")).alias("direction"), N.tag_value(F.col("tags"), "card::").cast("bigint").alias("card"))


@query("SELECT note_id, array_to_string(list_filter(string_split(tags, ' '), lambda t: NOT starts_with(t, 'card::') AND NOT starts_with(t, 'direction::')), ' ') AS kept FROM notes", "notes")
def fil15_unmanaged_tags(spark, d):
    return notes(spark, d).select("note_id", F.array_join(N.unmanaged(F.col("tags")), " ").alias("kept"))


@query("SELECT o_orderkey AS card_id, len(list_filter(ds, lambda x: x = 'meaning')) > 0 OR len(ds) = 0 AS meaning, len(list_filter(ds, lambda x: x = 'recall')) > 0 OR len(ds) = 0 AS recall FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['meaning'] WHEN 2 THEN ['recall'] ELSE ['meaning', 'recall'] END AS ds FROM orders)")
def fil9_direction(spark, d):
    k = F.col("card_id") % 4
    ds = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("meaning"))).when(k == 2, F.array(F.lit("recall"))).otherwise(F.array(F.lit("meaning"), F.lit("recall")))
    on = lambda x: (F.size(ds) == 0) | F.array_contains(ds, x)
    return cards(spark, d).select("card_id", on("meaning").alias("meaning"), on("recall").alias("recall"))


@query("SELECT card_id, count(*) AS contexts, count(*) FILTER (direction <> 'recall') AS kept FROM notes GROUP BY card_id HAVING count(*) <> count(*) FILTER (direction <> 'recall')", "notes")
def fil10_purge_sources(spark, d):
    """Contexts as arrays; recall ones stand for the source to purge; only cards that change are returned."""
    arrays = notes(spark, d).groupBy("card_id").agg(F.collect_list("direction").alias("c")).withColumn("k", F.filter("c", lambda x: x != "recall"))
    return arrays.where(F.size("c") != F.size("k")).select("card_id", F.size("c").cast("long").alias("contexts"), F.size("k").cast("long").alias("kept"))


@query("SELECT l_orderkey, replace(replace(replace(replace(replace(l_returnflag || '<b>' || l_linestatus || '</b>&\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS escaped, l_returnflag || l_linestatus || '&\"' AS stripped FROM lineitem")
def fun9_html(spark, d):
    raw = F.concat("l_returnflag", F.lit("<b>"), "l_linestatus", F.lit('</b>&"'))
    e = T.escape_html(raw)
    return table(spark, d, "lineitem").select("l_orderkey", e.alias("escaped"), T.strip_tags(T.unescape_html(e)).alias("stripped"))


@query("SELECT c_custkey, CAST(('0x' || substring(sha1(c_name), 1, 8)) AS BIGINT) AS csum FROM customer")
def fun18_checksum(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.checksum(F.col("c_name")).alias("csum"))


@query("SELECT card_id, substring(sha256(card_id || '|' || user_id || '|' || target), 1, 16) AS id FROM cards", "cards")
def fun19_stable_id(spark, d):
    return cards(spark, d).select("card_id", T.stable_id(F.col("card_id"), F.col("user_id"), F.col("target")).alias("id"))


@query("SELECT o_orderkey, sha256(concat_ws('|', 'v5', o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR))) AS key FROM orders")
def fun21_cache_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.lit("v5"), "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")), 256).alias("key"))


@query("SELECT highlight_id, substring(sha1('doc' || document_id || page || target || x1 || y1), 1, 8) AS head FROM (SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey % 1000 * 10 + l_linenumber AS highlight_id, l_orderkey // 1000 AS document_id, 1 + l_suppkey % 5 AS page, 'w' || (l_partkey % 3) AS target, CAST(l_partkey * 7 % 480 AS BIGINT) AS x1, CAST(l_suppkey * 11 % 700 AS BIGINT) AS y1 FROM lineitem)")
def fun20_name_id(spark, d):
    """The first group of a name-based id."""
    from lexmine.plans.base import rects

    name = F.concat(F.lit("doc"), "document_id", "page", "target", F.col("x1").cast("bigint"), F.col("y1").cast("bigint"))
    return rects(spark, d).select("highlight_id", F.substr(F.sha1(name), F.lit(1), F.lit(8)).alias("head"))


@query("SELECT p_partkey, CASE WHEN len(rest) > 0 THEN '<br><small>Подходит, но не целевой ответ: ' || p_brand || '<br>Близко по смыслу: ' || array_to_string(rest, ', ') || '</small>' ELSE '<br><small>Подходит, но не целевой ответ: ' || p_brand || '</small>' END AS hint FROM (SELECT p_partkey, p_brand, list_filter([p_type, upper(p_brand)], lambda v: lower(v) <> lower(p_brand)) AS rest FROM part)")
def fun33_distractor_hint(spark, d):
    return table(spark, d, "part").select("p_partkey", N.distractor_hint(F.array("p_brand"), F.array(F.col("p_type"), F.upper("p_brand"))).alias("hint"))


@query("SELECT page_id, string_agg(v, '|' ORDER BY i) AS leaves FROM (SELECT page_id, unnest(vs) AS v, generate_subscripts(vs, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<(?:p|li)>([^<>]*)</', 1) AS vs FROM pages)) GROUP BY page_id")
def fun13_leaf_values(spark, d):
    return table(spark, d, "pages").withColumn("v", F.regexp_extract_all("html", F.lit("(?i)<(?:p|li)>([^<>]*)</"), F.lit(1))).where(F.size("v") > 0).select("page_id", F.array_join("v", "|").alias("leaves"))


@query("SELECT p_partkey, CASE split_part(lower(p_type), ' ', 1) WHEN 'standard' THEN 'noun' WHEN 'small' THEN 'adjective' WHEN 'medium' THEN 'verb' ELSE split_part(lower(p_type), ' ', 1) END AS pos FROM part")
def fun14_relabel(spark, d):
    labels = spark.createDataFrame([("standard", "noun"), ("small", "adjective"), ("medium", "verb")], "raw string, pos string")  # a fixed map
    raw = table(spark, d, "part").select("p_partkey", F.split_part(F.lower("p_type"), F.lit(" "), F.lit(1)).alias("raw"))
    return raw.join(F.broadcast(labels), "raw", "left").select("p_partkey", F.coalesce("pos", "raw").alias("pos"))


@query("SELECT c_custkey, c_name AS target, 'x ' || lower(c_name) || ' y' AS rebuilt FROM customer")
def fun15_bold_span(spark, d):
    html = F.concat(F.lit("x <b>"), "c_name", F.lit("</b> y<br><small>tail</small>"))
    context = F.regexp_replace(html, "(?is)<br\\s*/?><small>.*?</small>\\s*$", "")
    return table(spark, d, "customer").select("c_custkey", F.regexp_extract(context, "(?is)<b\\b[^>]*>(.*?)</b>", 1).alias("target"), F.regexp_replace(context, "(?is)<b\\b[^>]*>.*?</b>", F.lower("c_name")).alias("rebuilt"))


@query("SELECT p_partkey, p_name || '|' || p_brand AS items FROM part")
def fun16_bullets(spark, d):
    back = F.concat(F.lit("• "), "p_name", F.lit("<br>• "), "p_brand", F.lit("<br>• "), "p_name")
    items = F.array_distinct(F.transform(F.split(back, "(?i)<br\\s*/?>"), lambda x: F.trim(F.regexp_replace(x, "^\\s*•\\s*", ""))))
    return table(spark, d, "part").select("p_partkey", F.array_join(items, "|").alias("items"))


@query(
    "SELECT note_id, CASE note_id % 4 WHEN 0 THEN 'site|meaning|' || card_id || ';context|meaning|a' || (note_id % 5) || '|say a' || (note_id % 5) || ' now' WHEN 1 THEN 'context|recall|a' || (note_id % 5) || '|say ' || chr(8291) || ' now' ELSE 'front|say a' || (note_id % 5) || ' now' END AS identities FROM notes",
    "notes",
)
def fun17_identities(spark, d):
    """Meaning cards with a site card, recall cards with a hint, cards of no article, and plain notes."""
    n, k, word = notes(spark, d), F.col("note_id") % 4, F.concat(F.lit("A"), F.col("note_id") % 5)
    front = F.when(k == 1, "Say <B>gap</B>  now<br/><small>hint</small>").otherwise(F.concat(F.lit("Say <b>"), word, F.lit("</b>  now")))
    tags = F.when(k == 0, F.concat(F.lit("site::"), "card_id", F.lit(" card::meaning article::p"))).when(k == 1, "article::p card::recall").when(k == 2, "site::1 card::meaning").otherwise("x")
    return n.select("note_id", F.array_join(N.identities(front, word, tags), ";").alias("identities"))


@query("SELECT c.card_id, c.user_id, d.source FROM cards c JOIN documents d ON c.document_id = d.doc_id", "cards")
def joi1_cards_documents(spark, d):
    return cards(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source"), "document_id").select("card_id", "user_id", "source")


@query("SELECT c.card_id, n.note_id, s.s_name FROM cards c JOIN notes n ON c.card_id = n.card_id JOIN supplier s ON n.deck_id = s.s_suppkey % 7 AND s.s_suppkey < 7", "cards", "notes")
def joi2_link_table(spark, d):
    decks = table(spark, d, "supplier").where("s_suppkey < 7").select((F.col("s_suppkey") % 7).alias("deck_id"), "s_name")
    return cards(spark, d).join(notes(spark, d), "card_id").join(decks, "deck_id").select("card_id", "note_id", "s_name")


@query("SELECT n.note_id, c.user_id FROM notes n JOIN cards c ON n.card_id = c.card_id WHERE c.current", "cards", "notes")
def joi3_current_cards(spark, d):
    return notes(spark, d).join(cards(spark, d).where("current"), "card_id").select("note_id", "user_id")


@query("SELECT c.card_id, n.note_id FROM cards c JOIN notes n ON c.card_id = n.card_id AND n.deck_id IN (1, 3, 5)", "cards", "notes")
def joi4_deck_join(spark, d):
    return cards(spark, d).join(notes(spark, d).where(F.col("deck_id").isin(1, 3, 5)), "card_id").select("card_id", "note_id")


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'known' ELSE 'new' END AS half FROM customer")
def joi6_split_known(spark, d):
    known = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(known, "c_custkey", "left_semi").withColumn("half", F.lit("known")).unionByName(c.join(known, "c_custkey", "left_anti").withColumn("half", F.lit("new")))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def joi8_exists(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


_FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card_id, direction ORDER BY note_id) AS k FROM notes) WHERE k = 1)"


@query(f", {_FIRST} SELECT note_id, card_id, direction FROM firsts", "notes")
def win12_first_note(spark, d):
    return N.first_by(notes(spark, d), ["card_id", "direction"], ["note_id"]).select("note_id", "card_id", "direction")


@query(f", kept AS (SELECT * FROM notes WHERE deck_id IN (0, 2, 4)), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card_id, direction ORDER BY note_id) AS k FROM kept) WHERE k = 1) SELECT c.card_id, d.direction, coalesce(f.due, 0) AS due, coalesce(f.ivl, 0) AS ivl, coalesce(f.reps, 0) AS reps, coalesce(f.lapses, 0) AS lapses, f.note_id IS NULL AS is_new FROM cards c, (VALUES ('meaning'), ('recall')) d(direction) LEFT JOIN firsts f ON f.card_id = c.card_id AND f.direction = d.direction".replace("FROM cards c, (VALUES ('meaning'), ('recall')) d(direction) LEFT", "FROM cards c CROSS JOIN (VALUES ('meaning'), ('recall')) d(direction) LEFT"), "cards", "notes")
def pip12_carry_schedules(spark, d):
    decks = notes(spark, d).select("deck_id").distinct().where(F.col("deck_id").isin(0, 2, 4))
    return N.carry_schedules(cards(spark, d), notes(spark, d), decks)


@query(f", {_FIRST} SELECT c.card_id, coalesce(f.due, 0) AS due, coalesce(f.ivl, 0) AS ivl FROM cards c LEFT JOIN firsts f ON f.card_id = c.card_id AND f.direction = 'recall'", "cards", "notes")
def joi17_schedule_defaults(spark, d):
    return N.carry_schedules(cards(spark, d), notes(spark, d)).where("direction = 'recall'").select("card_id", "due", "ivl")


@query("SELECT card_id, direction, max(note_id) FILTER (k = 1) AS survivor, sum(reps) AS reps, sum(lapses) AS lapses, count(*) - 1 AS removed FROM (SELECT *, row_number() OVER (PARTITION BY card_id, direction ORDER BY ivl DESC, reps DESC, lapses, note_id) AS k FROM notes) GROUP BY card_id, direction", "notes")
def agg10_fold_schedules(spark, d):
    return N.fold_schedules(notes(spark, d))


@query("SELECT card_id, direction, note_id FROM (SELECT *, row_number() OVER (PARTITION BY card_id, direction ORDER BY ivl DESC, reps DESC, lapses, note_id) AS k FROM notes) WHERE k = 1", "notes")
def win13_survivor(spark, d):
    return N.first_by(notes(spark, d), ["card_id", "direction"], [F.desc("ivl"), F.desc("reps"), "lapses", "note_id"]).select("card_id", "direction", "note_id")


@query("SELECT card_id, (SELECT max(note_id) FROM notes) + row_number() OVER (ORDER BY card_id) AS note_id FROM cards WHERE exported_at IS NULL", "cards", "notes")
def win14_new_ids(spark, d):
    return N.number_after(cards(spark, d).where("exported_at IS NULL").select("card_id"), notes(spark, d), "card_id", "note_id")


_DECKS = "decks AS (SELECT s_suppkey AS deck_id, CASE WHEN s_suppkey % 10 = 0 THEN 'd' || (s_suppkey // 10) ELSE 'd' || (s_suppkey // 10) || '::' || s_suppkey END AS name FROM supplier)"


@query(f"WITH {_DECKS} SELECT b.deck_id FROM decks a JOIN decks b ON a.deck_id = 10 AND (b.name = a.name OR starts_with(b.name, a.name || '::'))")
def joi24_deck_subtree(spark, d):
    s, top = F.col("s_suppkey"), F.concat(F.lit("d"), F.floor(F.col("s_suppkey") / 10))
    return N.deck_subtree(table(spark, d, "supplier").select(s.alias("deck_id"), F.when(s % 10 == 0, top).otherwise(F.concat(top, F.lit("::"), s)).alias("name")), 10)


_BATCH = "a AS (SELECT o_orderkey % 50 AS batch, o_orderkey AS id FROM orders), b AS (SELECT o_orderkey % 50 AS batch, o_orderkey + CASE WHEN o_orderkey % 500 = 7 THEN 1 ELSE 0 END AS id FROM orders)"


@query(f"WITH {_BATCH} SELECT batch, bool_and(x AND y) AS valid FROM (SELECT coalesce(a.batch, b.batch) AS batch, a.id IS NOT NULL AS x, b.id IS NOT NULL AS y FROM a FULL JOIN b ON a.batch = b.batch AND a.id = b.id) GROUP BY batch")
def joi25_same_ids(spark, d):
    k = F.col("o_orderkey")
    asked = table(spark, d, "orders").select((k % 50).alias("batch"), k.alias("id"))
    told = table(spark, d, "orders").select((k % 50).alias("batch"), (k + F.when(k % 500 == 7, 1).otherwise(0)).alias("id"))
    return E.complete_batches(told, asked).withColumnRenamed("complete", "valid")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey OR o_orderkey = c_custkey + 7)")
def joi26_no_identity(spark, d):
    """Two identities of a customer; a match of either one makes it known."""
    o = table(spark, d, "orders")
    known = o.select(F.explode(F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"))).alias("identity")).distinct()
    c = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("o"), F.col("c_custkey") + 7))).alias("identity"))
    return c.select("c_custkey").distinct().join(c.join(known, "identity", "left_semi").select("c_custkey"), "c_custkey", "left_anti")


@query("SELECT o_orderkey, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def joi27_strict_refresh(spark, d):
    n = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("ok").alias("status"))


@query("SELECT card_id, bool_and(p_size > 5) AS complete FROM (SELECT l_orderkey AS card_id, p_size FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY card_id")
def joi28_complete_cards(spark, d):
    there = table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("x"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    return rows.join(there, "l_partkey", "left").groupBy(F.col("l_orderkey").alias("card_id")).agg(F.bool_and(F.col("x").isNotNull()).alias("complete"))


@query("SELECT n.note_id, n.card_id FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY note_id) AS k FROM notes) n JOIN cards c ON n.card_id = c.card_id AND c.current WHERE n.k = 1", "cards", "notes")
def joi29_seeds(spark, d):
    return N.first_by(notes(spark, d), ["card_id"], ["note_id"]).join(cards(spark, d).where("current"), "card_id", "left_semi").select("note_id", "card_id")


_LINKED = "links AS (SELECT card_id, direction, min(note_id) AS note_id FROM notes WHERE deck_id = 1 GROUP BY card_id, direction)"
_STAGES = f"""{_LINKED}, wanted AS (SELECT card_id, direction FROM cards CROSS JOIN (VALUES ('meaning'), ('recall')) d(direction)),
s0 AS (SELECT w.*, l.note_id FROM wanted w JOIN links l ON w.card_id = l.card_id AND w.direction = l.direction),
s1 AS (SELECT w.card_id, w.direction, min(n.note_id) AS note_id FROM wanted w JOIN notes n ON n.card_id = w.card_id AND n.direction = w.direction WHERE NOT EXISTS (SELECT 1 FROM s0 WHERE s0.card_id = w.card_id AND s0.direction = w.direction) GROUP BY w.card_id, w.direction)"""


@query(f", {_STAGES} SELECT w.card_id, w.direction, coalesce(s0.note_id, s1.note_id) AS note_id, CASE WHEN s0.note_id IS NOT NULL THEN 0 WHEN s1.note_id IS NOT NULL THEN 1 END AS stage FROM wanted w LEFT JOIN s0 ON s0.card_id = w.card_id AND s0.direction = w.direction LEFT JOIN s1 ON s1.card_id = w.card_id AND s1.direction = w.direction", "cards", "notes")
def joi21_reconcile_stages(spark, d):
    """The fronts never match here, so the last stage finds nothing; tests cover it."""
    links = notes(spark, d).where("deck_id = 1").groupBy("card_id", "direction").agg(F.min("note_id").alias("note_id"))
    return N.reconcile(cards(spark, d).withColumn("front", F.concat(F.lit("c"), "card_id")), notes(spark, d).withColumn("front", F.concat(F.lit("n"), "note_id")), links)


@query(f", {_STAGES} SELECT count(*) FILTER (x) AS existing, count(*) FILTER (NOT x) AS missing FROM (SELECT (w.card_id, w.direction) IN (SELECT (card_id, direction) FROM s0 UNION ALL SELECT (card_id, direction) FROM s1) AS x FROM wanted w)", "cards", "notes")
def agg18_preview_counts(spark, d):
    return joi21_reconcile_stages(spark, d).agg(F.count_if(F.col("note_id").isNotNull()).alias("existing"), F.count_if(F.col("note_id").isNull()).alias("missing"))


@query(
    f""", {_LINKED}, wanted AS (SELECT card_id, direction, target AS front FROM cards CROSS JOIN (VALUES ('meaning'), ('recall')) d(direction)),
s0 AS (SELECT card_id, direction, note_id FROM wanted JOIN links USING (card_id, direction)),
s1 AS (SELECT card_id, direction, min(note_id) AS note_id FROM notes JOIN wanted USING (card_id, direction) WHERE deck_id < 3 AND (card_id, direction) NOT IN (SELECT (card_id, direction) FROM s0) GROUP BY card_id, direction),
used AS (SELECT *, 0 AS stage FROM s0 UNION ALL SELECT *, 1 FROM s1),
open_cards AS (SELECT card_id, direction, front, row_number() OVER (PARTITION BY front, direction ORDER BY card_id) AS k FROM wanted WHERE (card_id, direction) NOT IN (SELECT (card_id, direction) FROM used)),
open_notes AS (SELECT note_id, direction, front, row_number() OVER (PARTITION BY front, direction ORDER BY note_id) AS k FROM (SELECT note_id, direction, ['urgent', 'high', 'medium', 'notspecified', 'low'][due % 5 + 1] AS front FROM notes WHERE note_id NOT IN (SELECT note_id FROM used))),
every AS (SELECT * FROM used UNION ALL SELECT card_id, direction, note_id, 2 FROM open_cards JOIN open_notes USING (front, direction, k))
SELECT card_id, direction, note_id, stage FROM wanted LEFT JOIN every USING (card_id, direction)""",
    "cards", "notes",
)
def pip13_reconcile(spark, d):
    """All three stages: fronts by target, which several cards share."""
    links = notes(spark, d).where("deck_id = 1").groupBy("card_id", "direction").agg(F.min("note_id").alias("note_id"))
    fronts = cards(spark, d).select("card_id", F.col("target").alias("front"))
    other = notes(spark, d).withColumn("front", F.element_at(F.lit(["urgent", "high", "medium", "notspecified", "low"]), (F.col("due") % 5 + 1).cast("int")))
    return N.reconcile(fronts, other.withColumn("tags", F.when(F.col("deck_id") < 3, F.col("tags")).otherwise(F.concat(F.lit("card::"), "direction"))), links)


@query(
    """, old AS (SELECT note_id, 'b' AS back, card_id, direction FROM (SELECT *, row_number() OVER (PARTITION BY card_id, direction ORDER BY note_id) AS k FROM notes WHERE deck_id < 4) WHERE k = 1),
inc AS (SELECT note_id AS row_id, CASE WHEN deck_id % 2 = 0 THEN 'b' ELSE 'c' END AS back, card_id, direction FROM notes),
m AS (SELECT i.row_id, CASE WHEN i.back = o.back THEN 'same' ELSE 'update' END AS action, o.note_id FROM inc i JOIN old o ON i.card_id = o.card_id AND i.direction = o.direction),
r AS (SELECT row_id, row_number() OVER (PARTITION BY card_id, direction ORDER BY row_id) AS k FROM inc i WHERE NOT EXISTS (SELECT 1 FROM old o WHERE i.card_id = o.card_id AND i.direction = o.direction))
SELECT * FROM m UNION ALL SELECT row_id, 'skip', NULL FROM r WHERE k > 1 UNION ALL SELECT row_id, 'insert', (SELECT max(note_id) FROM old) + row_number() OVER (ORDER BY row_id) FROM r WHERE k = 1""",
    "notes",
)
def pip11_merge_notes(spark, d):
    tags = F.concat(F.lit("article::p site::"), "card_id", F.lit(" card::"), "direction")
    front = F.concat(F.lit("Card <b>word</b> "), "card_id")
    old = N.first_by(notes(spark, d).where("deck_id < 4"), ["card_id", "direction"], ["note_id"]).select("note_id", front.alias("front"), F.lit("b").alias("back"), tags.alias("tags"))
    new = notes(spark, d).select(F.col("note_id").alias("row_id"), front.alias("front"), F.when(F.col("deck_id") % 2 == 0, "b").otherwise("c").alias("back"), tags.alias("tags"))
    return N.merge_notes(old, new)


@query("SELECT before, added, before + added AS after FROM (SELECT count(*) AS before FROM (SELECT DISTINCT card_id, direction FROM notes WHERE deck_id < 4)), (SELECT count(*) AS added FROM (SELECT DISTINCT card_id, direction FROM notes EXCEPT SELECT DISTINCT card_id, direction FROM notes WHERE deck_id < 4))", "notes")
def agg13_merge_counts(spark, d):
    n = notes(spark, d).groupBy("card_id", "direction").agg(F.bool_or(F.col("deck_id") < 4).alias("old"))
    return n.agg(F.count_if("old").alias("before"), F.count_if(~F.col("old")).alias("added"), F.count("*").alias("after"))


@query("SELECT CASE WHEN deck_id < 2 THEN 'known' WHEN deck_id < 4 THEN 'unknown' WHEN deck_id < 5 THEN 'shadowed' ELSE 'leftover' END AS kind, count(*) AS n, sum(reps) AS reps FROM notes GROUP BY 1", "notes")
def agg14_accounting(spark, d):
    kind = F.when(F.col("deck_id") < 2, "known").when(F.col("deck_id") < 4, "unknown").when(F.col("deck_id") < 5, "shadowed").otherwise("leftover")
    return notes(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("reps").alias("reps"))


@query("SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ' | ') AS types, count(DISTINCT p_type) AS n_types, count(*) AS n FROM part GROUP BY p_brand")
def agg15_cluster_report(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), " | ").alias("types"), F.count_distinct("p_type").alias("n_types"), F.count("*").alias("n"))


@query("SELECT p_brand, string_agg(v, '|' ORDER BY k) AS p_type FROM (SELECT p_brand, v, row_number() OVER (PARTITION BY p_brand ORDER BY o) AS k FROM (SELECT p_brand, p_type AS v, min(p_partkey) AS o FROM part GROUP BY p_brand, p_type)) WHERE k <= 8 GROUP BY p_brand")
def agg7_ordered_distinct(spark, d):
    return N.ordered_distinct(table(spark, d, "part"), ["p_brand"], ["p_partkey"], "p_type", 8).select("p_brand", F.array_join("p_type", "|").alias("p_type"))


@query("SELECT p_brand, p_size, string_agg(v, '|' ORDER BY k) AS p_name FROM (SELECT p_brand, p_size, v, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY o) AS k FROM (SELECT p_brand, p_size, arg_min(trim(p_name), p_partkey) AS v, min(p_partkey) AS o FROM part GROUP BY p_brand, p_size, lower(trim(p_name)))) WHERE k <= 6 GROUP BY p_brand, p_size")
def agg8_grouped_translations(spark, d):
    return N.ordered_distinct(table(spark, d, "part"), ["p_brand", "p_size"], ["p_partkey"], "p_name", 6).select("p_brand", "p_size", F.array_join("p_name", "|").alias("p_name"))


@query("SELECT l_suppkey, l_returnflag, min(l_orderkey) AS first_note, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS learned, count(DISTINCT l_partkey) AS sources, arg_min(l_linestatus, l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey % 1000 * 10 + l_linenumber) AS replacement FROM lineitem GROUP BY l_suppkey, l_returnflag ORDER BY first_note, l_suppkey")
def agg6_source_contexts(spark, d):
    li = table(spark, d, "lineitem")
    key = F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey") % 1000 * 10 + F.col("l_linenumber")
    return li.groupBy("l_suppkey", "l_returnflag").agg(F.min("l_orderkey").alias("first_note"), F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).alias("learned"), F.count_distinct("l_partkey").alias("sources"), F.min_by("l_linestatus", key).alias("replacement")).orderBy("first_note", "l_suppkey")


@query("SELECT card_id, string_agg(note_id, '|' ORDER BY k) AS examples FROM (SELECT card_id, note_id, row_number() OVER (PARTITION BY card_id ORDER BY p, note_id) AS k FROM (SELECT card_id, direction, lapses, min(note_id) AS note_id, min(CASE WHEN deck_id < 3 THEN 0 ELSE 1 END) AS p FROM notes GROUP BY card_id, direction, lapses)) WHERE k <= 5 GROUP BY card_id", "notes")
def agg16_cluster_examples(spark, d):
    one = notes(spark, d).groupBy("card_id", "direction", "lapses").agg(F.min("note_id").alias("note_id"), F.min(F.when(F.col("deck_id") < 3, 0).otherwise(1)).alias("p"))
    top = one.withColumn("k", F.row_number().over(W.partitionBy("card_id").orderBy("p", "note_id"))).where("k <= 5")
    return top.groupBy("card_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "note_id"))), lambda x: x["note_id"]), "|").alias("examples"))


@query("SELECT n.note_id, c.card_id, row_number() OVER (PARTITION BY n.due ORDER BY (n.card_id = c.card_id) DESC, c.card_id, n.note_id) = 1 AS chosen FROM notes n JOIN cards c ON n.due = c.card_id", "cards", "notes")
def joi22_map_sources(spark, d):
    """A task holds the cards of its notes: all of them look small enough to broadcast by the bytes of their file, but aren't."""
    w = W.partitionBy("due").orderBy(F.desc("exact"), "c_id", "note_id")
    both = dealt(notes(spark, d).select("note_id", "card_id", "due"), "due").join(cards(spark, d).select(F.col("card_id").alias("c_id")).hint("shuffle_hash"), F.col("due") == F.col("c_id")).withColumn("exact", F.col("card_id") == F.col("c_id"))
    return both.select("note_id", F.col("c_id").alias("card_id"), (F.row_number().over(w) == 1).alias("chosen"))


@query("SELECT n.note_id, coalesce(a.card_id, b.card_id, -1) AS card_id FROM notes n LEFT JOIN (SELECT card_id FROM cards WHERE current) a ON a.card_id = n.card_id LEFT JOIN (SELECT user_id, min(card_id) AS card_id FROM cards WHERE exported_at IS NOT NULL GROUP BY user_id) b ON b.user_id = n.due", "cards", "notes")
def joi23_relink(spark, d):
    a = cards(spark, d).where("current").select("card_id", F.col("card_id").alias("a"))
    b = cards(spark, d).where("exported_at IS NOT NULL").groupBy(F.col("user_id").alias("due")).agg(F.min("card_id").alias("b"))
    return notes(spark, d).join(a, "card_id", "left").join(b, "due", "left").select("note_id", F.coalesce("a", "b", F.lit(-1)).alias("card_id"))


@query("SELECT card_id, tags || ' new::' || (card_id % 3) || ' ' || substring(tags, 1, strpos(tags, ' ') - 1) AS raw, tags || ' new::' || (card_id % 3) AS merged FROM notes", "notes")
def set3_merge_tags(spark, d):
    new = F.concat(F.lit("new::"), F.col("card_id") % 3, F.lit(" "), F.split_part("tags", F.lit(" "), F.lit(1)))
    return notes(spark, d).select("card_id", F.concat_ws(" ", "tags", new).alias("raw"), N.merge_tags(F.col("tags"), new).alias("merged"))


@query("SELECT note_id, list_has_any(string_split(tags, ' '), ['a', 'n']) AS hit FROM notes", "notes")
def set4_identity_overlap(spark, d):
    return notes(spark, d).select("note_id", F.arrays_overlap(F.split("tags", " "), F.lit(["a", "n"])).alias("hit"))


@query("SELECT card_id FROM cards EXCEPT (SELECT card_id FROM notes WHERE deck_id < 3 UNION SELECT card_id FROM notes WHERE deck_id = 6)", "cards", "notes")
def set5_unaccounted(spark, d):
    n = notes(spark, d)
    return cards(spark, d).select("card_id").subtract(n.where("deck_id < 3").select("card_id").union(n.where("deck_id = 6").select("card_id")))


@query("SELECT note_id FROM notes EXCEPT SELECT min(note_id) FROM notes GROUP BY card_id, direction", "notes")
def set6_shadowed(spark, d):
    n = notes(spark, d)
    return n.select("note_id").subtract(n.groupBy("card_id", "direction").agg(F.min("note_id").alias("note_id")).select("note_id"))


@query("SELECT card_id, list_sort(list_filter(list_distinct(list(lapses)), lambda x: x <> 0)) = [1, 2] AS both, count(*) AS n FROM notes GROUP BY card_id", "notes")
def set8_related_minus_valid(spark, d):
    g = notes(spark, d).groupBy("card_id").agg(F.collect_set("lapses").alias("s"), F.count("*").alias("n"))
    return g.select("card_id", (F.array_sort(F.array_except("s", F.lit([0]).cast("array<bigint>"))) == F.lit([1, 2]).cast("array<bigint>")).alias("both"), "n")


@query("SELECT note_id FROM notes WHERE deck_id = 0 UNION ALL SELECT note_id FROM notes WHERE deck_id IN (0, 1) AND note_id NOT IN (SELECT note_id FROM notes WHERE deck_id = 0)", "notes")
def set9_insert_or_ignore(spark, d):
    n = notes(spark, d)
    old, new = n.where("deck_id = 0").select("note_id"), n.where("deck_id IN (0, 1)").select("note_id")
    return old.unionByName(new.join(old, "note_id", "left_anti"))


@query("SELECT card_id, count(*) AS total, count(*) FILTER (direction = 'meaning') AS kept, count(*) = count(*) FILTER (direction = 'meaning') AS unchanged FROM notes GROUP BY card_id", "notes")
def set2_retained(spark, d):
    g = notes(spark, d).groupBy("card_id").agg(F.array_sort(F.collect_list("direction")).alias("all"))
    kept = F.filter("all", lambda x: x == "meaning")
    return g.select("card_id", F.size("all").cast("long").alias("total"), F.size(kept).cast("long").alias("kept"), (F.col("all") == kept).alias("unchanged"))


@query("SELECT p_partkey AS card_id, direction, CASE direction WHEN 'meaning' THEN '• ' || p_brand || '<br>• ' || p_type ELSE '<b>' || split_part(p_name, ' ', 1) || '</b>' END AS back, 'article::' || regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9_:-]+', '_', 'g'), '^_+|_+$', '', 'g') || ' site::' || p_partkey || ' card::' || direction AS tags FROM part CROSS JOIN (VALUES ('meaning'), ('recall')) d(direction)")
def pip10_render_cards(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("card_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("target"), F.col("p_name").alias("sentence"), F.col("p_brand").alias("replacement"), F.array("p_brand", "p_type").alias("translations"), F.col("p_type").alias("document"))
    return N.render_cards(c).select("card_id", "direction", "back", "tags")


@query("SELECT card_id, count(*) AS notes_left FROM notes WHERE deck_id <> 2 AND card_id IN (SELECT card_id FROM notes WHERE deck_id = 2) GROUP BY card_id", "notes")
def pip17_delete_cascade(spark, d):
    n = notes(spark, d).withColumnRenamed("note_id", "highlight_id")
    h = n.select("highlight_id", F.col("due").alias("created_at"), F.col("deck_id").alias("document_id"))
    out = N.delete_cascade(n.where("deck_id = 2"), h, n.select("card_id", "highlight_id"))
    left = n.join(n.where("deck_id = 2").select("highlight_id"), "highlight_id", "left_anti")
    return left.join(out["moved_cards"].select("card_id"), "card_id", "left_semi").groupBy("card_id").agg(F.count("*").alias("notes_left"))


@query("SELECT card_id, arg_min(note_id, (due, note_id)) AS highlight_id FROM notes WHERE deck_id <> 2 AND card_id IN (SELECT card_id FROM notes WHERE deck_id = 2) GROUP BY card_id", "notes")
def win17_representative(spark, d):
    n = notes(spark, d).withColumnRenamed("note_id", "highlight_id")
    h = n.select("highlight_id", F.col("due").alias("created_at"), F.col("deck_id").alias("document_id"))
    return N.delete_cascade(n.where("deck_id = 2"), h, n.select("card_id", "highlight_id"))["moved_cards"]


@query("SELECT card_id, md5(CAST(card_id AS VARCHAR) || '42') AS k FROM cards ORDER BY k", "cards")
def srt5_seeded_shuffle(spark, d):
    return cards(spark, d).select("card_id", F.md5(F.concat(F.col("card_id").cast("string"), F.lit("42"))).alias("k")).orderBy("k")


@query("SELECT card_id, min(note_id) AS first FROM notes GROUP BY card_id ORDER BY first", "notes")
def srt6_context_order(spark, d):
    return notes(spark, d).groupBy("card_id").agg(F.min("note_id").alias("first")).orderBy("first")


@query("SELECT card_id, target, CAST(TIMESTAMP '1999-01-01' AS TIMESTAMP) AS exported_at FROM cards WHERE exported_at IS NULL", "cards")
def pip18_export_pending(spark, d):
    return cards(spark, d).where("exported_at IS NULL").select("card_id", "target", F.lit("1999-01-01 00:00:00").cast("timestamp").alias("exported_at"))


@query("SELECT card_id, direction, survivor, removed, removed > 0 AS merged FROM (SELECT card_id, direction, max(note_id) FILTER (k = 1) AS survivor, count(*) - 1 AS removed FROM (SELECT *, row_number() OVER (PARTITION BY card_id, direction ORDER BY ivl DESC, reps DESC, lapses, note_id) AS k FROM notes) GROUP BY card_id, direction)", "notes")
def pip14_migrate(spark, d):
    return N.fold_schedules(notes(spark, d)).select("card_id", "direction", "survivor", "removed", (F.col("removed") > 0).alias("merged"))


@query("SELECT card_id, direction, count(*) AS notes, min(note_id) AS first_note, sum(CASE WHEN ivl > 20 THEN 1 ELSE 0 END) AS learned FROM notes GROUP BY card_id, direction", "notes")
def pip19_source_contexts(spark, d):
    n = notes(spark, d).withColumn("dir", N.direction_of(F.col("tags")))
    return n.groupBy("card_id", F.col("dir").alias("direction")).agg(F.count("*").alias("notes"), F.min("note_id").alias("first_note"), F.sum(F.when(F.col("ivl") > 20, 1).otherwise(0)).alias("learned"))


#: Notes of parts in both directions, as SQL says what they tell: note_id, target, sentence, replacement, translations, source, learned.
_TOLD = """told AS (SELECT p_partkey * 2 AS note_id, split_part(p_name, ' ', 1) AS target, 'Say ' || split_part(p_name, ' ', 1) || ' of ' || p_type || ' & co' AS sentence, '' AS replacement, [p_brand, 'size ' || p_size] AS translations, 'article::x · page::' || (p_size % 3) AS source, p_size % 3 AS learned FROM part
UNION ALL SELECT p_partkey * 2 + 1, split_part(p_name, ' ', 1), 'Say ' || split_part(p_name, ' ', 1) || ' of ' || p_type || ' & co', p_brand, CAST([] AS VARCHAR[]), 'article::x', p_size % 2 FROM part)"""
_CONTEXTS = f"""WITH {_TOLD}, g AS (SELECT lower(target) AS kt, lower(sentence) AS ks, arg_min(target, note_id) AS target, arg_min(sentence, note_id) AS sentence, coalesce(arg_min(replacement, note_id) FILTER (replacement <> ''), '') AS replacement, array_to_string(list_sort(list_distinct(list(source))), ' | ') AS source, list_sort(list(note_id)) AS note_ids, sum(learned) AS learned_cards FROM told GROUP BY 1, 2),
v AS (SELECT lower(target) AS kt, lower(sentence) AS ks, note_id, unnest(translations) AS v, generate_subscripts(translations, 1) AS i FROM told),
f AS (SELECT kt, ks, lower(v) AS k, arg_min(v, note_id * 10 + i) AS v, min(note_id * 10 + i) AS o FROM v GROUP BY kt, ks, lower(v)),
t AS (SELECT kt, ks, string_agg(v, '|' ORDER BY o) AS translations FROM (SELECT *, row_number() OVER (PARTITION BY kt, ks ORDER BY o) AS n FROM f) WHERE n <= 8 GROUP BY kt, ks)"""


def _deck(spark, d):
    p = table(spark, d, "part")
    word, tail = F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.lit("</b> of "), "p_type", F.lit(" &amp; co"))
    meaning = p.select((F.col("p_partkey") * 2).alias("note_id"), F.concat(F.lit("Say <b>"), word, tail).alias("front"), F.concat(F.lit("• "), "p_brand", F.lit("<br>- "), F.lower("p_brand"), F.lit("<BR/>· size "), "p_size").alias("back"), F.concat(F.lit("card::meaning article::x page::"), F.col("p_size") % 3).alias("tags"), (F.col("p_size") % 3).alias("learned"))
    recall = p.select((F.col("p_partkey") * 2 + 1).alias("note_id"), F.concat(F.lit("Say <b>"), "p_brand", tail, F.lit("<br><small>hint</small>")).alias("front"), F.concat(F.lit("<b>"), word, F.lit("</b>")).alias("back"), F.lit("direction::recall article::x").alias("tags"), (F.col("p_size") % 2).alias("learned"))
    return meaning.unionByName(recall)


@query(f"{_CONTEXTS} SELECT target, sentence, translations, replacement, source, array_to_string(note_ids, ',') AS note_ids, CAST(learned_cards AS BIGINT) AS learned_cards FROM g JOIN t USING (kt, ks)")
def pip19_context_table(spark, d):
    """Every part has a meaning and a recall note."""
    out = R.source_contexts(_deck(spark, d)).drop("id")
    return out.withColumns({"translations": F.array_join("translations", "|"), "note_ids": F.array_join("note_ids", ",")})


_MAPPED = f"""{_CONTEXTS}, h AS (SELECT p_partkey AS highlight_id, CASE WHEN p_partkey % 3 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE 'elsewhere' END AS target, 'say ' || split_part(p_name, ' ', 1) || ' of ' || p_type || '  & co' AS sentence FROM part WHERE p_partkey % 4 <> 0),
links AS (SELECT p_partkey * 2 AS note_id, p_partkey AS highlight_id FROM part UNION ALL SELECT (p_partkey + 1) * 2 + 1, p_partkey FROM part),
n AS (SELECT kt, ks, list_min(note_ids) AS lowest, unnest(note_ids) AS note_id FROM g),
fits AS (SELECT highlight_id, kt, ks, lowest, max(e) AS exact FROM (SELECT h.highlight_id, g.kt, g.ks, list_min(g.note_ids) AS lowest, 1 AS e FROM h JOIN g ON lower(h.target) = g.kt AND replace(lower(h.sentence), '  ', ' ') = g.ks UNION ALL SELECT h.highlight_id, n.kt, n.ks, n.lowest, 0 FROM h JOIN links USING (highlight_id) JOIN n USING (note_id)) GROUP BY 1, 2, 3, 4),
picked AS (SELECT *, row_number() OVER (PARTITION BY highlight_id ORDER BY exact DESC, lowest) = 1 AS chosen FROM fits)"""


def _mapping(spark, d):
    """Highlights that say what their note says, or are linked to it and to the next part's; those of every fourth part don't exist."""
    sources = R.source_contexts(_deck(spark, d))
    p = table(spark, d, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    highlights = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("highlight_id"), F.when(F.col("p_partkey") % 3 == 0, F.upper(word)).otherwise("elsewhere").alias("target"), F.concat(F.lit("say "), word, F.lit(" of "), "p_type", F.lit("  & co")).alias("sentence"), F.lit("reader").alias("source"), F.timestamp_seconds("p_partkey").alias("created_at"))
    links = p.select((F.col("p_partkey") * 2).alias("note_id"), F.col("p_partkey").alias("highlight_id")).unionByName(p.select((F.col("p_partkey") * 2 + 3).alias("note_id"), F.col("p_partkey").alias("highlight_id")))
    return sources, highlights, links


@query(f"{_MAPPED} SELECT highlight_id, lowest, exact = 1 AS exact, chosen FROM picked")
def joi22_source_mapping(spark, d):
    sources, highlights, links = _mapping(spark, d)
    lowest = sources.select(F.col("id").alias("source_id"), F.array_min("note_ids").alias("lowest"))
    return R.map_sources(highlights, sources, links).join(lowest, "source_id").select("highlight_id", "lowest", "exact", "chosen")


@query(
    f"""{_MAPPED}, taken AS (SELECT DISTINCT kt, ks FROM picked WHERE chosen), k AS (SELECT DISTINCT kt FROM taken), owned AS (SELECT n.*, kt IN (SELECT kt FROM k) AS known FROM n),
folded AS (SELECT kt, note_id % 2 AS direction, count(*) AS c FROM owned WHERE known GROUP BY 1, 2)
SELECT (SELECT count(*) FROM g) AS sources, (SELECT count(*) FROM h) AS highlights, (SELECT count(*) FROM taken) AS chosen, (SELECT count(*) FROM (SELECT DISTINCT kt, ks FROM fits EXCEPT SELECT kt, ks FROM taken)) AS shadowed, (SELECT count(*) FROM k) AS known_clusters, (SELECT count(DISTINCT kt) FROM g) - (SELECT count(*) FROM k) AS unknown_clusters,
(SELECT count(*) FROM folded) AS survivors, (SELECT CAST(sum(c - 1) AS BIGINT) FROM folded) AS removed, 2 * (SELECT count(*) FROM k) - (SELECT count(*) FROM folded) AS added, (SELECT count(*) FROM owned WHERE NOT known) AS unknown_notes,
(SELECT count(*) FROM g WHERE kt IN (SELECT kt FROM k) AND (kt, ks) NOT IN (SELECT kt, ks FROM fits EXCEPT SELECT kt, ks FROM taken)) AS contexts"""
)
def pip14_accounting(spark, d):
    """A word's contexts are a cluster."""
    sources, highlights, links = _mapping(spark, d)
    said = F.struct(F.col("id").alias("id"), F.lit("user").alias("source"), "target", "sentence")
    grouped = sources.groupBy(F.lower("target").alias("cluster_id")).agg(F.collect_list("id").alias("source_ids"), F.flatten(F.collect_list("note_ids")).alias("note_ids"), F.collect_list(said).alias("contexts"))
    notes_ = _deck(spark, d).select("note_id", "tags", (F.col("note_id") % 50).alias("ivl"), (F.col("note_id") % 7).alias("reps"), (F.col("note_id") % 3).alias("lapses"))
    return R.migrate(grouped, sources, highlights, links, notes_)["accounting"]


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"
_SIDES = f"""WITH p AS (SELECT p_partkey AS card_id, split_part(p_name, ' ', 1) AS w, p_name AS s, p_type AS x, p_brand AS b, p_size FROM part),
r AS (SELECT card_id, p_size, b, x, '<b>' || w || '</b>' || substring(s, length(w) + 1) AS f, '<b>' || CASE WHEN p_size % 5 = 0 THEN b ELSE x END || '</b>' || substring(s, length(w) + 1) || '<br><small>Подходит, но не целевой ответ: ' || b || '<br>Близко по смыслу: ' || x || '</small>' AS rc, w FROM p),
j AS (SELECT *, '[' || CAST(to_json({{'front': f, 'recall': rc, 'answer': w, 'source': 'user &amp; co'}}) AS VARCHAR) || ']' AS data FROM r WHERE p_size % 7 <> 0),
o AS (SELECT *, '<div data-card="' || card_id || '" data-contexts="' || {_ESC.format("data")} || '">' AS head FROM j),
sides AS (SELECT card_id, 'meaning' AS direction, head || f || '</div>' AS front, head || '<b>' || w || '</b><br>• ' || b || '<br>• ' || x || '<br><small>A &lt; B</small></div>' AS back, 'site::' || card_id || ' semantic::v1 family::' || w || ' card::meaning' AS tags FROM o
UNION ALL SELECT card_id, 'recall', head || rc || '</div>', head || '<b>' || w || '</b></div>', 'site::' || card_id || ' semantic::v1 family::' || w || ' card::recall' FROM o)"""


def _semantic(spark, d):
    """A card a part; those of every seventh size have no recall context; every fifth size's replacement is too long."""
    p = table(spark, d, "part").withColumn("w", F.split_part("p_name", F.lit(" "), F.lit(1)))
    c = p.select(F.col("p_partkey").alias("card_id"), F.col("w").alias("family"), F.lit("A < B").alias("sense"), F.array("p_brand", "p_type").alias("translations"), F.when(F.col("p_size") % 2 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("exported_at"))
    long_, none = F.lit("one two three four five six"), F.array().cast("array<string>")
    directions = F.when(F.col("p_size") % 7 == 0, F.array(F.lit("meaning"))).otherwise(none)
    contexts = p.select(F.col("p_partkey").alias("card_id"), F.lit(0).alias("place"), F.col("w").alias("target"), F.col("p_name").alias("sentence"), F.when(F.col("p_size") % 5 == 0, long_).otherwise(F.col("p_type")).alias("replacement"), F.lit("user & co").alias("source"), directions.alias("directions"), F.array("p_brand").alias("valid"), F.array("p_type", F.upper("p_brand")).alias("related"))
    return c, contexts


@query(f"{_SIDES} SELECT * FROM sides")
def pip10_semantic_cards(spark, d):
    return N.semantic_cards(*_semantic(spark, d))


@query(f"{_SIDES} SELECT p_partkey AS card_id, CASE WHEN p_size % 2 = 0 THEN TIMESTAMP '2024-01-01' WHEN p_size % 7 <> 0 THEN TIMESTAMP '1999-01-01' END AS exported_at, coalesce(n, 0) AS written FROM part LEFT JOIN (SELECT card_id, count(*) AS n FROM sides GROUP BY card_id) s ON s.card_id = p_partkey AND p_size % 2 <> 0")
def pip18_export(spark, d):
    """The pending ones are written as CSV, read again, and marked."""
    from lexmine.sources import files

    c, contexts = _semantic(spark, d)
    to = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    marked = N.export_pending(c, contexts, "exported_at", F.lit("1999-01-01 00:00:00").cast("timestamp"), to)
    read = files.read_cards_csv(spark, [to], ["Front", "Back", "Tags"]).groupBy(F.regexp_extract("Tags", "site::(\\d+)", 1).cast("long").alias("card_id")).agg(F.count("*").alias("written"))
    return marked.join(read, "card_id", "left").select("card_id", F.col("exported_at").cast("timestamp_ntz").alias("exported_at"), F.coalesce("written", F.lit(0)).alias("written"))
