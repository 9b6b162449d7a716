"""Queries over activity, dictionary, enrichment and files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmine.functions import status as S
from lexmine.functions import text as T
from lexmine.operators import clusters as K
from lexmine.operators import dashboard as B
from lexmine.operators import dictionary as D
from lexmine.operators import enrich as E
from lexmine.plans.base import cards, corpus, notes, query, table
from lexmine.sources import files

_AS_OF = "(SELECT max(ts) AS as_of FROM events)"


def _as_of(spark, d):
    return F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0])  # one value


@query("SELECT d.doc_id, d.source, count(l.doc_id) AS highlights FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1 GROUP BY d.doc_id, d.source")
def agg1_counts_per_document(spark, d):
    n = table(spark, d, "labels").where("quality = 1").groupBy("doc_id").agg(F.count("*").alias("n"))
    return table(spark, d, "documents").select("doc_id", "source").join(n, "doc_id", "left").select("doc_id", "source", F.coalesce("n", F.lit(0)).alias("highlights"))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY user_id")
def agg2_filtered_counts(spark, d):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, d, "events").groupBy("user_id").agg(kind("view").alias("views"), kind("error").alias("errors"), F.count("*").alias("n"))


@query("SELECT coalesce(max(due) + 1, 1) AS next_due, coalesce(max(note_id) + 1, 1) AS next_id, (SELECT max(ts) FROM events) AS alive FROM notes", "notes")
def agg3_next_ids(spark, d):
    alive = _as_of(spark, d)
    return notes(spark, d).agg(F.coalesce(F.max("due") + 1, F.lit(1)).alias("next_due"), F.coalesce(F.max("note_id") + 1, F.lit(1)).alias("next_id")).withColumn("alive", alive)


@query(f"SELECT user_id, count(*) AS failures, count(*) >= 4 AS limited FROM events, {_AS_OF} WHERE event_type = 'error' AND ts > as_of - INTERVAL 10 DAY GROUP BY user_id")
def agg4_failed_attempts(spark, d):
    e = table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("ts") > _as_of(spark, d) - F.expr("INTERVAL 10 DAYS")))
    return e.groupBy("user_id").agg(F.count("*").alias("failures"), (F.count("*") >= 4).alias("limited"))


@query("SELECT deck_id, count(*) AS n FROM notes GROUP BY deck_id ORDER BY n DESC, deck_id LIMIT 1", "notes")
def agg5_mode(spark, d):
    return notes(spark, d).groupBy("deck_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "deck_id").limit(1)


@query("SELECT event_type AS model, count(*) AS calls, count(*) FILTER (value > 50) AS ok, round(avg(value), 6) AS elapsed FROM events GROUP BY event_type")
def agg17_run_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 50).alias("ok"), F.round(F.avg("value"), 6).alias("elapsed"))


@query(f"SELECT event_id, date_diff('second', ts, as_of) > 86400 AS stale, date_diff('second', ts, as_of) <= 604800 AND event_type <> 'error' AS usable FROM events, {_AS_OF}")
def fil17_freshness(spark, d):
    e = table(spark, d, "events")
    age = S.age_s(F.date_trunc("second", "ts"), F.date_trunc("second", _as_of(spark, d)))
    return e.select("event_id", (age > 86400).alias("stale"), ((age <= 604800) & (F.col("event_type") != "error")).alias("usable"))


@query("SELECT doc_id, CASE WHEN n_chars > 0 THEN CAST(floor(100.0 * least(doc_id, n_chars) / n_chars) AS BIGINT) ELSE 0 END AS percent FROM documents")
def fil20_progress(spark, d):
    return table(spark, d, "documents").select("doc_id", S.progress(F.col("doc_id"), F.col("n_chars")).cast("bigint").alias("percent"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, date_trunc('minute', ts) AS cut FROM events")
def fun29_time_format(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.date_trunc("minute", "ts").alias("cut"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'auth' WHEN 'view' THEN 'temporary' WHEN 'click' THEN 'configuration' WHEN 'signup' THEN NULL ELSE 'other' END AS class FROM events")
def fun31_error_class(spark, d):
    code = F.when(F.col("event_type") == "error", "auth:denied").when(F.col("event_type") == "view", "temporary").when(F.col("event_type") == "click", "configuration:deck").when(F.col("event_type") == "signup", "").otherwise("unknown:x")
    return table(spark, d, "events").select("event_id", S.error_class(code).alias("class"))


@query("SELECT event_id, CASE WHEN a < 5 THEN [1, 5, 15, 60][least(a, 4)] END AS minutes FROM (SELECT event_id, 1 + event_id % 6 AS a FROM events)")
def fun32_backoff(spark, d):
    return table(spark, d, "events").select("event_id", S.backoff_minutes(1 + F.col("event_id") % 6).alias("minutes"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def win15_latest(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x"))
    return e.select("user_id", "x.*")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k > 3")
def win16_prune(spark, d):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k > 3").select("event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('view', 'click')) WHERE k = 1")
def win20_oldest_due(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    return e.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT card_id, exported_at FROM cards ORDER BY exported_at DESC NULLS LAST, card_id", "cards")
def srt1_library_order(spark, d):
    return cards(spark, d).select("card_id", "exported_at").orderBy(F.desc_nulls_last("exported_at"), "card_id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def srt2_recent(spark, d):
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(5)


@query("SELECT d.source, count(*) AS documents, count(l.doc_id) AS labelled, coalesce(sum(l.quality), 0) AS approved FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source ORDER BY documents DESC, d.source")
def pip20_dashboard(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("documents"), F.count("has").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("approved")).orderBy(F.desc("documents"), "source")


_ENTRIES = """e0 AS (SELECT page_id, list_distinct(regexp_extract_all(replace(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), 'ß', 'ss'), '\\p{L}+')) AS ws, regexp_extract_all(html, '(?i)<(?:p|li)>([^<>]*)</', 1) AS vs FROM pages),
e1 AS (SELECT page_id, ws, unnest(vs) AS value, generate_subscripts(vs, 1) - 1 AS i FROM e0),
entries AS (SELECT unnest(ws) AS word, CASE WHEN length(value) % 2 = 0 THEN 'noun' ELSE 'verb' END AS pos, page_id * 1000 + i AS ord, value FROM e1)"""


@query(f"WITH {_ENTRIES} SELECT word, pos, ord, value FROM entries")
def src9_entries(spark, d):
    return D.entries_of(table(spark, d, "pages"))


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


_DETACH = "(VALUES " + ", ".join(f"('{e}', '{n}')" for _, e, n in D.DETACHMENTS) + ") r(ending, new)"
_LEMMAS = f"{_ENTRIES}, asked AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), lemmas AS (SELECT DISTINCT word, substring(word, 1, length(word) - length(ending)) || new AS lemma FROM asked JOIN {_DETACH} ON suffix(word, ending) AND length(word) > length(ending)), good AS (SELECT word, lemma FROM lemmas WHERE lemma <> word AND lemma IN (SELECT word FROM entries))"


@query(f"WITH {_LEMMAS} SELECT word, lemma FROM good")
def joi20_lemmas(spark, d):
    return D.lemma_candidates(_asked(spark, d), D.entries_of(table(spark, d, "pages"))).select("word", "lemma")


@query(
    f"WITH {_LEMMAS}, ks AS (SELECT word, word AS key, 0 AS far FROM asked UNION ALL SELECT word, lemma, 1 FROM good), f AS (SELECT k.word, e.pos, k.far, k.key, e.ord, trim(e.value) AS value FROM ks k JOIN entries e ON e.word = k.key WHERE trim(e.value) <> ''), u AS (SELECT word, pos, replace(lower(value), 'ß', 'ss') AS lv, min((far, key, ord, value)) AS m FROM f GROUP BY 1, 2, 3), n AS (SELECT word, pos, m, row_number() OVER (PARTITION BY word, pos ORDER BY m) AS k FROM u) SELECT word, pos, string_agg(m[4], '|' ORDER BY k) AS found FROM n WHERE k <= 6 GROUP BY word, pos"
)
def pip16_dictionary_lookup(spark, d):
    return D.lookup(_asked(spark, d), D.entries_of(table(spark, d, "pages"))).select("word", "pos", F.array_join("value", "|").alias("found"))


@query(f"WITH {_ENTRIES} SELECT a.word, count(*) AS n FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) a JOIN entries e ON a.word = e.word GROUP BY a.word")
def joi19_dictionary_join(spark, d):
    return _asked(spark, d).join(D.entries_of(table(spark, d, "pages")), "word").groupBy("word").agg(F.count("*").alias("n"))


def _cache(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.when(F.col("o_orderkey") % 5 == 0, "v4:").otherwise("v5:"), F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"), 256)).alias("key"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("value"), F.col("o_orderkey").alias("written_at"))


_CACHE = "cache AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'v4:' ELSE 'v5:' END || sha256(o_custkey || '|' || o_orderpriority) AS key, o_orderstatus || o_orderkey AS value, o_orderkey AS written_at FROM orders), latest AS (SELECT key, arg_max(value, written_at) AS value FROM cache WHERE starts_with(key, 'v5:') GROUP BY key)"


@query(f"WITH {_CACHE} SELECT key, value FROM latest")
def src7_latest_cache(spark, d):
    return E.latest_cache(_cache(spark, d))


@query(f"WITH {_CACHE} SELECT o.o_orderkey, CASE WHEN l.key IS NULL THEN 'miss' WHEN NOT starts_with(l.value, 'O') THEN 'invalid' ELSE 'hit' END AS status FROM orders o LEFT JOIN latest l ON l.key = 'v5:' || sha256(o.o_custkey || '|' || o.o_orderpriority)")
def joi18_cache_status(spark, d):
    key = E.cache_key(F.col("o_custkey").cast("string"), F.col("o_orderpriority"))
    return table(spark, d, "orders").withColumn("key", key).join(E.latest_cache(_cache(spark, d)), "key", "left").select("o_orderkey", F.when(F.col("value").isNull(), "miss").when(~F.col("value").startswith("O"), "invalid").otherwise("hit").alias("status"))


@query("SELECT p_partkey, n AS problems FROM (SELECT p_partkey, (CASE WHEN p_size % 6 = 0 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) AS n FROM part)")
def fil11_violations(spark, d):
    """Every sixth size has an English translation, every seventh a repeated alternative."""
    k = F.col("p_size")
    item = F.struct(F.lit("слово").alias("explanation"), F.array(F.lit("дом"), F.when(k % 6 == 0, "house").otherwise("изба")).alias("translations"), F.lit("дом").alias("replacement"), F.array(F.lit("hut"), F.when(k % 7 == 0, " HUT").otherwise("home")).alias("alternatives"))
    return table(spark, d, "part").withColumn("item", item).select("p_partkey", F.size(E.violations(F.col("item"))).cast("int").alias("problems"))


@query(
    """WITH t AS (SELECT o_orderkey AS id, 'cust' || o_custkey AS target, 'v5:' || sha256('cust' || o_custkey || '|' || o_orderpriority) AS key, o_custkey FROM orders),
c AS (SELECT key, max(id) AS last FROM t WHERE id % 5 <> 0 GROUP BY key)
SELECT t.id, t.target, CASE WHEN c.last % 3 <> 0 THEN 'слово ' || c.last WHEN t.o_custkey % 4 = 0 THEN NULL ELSE 'ответ' END AS explanation FROM t LEFT JOIN c ON t.key = c.key"""
)
def pip15_enrich(spark, d):
    """Targets of cards through the cache: some cached items are not valid, and so are some new answers, which come in a code fence."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("cust"), "o_custkey").alias("target"), F.col("o_orderpriority").alias("sentence"))
    text = lambda word, alternative: F.concat(F.lit('{"explanation": "'), word, F.lit('", "translations": ["дом"], "replacement": "дом", "alternatives": ["'), alternative, F.lit('"]}'))
    cached = o.where("id % 5 <> 0").select(E.cache_key(F.col("target"), F.col("sentence")).alias("key"), text(F.concat(F.lit("слово "), "id"), F.when(F.col("id") % 3 == 0, "дом").otherwise("hut")).alias("value"), F.col("id").alias("written_at"))

    def answer(batches):
        for b in batches:
            repeats = b["target"].str.removeprefix("cust").astype("int64") % 4 == 0
            alternative = repeats.map({True: "Cust!", False: "hut"})
            yield b.assign(value='```json\n{"explanation": "ответ", "translations": ["дом"], "replacement": "дом", "alternatives": ["' + alternative + '"]}\n```')[["key", "value"]]

    rows, _ = E.enrich(o, cached, answer, good=E.valid_item)
    return rows.select("id", "target", E.item_of(F.col("value"))["explanation"].alias("explanation"))


def _leaders(spark, d):
    """Parts of even size as clusters' leaders, the others as highlights; a hundred keys are a user."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 100").alias("user_id"), T.normalize_selection(F.col("p_name")).alias("name"), "p_size")
    leaders = p.where("p_size % 2 = 0").select("user_id", F.col("id").alias("cluster_id"), F.col("name").alias("leader"))
    return p.where("p_size % 2 <> 0").select(F.col("id").alias("highlight_id"), "user_id", F.col("name").alias("text")), leaders


@query(
    """WITH l AS (SELECT p_partkey // 100 AS user_id, p_partkey AS cluster_id, p_name AS leader FROM part WHERE p_size % 2 = 0), h AS (SELECT p_partkey AS highlight_id, p_partkey // 100 AS user_id, p_name AS text FROM part WHERE p_size % 2 <> 0),
n AS (SELECT highlight_id, user_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\- ]', ' ', 'g'), ' +', ' ', 'g'), ' -') AS text FROM h), m AS (SELECT cluster_id, user_id, trim(regexp_replace(regexp_replace(lower(leader), '[^a-z0-9\\- ]', ' ', 'g'), ' +', ' ', 'g'), ' -') AS leader FROM l),
s AS (SELECT highlight_id, cluster_id, leader, 100.0 - 100.0 * levenshtein(text, leader) / greatest(length(text), length(leader)) AS score FROM n JOIN m USING (user_id))
SELECT highlight_id, cluster_id, leader, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY highlight_id ORDER BY score DESC, cluster_id) AS rank FROM s WHERE score >= 45) WHERE rank <= 5"""
)
def joi11_fuzzy_top(spark, d):
    likeness = lambda a, b: 100.0 - 100.0 * F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return E.fuzzy_top(*_leaders(spark, d), score=likeness).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(
    """WITH l AS (SELECT p_partkey // 100 AS user_id, p_partkey AS cluster_id, p_name AS leader FROM part WHERE p_size % 2 = 0), h AS (SELECT p_partkey AS highlight_id, p_partkey // 100 AS user_id, p_name AS text FROM part WHERE p_size % 2 <> 0),
n AS (SELECT highlight_id, user_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\- ]', ' ', 'g'), ' +', ' ', 'g'), ' -') AS text FROM h), m AS (SELECT cluster_id, user_id, trim(regexp_replace(regexp_replace(lower(leader), '[^a-z0-9\\- ]', ' ', 'g'), ' +', ' ', 'g'), ' -') AS leader FROM l),
b AS (SELECT highlight_id, cluster_id FROM (SELECT highlight_id, cluster_id, row_number() OVER (PARTITION BY highlight_id ORDER BY 100.0 - 100.0 * levenshtein(text, leader) / greatest(length(text), length(leader)) DESC, cluster_id) AS k FROM n JOIN m USING (user_id) WHERE 100.0 - 100.0 * levenshtein(text, leader) / greatest(length(text), length(leader)) >= 60) WHERE k = 1)
SELECT n.highlight_id, n.user_id, coalesce(CAST(b.cluster_id AS VARCHAR), 'new-' || substring(sha256(n.user_id || '|' || n.text), 1, 16)) AS cluster, b.cluster_id IS NULL AS is_new FROM n LEFT JOIN b ON n.highlight_id = b.highlight_id"""
)
def pip8_cluster_assign(spark, d):
    likeness = lambda a, b: 100.0 - 100.0 * F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    return E.cluster_assign(*_leaders(spark, d), least=60.0, score=likeness)


@query(None)
def pip8_assign_clusters(spark, d):
    """Parts of odd size as highlights, of even size as cards with a translation and a stored context each."""
    p = table(spark, d, "part").withColumn("user_id", F.expr("p_partkey div 100"))
    odd, even = p.where("p_size % 2 <> 0"), p.where("p_size % 2 = 0")
    day = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("p_partkey"))
    highlights = odd.select(F.col("p_partkey").alias("highlight_id"), "user_id", F.col("p_name").alias("target"), F.col("p_type").alias("sentence"), day.alias("created_at"))
    cards = even.select(F.col("p_partkey").cast("string").alias("card_id"), "user_id", F.col("p_name").alias("target"), F.col("p_type").alias("sentence"), F.array("p_brand").alias("translations"))
    links = even.where("p_size % 4 = 0").select(F.col("p_partkey").cast("string").alias("card_id"), F.col("p_name").alias("target"), F.col("p_brand").alias("sentence"), day.alias("created_at"))
    contexts = even.select(F.col("p_partkey").cast("string").alias("card_id"), F.lit(0).alias("place"), F.concat(F.lit("s"), "p_partkey").alias("context_id"), F.col("p_name").alias("target"), F.col("p_type").alias("sentence"))
    out = K.assign_clusters(highlights, cards, links, contexts)
    return out["assigned"].join(out["cards"].select("card_id", F.col("target").alias("leader")), "card_id")


@query(None)
def fun25_weighted_ratio(spark, d):
    return E.fuzzy_top(*_leaders(spark, d))


@query(None)
def joi11_weighted_top(spark, d):
    """The best five leaders by weighted ratio, of pairs that can be among them."""
    return E.weighted_top(*_leaders(spark, d))


@query(None)
def srt7_fuzzy_order(spark, d):
    return E.weighted_top(*_leaders(spark, d)).orderBy("highlight_id", F.desc("score"), "cluster_id")


@query(None)
def pip9_replay_clusters(spark, d):
    o = table(spark, d, "part")
    h = o.select(F.col("p_partkey").alias("highlight_id"), F.expr("p_partkey div 100").alias("user_id"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" "), F.lower("p_brand")).alias("text"), F.col("p_partkey").alias("created_at"))
    return E.replay_clusters(h)


def _scratch(spark) -> str:
    """A new folder in the shared checkpoint folder."""
    from lexmine.sources.shared import shared_folder

    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT p_partkey AS row_id, p_name AS \"Front\", p_type || ', \"' || p_brand || '\"' AS \"Back\", 'x' AS \"Tags\" FROM part")
def src3_csv_round_trip(spark, d):
    """SRC2 and SRC3: cards written as CSV and read again, with quotes and commas inside."""
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("row_id"), F.col("p_name").alias("Front"), F.concat("p_type", F.lit(', "'), "p_brand", F.lit('"')).alias("Back"), F.lit("x").alias("Tags"))
    to = _scratch(spark)
    files.write_cards_csv(rows, to)
    return files.read_cards_csv(spark, [to], ["Front", "Back", "Tags"]).withColumn("row_id", F.col("row_id").cast("bigint"))


@query("SELECT c_custkey AS row_id, c_name AS front FROM customer")
def src2_csv_read(spark, d):
    """Two files with a byte-order mark before the header."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("\ufeffrow_id"), F.col("c_name").alias("front"))
    folders = [_scratch(spark) for _ in range(2)]
    for k, to in enumerate(folders):
        files.write_cards_csv(rows.where(F.col("\ufeffrow_id").cast("bigint") % 2 == k), to)
    return files.read_cards_csv(spark, folders, ["row_id", "front"]).withColumn("row_id", F.col("row_id").cast("bigint"))


@query("SELECT doc_id, source FROM documents")
def src4_json_round_trip(spark, d):
    to = _scratch(spark)
    files.write_targets_json(table(spark, d, "documents").select("doc_id", "source"), to, "source", ["doc_id", "source"])
    return files.read_targets_json(spark, to, "doc_id bigint, source string")


@query("SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 3 = 0 THEN 'cached' ELSE 'recomputed' END AS origin FROM corpus", "corpus")
def src5_text_cache(spark, d):
    docs = corpus(spark, d)
    cache = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("version"))
    return files.through_text_cache(docs, cache, version=2).select("doc_id", F.length("text").alias("n"), "origin")


@query(None)
def src6_upload_intake(spark, d):
    """All files of the folder."""
    return files.classify_uploads(spark, d, magic={"parquet": b"PAR1"}, most_mb=50)


@query("SELECT lang, count(*) AS n, sum(n_chars) AS chars, min(doc_id) AS first FROM documents GROUP BY lang")
def src8_report(spark, d):
    to = _scratch(spark)
    table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first")).write.json(to)
    return spark.read.schema("lang string, n bigint, chars bigint, first bigint").json(to)


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'none' END AS note FROM orders")
def src10_schema_evolution(spark, d):
    o = table(spark, d, "orders")
    new, old = o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("note")), o.where("o_orderkey % 2 <> 0").select("o_orderkey", "o_orderstatus")
    return files.evolve([new, old], {"note": "none"})


@query("SELECT doc_id, source FROM documents WHERE lang IN ('de', 'fr')")
def set7_union_files(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("lang = 'de'").select("doc_id", "source").unionByName(docs.where("lang = 'fr'").select("source", "doc_id"))


@query(
    """WITH d AS (SELECT doc_id AS document_id, doc_id % 50 AS user_id FROM documents), c AS (SELECT o_orderkey AS card_id, o_custkey % 50 AS user_id, o_orderkey % 1000 AS document_id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS synced_at FROM orders),
j AS (SELECT event_id AS job_id, user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'done' WHEN 'click' THEN 'done' WHEN 'signup' THEN 'queued' ELSE 'running' END AS state, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'auth:denied' WHEN 1 THEN 'temporary' ELSE 'odd' END END AS code, ts FROM events WHERE event_id % 7 <> 0 OR event_type = 'error'),
u AS (SELECT DISTINCT user_id FROM events), owned AS (SELECT c.* FROM c JOIN d USING (document_id, user_id)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, job_id DESC) AS k FROM j) WHERE k = 1), a AS (SELECT user_id, arg_min(job_id, (ts, job_id)) AS active_job FROM j WHERE state IN ('queued', 'running') AND job_id % 2 = 0 GROUP BY user_id),
m AS (SELECT u.user_id, coalesce((SELECT count(*) FROM d WHERE d.user_id = u.user_id), 0) AS documents, coalesce((SELECT count(*) FROM owned o WHERE o.user_id = u.user_id), 0) AS cards, coalesce((SELECT count(*) FROM owned o WHERE o.user_id = u.user_id AND synced_at IS NULL), 0) AS pending FROM u)
SELECT m.*, l.job_id AS latest_job, l.state AS latest_state, CASE WHEN l.code LIKE 'auth%' THEN 'auth' WHEN l.code = 'odd' THEN 'other' ELSE l.code END AS latest_error, a.active_job,
CASE WHEN a.active_job IS NOT NULL THEN 'syncing' WHEN l.state = 'failed' THEN 'error' WHEN pending > 0 THEN 'pending' ELSE 'idle' END AS status FROM m LEFT JOIN l USING (user_id) LEFT JOIN a USING (user_id)"""
)
def pip20_sync_status(spark, d):
    """Users of events; their jobs are events, active ones those of even id."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 50).alias("user_id"))
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("card_id"), (F.col("o_custkey") % 50).alias("user_id"), (F.col("o_orderkey") % 1000).alias("document_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("synced_at"))
    e, k = table(spark, d, "events"), F.col("event_type")
    active = F.when(F.col("event_id") % 2 == 0, F.when(k == "signup", "queued").otherwise("running")).otherwise(F.when(k == "signup", "queued_").otherwise("running_"))
    state = F.when(k == "error", "failed").when(k.isin("view", "click"), "done").otherwise(active)
    code = F.when(k == "error", F.when(F.col("event_id") % 3 == 0, "auth:denied").when(F.col("event_id") % 3 == 1, "temporary").otherwise("odd"))
    jobs = e.where((F.col("event_id") % 7 != 0) | (k == "error")).select(F.col("event_id").alias("job_id"), "user_id", state.alias("state"), code.alias("error_code"), F.col("ts").alias("created_at"))
    out = B.sync_status(e.select("user_id").distinct(), c, docs, jobs)
    return out.withColumn("latest_state", F.regexp_replace("latest_state", "_$", ""))


@query("SELECT d.document_id, d.user_id, coalesce(h.n, 0) AS highlight_count FROM (SELECT doc_id AS document_id, doc_id % 50 AS user_id FROM documents) d LEFT JOIN (SELECT l_orderkey % 1000 AS document_id, l_suppkey % 50 AS user_id, count(*) AS n FROM lineitem GROUP BY 1, 2) h USING (document_id, user_id)")
def pip20_documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 50).alias("user_id"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("opened_at"), F.col("n_chars").alias("created_at"))
    highlights = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("document_id"), (F.col("l_suppkey") % 50).alias("user_id"))
    return B.documents_of(docs, highlights).select("document_id", "user_id", "highlight_count")
