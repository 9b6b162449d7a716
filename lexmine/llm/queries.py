"""The text operators as queries over a folder of tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmine.llm import bpe, conversation_repair, conversation_trie, decontaminate, line_dedup, lm, quality, simhash, substring_dedup, suffix_dedup, token_counts, toxicity, warc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), digest=True)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    out = lm.lm_scores(table(spark, sf_dir, "documents"), ~held_out, WORD_BPE)
    return out.withColumn("held_out", held_out)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.toxicity(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repairs(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_line_dedup": op2_line_dedup,
        "op3_bpe": op3_bpe,
        "op4_token_counts": op4_token_counts,
        "op5_quality": op5_quality,
        "op6_language_model": op6_language_model,
        "op7_decontamination": op7_decontamination,
        "op8_simhash": op8_simhash,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_warc": op12_warc,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": SUBSTRING_DEDUP_SQL, "op2_line_dedup": LINE_DEDUP_SQL, "op5_quality": QUALITY_SQL, "op11_conversation_trie": CONVERSATION_TRIE_SQL, "op12_warc": WARC_SQL}


LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, k, n, line || chr(10) || b || chr(10) || c AS win FROM (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id) AS n, line, lead(line, 1) OVER (PARTITION BY doc_id ORDER BY k) AS b, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM f) WHERE c IS NOT NULL),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS o FROM w) WHERE o > 1),
g AS (SELECT DISTINCT doc_id, k + d.d AS k FROM r, (VALUES (0), (1), (2)) d(d)),
a AS (SELECT l.doc_id, l.p, l.line, f.k, g.k IS NOT NULL AS gone FROM l LEFT JOIN f ON l.doc_id = f.doc_id AND l.p = f.p LEFT JOIN g ON f.doc_id = g.doc_id AND f.k = g.k)
SELECT doc_id, count(k) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM a GROUP BY doc_id
"""

QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
g AS (SELECT doc_id, p, word || ' ' || b || ' ' || c AS tri FROM (SELECT doc_id, p, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE c IS NOT NULL),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT p + d) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) d(d) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM t),
f AS (SELECT doc_id, source, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY doc_id),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM t GROUP BY source),
held AS (SELECT f.source, f.h, count(DISTINCT t.text) AS n FROM f JOIN t ON f.doc_id = t.doc_id GROUP BY f.source, f.h),
common AS (SELECT held.source, held.h FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE held.n > 20 AND held.n > 0.1 * hosts.n),
b AS (SELECT f.doc_id, sum(f.n) AS n FROM f JOIN common c ON f.source IS NOT DISTINCT FROM c.source AND f.h = c.h GROUP BY f.doc_id),
o AS (SELECT t.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dl.n_dup_lines, 0) AS n_dup_lines, coalesce(rw.n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_boilerplate
  FROM t JOIN w ON t.doc_id = w.doc_id LEFT JOIN dl ON t.doc_id = dl.doc_id LEFT JOIN rw ON t.doc_id = rw.doc_id LEFT JOIN b ON t.doc_id = b.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND 100 * (n_words - n_boilerplate) >= 50 * n_words AS kept FROM v
"""

SUBSTRING_DEDUP_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
s AS (SELECT w.doc_id, g.p, md5(array_to_string(ws[g.p : g.p + 19], ' ')) AS win FROM w, (SELECT unnest(range(1, (SELECT max(len(ws)) FROM w) + 1)) AS p) g WHERE g.p + 19 <= len(ws)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS o FROM s) WHERE o > 1),
e AS (SELECT doc_id, p, max(r) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM (SELECT x.doc_id, x.p, r.p AS r FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.p = r.p)),
k AS (SELECT x.doc_id, x.p, x.word, coalesce(e.last + 19 >= x.p, false) AS gone FROM x JOIN e ON x.doc_id = e.doc_id AND x.p = e.p)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, count(k.p) FILTER (k.gone) AS n_removed, sha256(coalesce(string_agg(k.word, ' ' ORDER BY k.p) FILTER (NOT k.gone), '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id GROUP BY w.doc_id, w.ws
"""

#: CRC-32 of an id's decimal text; t: turns in order, q: rebuilt ones; a node's subtree is reached by the conversation that names it.
CONVERSATION_TRIE_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda acc, v: list_reduce(list_prepend(xor(acc, v), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
q AS (SELECT c.conv_id, 0 AS part, t.j, t.r, t.x FROM c JOIN t ON t.conv_id = c.base AND t.j <= c.h UNION ALL SELECT c.conv_id, 1, t.j, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.j > c.h),
k AS (SELECT conv_id, row_number() OVER w AS d, md5(string_agg(md5(r) || md5(x), '') OVER w) AS key, strlen(x) AS bytes FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY part, j)),
p AS (SELECT conv_id, d, key, bytes FROM k UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT p.d, p.key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id) m USING (conv_id, d) GROUP BY p.d, p.key),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS own FROM p GROUP BY d, key),
l AS (SELECT n.*, a.key AS parent_key FROM n LEFT JOIN p a ON a.conv_id = n.conv_id AND a.d = n.d - 1),
f AS (SELECT d - 1 AS d, parent_key AS key, count(*) AS n_children FROM l WHERE d > 0 GROUP BY 1, 2),
s AS (SELECT a.d, a.key, count(*) FILTER (f.key IS NULL) AS n_leaves, CAST(sum(n.own) AS BIGINT) AS saved_tokens FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d LEFT JOIN f ON f.d = n.d AND f.key = n.key GROUP BY a.d, a.key)
SELECT l.conv_id, l.d AS depth, u.conv_id AS parent_conv_id, l.n_convs, coalesce(f.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM l JOIN s ON s.d = l.d AND s.key = l.key LEFT JOIN n u ON u.d = l.d - 1 AND u.key = l.parent_key LEFT JOIN f ON f.d = l.d AND f.key = l.key LEFT JOIN e ON e.d = l.d AND e.key = l.key
"""

WARC_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r IS NULL THEN 'response' ELSE 'revisit' END AS record_type, r AS refers_to FROM (
  SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 THEN nullif(min(page_id) OVER (PARTITION BY h), coalesce(page_id, min(page_id) OVER (PARTITION BY h) - 1)) END AS r
  FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
