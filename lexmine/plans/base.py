"""The registry of queries, and the roles that the driver's tables play in them.

A role is bound once as a DataFrame and once as SQL (a WITH item), so a query and its SQL twin start
from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmine.functions.text import ABBREVIATIONS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *roles: str):
    """Register a query under its function's name; its SQL follows the roles it names."""

    def keep(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = (("WITH " + ",\n".join(ROLES[r] for r in roles) + "\n") if roles else "") + sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts at once, where many rows are sorted by key.
ROWS = 1_000_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys over so many tasks that each has ROWS or so, however many there are in all; a table's rows are counted from its files' footers."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, -(-rows.count() // ROWS)), *keys)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all languages: doc_id, text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def targets(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """The n most frequent words of six letters or more of the corpus (ties by word): a top-k report, so of bounded size."""
    words = corpus(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("target")).where(F.length("target") >= 6)
    return words.groupBy("target").count().orderBy(F.desc("count"), "target").limit(n).select("target")


def _line_id():
    """Line numbers repeat within an order here, so a line is named by part and supplier too."""
    return F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey") % 1000 * 10 + F.col("l_linenumber")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cards."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("card_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 40).alias("document_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "O").alias("current"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("exported_at"), F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]", "").alias("target"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as notes with schedules."""
    return table(spark, sf_dir, "lineitem").select(
        _line_id().alias("note_id"), F.col("l_orderkey").alias("card_id"), F.when(F.col("l_linenumber") % 2 == 0, "meaning").otherwise("recall").alias("direction"), (F.col("l_suppkey") % 7).alias("deck_id"),
        F.col("l_partkey").alias("due"), F.col("l_quantity").cast("long").alias("ivl"), (F.col("l_suppkey") % 10).alias("reps"), (F.col("l_suppkey") % 3).alias("lapses"), F.concat(F.lit("card::"), F.col("l_orderkey").cast("string"), F.lit(" direction::"), F.when(F.col("l_linenumber") % 2 == 0, "meaning").otherwise("recall"), F.lit(" "), F.lower("l_returnflag")).alias("tags"),
    )


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rectangles of highlights, made by a reader or imported; a thousand orders' keys are a document."""
    return table(spark, sf_dir, "lineitem").select(
        _line_id().alias("highlight_id"), F.expr("l_orderkey div 1000").alias("document_id"), (1 + F.col("l_suppkey") % 5).alias("page"), F.when(F.col("l_returnflag") == "N", "reader").otherwise("pdf_import").alias("source"), F.concat(F.lit("w"), (F.col("l_partkey") % 3).cast("string")).alias("target"),
        (F.col("l_partkey") * 7 % 480).cast("double").alias("x1"), (F.col("l_suppkey") * 11 % 700).cast("double").alias("y1"), ((F.col("l_partkey") * 7 % 480) + 20 + F.col("l_quantity")).cast("double").alias("x2"), ((F.col("l_suppkey") * 11 % 700) + 12).cast("double").alias("y2"), F.col("l_shipdate").alias("created_at"),
    )


#: White space and digits as Python knows them, for the regular expressions of DuckDB.
_SPACE, _DIGIT = r"[\s\v\x1c-\x1f\x{85}\p{Z}]", r"[\p{Nd}²³¹⁰⁴-⁹₀-₉፩-፱᧚①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒𐩀-𐩃𐹠-𐹨𑁒-𑁚🄀-🄊]"

#: The roles in SQL.
ROLES = {
    "corpus": "corpus AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "targets": """targets AS (SELECT target FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS target FROM corpus) WHERE length(target) >= 6 GROUP BY target ORDER BY count(*) DESC, target LIMIT 20)""",
    "cards": """cards AS (SELECT o_orderkey AS card_id, o_custkey AS user_id, o_orderkey % 40 AS document_id, o_orderdate AS created_at, o_orderstatus = 'O' AS current,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS exported_at, regexp_replace(lower(o_orderpriority), '[^a-z]', '', 'g') AS target FROM orders)""",
    "notes": """notes AS (SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey % 1000 * 10 + l_linenumber AS note_id, l_orderkey AS card_id, CASE WHEN l_linenumber % 2 = 0 THEN 'meaning' ELSE 'recall' END AS direction, l_suppkey % 7 AS deck_id,
  l_partkey AS due, CAST(l_quantity AS BIGINT) AS ivl, l_suppkey % 10 AS reps, l_suppkey % 3 AS lapses,
  'card::' || l_orderkey || ' direction::' || CASE WHEN l_linenumber % 2 = 0 THEN 'meaning' ELSE 'recall' END || ' ' || lower(l_returnflag) AS tags FROM lineitem)""",
    "rects": """rects AS (SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey % 1000 * 10 + l_linenumber AS highlight_id, l_orderkey // 1000 AS document_id, 1 + l_suppkey % 5 AS page, CASE WHEN l_returnflag = 'N' THEN 'reader' ELSE 'pdf_import' END AS source, 'w' || (l_partkey % 3) AS target,
  CAST(l_partkey * 7 % 480 AS DOUBLE) AS x1, CAST(l_suppkey * 11 % 700 AS DOUBLE) AS y1, CAST(l_partkey * 7 % 480 + 20 + l_quantity AS DOUBLE) AS x2, CAST(l_suppkey * 11 % 700 + 12 AS DOUBLE) AS y2, l_shipdate AS created_at FROM lineitem)""",
    # A piece is text up to a run of marks (and what closes it). A run ends nothing if it begins with a colon without "name =" after it,
    # parts a letter or digit from a digit, or ends an abbreviation, which begins after a space or a sentence's end. So of abbreviations
    # that follow each other without a space every second one is such (chained: the opposite of the run before).
    "sentences": rf"""squeezed AS (SELECT doc_id, trim(regexp_replace(text, '[\s\v]+', ' ', 'g')) AS s FROM corpus),
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_extract_all(s, '[^.!?:]*[.!?:]+["''”’)\]}}]*|[^.!?:]+') AS p FROM squeezed)),
cut_ AS (SELECT doc_id, k, piece, regexp_extract(piece, '^([^.!?:]*)([.!?:]*)(.*)$', ['body', 'run', 'closers'], 's') AS c, coalesce(lead(piece) OVER (PARTITION BY doc_id ORDER BY k), '') AS after FROM pieces),
run_ AS (SELECT *, c.body AS body, c.run || c.closers AS run, contains(c.body, ' ') OR k = 1 AS fresh, replace(replace(replace(replace(lower(regexp_extract(c.body, '[^ ]*$')), 'ſ', 's'), 'ﬁ', 'fi'), 'ﬅ', 'st'), 'ﬆ', 'st') AS word FROM cut_),
told AS (SELECT *, run <> '' AND NOT (starts_with(run, ':') AND NOT regexp_matches(after, '^{_SPACE}*[\p{{L}}\p{{N}}_-]{{1,30}}{_SPACE}*=')) AND NOT (length(run) = 1 AND regexp_matches(body, '[\p{{L}}\p{{N}}]$') AND regexp_matches(after, '^{_DIGIT}')) AS may_end,
  starts_with(run, '.') AND list_contains({[x[:-1] for x in ABBREVIATIONS if x.count(".") == 1]}, word) AS short,
  starts_with(run, '.') AND NOT fresh AND lag(run) OVER o = '.' AND list_contains({[x[:-1] for x in ABBREVIATIONS if x.count(".") == 2 and x[:2] in ABBREVIATIONS]}, lag(word) OVER o || '.' || word) AS dotted FROM run_ WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
linked AS (SELECT *, may_end AND short AND NOT fresh AND NOT dotted AS chained, may_end AND NOT dotted AND NOT short AS plain_end FROM told),
anchored AS (SELECT *, max(CASE WHEN NOT chained THEN 2 * k + CASE WHEN plain_end THEN 1 ELSE 0 END END) OVER (PARTITION BY doc_id ORDER BY k) AS anchor FROM linked),
ended_ AS (SELECT doc_id, k, piece, CASE WHEN (anchor % 2 + k - anchor // 2) % 2 = 1 THEN 1 ELSE 0 END AS ends FROM anchored),
numbered AS (SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY k) - ends AS n FROM ended_),
parts AS (SELECT doc_id, n, string_agg(piece, '' ORDER BY k) AS part FROM numbered GROUP BY doc_id, n),
sentences AS (SELECT doc_id, trim(part) AS sentence, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS sent_id FROM parts WHERE trim(part) <> '')""",
}
ROLES["words"] = """raw_words AS (SELECT doc_id, sent_id, sentence, regexp_extract_all(sentence, '[A-Za-z]+|[^A-Za-z\\s]+|\\s+') AS t FROM sentences),
tokens AS (SELECT doc_id, sent_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM raw_words),
words AS (SELECT doc_id, sent_id, pos, CAST(sum(length(token)) OVER (PARTITION BY doc_id, sent_id ORDER BY pos) - length(token) AS BIGINT) AS start, token FROM tokens QUALIFY regexp_matches(token, '^[A-Za-z]+$'))""".replace("\\\\", "\\")
