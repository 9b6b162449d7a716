"""Dictionary lookup by word and base forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.operators.notes import ordered_distinct

#: Endings that a base form loses, and what it gets, by part of speech.
DETACHMENTS = [
    ("n", "s", ""), ("n", "ses", "s"), ("n", "ves", "f"), ("n", "xes", "x"), ("n", "zes", "z"), ("n", "ches", "ch"), ("n", "shes", "sh"), ("n", "men", "man"), ("n", "ies", "y"),
    ("v", "s", ""), ("v", "ies", "y"), ("v", "es", "e"), ("v", "es", ""), ("v", "ed", "e"), ("v", "ed", ""), ("v", "ing", "e"), ("v", "ing", ""),
    ("a", "er", ""), ("a", "est", ""), ("a", "er", "e"), ("a", "est", "e"),
]


def lemma_candidates(words: DataFrame, headwords: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """JOI20. (word, lemma): base forms of words that are headwords (word), other than the word itself. exceptions (word, lemma) holds irregular ones."""
    forms = F.array(*[F.when(F.col("word").endswith(end) & (F.length("word") > len(end)), F.concat(F.substr("word", F.lit(1), F.length("word") - len(end)), F.lit(new))) for _, end, new in DETACHMENTS])
    found = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))).alias("lemma"))
    if exceptions is not None:
        found = found.unionByName(exceptions.join(words.select("word").distinct(), "word", "left_semi").select("word", "lemma")).distinct()
    return found.where("lemma <> word").join(headwords.select(F.col("word").alias("lemma")).distinct(), "lemma", "left_semi")


def lookup(words: DataFrame, entries: DataFrame, limit: int = 6) -> DataFrame:
    """PIP16, JOI19. For each word and part of speech its values: those of the word first, then of its base forms, limit at most.

    entries: (word, pos, ord, value).
    """
    keys = words.select("word").distinct().select("word", F.col("word").alias("key"), F.lit(0).alias("far")).unionByName(lemma_candidates(words, entries).select("word", F.col("lemma").alias("key"), F.lit(1).alias("far")))
    found = keys.join(entries.select(F.col("word").alias("key"), "pos", "ord", "value"), "key")
    return ordered_distinct(found.select("word", "pos", "far", "key", "ord", "value"), ["word", "pos"], ["far", "key", "ord"], "value", limit)


def entries_of(pages: DataFrame) -> DataFrame:
    """SRC9. Pages as entries: a title's words as headwords, the text of its p and li elements as values."""
    values = F.regexp_extract_all("html", F.lit("(?i)<(?:p|li)>([^<>]*)</"), F.lit(1))
    title = T.fold(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    rows = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(title, F.lit("[\\p{L}]+"), F.lit(0)))).alias("word"), values.alias("v"))
    return rows.select("page_id", "word", F.posexplode("v").alias("i", "value")).select("word", F.when(F.length("value") % 2 == 0, "noun").otherwise("verb").alias("pos"), (F.col("page_id") * 1000 + F.col("i")).alias("ord"), "value")
