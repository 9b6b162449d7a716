"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, single spaces, trimmed) and hashed; for each host the distinct
documents that hold a line are counted, copies of one text once. A line above the host's limit is
boilerplate. A document fails if its base figures are bad, or if too little is left without such lines.
clean() returns the documents that pass, with the lines above the limit removed from their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import SPACES, checkpoint, has_word, let, text_key, words

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Common lines of all hosts (8 bytes each) up to which clean() broadcasts them.
BROADCAST_LINES = 100_000


def _covered_by_repeats(w: Column, width: int = 3) -> Column:
    """How many words lie in a window of width words that the text holds twice or more."""
    hashed = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - width), lambda i: F.struct(F.xxhash64(*[F.get(v, i + k) for k in range(width)]).alias("h"), i.alias("p")))
    windows = let(w, lambda v: F.when(F.size(v) >= width, hashed(v)).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    repeated = let(F.sort_array(windows), lambda s: F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["p"])), lambda p: p.isNotNull()))
    return F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda p: F.sequence(p, p + (width - 1))))))


def _bad(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def base_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("q_words", words(text)).withColumn("q_lines", F.filter(F.split(text, "\n"), has_word))
    out = out.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
            "n_repeat_words": _covered_by_repeats(F.col("q_words")).cast("long"),
        }
    ).drop("q_words", "q_lines")
    return out.withColumn("base_failed", _bad(F.col("n_words"), F.col("n_repeat_words")))


def _normal(line: Column) -> Column:
    return F.xxhash64(F.array_join(words(F.lower(line)), " "))


def _common(rows: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(q_at host, q_common hash of a line above the host's limit) from rows with q_host, q_key, q_text."""
    lines = F.filter(F.split(F.col("q_text"), "\n"), has_word)
    texts = rows.groupBy("q_host").agg(F.count_distinct("q_key").alias("q_texts"))
    held = rows.select("q_host", "q_key", F.explode(F.array_distinct(F.transform(lines, _normal))).alias("q_line")).distinct().groupBy("q_host", "q_line").count().where(F.col("count") > least_docs)
    return held.join(texts, held["q_host"].eqNullSafe(texts["q_host"])).where(F.col("count") > share * F.col("q_texts")).select(held["q_host"].alias("q_at"), F.col("q_line").alias("q_common"))


def clean(docs: DataFrame, host_col: str = "source", least_docs: int = 20, share: float = 0.1, left_percent: int = 50, text_col: str = "text") -> DataFrame:
    """The rows of docs that quality() keeps, without the lines above their host's limit; other columns stay as they are.

    The figures that decide are those of the whole text. Lines without a word stay. Every row is judged
    by its own text, whatever its id. Columns keep their names and order, whatever they are called.
    """
    names = docs.columns
    docs = docs.select([F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    host_col, text_col = f"c{names.index(host_col)}", f"c{names.index(text_col)}"
    rows = docs.select(F.col(host_col).alias("q_host"), F.coalesce(F.col(text_col), F.lit("")).alias("q_text")).withColumn("q_key", text_key(F.col("q_text")))
    sets = checkpoint(_common(rows, least_docs, share).groupBy("q_at").agg(F.collect_set("q_common").alias("q_set")))
    few = (sets.agg(F.sum(F.size("q_set"))).first()[0] or 0) <= BROADCAST_LINES
    out = docs.join(F.broadcast(sets) if few else sets, docs[host_col].eqNullSafe(sets["q_at"]), "left")
    lines = F.split(text_col, "\n")
    common = lambda x: has_word(x) & F.array_contains("q_set", _normal(x))
    gone = F.when(F.col("q_set").isNull(), 0).otherwise(F.aggregate(F.filter(lines, common), F.lit(0), lambda n, x: n + F.size(words(x))))
    # One expression, as Spark would compute columns that a filter uses once for every use.
    kept = let(words(F.col(text_col)), lambda w: ~_bad(F.size(w), _covered_by_repeats(w)) & (100 * (F.size(w) - gone) >= left_percent * F.size(w)))
    text = F.when(F.col("q_set").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda x: ~common(x)), "\n"))
    return out.where(kept).select(*[(text if c == text_col else docs[c]).alias(name) for c, name in zip(docs.columns, names, strict=True)])


def quality(docs: DataFrame, host_col: str = "source", least_docs: int = 20, share: float = 0.1, left_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the base figures, base_failed, n_boilerplate (words on lines above the limit), kept.

    A host's line is above the limit if over max(least_docs, share * the host's distinct texts)
    distinct texts of the host hold it. kept is false if base_failed, or if less than left_percent of
    the words are left without such lines. A null text counts as empty (so base_failed); a null host is
    a host of its own; null ids and repeated rows are judged like others, a repeated text counting once.
    Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("q_id"), F.col(host_col).alias("q_host"), F.coalesce(F.col(text_col), F.lit("")).alias("q_text"))
    rows = rows.withColumn("q_key", text_key(F.col("q_text")))
    lines = F.filter(F.split(F.col("q_text"), "\n"), has_word)
    common = _common(rows, least_docs, share)

    placed = rows.select("q_id", "q_host", "q_key", F.explode(F.transform(lines, lambda x: F.struct(_normal(x).alias("h"), F.size(words(x)).alias("n")))).alias("q_l"))
    gone = (
        placed.join(common, placed["q_host"].eqNullSafe(common["q_at"]) & (placed["q_l.h"] == common["q_common"]), "left_semi")
        .groupBy("q_id", "q_key", "q_host").agg(F.sum("q_l.n").alias("q_sum"), F.count("*").alias("q_n"))
    )
    times = rows.groupBy("q_id", "q_key", "q_host").agg(F.count("*").alias("q_times"))
    figures = base_figures(rows.select("q_id", "q_host", "q_key", "q_text"), "q_text").drop("q_text")
    gone = gone.join(times, [gone[c].eqNullSafe(times[c]) for c in ("q_id", "q_key", "q_host")]).select(*[gone[c].alias(f"g{c}") for c in ("q_id", "q_key", "q_host")], (F.col("q_sum") / F.col("q_times")).cast("long").alias("q_gone"))
    out = figures.join(gone, [figures[c].eqNullSafe(gone[f"g{c}"]) for c in ("q_id", "q_key", "q_host")], "left")
    left = 100 * (F.col("n_words") - F.coalesce("q_gone", F.lit(0))) >= left_percent * F.col("n_words")
    return out.select(F.col("q_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("q_gone", F.lit(0)).cast("long").alias("n_boilerplate"), (~F.col("base_failed") & left).alias("kept"))
