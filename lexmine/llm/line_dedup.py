"""Line dedup with overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines that have a word is hashed (to 128 bits). A window's first place
is found by a grouping that Spark combines before it shuffles; the other places of windows that occur
again come from a join that adaptive execution can split where one window is very common. The lines
that such later windows cover are merged per document and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import has_word, let, text_key


def _hashes(at, width: int) -> list[Column]:
    lines = [at(k) for k in range(width)]
    return [F.xxhash64(*lines), F.xxhash64(F.lit(width), *lines[::-1])]


def line_dedup(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's later copies of line windows removed, and new columns ld_lines, ld_removed.

    Lines end at "\\n". Lines without a word stay and take no part. A window's first place is the one
    with the smallest (id, hash of the text, line). Rows equal in id and text count as one document and
    get the same text. Null ids are a value like others (the smallest). A null text stays null with 0
    lines; one with fewer than three lines stays as it is. Columns keep their names and order, whatever they
    are called; only columns named ld_lines or ld_removed give way to the new ones. An empty table gives an
    empty result.
    """
    names = [c for c in docs.columns if c not in ("ld_lines", "ld_removed")]
    docs = docs.select([F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    id_col, text_col = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    plain = (
        docs.select(F.col(id_col).alias("ld_id"), text_key(F.col(text_col)).alias("ld_text"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("ld_all"))
        .withColumn("ld_full", F.filter("ld_all", has_word))
        .where(F.size("ld_full") >= window)
    )
    place = F.struct("ld_id", "ld_text", "ld_at")
    hashed = let(
        F.col("ld_full"),
        lambda full: F.transform(F.sequence(F.lit(0), F.size(full) - window), lambda i: F.struct(*[h.alias(f"h{n}") for n, h in enumerate(_hashes(lambda k: F.get(full, i + k), window))])),
    )
    windows = plain.select("ld_id", "ld_text", F.posexplode(hashed).alias("ld_at", "w")).select("ld_id", "ld_text", "ld_at", "w.*")
    first = windows.groupBy("h0", "h1").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h0", "h1", "first")
    later = windows.join(first, ["h0", "h1"]).where(place != F.col("first"))
    removed = later.groupBy("ld_id", "ld_text").agg(F.collect_set("ld_at").alias("ld_starts"))

    key = text_key(F.col(text_col))
    removed = removed.select(F.col("ld_id").alias("ld_rid"), F.col("ld_text").alias("ld_rtext"), "ld_starts")
    both = docs.join(removed, (docs[id_col].eqNullSafe(F.col("ld_rid"))) & (key == F.col("ld_rtext")), "left")
    parts = both.withColumn("ld_all", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    parts = parts.withColumn("ld_full", F.filter(F.transform("ld_all", lambda x, i: F.when(has_word(x), i)), lambda i: i.isNotNull()))
    covered = F.array_distinct(F.flatten(F.transform(F.coalesce("ld_starts", F.array().cast("array<int>")), lambda p: F.sequence(p, p + (window - 1)))))
    parts = parts.withColumn("ld_gone", let(F.col("ld_full"), lambda full: F.transform(covered, lambda i: F.get(full, i))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("ld_all") - 1), F.col("ld_gone"))
    text = F.concat_ws("\n", let(F.col("ld_all"), lambda lines: F.transform(stay, lambda i: F.get(lines, i))))
    return parts.select(
        *[(F.when(F.col("ld_starts").isNull(), F.col(text_col)).otherwise(text) if c == text_col else F.col(c)).alias(name) for c, name in zip(docs.columns, names, strict=True)],
        F.size("ld_full").cast("long").alias("ld_lines"),
        F.size("ld_gone").cast("long").alias("ld_removed"),
    )
