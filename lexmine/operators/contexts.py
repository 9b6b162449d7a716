"""Choosing example contexts of targets: scores, readable ones, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.operators import concordance as C

#: Candidates of a document taken before any filter, sent to approval, kept for a target, and of these from one document.
PER_DOCUMENT, APPROVAL, KEPT, KEPT_PER_DOCUMENT = 6, 14, 4, 2


def score(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """found with readable, words, anchor_words and score (FUN34); anchors (target, anchor) has the known text of a target."""
    own = F.array(F.lower("target")) if "target_words" not in found.columns else F.col("target_words")
    both = found.join(anchors, "target").withColumn("words", T.content_words(F.col("sentence"), own)).withColumn("anchor_words", T.content_words(F.col("anchor"), own))
    return both.withColumn("readable", T.is_readable(F.col("sentence"))).withColumn("score", T.context_score(F.col("target"), F.col("anchor_words"), F.col("words")))


def cap(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key in an order. Spark prunes inside each task before it shuffles."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def candidates(scored: DataFrame) -> DataFrame:
    """WIN9, FIL3 and WIN11: six of a document first, then readable ones with a score, then the best fourteen of a target."""
    first = cap(scored, ["target", "doc_id"], ["sent_id", "place"], PER_DOCUMENT).where("readable AND score IS NOT NULL")
    return cap(first, ["target"], [F.desc("score"), "doc_id", "sent_id", "place"], APPROVAL)


def two_caps(rows: DataFrame) -> DataFrame:
    """WIN10: two of a document, then four of a target, best scores first. Equal to a walk with both caps."""
    inner = cap(rows, ["target", "doc_id"], [F.desc("score"), "sent_id", "place"], KEPT_PER_DOCUMENT)
    return cap(inner, ["target"], [F.desc("score"), "doc_id", "sent_id", "place"], KEPT)


def mine(scored: DataFrame, approved: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """PIP5. Contexts to keep. approved (doc_id): only those (strict), or those first."""
    rows = candidates(scored)
    if approved is None:
        return two_caps(rows)
    if strict:
        return two_caps(rows.join(approved.distinct(), "doc_id", "left_semi"))
    marked = rows.join(approved.distinct().withColumn("_ok", F.lit(True)), "doc_id", "left").withColumn("score", F.col("score") + F.when(F.col("_ok"), 1000).otherwise(0))
    return two_caps(marked).withColumn("score", F.when(F.col("_ok"), F.col("score") - 1000).otherwise(F.col("score"))).drop("_ok")


def refresh(sents: DataFrame, targets: DataFrame, anchors: DataFrame, retained: DataFrame, approved: DataFrame | None = None, strict: bool = True, **how) -> DataFrame:
    """PIP5. The contexts of each target after a round of mining: (target, id, sentence, is_new).

    Literal occurrences (PIP3) and variant forms (PIP4, with how) are scored against the known text of their
    target, capped, checked for readability and approval (WIN9, FIL3, WIN11, WIN10), and added to the retained
    ones (target, id, sentence), which stay (SET2). A target without a new row is unchanged, so a second
    round with the first one's result changes nothing.
    """
    exact = C.concordance(sents, sents, targets)
    variants = C.variant_concordance(sents, targets, **how).select(exact.columns)
    both = exact.unionByName(variants).dropDuplicates(["target", "id"])
    chosen = mine(score(both, anchors), approved, strict).select("target", "id", "sentence")
    new = chosen.join(retained.select("target", "id"), ["target", "id"], "left_anti")
    return retained.select("target", "id", "sentence", F.lit(False).alias("is_new")).unionByName(new.select("target", "id", "sentence", F.lit(True).alias("is_new")))
