"""Assigning highlights to sense clusters: candidates, examples, a chooser, and what that changes in cards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.operators.enrich import retried, weighted_top
from lexmine.operators.notes import first_by, ordered_distinct
from lexmine.sources.shared import checkpoint

#: Candidates of a highlight, examples of a candidate, translations of a card at most; the ratio that the default chooser takes.
CANDIDATES, EXAMPLES, TRANSLATIONS, LEAST = 5, 5, 8, 80.0
#: What a chooser answers: the candidate's cluster (null or unknown: a new one), a leader for a new one, translations.
CHOICE = "cluster_id string, leader string, translations array<string>"


def cluster_examples(cards: DataFrame, links: DataFrame, contexts: DataFrame, limit: int = EXAMPLES) -> DataFrame:
    """AGG16. cards (card_id, target, sentence) with examples, an array of (highlight, context) of one to limit.

    Linked highlights (card_id, target, sentence, created_at) come first, by time, then stored contexts (card_id,
    place, target, sentence), each pair of words once (blind to case and white space); a card without any has itself.
    """
    shape = lambda df, kind, at: df.select("card_id", F.lit(kind).alias("kind"), at.cast("string").alias("at"), T.normalize_selection(F.col("target")).alias("highlight"), T.squeeze(F.col("sentence")).alias("context"))
    number = lambda c: F.lpad(c.cast("string"), 20, "0")
    rows = shape(links, 0, F.date_format("created_at", "yyyyMMddHHmmssSSSSSS")).unionByName(shape(contexts, 1, number(F.col("place"))))
    rows = rows.where("highlight <> '' AND context <> ''").unionByName(shape(cards, 2, F.lit("")))
    once = rows.groupBy("card_id", "highlight", T.fold(F.col("context")).alias("said")).agg(F.min(F.struct("kind", "at", "highlight", "context")).alias("e"))
    w = W.partitionBy("card_id").orderBy("e")
    kept = once.withColumn("n", F.row_number().over(w)).where((F.col("n") <= limit) & ((F.col("e.kind") < 2) | (F.col("n") == 1)))
    listed = kept.groupBy("card_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["highlight"].alias("highlight"), e["context"].alias("context"))).alias("examples"))
    return cards.join(listed, "card_id", "left_semi").select("card_id", "target", "sentence").join(listed, "card_id")


def requests(highlights: DataFrame, cards: DataFrame, examples: DataFrame) -> DataFrame:
    """What a chooser is asked for each highlight (highlight_id, user_id, target, sentence): key, text, target, sentence, candidates.

    Candidates are the best cards (card_id, user_id, target) of the user by weighted ratio (JOI11) with their examples
    (AGG16), best first, as JSON (cluster_id, leader, score, examples). Equal questions have one key.
    """
    named = highlights.withColumn("text", T.normalize_selection(F.col("target")))
    leaders = cards.select("user_id", F.col("card_id").alias("cluster_id"), T.normalize_selection(F.col("target")).alias("leader"))
    best = weighted_top(named.select("highlight_id", "user_id", "text"), leaders, limit=CANDIDATES)
    shown = best.join(examples.select(F.col("card_id").alias("cluster_id"), "examples"), "cluster_id", "left")
    listed = shown.groupBy("highlight_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cluster_id", "leader", "score", "examples"))).alias("c"))
    listed = listed.select("highlight_id", F.transform("c", lambda c: F.struct(c["cluster_id"].alias("cluster_id"), c["leader"].alias("leader"), c["score"].alias("score"), c["examples"].alias("examples"))).alias("c"))
    out = named.join(listed, "highlight_id", "left").withColumn("candidates", F.coalesce(F.to_json("c"), F.lit("[]")))
    key = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "text", T.squeeze(F.col("sentence")), "candidates"), 256)
    return out.withColumn("key", key).drop("c")


def default_choice(candidates, text):
    """The best candidate if it is like enough, else a new cluster named by the text; no translations."""
    first = F.get(F.from_json(candidates, "array<struct<cluster_id string, score double>>"), 0)
    return F.to_json(F.struct(F.when(first["score"] >= LEAST, first["cluster_id"]).alias("cluster_id"), text.alias("leader"), F.array().cast("array<string>").alias("translations")))


def assign_clusters(highlights: DataFrame, cards: DataFrame, links: DataFrame, contexts: DataFrame, chooser: Callable[[pd.DataFrame, int], pd.DataFrame] | None = None) -> dict[str, DataFrame]:
    """PIP8. Assign highlights (highlight_id, user_id, target, sentence, created_at) to cards (card_id, user_id, target, sentence, translations).

    links (card_id, target, sentence, created_at) and contexts (card_id, place, context_id, target, sentence) are what
    cards have so far. chooser takes a batch (key, text, target, sentence, candidates) and the number of the attempt,
    and answers (key, value), value a JSON object of CHOICE; a batch whose keys don't come back each once is asked
    again. Each key is asked once, answers are written down before they are used. Without a chooser the best
    candidate of 80 or more is taken. A choice that isn't among the candidates makes a new card, named by the
    user and the leader, so equal leaders make one card.

    Returns assigned (highlight_id, card_id, is_new), contexts to add (none whose sentence or id the card has
    already, the first of equal ones), and cards that change: with merged translations (old first, eight at
    most, blind to case), new ones with the first highlight's sentence.
    """
    asked = checkpoint(requests(highlights, cards, cluster_examples(cards, links, contexts)))
    once = asked.select("key", "text", "target", "sentence", "candidates").dropDuplicates(["key"])
    if chooser is None:
        answers = once.select("key", default_choice(F.col("candidates"), F.col("text")).alias("value"))
    else:
        ask = retried(chooser)

        def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from ask(batches)

        answers = once.mapInPandas(infer, "key string, value string")
    answers = checkpoint(answers.select("key", F.from_json("value", CHOICE).alias("choice")))
    told = asked.join(answers, "key").withColumn("known", F.transform(F.from_json("candidates", "array<struct<cluster_id string>>"), lambda c: c["cluster_id"]))
    chosen = F.array_contains("known", F.col("choice.cluster_id"))
    named = T.normalize_selection(F.coalesce(F.col("choice.leader"), F.lit("")))
    leader = F.when(named != "", named).otherwise(F.col("text"))
    fresh = F.concat(F.lit("new-"), T.stable_id(F.col("user_id").cast("string"), leader))
    is_new = ~F.coalesce(chosen, F.lit(False))
    told = checkpoint(told.select("highlight_id", "user_id", "target", "sentence", "created_at", leader.alias("leader"), is_new.alias("is_new"), F.when(is_new, fresh).otherwise(F.col("choice.cluster_id")).alias("card_id"), F.col("choice.translations").alias("translations")))

    said = T.fold(T.squeeze(F.col("sentence")))
    new = first_by(told.select("card_id", F.col("highlight_id").cast("string").alias("context_id"), "target", "sentence", "created_at", said.alias("said")), ["card_id", "said"], ["created_at", "context_id"])
    old = contexts.select(F.col("card_id").cast("string").alias("card_id"), F.col("context_id").cast("string").alias("context_id"), said.alias("said"))
    added = new.join(old.select("card_id", "said").distinct(), ["card_id", "said"], "left_anti").join(old.select("card_id", "context_id").distinct(), ["card_id", "context_id"], "left_anti")

    touched = told.select("card_id").distinct()
    before = cards.select(F.col("card_id").cast("string").alias("card_id"), F.posexplode("translations").alias("place", "translations")).join(touched, "card_id", "left_semi")
    after = told.select("card_id", F.lit(1).alias("late"), F.date_format("created_at", "yyyyMMddHHmmssSSSSSS").alias("at"), F.col("highlight_id").cast("string").alias("by"), F.posexplode("translations").alias("place", "translations"))
    every = before.select("card_id", F.lit(0).alias("late"), F.lit("").alias("at"), F.lit("").alias("by"), "place", "translations").unionByName(after)
    merged = ordered_distinct(every, ["card_id"], ["late", "at", "by", "place"], "translations", TRANSLATIONS)
    made = first_by(told.where("is_new"), ["card_id"], ["created_at", "highlight_id"]).select("card_id", "user_id", F.col("leader").alias("target"), "sentence", F.lit(True).alias("is_new"))
    kept = cards.select(F.col("card_id").cast("string").alias("card_id"), "user_id", "target", "sentence", F.lit(False).alias("is_new")).join(touched, "card_id", "left_semi")
    changed = kept.unionByName(made).join(merged, "card_id", "left").withColumn("translations", F.coalesce("translations", F.array().cast("array<string>")))
    return {"assigned": told.select("highlight_id", "card_id", "is_new"), "contexts": added.select("card_id", "context_id", "target", "sentence"), "cards": changed}
