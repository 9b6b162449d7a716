"""Enrichment of targets behind a content-keyed cache, with validation; clusters by fuzzy likeness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmine.functions import text as T
from lexmine.functions import udfs
from lexmine.functions.fuzzy import Leaders
from lexmine.sources.shared import checkpoint

#: Attempts at a batch; the version that cache keys begin with.
ATTEMPTS, VERSION = 5, "v5"


def cache_key(*parts: Column) -> Column:
    return F.concat(F.lit(f"{VERSION}:"), F.sha2(F.concat_ws("|", *parts), 256))


def latest_cache(cache: DataFrame) -> DataFrame:
    """SRC7. The newest value of each key of this version."""
    return cache.where(F.col("key").startswith(f"{VERSION}:")).groupBy("key").agg(F.max_by("value", "written_at").alias("value"))


def violations(item: Column) -> Column:
    """FIL11. What is wrong with an item (explanation, translations, replacement, alternatives): an array of reasons, empty if nothing is."""
    t, a = item["translations"], item["alternatives"]
    cyrillic = lambda c: c.rlike("[А-Яа-яЁё]")
    once = lambda c: F.size(F.array_distinct(F.transform(c, T.target_key))) == F.size(c)
    rules = {
        "explanation": cyrillic(item["explanation"]),
        "translation_count": F.size(t).between(1, 5),
        "translation_script": F.forall(t, cyrillic),
        "translation_repeats": once(t),
        "translation_mark": ~F.exists(t, lambda x: x.rlike("[.,;:!?]$")),
        "replacement": cyrillic(item["replacement"]),
        "alternative_count": F.size(a) <= 6,
        "alternative_script": F.forall(a, lambda x: x.rlike("[A-Za-z]")),
        "alternative_repeats": once(a),
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def enrich(targets: DataFrame, cache: DataFrame, infer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], good: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """PIP15. targets (id, target, sentence) with value, and the rows to append to the cache (key, value).

    A cached value counts if good(value, target) says so; all if good is None. Only keys without one go to infer
    (key, target, sentence to key, value), each once; nothing is called when all are known. infer retries in
    itself (see retried). What it answered is written down before it is used, so result and cache agree
    and nothing is asked twice. An answer that isn't good has no value and isn't put into the cache.
    """
    fine = (lambda v, t: F.lit(True)) if good is None else good
    keyed = targets.withColumn("key", cache_key(F.col("target"), F.col("sentence")))
    asked = keyed.select("key", "target", "sentence").dropDuplicates(["key"])
    known = checkpoint(asked.select("key", "target").join(latest_cache(cache), "key").where(F.coalesce(fine(F.col("value"), F.col("target")), F.lit(False))).select("key", "value"))
    made = checkpoint(asked.join(known, "key", "left_anti").mapInPandas(infer, "key string, value string"))
    new = made.join(asked.select("key", "target"), "key").where(F.coalesce(fine(F.col("value"), F.col("target")), F.lit(False))).select("key", "value")
    return keyed.join(known.unionByName(new), "key", "left"), new


#: The shape of an item in a model's answer.
ITEM = "explanation string, translations array<string>, replacement string, alternatives array<string>"


def item_of(value: Column) -> Column:
    """FUN36. The item in an answer's text, with or without a code fence around it; null if it isn't one."""
    return F.from_json(T.strip_code_fence(value), ITEM)


def valid_item(value: Column, target: Column) -> Column:
    """Is a value an item without violations (FIL11) whose alternatives don't repeat the target (FIL13, by letters alone)?"""
    item = item_of(value)
    repeats = F.exists(item["alternatives"], lambda a: T.letters_only(a) == T.letters_only(target))
    return item.isNotNull() & (F.size(violations(item)) == 0) & ~F.coalesce(repeats, F.lit(False))


def complete_batches(answers: DataFrame, requests: DataFrame) -> DataFrame:
    """JOI25. Batches (batch, id) of requests whose answers have the same ids, each once: batch, complete."""
    both = requests.groupBy("batch", "id").agg(F.count("*").alias("asked")).join(answers.groupBy("batch", "id").agg(F.count("*").alias("told")), ["batch", "id"], "full")
    return both.groupBy("batch").agg(F.bool_and(F.coalesce((F.col("told") == 1) & F.col("asked").isNotNull(), F.lit(False))).alias("complete"))


def retried(call: Callable[[pd.DataFrame, int], pd.DataFrame], attempts: int = ATTEMPTS):
    """An infer that calls call(batch, attempt) until it returns each key of the batch once, attempts times at most."""

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for attempt in range(1, attempts + 1):
                out = call(batch, attempt)
                if sorted(out["key"]) == sorted(batch["key"]):
                    yield out[["key", "value"]]
                    break
            else:
                raise RuntimeError(f"no complete answer after {attempts} attempts")

    return infer


#: Texts and leaders of a user that meet in one task at most; larger users are dealt over a grid of such blocks.
TEXTS, LEADERS = 5_000, 20_000


def weighted_top(highlights: DataFrame, leaders: DataFrame, cutoff: float = 45.0, limit: int = 5, texts: int = TEXTS, most: int = LEADERS) -> DataFrame:
    """JOI11. For each highlight (highlight_id, user_id, text) the best leaders (cluster_id, leader) of its user by weighted ratio: score descending, id ascending.

    A filtered similarity join: a user's different texts and leaders meet in blocks of `texts` by `most`, and
    inside a block only pairs are scored whose bound can still reach the best ones (functions.fuzzy.Leaders). What
    each block finds is cut to the limit once more. Null or empty texts and leaders match nothing.
    """
    id_kind, user_kind = (df.schema[c].dataType.simpleString() for df, c in ((leaders, "cluster_id"), (leaders, "user_id")))

    def dealt(df: DataFrame, text: str, size: int, own: str) -> tuple[DataFrame, DataFrame]:
        """Different texts of each user with the block they belong to; blocks a user has."""
        one = df.where(F.col(text).isNotNull() & (F.col(text) != "")).groupBy("user_id", F.col(text).alias("text")).agg(F.min("cluster_id" if text == "leader" else "highlight_id").alias("id"))
        blocks = one.groupBy("user_id").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{own}_blocks"))
        return one.join(blocks, "user_id").withColumn(own, F.pmod(F.xxhash64("text"), F.col(f"{own}_blocks")).cast("int")), blocks

    (h, h_blocks), (c, c_blocks) = dealt(highlights, "text", texts, "h"), dealt(leaders, "leader", most, "c")
    h = h.join(c_blocks, "user_id").select("user_id", "text", "h", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)).alias("c"))
    c = c.join(h_blocks, "user_id").select(F.col("user_id").alias("owner"), "text", "id", F.col("c").alias("of"), F.explode(F.sequence(F.lit(0), F.col("h_blocks") - 1)).alias("to"))

    # scoring costs far more than its bytes tell, so blocks are dealt over all partitions, which adaptive plans would merge
    n = int(highlights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    h, c = h.repartition(n, "user_id", "h", "c"), c.repartition(n, "owner", "to", "of")  # names of their own, as both may come from one table

    def meet(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        index = Leaders()
        known = known.sort_values("id")
        for text in known["text"]:
            index.add(text)
        ids = known["id"].tolist()
        out = [(user, text, ids[k], index.texts[k], score) for user, text in zip(asked["user_id"], asked["text"], strict=True) for score, k in index.best(text, cutoff, limit)]
        return pd.DataFrame(out, columns=["user_id", "text", "cluster_id", "leader", "score"])

    pairs = h.groupBy("user_id", "h", "c").cogroup(c.groupBy("owner", "to", "of")).applyInPandas(meet, f"user_id {user_kind}, text string, cluster_id {id_kind}, leader string, score double")
    # a leader's smallest cluster stands for all that have it: back to each of them, and again the best ones of a text
    every = pairs.drop("cluster_id").join(leaders.select("user_id", "leader", "cluster_id"), ["user_id", "leader"])
    w = W.partitionBy("user_id", "text").orderBy(F.desc("score"), "cluster_id")
    every = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return highlights.join(every, ["user_id", "text"]).select("highlight_id", "cluster_id", "leader", "score", "rank")


def fuzzy_top(highlights: DataFrame, leaders: DataFrame, cutoff: float = 45.0, limit: int = 5, score=udfs.weighted_ratio) -> DataFrame:
    """JOI11 by any score: as weighted_top, but all pairs of a user are scored.

    Distinct pairs of texts of a user are scored once; the join is by user, dealt over all partitions, as pairs are far
    more than the bytes of both sides tell, by which files are split and adaptive plans merge tasks or broadcast a side.
    """
    n = int(highlights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    highlights, leaders = highlights.repartition(n, "user_id"), leaders.repartition(n, "user_id").hint("merge")
    pairs = highlights.select("user_id", "text").distinct().join(leaders.select("user_id", "leader").distinct(), "user_id")
    scored = pairs.select("text", "leader").distinct().withColumn("score", score("text", "leader")).where(F.col("score") >= cutoff)
    found = highlights.join(leaders, "user_id").join(scored, ["text", "leader"])
    w = W.partitionBy("highlight_id").orderBy(F.desc("score"), "cluster_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("highlight_id", "cluster_id", "leader", "score", "rank")


def cluster_assign(highlights: DataFrame, leaders: DataFrame, least: float = 80.0, score=udfs.weighted_ratio) -> DataFrame:
    """PIP8. Highlights (highlight_id, user_id, text) with the cluster of the likest leader of their user if it is like enough, else a new one named by the text's hash.

    Equal texts of a user come to the same new cluster, so no order is needed between highlights.
    """
    best = fuzzy_top(highlights, leaders, cutoff=least, limit=1, score=score).select("highlight_id", "cluster_id")
    out = highlights.join(best, "highlight_id", "left")
    return out.select("highlight_id", "user_id", F.coalesce(F.col("cluster_id").cast("string"), F.concat(F.lit("new-"), T.stable_id(F.col("user_id"), F.col("text")))).alias("cluster"), F.col("cluster_id").isNull().alias("is_new"))


def replay_clusters(highlights: DataFrame, cutoff: float = 90.0) -> DataFrame:
    """PIP8, PIP9. Highlights (highlight_id, user_id, text, created_at) assigned in order: each joins the likest cluster of its user, or begins one.

    Each assignment changes what the next one sees, so a user's texts are walked in order; users run side by side.
    Spark sorts them, and a task holds the leaders of one user, not its rows: the state goes from batch to batch.
    A text is scored against leaders only whose bound can beat the best one. Equal texts of a user are taken once.
    """
    kind = highlights.schema["user_id"].dataType
    texts = highlights.groupBy("user_id", "text").agg(F.min(F.struct("created_at", "highlight_id")).alias("first"))
    schema = pa.schema([("user_id", to_arrow_type(kind)), ("text", pa.string()), ("cluster", pa.string())])

    def walk(batches):
        user, index = None, None
        for batch in batches:
            out = []
            for u, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if index is None or u != user:
                    user, index = u, Leaders()
                best = index.best(text, cutoff) if text else []
                if not best:
                    index.add(text or "")
                out.append(index.texts[best[0][1]] if best else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], schema=schema)

    laid = texts.repartition("user_id").sortWithinPartitions("user_id", "first").select("user_id", "text")
    chosen = laid.mapInArrow(walk, f"user_id {kind.simpleString()}, text string, cluster string")
    same = highlights["text"].eqNullSafe(chosen["text"]) & highlights["user_id"].eqNullSafe(chosen["user_id"])
    return highlights.join(chosen, same).select("highlight_id", highlights["user_id"], highlights["text"], "cluster")
