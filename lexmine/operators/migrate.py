"""Moving a deck to sense clusters: contexts from notes, which highlight each belongs to, and what becomes of every note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.operators import notes as N
from lexmine.operators.text import unescape_texts
from lexmine.sources.shared import checkpoint

_BREAK, _BOLD, _WHOLE = "(?i)<br\\s*/?>", "(?is)<b\\b[^>]*>(.*?)</b>", "(?is)<b\\b[^>]*>.*?</b>"
_HINT = "(?is)<br\\s*/?><small>.*?</small>\\s*$"
_FIELD, _PART = "\x01", "\x02"
TRANSLATIONS = 8


def context_key(c: Column) -> Column:
    """A context's text without case, extra spaces, and spaces before closing marks or after opening ones."""
    v = F.regexp_replace(T.squeeze(T.fold(c)), "\\s+([,.;:!?%)\\]])", "$1")
    return F.regexp_replace(v, "([(\\[])\\s+", "$1")


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt by key over all partitions: patterns cost far more than the bytes of a row tell, by which files are split and adaptive plans merge tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def note_contexts(notes: DataFrame) -> DataFrame:
    """FIL14, FUN15, FUN16, FUN9. What notes (note_id, front, back, tags) say: note_id, direction, target, sentence, replacement, translations, source.

    A meaning note's target is its first bold words, its translations are the lines of its back; a recall note's
    target is its back, and its bold words the replacement. Others, and notes without target or sentence, have no row.
    """
    plain = lambda c: T.squeeze(T.strip_tags(F.regexp_replace(c, _BREAK, " "), " "))
    front, back = F.coalesce(F.col("front"), F.lit("")), F.coalesce(F.col("back"), F.lit(""))
    clean = F.regexp_replace(front, _HINT, "")
    meaning, whole = F.col("direction") == "meaning", F.regexp_extract(clean, _WHOLE, 0)
    at = F.instr(clean, whole)
    shown = F.concat(F.substr(clean, F.lit(1), at - 1), plain(back), F.substr(clean, at + F.length(whole)))
    rows = _spread(notes.select("note_id", "front", "back", "tags"), "note_id").withColumn("direction", N.direction_of(F.col("tags"))).where(F.col("direction").isNotNull() & F.when(F.col("direction") == "meaning", front).otherwise(clean).rlike(_BOLD))
    said = F.concat_ws(
        _FIELD,
        F.when(meaning, plain(F.regexp_extract(front, _BOLD, 1))).otherwise(plain(back)),
        F.when(meaning, plain(front)).otherwise(plain(shown)),
        F.when(meaning, "").otherwise(plain(F.regexp_extract(clean, _BOLD, 1))),
        F.when(meaning, F.array_join(F.transform(F.split(back, _BREAK), plain), _PART)).otherwise(""),
    )
    labels = F.array_sort(F.filter(N.tag_list(F.coalesce("tags", F.lit(""))), lambda t: t.startswith("article::") | t.startswith("page::")))
    source = F.when(F.size(labels) > 0, F.array_join(labels, " · ")).otherwise("original_deck")
    made = checkpoint(rows.select("note_id", "direction", said.alias("said"), source.alias("source")))  # read more than once below, made by many patterns
    told = unescape_texts(made, "said").withColumn("s", F.split("said", _FIELD))
    lines = F.transform(F.split(F.get("s", F.lit(3)), _PART), lambda v: F.trim(F.regexp_replace(T.squeeze(v), "^[•·\\- ]+", "")))
    out = told.select("note_id", "direction", *[T.squeeze(F.get("s", F.lit(k))).alias(n) for k, n in enumerate(("target", "sentence", "replacement"))], F.filter(lines, lambda v: v != "").alias("translations"), "source")
    return out.where("target <> '' AND sentence <> ''")


def source_contexts(notes: DataFrame) -> DataFrame:
    """PIP19, AGG6. notes (note_id, front, back, tags, learned) as contexts: id, target, sentence, translations, replacement, source, note_ids, learned_cards.

    Notes of one target and sentence (context_key) are one context: it has the spelling of the lowest note, the
    translations of all in order (eight, blind to case), the first replacement, the sources, all notes, and
    learned cards in all.
    """
    told = note_contexts(notes).withColumns({"kt": context_key(F.col("target")), "ks": context_key(F.col("sentence"))}).join(notes.select("note_id", "learned"), "note_id")
    told = checkpoint(told)
    given = F.col("replacement") != ""
    base = told.groupBy("kt", "ks").agg(
        F.min_by("target", "note_id").alias("target"), F.min_by("sentence", "note_id").alias("sentence"), F.min_by(F.when(given, F.col("replacement")), F.when(given, F.col("note_id"))).alias("replacement"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_list("note_id")).alias("note_ids"), F.sum("learned").alias("learned_cards"),
    )
    each = told.select("kt", "ks", "note_id", F.posexplode("translations").alias("i", "translations"))
    named = N.ordered_distinct(each, ["kt", "ks"], ["note_id", "i"], "translations", TRANSLATIONS)
    key = F.concat(F.lit("source:"), F.substr(F.sha2(F.concat_ws("\x00", "kt", "ks"), 256), F.lit(1), F.lit(20)))
    return base.join(named, ["kt", "ks"], "left").select(
        key.alias("id"), "target", "sentence", F.coalesce("translations", F.array().cast("array<string>")).alias("translations"), F.coalesce("replacement", F.lit("")).alias("replacement"), F.array_join("sources", " | ").alias("source"), "note_ids", "learned_cards"
    )


def map_sources(highlights: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """JOI22. Which sources (id, target, sentence, note_ids) may stand for highlights (highlight_id, target, sentence): highlight_id, source_id, exact, chosen.

    A source fits a highlight that says the same (exact), or that is linked (note_id, highlight_id) to one of its
    notes. Of several the exact one is chosen, then the one with the lowest note.
    """
    keyed = lambda df: df.withColumns({"kt": context_key(F.col("target")), "ks": context_key(F.col("sentence"))})
    s = keyed(sources.withColumnRenamed("id", "source_id"))
    exact = keyed(_spread(highlights.select("highlight_id", "target", "sentence"), "highlight_id")).join(s, ["kt", "ks"]).select("highlight_id", "source_id")
    linked = sources.select(F.col("id").alias("source_id"), F.explode("note_ids").alias("note_id")).join(links.select("note_id", "highlight_id"), "note_id").join(highlights.select("highlight_id"), "highlight_id", "left_semi").select("highlight_id", "source_id")
    both = exact.withColumn("exact", F.lit(True)).unionByName(linked.withColumn("exact", F.lit(False))).groupBy("highlight_id", "source_id").agg(F.max("exact").alias("exact"))
    both = both.join(sources.select(F.col("id").alias("source_id"), F.array_min("note_ids").alias("lowest")), "source_id")
    first = W.partitionBy("highlight_id").orderBy(F.desc("exact"), F.asc_nulls_last("lowest"), "source_id")
    return both.select("highlight_id", "source_id", "exact", (F.row_number().over(first) == 1).alias("chosen"))


def migrate(clusters: DataFrame, sources: DataFrame, highlights: DataFrame, links: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """PIP14. Make clusters (cluster_id, source_ids, note_ids, contexts) the cards of highlights (highlight_id, target, sentence, source, created_at).

    Each highlight gets one source (JOI22). Candidates that no highlight took are shadowed; their contexts go.
    Clusters with a chosen source are known: their contexts of chosen sources are rewritten to the
    highlight (a generated one keeps its text and is named after it), of their notes (note_id, tags, ivl, reps,
    lapses) one a direction survives (WIN13), with the sums of the others (AGG10), a missing one is added; a note goes
    to its lowest cluster. The other clusters are unknown, and their notes are set aside.

    Returns mapping, shadowed, contexts, survivors (cluster_id, direction, note_id or null for a new one, reps,
    lapses, removed), unknown_notes and accounting (one row of numbers). It is an error if a highlight has
    no source, or a note of a source is neither in a known nor in an unknown cluster.
    """
    fits = checkpoint(map_sources(highlights, sources, links))
    chosen = fits.where("chosen").select("highlight_id", "source_id")
    if lost := highlights.join(chosen, "highlight_id", "left_anti").select("highlight_id").limit(5).collect():
        raise ValueError(f"no source fits the highlights {[r[0] for r in lost]}, perhaps more")
    taken = chosen.select("source_id").distinct()
    shadowed = fits.select("source_id").distinct().join(taken, "source_id", "left_anti")
    parts = clusters.select("cluster_id", F.explode("source_ids").alias("source_id"))
    known = checkpoint(parts.join(taken, "source_id", "left_semi").select("cluster_id").distinct())
    owned = checkpoint(clusters.select("cluster_id", F.explode("note_ids").alias("note_id")).distinct().join(known.withColumn("known", F.lit(True)), "cluster_id", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    every = sources.select(F.explode("note_ids").alias("note_id")).distinct()
    if left := every.join(owned, "note_id", "left_anti").limit(5).collect():
        raise ValueError(f"notes {[r[0] for r in left]}, perhaps more, are in no cluster")

    newest = chosen.join(highlights, "highlight_id").groupBy("source_id").agg(F.max_by(F.struct("highlight_id", "target", "sentence", "source"), F.struct("created_at", "highlight_id")).alias("h"))
    said = clusters.join(known, "cluster_id", "left_semi").select("cluster_id", F.posexplode("contexts").alias("place", "c"))
    said = said.withColumn("source_id", F.regexp_replace("c.id", "^generated:", "")).join(shadowed, "source_id", "left_anti").join(newest, "source_id", "left")
    made, has = F.col("c.id").startswith("generated:"), F.col("h").isNotNull()
    name = F.when(has & made, F.concat(F.lit("generated:"), F.col("h.highlight_id").cast("string"))).when(has, F.col("h.highlight_id").cast("string")).otherwise(F.col("c.id"))
    own = lambda c: F.when(has & ~made, F.col(f"h.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
    contexts = said.select("cluster_id", "place", name.alias("id"), *map(own, ("source", "target", "sentence")))

    first = owned.where("known").groupBy("note_id").agg(F.min("cluster_id").alias("cluster_id"))
    dealt = notes.join(first, "note_id").withColumn("direction", N.direction_of(F.col("tags"))).where("direction IS NOT NULL").withColumnRenamed("cluster_id", "card_id")
    folded = N.fold_schedules(dealt).withColumnRenamed("card_id", "cluster_id")
    wanted = known.select("cluster_id", F.explode(F.array(*map(F.lit, N.DIRECTIONS))).alias("direction"))
    survivors = checkpoint(wanted.join(folded, ["cluster_id", "direction"], "left").select("cluster_id", "direction", F.col("survivor").alias("note_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reps", "lapses", "removed")]))
    unknown = owned.where("NOT known").select("note_id").distinct()

    count = lambda df, n, what=None: df.agg((F.count("*") if what is None else F.coalesce(F.sum(what), F.lit(0))).cast("long").alias(n))
    numbers = [
        count(sources, "sources"), count(highlights, "highlights"), count(taken, "chosen"), count(shadowed, "shadowed"), count(known, "known_clusters"), count(clusters.join(known, "cluster_id", "left_anti"), "unknown_clusters"),
        count(survivors.where("note_id IS NOT NULL"), "survivors"), count(survivors, "removed", "removed"), count(survivors.where("note_id IS NULL"), "added"), count(unknown, "unknown_notes"), count(contexts, "contexts"),
    ]
    accounting = numbers[0]
    for n in numbers[1:]:
        accounting = accounting.join(F.broadcast(n))  # one row each
    return {"mapping": chosen, "shadowed": shadowed, "contexts": contexts, "survivors": survivors, "unknown_notes": unknown, "accounting": accounting}
