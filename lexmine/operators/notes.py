"""Cards, notes, schedules: merging, carrying over, reconciling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmine.functions import text as T
from lexmine.operators.graph import components
from lexmine.sources.files import write_cards_csv
from lexmine.sources.shared import checkpoint

#: The kinds of a card, in the order in which they are looked for; prefixes of tags that the engine sets itself.
DIRECTIONS = ("meaning", "recall")
MANAGED = ("card::", "direction::", "family::", "site::")
#: Rows of a component that are walked in one place at most.
WALKED = 200_000
#: Tasks over which the notes of one deck are dealt.
SHARES = 64


def tag_list(tags: Column) -> Column:
    return F.filter(F.split(tags, " "), lambda t: t != "")


def tag_value(tags: Column, prefix: str) -> Column:
    """What follows a prefix in the lowest tag that has it; null without one."""
    return _tag_value(tag_list(tags), prefix)


def _tag_value(listed: Column, prefix: str) -> Column:
    return F.substr(F.array_min(F.filter(listed, lambda t: t.startswith(prefix))), F.lit(len(prefix) + 1))


def direction_of(tags: Column) -> Column:
    """FIL14. The first direction that a card:: or direction:: tag names."""
    out = F.lit(None).cast("string")
    for d in reversed(DIRECTIONS):
        out = F.when(F.arrays_overlap(tag_list(tags), F.array(F.lit(f"card::{d}"), F.lit(f"direction::{d}"))), d).otherwise(out)
    return out


def unmanaged(tags: Column) -> Column:
    """FIL15. Tags that a user set."""
    return F.filter(tag_list(tags), lambda t: ~(t.startswith(MANAGED[0]) | t.startswith(MANAGED[1]) | t.startswith(MANAGED[2]) | t.startswith(MANAGED[3])))


def merge_tags(old: Column, new: Column) -> Column:
    """SET3. Old tags and then new ones, each once."""
    return F.array_join(F.array_distinct(F.concat(tag_list(old), tag_list(new))), " ")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """WIN12. The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def ordered_distinct(df: DataFrame, keys: list[str], order: list, value: str, limit: int | None = None) -> DataFrame:
    """AGG7. For each key the array of distinct values (blind to case and outer space, first spelling kept) in order, limit at most.

    The first place of each value is found by a grouping first, so a key's repeats are not collected.
    """
    rows = df.withColumn("_v", F.trim(value)).where("_v <> ''").withColumn("_k", T.fold(F.col("_v")))
    first = rows.groupBy(*keys, "_k").agg(F.min(F.struct(*order, "_v")).alias("_f"))
    ranked = first.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_f")))
    if limit:
        ranked = ranked.where(F.col("_n") <= limit)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_f._v"))), lambda x: x["_v"]).alias(value))


def identities(front: Column, back: Column, tags: Column) -> Column:
    """FUN17. What a note is known by: an array of one or more strings.

    A card of an article (tags card::meaning or card::recall, and article::) is known by its site card, and
    by its target in its context: of a meaning card the bold words and the whole front, of a recall card the
    back and the front around its bold words, without a hint at its end. Other notes, and cards with
    neither, are known by their front.
    """
    plain = lambda c: T.squeeze(T.fold(T.strip_tags(c)))
    named = lambda *parts: F.concat_ws("|", *parts)

    def meaning(kind):
        bold = plain(F.regexp_extract(front, "(?is)<b\\b[^>]*>(.*?)</b>", 1))
        return T.let(bold, lambda b: F.when(b != "", named(F.lit("context"), kind, b, plain(front))))

    def around(context, whole):
        sides = lambda at: F.concat(T.squeeze(T.strip_tags(F.substr(context, F.lit(1), at - 1))), F.lit(" \u2063 "), T.squeeze(T.strip_tags(F.substr(context, at + F.length(whole)))))
        return T.squeeze(T.fold(T.let(F.instr(context, whole), sides)))

    def recall(kind):
        context = F.regexp_replace(front, "(?is)<br\\s*/?><small>.*?</small>\\s*$", "")
        placed = lambda b: T.let(context, lambda c: T.let(F.regexp_extract(c, "(?is)<b\\b[^>]*>.*?</b>", 0), lambda w: F.when(w != "", named(F.lit("context"), kind, b, around(c, w)))))
        return T.let(plain(back), lambda b: F.when(b != "", placed(b)))

    def own(listed):
        kind = F.when(F.array_contains(listed, "card::recall"), "recall").when(F.array_contains(listed, "card::meaning"), "meaning")
        site = lambda k: T.let(_tag_value(listed, "site::"), lambda card: F.when(card.isNotNull(), named(F.lit("site"), k, card)))
        found = lambda k: F.filter(F.array(site(k), F.when(k == "recall", recall(k)).otherwise(meaning(k))), lambda x: x.isNotNull())
        return F.when(F.exists(listed, lambda t: t.startswith("article::")), T.let(kind, lambda k: F.when(k.isNotNull(), found(k))))

    return T.let(T.let(tag_list(tags), own), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(named(F.lit("front"), plain(front)))))


def merge_notes(notes: DataFrame, incoming: DataFrame, most: int = WALKED) -> DataFrame:
    """PIP11. What each incoming row (row_id, front, back, tags) does to notes (note_id, front, back, tags): row_id, action, note_id.

    update: a note with the same site card and direction changes; same: it is as it is already; skip: an
    earlier row has its site card and direction, or an identity is there already, in a note or in an
    earlier row that is inserted; insert: a new note, numbered after the last. Rows go by row_id.

    What a row does depends on earlier rows that share an identity, so rows are parted into components by shared
    identities; a component of `most` rows or fewer is walked in order in one place, larger ones in rounds, in which
    a row that comes first for all its identities is inserted and rows that share one with it are skipped.
    """
    key = lambda df: df.withColumns({"card": tag_value(F.col("tags"), "site::"), "dir": direction_of(F.col("tags"))})
    known = first_by(key(notes).where("card IS NOT NULL AND dir IS NOT NULL"), ["card", "dir"], ["note_id"]).select("card", "dir", F.col("note_id").alias("old_id"), F.col("front").alias("old_front"), F.col("back").alias("old_back"), F.col("tags").alias("old_tags"))
    same = (F.col("front") == F.col("old_front")) & (F.col("back") == F.col("old_back")) & (merge_tags(F.col("old_tags"), F.col("tags")) == F.array_join(tag_list(F.col("old_tags")), " "))
    texts = [F.when(F.col("old_id").isNull(), F.col(c)).alias(c) for c in ("front", "back", "tags")]
    rows = checkpoint(key(incoming).join(known, ["card", "dir"], "left").select("row_id", "card", "dir", "old_id", same.alias("same"), *texts))
    matched = rows.where("old_id IS NOT NULL").select("row_id", F.when(F.col("same"), "same").otherwise("update").alias("action"), F.col("old_id").alias("note_id"))
    keyed = F.col("card").isNotNull() & F.col("dir").isNotNull()
    place = F.row_number().over(W.partitionBy("card", "dir", F.when(~keyed, F.col("row_id"))).orderBy("row_id"))
    rest = checkpoint(rows.where("old_id IS NULL").withColumn("place", F.when(keyed, place).otherwise(1)).select("row_id", "place", F.when(F.col("place") == 1, identities(F.col("front"), F.col("back"), F.col("tags"))).alias("all")))
    there = notes.select(F.explode(identities(F.col("front"), F.col("back"), F.col("tags"))).alias("identity")).distinct()
    each = rest.where("place = 1").select("row_id", F.explode("all").alias("identity"))
    open_ = checkpoint(each.join(each.join(there, "identity", "left_semi").select("row_id").distinct(), "row_id", "left_anti"))
    new = _inserted(open_, most)
    skipped = rest.select("row_id").join(new, "row_id", "left_anti").select("row_id", F.lit("skip").alias("action"), F.lit(None).cast("bigint").alias("note_id"))
    return matched.unionByName(skipped).unionByName(number_after(new, notes, "row_id", "note_id").select("row_id", F.lit("insert").alias("action"), "note_id"))


def _inserted(open_: DataFrame, most: int) -> DataFrame:
    """The rows (row_id, identity) of which none shares an identity with an inserted row of a lower row_id: row_id."""
    lowest = open_.groupBy("identity").agg(F.min("row_id").alias("b"))
    roots = components(open_.join(lowest, "identity").select(F.col("row_id").alias("a"), "b"))
    alone = open_.select("row_id").distinct().join(roots.select(F.col("node").alias("row_id")), "row_id", "left_anti")
    grouped = checkpoint(open_.join(roots.withColumnRenamed("node", "row_id"), "row_id"))
    sizes = grouped.groupBy("root").agg(F.count_distinct("row_id").alias("n"))
    small = grouped.join(sizes.where(F.col("n") <= most).select("root"), "root", "left_semi")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        won = []
        for row, own in rows.sort_values("row_id").groupby("row_id", sort=True)["identity"]:
            if not taken.intersection(own):
                won.append(row)
                taken.update(own)
        return pd.DataFrame({"row_id": won})

    new = alone.unionByName(small.groupBy("root").applyInPandas(walk, f"row_id {open_.schema['row_id'].dataType.simpleString()}"))
    left = checkpoint(grouped.join(sizes.where(F.col("n") > most).select("root"), "root", "left_semi").select("row_id", "identity"))
    while not left.isEmpty():
        first = left.groupBy("identity").agg(F.min("row_id").alias("first"))
        won = checkpoint(left.join(first, "identity").groupBy("row_id").agg(F.bool_and(F.col("first") == F.col("row_id")).alias("won")).where("won").select("row_id"))
        taken = left.join(won, "row_id", "left_semi").select("identity").distinct()
        out = left.join(taken, "identity", "left_semi").select("row_id").distinct()
        new = new.unionByName(won)
        left = checkpoint(left.join(out, "row_id", "left_anti"))
    return checkpoint(new)


def number_after(rows: DataFrame, notes: DataFrame, order: str, name: str) -> DataFrame:
    """WIN14. rows with name: numbers in order that follow the largest of notes.

    Rows are counted by range partition and numbered inside each, so no task gets them all. The
    partitions are written down, as later plans may deal the rows otherwise.
    """
    ranged = checkpoint(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").count()
    offsets = sizes.withColumn("_o", F.sum("count").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))).select("_p", F.coalesce("_o", F.lit(0)).alias("_o"))  # a row a partition
    last = notes.agg(F.coalesce(F.max(name), F.lit(0)).alias("_m"))  # one row
    inner = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy(order)))
    return inner.join(F.broadcast(offsets), "_p").join(F.broadcast(last)).withColumn(name, F.col("_m") + F.col("_o") + F.col("_n")).drop("_p", "_o", "_m", "_n")


def deck_subtree(decks: DataFrame, root: int) -> DataFrame:
    """JOI24. Ids of a deck and those below it; names go down by "::"."""
    top = decks.where(F.col("deck_id") == root).select(F.col("name").alias("top"))  # one row
    return decks.join(F.broadcast(top), (F.col("name") == F.col("top")) | F.col("name").startswith(F.concat("top", F.lit("::")))).select("deck_id")


def carry_schedules(cards: DataFrame, notes: DataFrame, decks: DataFrame | None = None) -> DataFrame:
    """PIP12. cards (card_id), each in both directions, with the schedule of their first note (by note_id) of the decks; a new card's without one."""
    kept = notes
    if decks is not None:  # a deck's notes are dealt over SHARES tasks, as a few decks hold most notes
        wanted = decks.select("deck_id").distinct().withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        kept = notes.withColumn("_share", F.pmod(F.xxhash64("note_id"), F.lit(SHARES)).cast("int")).join(wanted, ["deck_id", "_share"], "left_semi")
    old = first_by(kept, ["card_id", "direction"], ["note_id"]).select("card_id", "direction", "due", "ivl", "reps", "lapses")
    both = cards.select("card_id", F.explode(F.array(*map(F.lit, DIRECTIONS))).alias("direction"))
    out = both.join(old, ["card_id", "direction"], "left")
    return out.select("card_id", "direction", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("due", "ivl", "reps", "lapses")], F.col("ivl").isNull().alias("is_new"))


def reconcile(cards: DataFrame, notes: DataFrame, links: DataFrame) -> DataFrame:
    """PIP13, JOI21. A note for each card (card_id, front) and direction: (card_id, direction, note_id, stage), note_id null where missing.

    Stages: a known link; a note tagged with card and direction; a note with an equal front. A stage
    takes only what earlier ones left, and a note is used once (the lowest card gets it).
    """
    wanted = cards.select("card_id", "front", F.explode(F.array(*map(F.lit, DIRECTIONS))).alias("direction"))
    tagged = notes.withColumns({"card": tag_value(F.col("tags"), "card::").try_cast("bigint"), "dir": direction_of(F.col("tags"))})
    found = None
    for stage in range(3):
        left = wanted if found is None else wanted.join(found.select("card_id", "direction"), ["card_id", "direction"], "left_anti")
        free = tagged if found is None else tagged.join(found.select("note_id"), "note_id", "left_anti")
        if stage == 0:
            pairs = left.join(links.select("card_id", "direction", "note_id"), ["card_id", "direction"]).join(free.select("note_id"), "note_id", "left_semi")
        elif stage == 1:
            pairs = left.join(free.select(F.col("card").alias("card_id"), F.col("dir").alias("direction"), "note_id"), ["card_id", "direction"])
        else:
            # one note of a front and direction for each card: the k-th note for the k-th card, so many equal fronts never multiply
            rank = lambda df, by: df.withColumn("k", F.row_number().over(W.partitionBy("front", "direction").orderBy(by)))
            pairs = rank(left, "card_id").join(rank(free.select("front", F.col("dir").alias("direction"), "note_id"), "note_id"), ["front", "direction", "k"])
        one = first_by(first_by(pairs.select("card_id", "direction", "note_id"), ["card_id", "direction"], ["note_id"]), ["note_id"], ["card_id", "direction"])
        one = checkpoint(one.withColumn("stage", F.lit(stage)))
        found = one if found is None else found.unionByName(one)
    return wanted.select("card_id", "direction").join(found, ["card_id", "direction"], "left")


def fold_schedules(notes: DataFrame) -> DataFrame:
    """AGG10, WIN13. For each card and direction the note that survives (longest interval, most repetitions, fewest lapses, lowest id) with the sums of all."""
    ranked = notes.withColumn("_n", F.row_number().over(W.partitionBy("card_id", "direction").orderBy(F.desc("ivl"), F.desc("reps"), "lapses", "note_id")))
    return ranked.groupBy("card_id", "direction").agg(F.max(F.when(F.col("_n") == 1, F.col("note_id"))).alias("survivor"), F.sum("reps").alias("reps"), F.sum("lapses").alias("lapses"), (F.count("*") - 1).alias("removed"))


def render_cards(cards: DataFrame) -> DataFrame:
    """PIP10. Two rows (front, back, tags) for each card (card_id, target, sentence, replacement, translations array, document)."""
    front = T.emphasize(F.col("sentence"), F.col("target"))
    recall = T.emphasize(F.col("sentence"), F.col("target"), F.col("replacement"))
    back = F.array_join(F.transform("translations", lambda v: F.concat(F.lit("• "), T.escape_html(v))), "<br>")
    common = F.concat(F.lit("article::"), T.safe_tag(F.col("document")), F.lit(" site::"), F.col("card_id").cast("string"))
    side = lambda d, f, b: F.struct(F.lit(d).alias("direction"), f.alias("front"), b.alias("back"), F.concat(common, F.lit(f" card::{d}")).alias("tags"))
    rows = F.array(side("meaning", front, back), side("recall", recall, F.concat(F.lit("<b>"), T.escape_html(F.col("target")), F.lit("</b>"))))
    return cards.select("card_id", F.explode(rows).alias("r")).select("card_id", "r.*")


def distractor_hint(valid: Column, related: Column) -> Column:
    """FUN33. The hint below a recall card: valid substitutes, then related words that aren't valid ones (blind to case); empty without either."""
    folded = F.transform(valid, T.fold)
    rest = F.filter(related, lambda v: ~F.array_contains(folded, T.fold(v)))
    part = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(F.transform(values, T.escape_html), ", ")))
    # The two labels.
    hints = F.filter(F.array(part("Подходит, но не целевой ответ: ", valid), part("Близко по смыслу: ", rest)), lambda x: x.isNotNull())
    return F.when(F.size(hints) > 0, F.concat(F.lit("<br><small>"), F.array_join(hints, "<br>"), F.lit("</small>"))).otherwise("")


def compact_replacement(replacement: Column, fallback: Column, target: Column) -> Column:
    """FIL12. The replacement if it has few words for its target and no sentence marks, else the fallback."""
    n = lambda c: F.size(F.filter(F.split(c, "\\s+"), lambda w: w != ""))
    most = F.least(F.lit(8), F.greatest(F.lit(5), 2 * n(target) + 1))
    return F.when((n(replacement) <= most) & ~replacement.rlike("[.!?;:]"), replacement).otherwise(fallback)


def delete_cascade(deleted: DataFrame, highlights: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """PIP17. Deleting highlights (highlight_id): tombstones, cards that lose their last highlight, and the oldest highlight that now stands for each other card touched."""
    gone = deleted.select("highlight_id").distinct()
    touched = links.join(gone, "highlight_id", "left_semi").select("card_id").distinct()
    left = links.join(gone, "highlight_id", "left_anti").join(touched, "card_id", "left_semi").join(highlights.select("highlight_id", "created_at", "document_id"), "highlight_id")
    first = left.groupBy("card_id").agg(F.min_by("highlight_id", F.struct("created_at", "highlight_id")).alias("highlight_id"))
    return {"tombstones": highlights.join(gone, "highlight_id", "left_semi").select("highlight_id", "document_id"), "removed_cards": touched.join(first, "card_id", "left_anti"), "moved_cards": first}


def enabled(directions: Column, direction: str) -> Column:
    """FIL9. Does a context (its directions; none: both) take part in a direction?"""
    return F.coalesce(F.size(directions) == 0, F.lit(True)) | F.coalesce(F.array_contains(directions, direction), F.lit(False))


def semantic_cards(cards: DataFrame, contexts: DataFrame) -> DataFrame:
    """PIP10. Two rows (card_id, direction, front, back, tags) for each card that has contexts of both directions.

    cards: card_id, family, sense, translations; contexts: card_id, place, target, sentence, replacement, source,
    directions, valid and related (arrays of other words). Every context is rendered: its front has the target bold,
    its recall the replacement (compact, else the card's first translation: FIL12) and the hint (FUN33). A side
    shows the first of its direction's contexts (FIL9) and carries all of them as JSON in its data-contexts.
    """
    c = contexts.join(cards.select("card_id", F.get("translations", F.lit(0)).alias("fallback")), "card_id")
    shown = compact_replacement(F.col("replacement"), F.col("fallback"), F.col("target"))
    bare = T.emphasize(F.col("sentence"), F.col("target"), shown)
    rendered = F.struct(
        T.emphasize(F.col("sentence"), F.col("target")).alias("front"), F.concat(bare, distractor_hint(F.coalesce("valid", F.array()), F.coalesce("related", F.array()))).alias("recall"), T.escape_html(F.col("target")).alias("answer"), T.escape_html(F.col("source")).alias("source")
    )
    each = c.select("card_id", "place", "directions", rendered.alias("r"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(enabled(F.col("directions"), d), F.struct("place", "r")))), lambda x: x["r"]).alias(d) for d in DIRECTIONS]
    sides = each.groupBy("card_id").agg(*lists).where(F.forall(F.array(*[F.size(d) for d in DIRECTIONS]), lambda n: n > 0))
    full = cards.join(sides, "card_id")
    translations = F.array_join(F.transform("translations", lambda v: F.concat(F.lit("• "), T.escape_html(v))), "<br>")
    tail = F.concat(F.lit("<br>"), translations, F.lit("<br><small>"), T.escape_html(F.coalesce("sense", F.lit(""))), F.lit("</small>"))
    family = T.safe_tag(F.coalesce("family", F.lit("")))
    tags = F.concat(F.lit("site::"), F.col("card_id").cast("string"), F.lit(" semantic::v1 family::"), F.when(family == "article", "word").otherwise(family))

    def side(direction: str, face: str, more: Column) -> Column:
        first = F.get(direction, F.lit(0))
        data = F.concat(F.lit('<div data-card="'), T.escape_html(F.col("card_id").cast("string")), F.lit('" data-contexts="'), T.escape_html(F.to_json(direction)), F.lit('">'))
        wrapped = lambda inner: F.concat(data, inner, F.lit("</div>"))
        back = F.concat(F.lit("<b>"), first["answer"], F.lit("</b>"), more)
        return F.struct(F.lit(direction).alias("direction"), wrapped(first[face]).alias("front"), wrapped(back).alias("back"), F.concat(tags, F.lit(f" card::{direction}")).alias("tags"))

    return full.select("card_id", F.explode(F.array(side("meaning", "front", tail), side("recall", "recall", F.lit("")))).alias("s")).select("card_id", "s.*")


def export_pending(cards: DataFrame, contexts: DataFrame, column: str, as_of: Column, path: str) -> DataFrame:
    """PIP18. Write the rendered sides (PIP10) of the cards without a time in column (FIL1) as CSV (Front, Back, Tags; SRC3) below path; cards with that time set for those written.

    A card that can't be rendered isn't written and stays pending.
    """
    sides = checkpoint(semantic_cards(cards.where(F.col(column).isNull()), contexts))
    write_cards_csv(sides.select(F.col("front").alias("Front"), F.col("back").alias("Back"), F.col("tags").alias("Tags")), path)
    done = sides.select("card_id").distinct().withColumn("_done", F.lit(True))
    return cards.join(done, "card_id", "left").withColumn(column, F.when(F.col("_done"), as_of).otherwise(F.col(column))).drop("_done")
