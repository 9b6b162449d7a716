"""Word boxes, highlight regions and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from lexmine.functions import text as T

#: Height of the bands that boxes are dealt into, so that only boxes near each other meet in a join.
BAND = 32.0


def area(r) -> Column:
    return (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])


def intersection(a, b) -> Column:
    """Area that two rectangles share."""
    width = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    return width * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))


def quad_box(points: Column, left: Column, bottom: Column, height: Column) -> Column:
    """The box (x0, top, x1, bottom) of an array of eight numbers x, y, x, y .. whose origin is the page's lower left corner."""
    x, y = F.filter(points, lambda v, i: i % 2 == 0), F.filter(points, lambda v, i: i % 2 == 1)
    return F.struct((F.array_min(x) - left).alias("x0"), (height - (F.array_max(y) - bottom)).alias("top"), (F.array_max(x) - left).alias("x1"), (height - (F.array_min(y) - bottom)).alias("bottom"))


def valid_rects(rects: Column) -> Column:
    """1 to 16 rectangles, finite, within 100,000, not empty once rounded to 3 places."""
    r3 = lambda v: F.bround(v, 3)
    good = lambda r: F.forall(F.array(r["x1"], r["y1"], r["x2"], r["y2"]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= 100_000)) & (r3(r["x2"]) > r3(r["x1"])) & (r3(r["y2"]) > r3(r["y1"]))
    return F.size(rects).between(1, 16) & F.forall(rects, good)


def signature(page: Column, target: Column, rects: Column) -> Column:
    """page:target:coordinates, the coordinates sorted, to know a highlight again."""
    parts = F.array_sort(F.transform(rects, lambda r: F.concat_ws(",", *[F.bround(r[k], 3).cast("string") for k in ("x1", "y1", "x2", "y2")])))
    return F.concat_ws(":", page.cast("string"), F.lower(target), F.array_join(parts, ";"))


def _bands(top: Column, bottom: Column) -> Column:
    return F.explode(F.sequence(F.floor(top / BAND).cast("int"), F.floor(bottom / BAND).cast("int")))


def shared_areas(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """FUN27. (id, other, shared) of each pair of rectangles (id, *keys, x1, y1, x2, y2) of different highlights that share an area.

    An equi join on keys and a band of the page; a pair is counted in the band where both have begun, so no
    distinct is needed.
    """
    deal = lambda df: df.withColumn("band", _bands(F.col("y1"), F.col("y2")))
    a, b = deal(first).alias("a"), deal(second).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "band"]]
    begun = F.col("a.band") == F.greatest(F.floor(F.col("a.y1") / BAND), F.floor(F.col("b.y1") / BAND))
    box = lambda s: {k: F.col(f"{s}.{k}") for k in ("x1", "y1", "x2", "y2")}
    shared = intersection(box("a"), box("b"))
    return a.join(b, on).where(begun & (F.col("a.id") != F.col("b.id")) & (shared > 0)).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), shared.alias("shared"))


def overlapping(first: DataFrame, second: DataFrame, keys: list[str], least: float = 0.6) -> DataFrame:
    """JOI9. (id, other) of highlights (id, *keys, x1, y1, x2, y2, a row for each rectangle) whose shared area, added over their rectangles, is least of the smaller one's or more."""
    size = lambda df, n: df.withColumn("_a", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).groupBy("id").agg(F.sum("_a").alias(n))
    pairs = shared_areas(first, second, keys).groupBy("id", "other").agg(F.sum("shared").alias("shared"))
    sized = pairs.join(size(first, "s1"), "id").join(size(second, "s2").withColumnRenamed("id", "other"), "other")
    return sized.where(F.col("shared") / F.least("s1", "s2") >= least).select("id", "other")


def region_overlap(words: DataFrame, regions: DataFrame) -> DataFrame:
    """JOI10. words with overlap, the largest share of a word's box that one region of its page covers (0 without any).

    Words and regions are dealt by page together and meet in bands of it, in windows of that partitioning: a word is shuffled once.
    """
    box = F.struct("x1", "y1", "x2", "y2")
    sides = words.withColumn("_region", F.lit(False)).unionByName(regions.select("doc_id", "page", "x1", "y1", "x2", "y2", F.lit(True).alias("_region")), allowMissingColumns=True)
    dealt = sides.repartition("doc_id", "page").withColumn("_row", F.monotonically_increasing_id())
    banded = dealt.withColumn("_band", F.explode_outer(F.sequence(F.floor(F.col("y1") / BAND).cast("int"), F.floor(F.col("y2") / BAND).cast("int"))))
    met = banded.withColumn("_near", F.collect_list(F.when(F.col("_region"), box)).over(W.partitionBy("doc_id", "page", "_band"))).where("NOT _region")
    share = F.array_max(F.transform("_near", lambda r: intersection(box, r) / area(box)))
    rest = [c for c in words.columns if c not in ("doc_id", "page")]
    found = met.withColumn("_share", share).groupBy("doc_id", "page", "_row").agg(*[F.first(c).alias(c) for c in rest], F.coalesce(F.max("_share"), F.lit(0.0)).alias("overlap"))
    return found.select(*words.columns, "overlap")


def selected(word: Column, height: Column, coverage: Column, spill: Column, overlap: Column) -> Column:
    """FIL7. Is a word highlighted, by how its box is covered, or by an annotation over it?"""
    brushed = ((coverage >= 0.60) & (spill < 0.30)) | ((coverage >= 0.32) & (spill <= 0.22))
    return word.rlike("\\p{L}") & (((height >= 8) & brushed) | (overlap >= 0.45))


def word_boxes(docs: DataFrame) -> DataFrame:
    """Boxes of the words of documents (doc_id, text) laid out twelve to a line and 300 to a page: word_id, word, page, line, x1, y1, x2, y2."""
    w = docs.select("doc_id", F.posexplode(F.array_remove(F.split("text", "\\s+"), "")).alias("word_id", "word"))
    w = w.withColumns({"page": F.floor(F.col("word_id") / 300), "line": F.floor(F.col("word_id") / 12)})
    w = w.withColumns({"x1": (F.col("word_id") % 12 * 45).cast("double"), "y1": (50 + F.col("line") % 25 * 14).cast("double")})
    return w.withColumns({"x2": F.col("x1") + 5 * F.length("word"), "y2": F.col("y1") + 11})


#: Room between words of a phrase, and over a skipped mark or formula; how far down a phrase may wrap, in heights.
GAP, WIDE_GAP, WRAP = 8.0, 60.0, 1.6
#: Words that a phrase of three words or more doesn't begin with.
LEADING = ["and", "but", "or"]


def phrase_groups(words: DataFrame, gap: float = GAP, between: int = 2) -> DataFrame:
    """WIN2. Selected words (doc_id, page, word_id, x1, y1, x2, y2, word, selected) with group_id: runs of selected words of a page, counted from 1.

    Two selected words go together if they follow each other, or have at most `between` words without a letter or
    digit between them, and one of these holds: they stand on one line with little room between them; the second
    begins further left on the next line (at most 1.6 heights down) and the first ends no sentence; the first ends
    in a hyphen and the second stands below. A group of three words or more loses a leading and, but, or.
    Gaps and islands over the words of a page.
    """
    placed = words.withColumn("_plain", _plain(F.col("word")))
    return _grouped(placed.withColumns({"_all": F.sum("_plain").over(_so_far()), "_place": F.row_number().over(_by_page())}), gap, between).select(*words.columns, "group_id")


def _by_page() -> WindowSpec:
    return W.partitionBy("doc_id", "page").orderBy("word_id")


def _so_far() -> WindowSpec:
    return _by_page().rowsBetween(W.unboundedPreceding, 0)


def _plain(word: Column) -> Column:
    """1 for a word with a letter or digit."""
    return F.when(word.rlike("[A-Za-z0-9]"), 1).otherwise(0)


def _grouped(words: DataFrame, gap: float = GAP, between: int = 2) -> DataFrame:
    """Selected ones of words (with _plain, _all: plain ones so far, _place on the page) with group_id, and line, which tells the lines of a group apart. All windows have one order."""
    marked = words.where("selected").withColumns({f"_b_{c}": F.lag(c).over(_by_page()) for c in ("_place", "_all", "word", "x1", "x2", "y1", "y2")})  # each is taken once
    prev = lambda c: F.col(f"_b_{c}")
    height = F.greatest(F.col("y2") - F.col("y1"), prev("y2") - prev("y1"))
    skipped = F.col("_place") - prev("_place") - 1
    marks = skipped.between(1, between) & (F.col("_all") - F.col("_plain") == prev("_all"))
    down = F.col("y1") - prev("y1")
    one_line, room = F.abs(down) <= F.greatest(F.lit(2.0), 0.25 * height), F.col("x1") - prev("x2")
    wraps = (down > 2.0) & (down <= WRAP * height) & (F.col("x1") < prev("x1")) & ~T.is_sentence_end(prev("word"))
    hyphen = prev("word").endswith("-") & (down > 2.0)
    goes_on = ((skipped == 0) | marks) & ((one_line & ((room <= gap) | (marks & (room <= WIDE_GAP)))) | wraps | hyphen)
    marked = marked.withColumns({"_starts": F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1), "_moves": F.when(_moved(prev("y1")), 1).otherwise(0)})
    ahead = lambda n: F.lead("_starts", n, 1).over(_by_page()) == 0
    marked = marked.withColumns({"group_id": F.sum("_starts").over(_so_far()), "line": F.sum("_moves").over(_so_far()), "_of_three": (F.col("_starts") == 1) & ahead(1) & ahead(2)})
    leads = F.col("_of_three") & F.lower(T.split_outer_punctuation(F.col("word"))["core"]).isin(LEADING)
    return marked.where(~leads)


def _moved(before: Column) -> Column:
    """Does a word stand on another line than the one before it, whose top is given?"""
    return F.abs(F.col("y1") - before) > F.greatest(F.lit(2.0), 0.25 * (F.col("y2") - F.col("y1")))


def line_groups(words: DataFrame) -> DataFrame:
    """WIN3. words of groups with line_id: a new line where the top moves by more than a quarter of the height (2 at least)."""
    w = W.partitionBy("doc_id", "page", "group_id").orderBy("word_id")
    return words.withColumn("line_id", F.sum(F.when(_moved(F.lag("y1").over(w)), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def group_boxes(words: DataFrame) -> DataFrame:
    """AGG9. A box for each line of each group."""
    return line_groups(words).groupBy("doc_id", "page", "group_id", "line_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n_words"))


def _broken(top: Column, bottom: Column, before: Column) -> Column:
    step = top - before
    return F.coalesce((step > 1.8 * F.greatest(bottom - top, F.lit(1.0))) | (step < -1), F.lit(False))


def paragraph_breaks(words: DataFrame) -> DataFrame:
    """WIN4. words with break_before: a jump of over 1.8 heights down, or a move up on the page."""
    return words.withColumn("break_before", _broken(F.col("y1"), F.col("y2"), F.lag("y1").over(_by_page())))


def sentence_ids(words: DataFrame, ends: Column) -> DataFrame:
    """WIN6. words with sentence_id; a sentence ends after a word for which ends holds."""
    w = W.partitionBy("doc_id").orderBy("word_id").rowsBetween(W.unboundedPreceding, -1)
    return words.withColumn("sentence_id", F.coalesce(F.sum(F.when(ends, 1).otherwise(0)).over(w), F.lit(0)))


def extract_highlights(words: DataFrame, regions: DataFrame, top: float, bottom: float, dealt: bool = False) -> DataFrame:
    """PIP6. Highlights of documents: doc_id, page, group_id, target, occurrence, sentence, rects.

    words (doc_id, page, word_id, word, x1, y1, x2, y2, coverage, spill: how much of the box, and of the room above
    or below it, is brushed; word_id counts on from page to page) lose what stands outside the margins (FIL5); regions
    (doc_id, page, box) are annotations (JOI10); selected words (FIL7) form phrases (WIN2), whose target is their words
    without outer marks. occurrence counts a target's earlier ones on its page (WIN1). The sentence goes from the last
    sentence end or paragraph break before the phrase to the next one after it (WIN4, WIN6). rects has a box a line (AGG9).

    All windows, groupings and the join with the sentences keep to a partitioning by document, and those over words to one
    order, so words are shuffled once and sorted once for the phrases, and so (without boxes) for the sentences. dealt: words
    and regions lie by document already, as those made of a document's text after it was dealt do; then nothing is shuffled.
    """
    by_document = (lambda df: df) if dealt else (lambda df: df.repartition("doc_id"))
    inside = words.where((F.col("y1") >= top) & (F.col("y2") <= bottom) & (F.trim("word") != ""))
    height = F.col("y2") - F.col("y1")
    brushed = F.coalesce(selected(F.col("word"), height, F.col("coverage"), F.col("spill"), F.lit(0.0)), F.lit(False))
    after = {f"_a_{c}": F.lead(c).over(_by_page()) for c in ("y1", "y2")}
    ends = F.when(T.is_sentence_end(F.col("word")) | _broken(F.col("_a_y1"), F.col("_a_y2"), F.col("y1")), 1).otherwise(0)
    boxed = inside.select("doc_id", "page", "word_id", "word", "x1", "y1", "x2", "y2", brushed.alias("_brushed"))
    both = by_document(boxed.unionByName(regions.select("doc_id", "page", "x1", "y1", "x2", "y2"), allowMissingColumns=True)).withColumn("_plain", _plain(F.col("word")))
    box = F.struct("x1", "y1", "x2", "y2")
    on_page = F.collect_list(F.when(F.col("word").isNull(), box)).over(_by_page().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    met = both.withColumns({"_regions": on_page, "_all": F.sum("_plain").over(_so_far()), "_place": F.row_number().over(_by_page()), **after}).where("word IS NOT NULL")  # regions come first on a page
    near = F.filter("_regions", lambda r: (r["y1"] < F.col("y2")) & (r["y2"] > F.col("y1")))
    overlap = F.coalesce(F.array_max(F.transform(near, lambda r: F.when(area(box) > 0, intersection(box, r) / area(box)).otherwise(0.0))), F.lit(0.0))
    chosen = met.withColumns({"selected": F.col("_brushed") | selected(F.col("word"), height, F.lit(0.0), F.lit(1.0), overlap), "_ends": ends}).drop("_regions", "_brushed", *after)
    before = F.sum("_ends").over(W.partitionBy("doc_id").orderBy("page", "word_id").rowsBetween(W.unboundedPreceding, -1))
    chosen = chosen.withColumn("sentence_id", F.coalesce(before, F.lit(0)).cast("int"))
    corners = [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]
    groups = _grouped(chosen).groupBy("doc_id", "page", "group_id").agg(
        *corners, F.min("line").alias("l1"), F.max("line").alias("l2"), F.min("sentence_id").alias("s1"), F.max("sentence_id").alias("s2"), F.array_sort(F.collect_list(F.struct("word_id", "word", "line", "x1", "y1", "x2", "y2"))).alias("w")
    )

    def line_box(n):
        of = F.filter("w", lambda x: x["line"] == n)
        return F.struct(F.array_min(of["x1"]).alias("x1"), F.array_min(of["y1"]).alias("y1"), F.array_max(of["x2"]).alias("x2"), F.array_max(of["y2"]).alias("y2"))

    rects = F.when(F.col("l1") == F.col("l2"), F.array(box)).otherwise(F.transform(F.array_distinct(F.col("w")["line"]), line_box))
    target = T.split_outer_punctuation(T.join_words(F.col("w")["word"]))["core"]
    groups = groups.select("doc_id", "page", "group_id", target.alias("target"), rects.alias("rects"), F.element_at("w", 1)["word_id"].alias("first"), "s1", "s2")
    groups = groups.withColumn("occurrence", F.row_number().over(W.partitionBy("doc_id", "page", T.fold(F.col("target"))).orderBy("first")) - 1).where("target <> ''")
    marked = by_document(inside.select("doc_id", "page", "word_id", "word", "y1", "y2")).withColumns(after).withColumn("_ends", ends)
    spelled = F.array_sort(F.collect_list(F.struct("page", "word_id", F.concat("word", F.when(F.col("_ends") == 1, "\n").otherwise(" ")).alias("word"))))["word"]
    said = marked.groupBy("doc_id").agg(F.split(F.rtrim(F.array_join(spelled, "")), "\n").alias("said"))  # words hold no white space
    sentence = T.join_words(F.slice("said", F.col("s1") + 1, F.col("s2") - F.col("s1") + 1))
    sentence = F.explode(F.array(sentence))  # made where the join runs, so that a document's sentences aren't copied for each of its groups
    return groups.join(said.hint("merge"), "doc_id").select("doc_id", "page", "group_id", "target", F.col("occurrence").cast("int").alias("occurrence"), sentence.alias("sentence"), "rects")


def import_highlights(extracted: DataFrame, existing: DataFrame, tombstones: DataFrame) -> DataFrame:
    """PIP7. Which extracted highlights (id, document_id, page, target, x1, y1, x2, y2) to add: none deleted before (JOI7), none over an existing one (JOI9), none there already (SET9)."""
    fresh = extracted.join(tombstones.select("id").distinct(), "id", "left_anti").join(existing.select("id").distinct(), "id", "left_anti")
    taken = overlapping(fresh, existing, ["document_id", "page", "target"])
    return fresh.join(taken.select("id").distinct(), "id", "left_anti")
