"""Occurrences of targets with their sentences: exact, by stem, and by near spelling."""

from __future__ import annotations

import functools
import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmine.functions import text as T
from lexmine.functions import udfs
from lexmine.operators.text import word_index
from lexmine.sources.shared import checkpoint

#: A target has four words at most, so that many lengths of phrases are looked up.
LONGEST = 4


def exact_matches(sents: DataFrame, targets: DataFrame, longest: int = LONGEST) -> DataFrame:
    """JOI12. (doc_id, sent_id, start, end, target) of targets (of letters and spaces) in any case, on word bounds.

    Postings meet the words of the targets first; phrases are then put together from what is left, by the
    words that follow each other. No text is scanned once a target. Spark broadcasts the words if they are few.
    """
    keyed = targets.select("target", T.target_key(F.col("target")).alias("gram")).withColumn("ws", F.split("gram", " ")).where(F.size("ws") <= longest)
    postings = word_index(sents).withColumn("w", F.lower("token"))
    if longest == 1:
        found = postings.join(keyed.select("target", F.col("gram").alias("w")), "w").select("doc_id", "sent_id", "start", (F.col("start") + F.length("token")).alias("end"), "target")
        return found
    some = postings.join(keyed.select(F.explode("ws").alias("w")).distinct(), "w")
    return word_grams(some, F.col("w"), longest).join(keyed.select("target", "gram"), "gram").select("doc_id", "sent_id", "start", "end", "target")


def single_word_candidates(sents: DataFrame, targets: DataFrame, stem) -> DataFrame:
    """SET1. Exact and inflected forms of targets of one word (of letters, in lower case): (doc_id, sent_id, start, end, target, kind), kind exact or variant.

    A form that equals its target has its stem too, so one reading and one join by stem find both; stem is a column function.
    """
    stems = targets.select("target", stem("target").alias("stem"))
    postings = word_index(sents).where(F.length("token") >= 3).withColumn("w", F.lower("token")).withColumn("stem", stem("w"))
    kind = F.when(F.col("w") == F.col("target"), "exact").otherwise("variant")
    return postings.join(stems, "stem").select("doc_id", "sent_id", "start", (F.col("start") + F.length("token")).alias("end"), "target", kind.alias("kind"))


def word_grams(postings: DataFrame, value, longest: int, shortest: int = 1) -> DataFrame:
    """Runs of shortest to longest words, of which only white space parts each from the one before: (doc_id, sent_id, start, end, gram of their values).

    postings needn't be all words: a run is broken where one is missing.
    """
    w = W.partitionBy("doc_id", "sent_id").orderBy("pos")
    one = postings.select("doc_id", "sent_id", "pos", "start", (F.col("start") + F.length("token")).alias("stop"), "follows", value.alias("v"))
    grams, known, said = [], F.lit(True), F.col("v")
    for n in range(1, longest + 1):
        if n > 1:
            ahead = lambda c, k=n - 1: F.lead(c, k).over(w)
            known = known & F.coalesce(ahead("follows") & (ahead("pos") == F.col("pos") + 2 * (n - 1)), F.lit(False))
            said = F.concat_ws(" ", said, ahead("v"))
        if n >= shortest:
            grams.append(F.when(known, F.struct((F.col("stop") if n == 1 else F.lead("stop", n - 1).over(w)).alias("end"), said.alias("gram"))))
    found = one.select("doc_id", "sent_id", "start", F.array(*grams).alias("g"))
    return found.select("doc_id", "sent_id", "start", F.explode("g").alias("g")).where("g IS NOT NULL").select("doc_id", "sent_id", "start", "g.end", "g.gram")


def longest_first(matches: DataFrame, limit: int = 12) -> DataFrame:
    """WIN7. In each document the matches that a greedy walk takes: by place, longer first, none that overlaps one taken, limit for each target (tested first).

    Spark sorts each document's matches; the walk goes over them once and holds a count a target of one document.
    """
    kind = matches.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("sent_id", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("target", pa.string())])

    def walk(batches):
        doc, counts, last = None, None, None
        for batch in batches:
            kept = []
            for k, (d, s, start, end, target) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if counts is None or d != doc:
                    doc, counts, last = d, {}, None
                if counts.get(target, 0) < limit and (last is None or last[0] != s or start >= last[1]):
                    counts[target] = counts.get(target, 0) + 1
                    last = s, end
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int32())).cast(schema)

    rows = matches.select("doc_id", F.col("sent_id").cast("int").alias("sent_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "target")
    laid = rows.repartition("doc_id").sortWithinPartitions("doc_id", "sent_id", "start", F.desc("end"), "target")
    return laid.mapInArrow(walk, f"doc_id {kind.simpleString()}, sent_id int, start long, end long, target string")


def contexts(matches: DataFrame, sents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Matches with the sentence (trimmed around the target), the surface form, HTML and recall template, and a stable id; columns to keep come last."""
    both = matches.join(sents, ["doc_id", "sent_id"])
    w = T.trim_window(F.col("sentence"), F.col("start").cast("int"), F.col("end").cast("int"))
    out = both.withColumn("w", w).select("doc_id", "sent_id", "target", *keep, F.col("start").alias("place"), F.col("w.sentence").alias("sentence"), F.col("w.start").alias("s"), F.col("w.end").alias("e"))
    marked, recall = T.mark_span(F.col("sentence"), F.col("s"), F.col("e"))
    out = out.withColumn("surface", F.substr("sentence", F.col("s") + 1, F.col("e") - F.col("s")))
    return out.select("doc_id", "sent_id", "place", "target", "surface", "sentence", marked.alias("sentence_html"), recall.alias("recall_template"), T.stable_id(F.col("doc_id"), F.col("sent_id"), F.col("place"), F.col("surface"), F.col("sentence")).alias("id"), *keep)


def first_seen(found: DataFrame) -> DataFrame:
    """WIN18. In each document the first of contexts with one surface and sentence."""
    w = W.partitionBy("doc_id", F.lower("surface"), T.target_key(F.col("sentence"))).orderBy("sent_id", "place")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def concordance(docs: DataFrame, sents: DataFrame, targets: DataFrame, limit: int = 12) -> DataFrame:
    """PIP3. Contexts of literal occurrences."""
    return first_seen(contexts(longest_first(exact_matches(sents, targets), limit), sents))


def variant_matches(sents: DataFrame, targets: DataFrame, stem=udfs.porter_stem, ratio=udfs.weighted_ratio, cutoff: float = 78.0) -> DataFrame:
    """JOI13 and JOI14. Inflected and near-spelled forms: (doc_id, sent_id, start, end, target, kind), kind 0 by stem and 1 by spelling.

    Stems and likeness are computed on the distinct vocabulary (written down once) and its pairs with the targets'
    first four letters. Postings then meet the forms found, so only words that are one are ever shuffled.
    """
    postings = word_index(sents).where(F.length("token") >= 3).withColumn("w", F.lower("token"))
    vocabulary = checkpoint(postings.select("w").distinct().withColumn("stem", stem("w")))
    t = targets.select("target", F.regexp_extract_all(F.lower("target"), F.lit("[a-z]+"), F.lit(0)).alias("ws")).where(F.forall("ws", lambda w: F.length(w) >= 3) & (F.size("ws") > 0))
    pieces = t.select("target", F.posexplode("ws").alias("i", "w"))
    stems = pieces.withColumn("stem", stem("w")).groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "stem"))), lambda x: x["stem"]).alias("stems"))
    stems = checkpoint(stems.select("target", "stems", F.array_join("stems", " ").alias("gram"), F.size("stems").alias("n")))
    single = stems.where("n = 1").withColumn("t", F.lower("target"))
    alike = vocabulary.join(single.select(F.col("gram").alias("stem"), "target"), "stem").select("w", "target", F.lit(0).alias("kind"))
    near = vocabulary.where(F.length("w") >= 4).join(single, F.substr("w", F.lit(1), F.lit(4)) == F.substr("t", F.lit(1), F.lit(4)))
    near = near.where((F.col("w") != F.col("t")) & (F.abs(F.length("w") - F.length("t")) <= 4) & (F.col("stem") != F.col("gram"))).select("w", "t", "target").distinct()
    near = near.withColumn("score", ratio("t", "w")).where(F.col("score") >= cutoff).select("w", "target", F.lit(1).alias("kind"))
    out = postings.join(alike.unionByName(near), "w").select("doc_id", "sent_id", "start", (F.col("start") + F.length("token")).alias("end"), "target", "kind")
    many = stems.where(F.col("n").between(2, LONGEST))
    if many.isEmpty():
        return out
    forms = vocabulary.join(many.select(F.explode("stems").alias("stem")).distinct(), "stem")
    grams = word_grams(postings.join(forms, "w"), F.col("stem"), LONGEST, shortest=2).join(many.select("gram", "target"), "gram")
    return out.unionByName(grams.select("doc_id", "sent_id", "start", "end", "target", F.lit(0).alias("kind")))


def variant_concordance(sents: DataFrame, targets: DataFrame, limit: int = 8, **how) -> DataFrame:
    """PIP4. Contexts of variant forms, limit a target and document, stems before spellings (WIN8)."""
    found = variant_matches(sents, targets, **how)
    made = first_seen_by_target(contexts(found, sents, keep=("kind",))).where(F.lower("surface") != T.target_key(F.col("target")))
    w = W.partitionBy("doc_id", "target").orderBy("kind", "sent_id", "place")
    return made.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")


def first_seen_by_target(found: DataFrame) -> DataFrame:
    w = W.partitionBy("doc_id", "target", F.lower("surface"), T.target_key(F.col("sentence"))).orderBy("kind", "sent_id", "place")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


#: Bytes of targets that one automaton holds at most; with more, texts are read once for each such part.
AUTOMATON_BYTES = 8_000_000


def _fold(c: str) -> str:
    """A letter as a search in any case knows it; one letter for one, so places stay."""
    folded = c.casefold()
    return {"\u0130": "i", "\u0131": "i"}.get(c) or (folded if len(folded) == 1 else c.lower() if len(c.lower()) == 1 else c)


#: In any case, so a few letters beyond ASCII count too.
_LETTER = re.compile("[A-Za-z]", re.IGNORECASE)


class Finder:
    """All targets in one automaton. find() reads a text once and gives (start, end, target) as a search for each target would: on letter bounds, in any case, any white space between words, none that overlaps an earlier one of its target."""

    def __init__(self, targets: tuple[str, ...]):
        self.known: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        by_key: dict[str, list[int]] = {}
        self.targets = targets
        self.patterns: list[re.Pattern | None] = [None] * len(targets)
        for k, target in enumerate(targets):
            if key := self.folded(" ".join(target.split())):
                by_key.setdefault(key, []).append(k)
        for key, which in by_key.items():
            self.automaton.add_word(key, (len(key), which))
        self.any = bool(by_key)
        if self.any:
            self.automaton.make_automaton()

    def folded(self, text: str) -> str:
        known = self.known
        for c in set(text) - known.keys():
            known[c] = _fold(c)
        return "".join([known[c] for c in text])

    def _same(self, k: int, found: str) -> bool:
        """Folding joins a few letters more than a search in any case does."""
        if self.patterns[k] is None:
            self.patterns[k] = re.compile("\\s+".join(map(re.escape, self.targets[k].split())), re.IGNORECASE)
        return self.patterns[k].fullmatch(found) is not None

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text or not self.any:
            return []
        # white space runs as one space: `cuts` has the places after which more was left out, `gone` how much by then
        cuts, gone, parts, last, lost = [], [0], [], 0, 0
        for run in re.finditer("\\s+", text):
            a, b = run.span()
            parts += [text[last:a], " "]
            last = b
            if b - a > 1:
                lost += b - a - 1
                cuts.append(b - lost - 1)
                gone.append(lost)
        parts.append(text[last:])
        flat = self.folded("".join(parts))
        out, reached = [], {}
        for end, (size, which) in self.automaton.iter(flat):
            first = end + 1 - size
            a, b = first + gone[bisect_right(cuts, first - 1)], end + 1 + gone[bisect_right(cuts, end)]
            if (a and _LETTER.match(text[a - 1])) or (b < len(text) and _LETTER.match(text[b])):
                continue
            for k in which:
                if reached.get(k, 0) <= a and self._same(k, text[a:b]):
                    reached[k] = b
                    out.append((a, b, self.targets[k]))
        return out


@functools.lru_cache(maxsize=2)
def _finder(targets: tuple[str, ...]) -> Finder:
    """A worker builds an automaton once."""
    return Finder(targets)


def pattern_matches(docs: DataFrame, targets: DataFrame, most: int = AUTOMATON_BYTES) -> DataFrame:
    """UDF8. (doc_id, start, end, target) of targets that hold more than letters and spaces, which no run of words can express.

    A text is read once for all targets together, by an automaton; targets are split only if they have more than
    `most` bytes, by hash, into as many parts as that needs.
    """
    real = targets.select("target").where(F.trim(F.regexp_replace("target", "\\s+", " ")) != "").distinct()
    held = real.agg(F.coalesce(F.sum(F.octet_length("target")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-held // most))
    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("start", pa.int64()), ("end", pa.int64()), ("target", pa.string())])
    out = None
    for part in range(parts):
        some = [r["target"] for r in real.where(F.pmod(F.xxhash64("target"), F.lit(parts)) == part).orderBy("target").collect()]  # about `most` bytes
        shared = docs.sparkSession.sparkContext.broadcast(tuple(some))

        def search(batches, shared=shared):
            finder = _finder(shared.value)
            for batch in batches:
                rows, found = [], []
                for k, text in enumerate(batch.column(1)):
                    hits = finder.find(text.as_py())
                    rows += [k] * len(hits)
                    found += hits
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

        one = docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind.simpleString()}, start long, end long, target string")
        out = one if out is None else out.unionByName(one)
    return out
