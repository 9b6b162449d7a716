"""Documents, sentences and word positions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmine.functions import text as T
from lexmine.functions import udfs

#: Characters of text that are split at once.
SLICE = 500_000


def clean_documents(pages: DataFrame) -> DataFrame:
    """PIP1. pages (doc_id, page_no, raw_text) to documents (doc_id, text, page_ranges, hard_page_starts).

    Pages lose page numbers, links and headings, are joined by a space, and keep their code-point ranges; a page
    without prose has an empty range. A page starts hard if its first line is a heading.
    """
    lines = T.clean_lines(F.coalesce("raw_text", F.lit("")))
    firsts = F.filter(F.transform(F.split(F.coalesce("raw_text", F.lit("")), "\\r?\\n"), F.trim), lambda x: (x != "") & ~x.rlike("^[0-9]{1,3}$"))
    clean = pages.select("doc_id", "page_no", T.dehyphenate(F.array_join(lines, "\n")).alias("t"), F.coalesce(T.is_heading(F.get(firsts, 0)), F.lit(False)).alias("h"))
    return joined_pages(clean)


def joined_pages(pages: DataFrame) -> DataFrame:
    """Clean pages (doc_id, page_no, t, h: does it start hard) as documents (doc_id, text, page_ranges, hard_page_starts)."""
    by_doc = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "t", "h"))).alias("p"))
    sizes = F.transform("p", lambda x: F.length(x["t"]))
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, n):
        last = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
        start = last + F.when((last > 0) & (n > 0), 1).otherwise(0)
        return F.concat(acc, F.array(F.struct(start.alias("start"), (start + n).alias("end"))))

    text = F.array_join(F.filter(F.transform("p", lambda x: x["t"]), lambda t: t != ""), " ")
    return by_doc.select("doc_id", text.alias("text"), F.aggregate(sizes, zero, step).alias("page_ranges"), F.transform("p", lambda x: x["h"]).alias("hard_page_starts"))


def page_of(position: Column, page_ranges: Column) -> Column:
    """JOI16. The page (from 1) that holds a position; the last one if none does."""
    inside = F.filter(F.transform(page_ranges, lambda r, i: F.when(position.between(r["start"], r["end"]), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.get(inside, 0), F.size(page_ranges))


_STOP = re.compile("[.!?:]+[\"'”’)\\]}]*")
_NAME = re.compile("\\s*[\\w-]{1,30}\\s*=")
_ABBREVIATIONS = frozenset(T.ABBREVIATIONS)


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Where the sentences of a squeezed text start and end, in code points.

    A sentence ends at a run of . ! ? : and closing marks, but not between a letter or digit and a digit, nor
    after an abbreviation; a colon ends one only before "name =". What is left at the end is a sentence too.
    """
    begin, size = 0, len(text)
    for stop in _STOP.finditer(text):
        at, end = stop.span()
        if text[at] == ":" and not _NAME.match(text, end):
            continue
        if at and text[at + 1 : at + 2].isdigit() and text[at - 1].isalnum():
            continue
        if text[max(begin, text.rfind(" ", begin, at) + 1) : at + 1].casefold() in _ABBREVIATIONS:
            continue
        if text[begin] == " ":
            begin += 1
        yield begin, end
        begin = end
    if begin < size and text[begin] == " ":
        begin += 1
    if begin < size:
        yield begin, size


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have SLICE characters or so."""
    start = held = 0
    for k, text in enumerate(batch.column(column)):
        held += len(text.as_buffer() or b"")
        if held > SLICE:
            yield batch.slice(start, k + 1 - start)
            start, held = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def sentence_spans(docs: DataFrame) -> DataFrame:
    """PIP2, FUN4. documents (doc_id, text) to (doc_id, sent_id, start, end, sentence): sentences count from 0, spans are code points of the squeezed text.

    One pass over a text in Python, an Arrow batch at a time: chained patterns can't tell places, and take five times as long.
    """
    squeezed = docs.select("doc_id", T.squeeze(F.col("text")).alias("text"))
    kind = squeezed.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("sent_id", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("sentence", pa.string())])

    def split(batches):
        for batch in (part for whole in batches for part in _slices(whole, 1)):
            rows, ids, starts, ends, said = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for n, (a, b) in enumerate(spans(text or "")):
                    rows.append(k)
                    ids.append(n)
                    starts.append(a)
                    ends.append(b)
                    said.append(text[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, f.type) for c, f in zip((ids, starts, ends, said), list(schema)[1:], strict=True))], schema=schema)

    return squeezed.mapInArrow(split, f"doc_id {kind.simpleString()}, sent_id int, start int, end int, sentence string")


def sentences(docs: DataFrame) -> DataFrame:
    """PIP2. documents (doc_id, text) to (doc_id, sent_id, sentence)."""
    return sentence_spans(docs).drop("start", "end")


def page_sentences(docs: DataFrame) -> DataFrame:
    """PIP2. Sentences of clean documents (of clean_documents) as each of their pages has them: doc_id, sent_id, page (from 1), start, end, sentence.

    Sentence ends and hard page starts are two lists of breaks that are merged: on a page that starts hard, a
    sentence from the page before begins with the page. An abbreviation left over at the beginning ("g., ") is
    dropped. A sentence over several pages has a row for each.
    """
    pages = docs.select("doc_id", F.posexplode("page_ranges").alias("page", "r"), "hard_page_starts").select("doc_id", (F.col("page") + 1).alias("page"), "r.*", F.get("hard_page_starts", F.col("page")).alias("hard")).where("end > start")
    pages = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "page", "hard"))).alias("pages"))  # the ranges of a document, not its text
    said = sentence_spans(docs).join(pages, "doc_id").withColumnsRenamed({"start": "s", "end": "e"})
    on = said.select("doc_id", "sent_id", "s", "e", "sentence", F.explode(F.filter("pages", lambda p: (p["start"] < F.col("e")) & (p["end"] > F.col("s")))).alias("p"))
    begin = F.when(F.col("p.hard"), F.greatest("s", F.col("p.start"))).otherwise(F.col("s"))
    on = on.select("doc_id", "sent_id", F.col("p.page").alias("page"), begin.alias("start"), F.col("e").alias("end"), F.substr("sentence", begin - F.col("s") + 1).alias("sentence"))
    left = F.length(F.regexp_extract("sentence", "^[a-z]\\.,\\s+", 0))
    return on.select("doc_id", "sent_id", "page", (F.col("start") + left).alias("start"), "end", F.substr("sentence", left + 1).alias("sentence"))


def sentence_at(matches: DataFrame, said: DataFrame) -> DataFrame:
    """JOI15. matches (doc_id, page, position, ...) with the sentence of page_sentences that holds the position on that page.

    The join is by document and page, and by bands of the text, so a page's matches meet the sentences around them only.
    """
    band = 1000
    dealt = said.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / band), F.floor(F.col("end") / band))))
    both = matches.withColumn("_b", F.floor(F.col("position") / band)).join(dealt, ["doc_id", "page", "_b"])
    return both.where("position >= start AND position < end").drop("_b")


_WORD, _RUN = re.compile("[A-Za-z]+"), re.compile("[^A-Za-z\\s]+|\\s+", re.ASCII)


def word_index(sents: DataFrame) -> DataFrame:
    """AGG11. Postings (doc_id, sent_id, pos, start, token, follows): the runs of letters of each sentence with their offsets.

    pos counts all runs (of letters, of spaces, of others); follows: only white space parts the word from the
    one before. One pass in Python, an Arrow batch at a time, as Spark has no expression for the places of all
    matches; tokens are not shuffled.
    """
    kind = sents.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("sent_id", pa.int32()), ("pos", pa.int32()), ("start", pa.int64()), ("token", pa.string()), ("follows", pa.bool_())])

    def index(batches):
        gaps: dict[str, tuple[int, bool]] = {"": (0, False), " ": (1, True)}
        for batch in (part for whole in batches for part in _slices(whole, 2)):
            rows, places, starts, tokens, follows = [], [], [], [], []
            for k, sentence in enumerate(batch.column(2).to_pylist()):
                pos, last = -1, 0
                for word in _WORD.finditer(sentence or ""):
                    start, end = word.span()
                    gap = sentence[last:start]
                    known = gaps.get(gap)
                    if known is None:
                        known = len(_RUN.findall(gap)), gap.isspace()
                        if len(gaps) < 10_000:
                            gaps[gap] = known
                    pos += known[0] + 1
                    rows.append(k)
                    places.append(pos)
                    starts.append(start)
                    tokens.append(word.group())
                    follows.append(known[1] and last > 0)
                    last = end
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, f.type) for c, f in zip((places, starts, tokens, follows), list(schema)[2:], strict=True))], schema=schema)

    return sents.select("doc_id", F.col("sent_id").cast("int").alias("sent_id"), "sentence").mapInArrow(index, f"doc_id {kind.simpleString()}, sent_id int, pos int, start long, token string, follows boolean")


def phrases(sents: DataFrame, n: int) -> DataFrame:
    """All runs of n words of a sentence that only white space parts: (doc_id, sent_id, start, end, gram), gram in lower case with single spaces."""
    kind = sents.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("sent_id", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("gram", pa.string())])

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole, 2)):
            rows, starts, ends, grams = [], [], [], []
            for k, sentence in enumerate(batch.column(2).to_pylist()):
                held: list[tuple[int, str]] = []
                last = 0
                for word in _WORD.finditer(sentence or ""):
                    start, end = word.span()
                    if held and not sentence[last:start].isspace():
                        held = []
                    held.append((start, word.group().lower()))
                    last = end
                    if len(held) == n:
                        rows.append(k)
                        starts.append(held[0][0])
                        ends.append(end)
                        grams.append(" ".join(w for _, w in held))
                        held = held[1:]
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, f.type) for c, f in zip((starts, ends, grams), list(schema)[2:], strict=True))], schema=schema)

    return sents.select("doc_id", F.col("sent_id").cast("int").alias("sent_id"), "sentence").mapInArrow(run, f"doc_id {kind.simpleString()}, sent_id int, start long, end long, gram string")


def through_python(df: DataFrame, column: str, needs: Column, udf) -> DataFrame:
    """df with column mapped by a Python function where needs holds; only different values go to Python, rows that don't need it aren't shuffled."""
    rest = df.where(needs)
    values = rest.select(column).distinct().withColumn("_mapped", udf(column))
    mapped = rest.join(values, column).withColumn(column, F.col("_mapped")).select(df.columns)
    return df.where(~needs).unionByName(mapped)


def mapped_in_place(df: DataFrame, column: str, needs: Column, udf) -> DataFrame:
    """As through_python, for whole documents, which cost more to shuffle than to map again: other rows send a null to Python, and no row is shuffled."""
    mapped = df.withColumn("_mapped", udf(F.when(needs, F.col(column))))
    return mapped.withColumn(column, F.coalesce("_mapped", column)).select(df.columns)


def normalize_selections(df: DataFrame, column: str) -> DataFrame:
    """FUN1. df with a column of selected texts as targets; texts with compatibility characters (ligatures, full width, ...) pass NFKC and full case folding first (UDF3)."""
    ready = mapped_in_place(df, column, T.has_compatibility(F.col(column)), udfs.nfkc_fold)
    return ready.withColumn(column, T.normalize_selection(F.col(column)))


def unescape_texts(df: DataFrame, column: str) -> DataFrame:
    """FUN9. df with a column's entities as characters, from the full table (UDF4) where others than the usual ones occur."""
    rare = T.has_entity(F.col(column))
    marked = df.withColumn("_rare", rare).withColumn(column, F.when(rare, F.col(column)).otherwise(T.unescape_html(F.col(column))))
    return through_python(marked, column, F.col("_rare"), udfs.html_unescape).drop("_rare")
