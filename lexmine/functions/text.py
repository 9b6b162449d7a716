"""Column functions for cleaning, splitting and marking text. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words whose full stop doesn't end a sentence.
ABBREVIATIONS = ["al.", "approx.", "dr.", "e.", "e.g.", "eq.", "eqs.", "etc.", "fig.", "figs.", "g.", "i.e.", "mr.", "mrs.", "ms.", "no.", "prof.", "s.", "sec.", "secs.", "st.", "v.", "v.s.", "vs."]
#: Words that don't count when the words of two sentences are compared.
STOPWORDS = [
    "about", "after", "also", "among", "and", "are", "because", "been", "before", "being", "between", "both", "but", "can", "could", "does",
    "during", "each", "for", "from", "had", "has", "have", "into", "its", "may", "more", "most", "not", "only", "other", "our", "over", "same",
    "such", "than", "that", "the", "their", "these", "they", "this", "through", "under", "using", "was", "were", "when", "where", "which", "while",
    "with", "would",
]
#: Characters of a context at most; the mark of a hidden target in a recall template.
CONTEXT_CHARS, RECALL_MARK = 420, "[[[TARGET_RU]]]"

#: Private-use characters: a full stop that ends nothing, and the place after a sentence.
_DOT, _END = "\uE000", "\uE001"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def fold(c: Column) -> Column:
    """Lower case with ß as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def target_key(c: Column) -> Column:
    """The key of a target: folded, white space squeezed."""
    return squeeze(fold(c))


def normalize_selection(c: Column) -> Column:
    """A selected text as a target: line-break hyphens joined, apostrophes and dashes unified, other marks dropped, folded.

    Compatibility characters are not mapped here: operators.text.normalize_selections does that for the texts that hold some.
    """
    v = F.regexp_replace(c, "[-\\x{2010}-\\x{2015}\\x{2212}\\x{AD}]\\s*\\r?\\n\\s*", "")
    v = F.regexp_replace(v, "\\x{AD}", "")
    v = F.regexp_replace(v, "[\\x{2019}\\x{2018}\\x{2BC}\\x{FF07}]", "'")
    v = F.regexp_replace(v, "[\\p{Pd}\\x{2212}]", "-")
    v = squeeze(fold(F.regexp_replace(v, "[^\\p{L}\\p{M}\\p{N}'\\-]", " ")))
    v = F.regexp_replace(F.regexp_replace(v, "-{2,}", "-"), "'{2,}", "'")
    return F.regexp_replace(v, "^[ \\-']+|[ \\-']+$", "")


#: Characters that NFKC leaves as they are and that fold() folds as a full case folding does: ASCII, most of Latin, Cyrillic, and common marks.
_PLAIN = "\\x{00}-\\x{7F}\\x{A1}-\\x{A7}\\x{A9}\\x{AB}-\\x{AE}\\x{B0}\\x{B1}\\x{B6}\\x{B7}\\x{BB}\\x{BF}-\\x{12F}\\x{131}\\x{134}-\\x{13E}\\x{141}-\\x{148}\\x{14A}-\\x{17E}\\x{400}-\\x{45F}\\x{2010}\\x{2012}-\\x{2016}\\x{2018}-\\x{2022}\\x{2212}"


def has_compatibility(c: Column) -> Column:
    """May a text hold characters that NFKC or full case folding changes otherwise than normalize_selection does?"""
    return F.coalesce(c.rlike(f"[^{_PLAIN}]"), F.lit(False))


def has_entity(c: Column) -> Column:
    """Does a text hold an entity beyond those of unescape_html? A semicolon may be missing."""
    known = F.regexp_replace(c, "&(amp|lt|gt|quot|#x27|#39);", "")
    return F.coalesce(known.rlike("&(#|[A-Za-z])"), F.lit(False))


def repair_spacing(c: Column) -> Column:
    """Squeezed text without spaces before closing marks, after opening ones, or before 's."""
    v = F.regexp_replace(c, "\\s+([,;:.!?%)\\]}])", "$1")
    v = F.regexp_replace(v, "([(\\[{])\\s+", "$1")
    v = F.regexp_replace(v, "\\s+(['’])s\\b", "$1s")
    return squeeze(v)


def dehyphenate(c: Column) -> Column:
    """Joins words that a line break cut, and turns other line breaks into spaces."""
    v = F.regexp_replace(c, "([a-z])- *\\n *([a-z])", "$1$2")
    return squeeze(v)


def is_heading(line: Column) -> Column:
    """Does a line look like a numbered section heading?"""
    return (F.length(line) <= 120) & line.rlike("^([0-9]+(\\.[0-9]+)*\\.?|[A-Z]\\.?)\\s+[A-Z][A-Za-z0-9 :,\\-/()]+$")


def clean_lines(page: Column) -> Column:
    """The lines of a page that are prose: after an "abstract" line if there is one, no blanks, page numbers, footnote links or headings."""
    lines = F.transform(F.split(page, "\\r?\\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    at = F.array_position(F.transform(lines, F.lower), F.lit("abstract"))
    rest = F.slice(lines, at.cast("int") + 1, F.size(lines))
    return F.filter(rest, lambda x: (x != "") & ~x.rlike("^[0-9]{1,3}$") & ~x.rlike("(?i)^[0-9]*\\s*(https?://|www\\.)\\S+$") & ~is_heading(x))


def is_sentence_end(word: Column) -> Column:
    """Does a word end a sentence?"""
    core = F.regexp_replace(F.trim(word), "[\"'”’)\\]}]+$", "")
    ends = core.rlike("[.!?]$") & ~F.lower(core).isin(ABBREVIATIONS) & ~core.rlike("^[0-9]+\\.[0-9]+$")
    return F.when(~(word.contains(".") | word.contains("!") | word.contains("?")), False).otherwise(ends)  # most words hold no mark


def sentence_array(text: Column) -> Column:
    """The sentences of a text.

    A sentence ends at a run of . ! ? and closing marks, but not between a letter or digit and a digit,
    nor after an abbreviation; a colon ends one only before "name =". What is left at the end is a
    sentence too.
    """
    s = squeeze(text)
    for _ in range(2):  # adjacent decimals share a digit
        s = F.regexp_replace(s, "([A-Za-z0-9])\\.([0-9])", f"$1{_DOT}$2")
    for a, b in (x[:-1].split(".") for x in ABBREVIATIONS if x.count(".") == 2):
        s = F.regexp_replace(s, f"(?i)(^| )({a})\\.({b})\\.", f"$1$2{_DOT}$3{_DOT}")
    plain = "|".join(x[:-1] for x in ABBREVIATIONS if x.count(".") == 1)
    for _ in range(2):  # neighbours share a space
        s = F.regexp_replace(s, f"(?i)(^| )({plain})\\.", f"$1$2{_DOT}")
    s = F.regexp_replace(s, "([.!?]+[\"'”’)\\]}]*)", f"$1{_END}")
    s = F.regexp_replace(s, "(:)(\\s*[\\w-]{1,30}\\s*=)", f"$1{_END}$2")
    parts = F.transform(F.split(s, _END), lambda x: F.trim(F.replace(x, F.lit(_DOT), F.lit("."))))
    return F.filter(parts, lambda x: x != "")


def is_selectable(c: Column) -> Column:
    """May a text be a target: 1 to 4 words of letters, digits and inner apostrophes or hyphens, 100 characters at most."""
    parts = F.filter(F.split(c, "\\s+"), lambda w: w != "")
    return F.size(parts).between(1, 4) & F.forall(parts, lambda w: w.rlike("^[\\p{L}\\p{N}_]+(['’-][\\p{L}\\p{N}_]+)*$")) & (F.length(c) <= 100)


def numbers(c: Column) -> Column:
    """The numbers of a text that no letter stands before, with their percent signs."""
    return F.regexp_extract_all(c, F.lit("(?<![A-Za-z])[0-9]+(?:\\.[0-9]+)?%?"), F.lit(0))


def is_readable(c: Column) -> Column:
    """Is a sentence prose that can serve as an example: long enough, no table row, few numbers and symbols?"""
    s = F.trim(c)
    n = F.size(numbers(s))
    return (
        (F.length(s) >= 45)
        & ~s.endswith(" .")
        & ~s.contains("|")
        & ~s.rlike("^(…\\s*)?[0-9]+\\s+[0-9]+(\\.[0-9]+)+\\s+")
        & (n < 8)
        & (F.size(F.filter(numbers(s), lambda x: x.endswith("%"))) < 3)
        & ~(s.startswith("…") & (n >= 4))
        & (F.length(F.regexp_replace(s, "[^\\p{S}]", "")) < 5)
    )


def content_words(c: Column, targets: Column | None = None) -> Column:
    """Distinct words of three letters or more, without stop words and the words of targets (an array of words), sorted."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(fold(c), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 3))
    found = F.array_except(found, F.lit(STOPWORDS))
    return F.array_sort(F.array_except(found, targets) if targets is not None else found)


def context_score(target: Column, anchor: Column, candidate: Column) -> Column:
    """100 + shared words for targets of two words or more; else the shared words, null if under two. anchor and candidate are arrays of words."""
    shared = F.size(F.array_intersect(anchor, candidate))
    many = F.size(F.regexp_extract_all(target, F.lit("[A-Za-z]+"), F.lit(0))) >= 2
    return F.when(many, 100 + shared).when(shared >= 2, shared)


def escape_html(c: Column) -> Column:
    """Text for HTML: & < > and both quotes as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_html(c: Column) -> Column:
    """The five entities of escape_html and &#39; as characters; udfs.html_unescape knows them all."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column, tag_replacement: str = "") -> Column:
    """Text without tags; tag_replacement stands in for each."""
    return F.regexp_replace(c, "<[^>]+>", tag_replacement)


def split_outer_punctuation(c: Column) -> Column:
    """Struct of the opening marks, the core and the closing marks of a text."""
    pattern = "^([\"'“‘(\\[{]*)(.*?)([\"'”’)\\]},;:.!?]*)$"
    return F.struct(*[F.regexp_extract(c, pattern, k).alias(n) for k, n in ((1, "prefix"), (2, "core"), (3, "suffix"))])


def join_words(parts: Column) -> Column:
    """Words joined by spaces; a word that ends in a hyphen joins the next if that begins in lower case."""
    joined = F.array_join(parts, " ")
    return F.when(joined.contains("- "), F.regexp_replace(joined, "- ([a-z])", "$1")).otherwise(joined)


def trim_window(sentence: Column, start: Column, end: Column, maximum: int = CONTEXT_CHARS) -> Column:
    """Struct of a long sentence's part around [start, end) (0-based), and the target's start and end in it.

    45 % of the room goes before the target; cuts are moved to spaces and marked with an ellipsis.
    """
    n = F.length(sentence)

    def budget(x):
        room = F.greatest(F.lit(40), maximum - (x["end"] - x["start"]) - 4)
        a = F.greatest(F.lit(0), x["start"] - F.floor(room * 0.45).cast("int"))
        return F.struct(x["s"].alias("s"), x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n"), a.alias("a"), F.least(x["n"], a + maximum).alias("b"))

    def back(x):
        a = F.when(x["b"] == x["n"], F.greatest(F.lit(0), x["b"] - maximum)).otherwise(x["a"])
        return x.withField("a", a)

    def spaces(x):
        before = F.position(F.lit(" "), x["s"], x["a"] + 1)
        after = F.position(F.lit(" "), F.reverse(F.substr(x["s"], x["end"] + 1, F.greatest(x["b"] - x["end"], F.lit(0)))))
        return x.withField("gap", before).withField("cut", F.when(after > 0, x["b"] - after).otherwise(0))

    def moved(x):
        a = F.when((x["a"] > 0) & (x["gap"] > 0) & (x["gap"] - 1 < x["start"]), x["gap"]).otherwise(x["a"])
        return x.withField("a", a).withField("b", F.when((x["b"] < x["n"]) & (x["cut"] > x["end"]), x["cut"]).otherwise(x["b"]))

    def cut(x):
        prefix, suffix = F.when(x["a"] > 0, F.lit("… ")).otherwise(""), F.when(x["b"] < x["n"], F.lit(" …")).otherwise("")
        place = F.length(prefix) + x["start"] - x["a"]
        return F.struct(F.concat(prefix, F.trim(F.substr(x["s"], x["a"] + 1, x["b"] - x["a"])), suffix).alias("sentence"), place.cast("int").alias("start"), (place + x["end"] - x["start"]).cast("int").alias("end"))

    given = F.struct(sentence.alias("s"), start.alias("start"), end.alias("end"), n.alias("n"))
    trimmed = given
    for step in (budget, back, spaces, moved, cut):
        trimmed = let(trimmed, step)
    return F.when(n > maximum, trimmed).otherwise(F.struct(sentence.alias("sentence"), start.cast("int").alias("start"), end.cast("int").alias("end")))


def mark_span(sentence: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """HTML with the target bold, and with the recall mark in its place."""
    before, inner, after = escape_html(F.substr(sentence, F.lit(1), start)), escape_html(F.substr(sentence, start + 1, end - start)), escape_html(F.substr(sentence, end + 1))
    return F.concat(before, F.lit("<b>"), inner, F.lit("</b>"), after), F.concat(before, F.lit(RECALL_MARK), after)


def emphasize(sentence: Column, target: Column, replacement: Column | None = None) -> Column:
    """HTML of a sentence with the first case-blind occurrence of target bold, or replaced; escaped as it is without one."""
    at = F.position(F.lower(target), F.lower(sentence))
    inner = F.substr(sentence, at, F.length(target)) if replacement is None else replacement
    return F.when(at > 0, F.concat(escape_html(F.substr(sentence, F.lit(1), at - 1)), F.lit("<b>"), escape_html(inner), F.lit("</b>"), escape_html(F.substr(sentence, at + F.length(target))))).otherwise(escape_html(sentence))


def nearest_occurrence(text: Column, target: Column, hint: Column) -> Column:
    """WIN19. Where target begins in text nearest to hint (from 1; the earlier of two as near); null if it doesn't occur. One search forward and one backward from the hint."""
    size, width, at = F.length(text), F.length(target), F.greatest(hint.cast("int"), F.lit(1))
    after = F.position(target, text, at)
    back = F.position(F.reverse(target), F.reverse(text), F.greatest(F.lit(1), size - width + 3 - at))
    before = F.when(back > 0, size - back - width + 2)
    return F.when(after == 0, before).when(before.isNull() | (after - at < at - before), after).otherwise(before)


def safe_tag(c: Column) -> Column:
    """A tag without white space and odd characters; "article" if nothing is left."""
    v = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_:-]+", "_"), "^_+|_+$", "")
    return F.get(F.transform(F.array(v), lambda x: F.when(x == "", "article").otherwise(x)), F.lit(0))  # v is computed once


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def strip_code_fence(c: Column) -> Column:
    """The inside of a fenced block, or the text as it is."""
    inner = F.regexp_extract(F.trim(c), "(?s)^```[A-Za-z]*\\s*(.*?)\\s*```$", 1)
    return F.when(inner != "", inner).otherwise(F.trim(c))


def stable_id(*parts: Column, size: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts."""
    return F.substr(F.sha2(F.concat_ws("|", *parts), 256), F.lit(1), F.lit(size))


def checksum(c: Column) -> Column:
    """First 8 hex digits of the SHA-1 as a number."""
    return F.conv(F.substr(F.sha1(c), F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def suffix_stem(word: Column) -> Column:
    """A light stem: a common ending is cut if three letters stay. udfs.porter_stem is the full algorithm."""
    return F.regexp_replace(F.lower(word), "^([a-z]{3,}?)(ments|ment|ings|ing|edly|ed|es|ly|s)$", "$1")
