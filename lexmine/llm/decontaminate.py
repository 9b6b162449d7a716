"""Benchmark decontamination: word-pair seeds that miss no match, then Smith-Waterman alignment of words.

Benchmark items are taken in blocks of bounded size, and every block meets all documents. Seeds are
pairs of words that follow each other directly or with one word between, on either side. Words matched
one after another that aren't such a pair are MATCH or more apart in cost, so an alignment that scores
least * n of an item's n words has pairs at least * n - 1 of the item's places or more, all within
(3 - 2 * least) * n words of the text. Items for which that is none are seeded by single words.

A first pass counts the documents that hold each seed. Places with common seeds are dropped, and as many
hits fewer are asked for; one at least is left. A second pass finds, in every text, where enough
hits of an item lie together, and aligns the item with the words around them; the score alone
decides. Nothing but seed counts is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmine.llm.common import Texts, as_bytes, mix, slices

#: Benchmark bytes in a block (which bounds what is broadcast); a place is common if its seeds are in more documents than FLOOR + FACTOR times its item's median; hits held at once.
BLOCK_BYTES, FLOOR, FACTOR, HITS = 16_000_000, 10, 4, 4_000_000
#: Alignment: match, mismatch, gap (the seeds rely on a match being worth two of the others); least share of the item's words that the alignment must score.
MATCH, MISMATCH, GAP, LEAST = 1.0, -0.5, -0.5, 0.5

#: Letters are lowered, ASCII that is neither a letter nor a digit becomes a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: bytes) -> bytes:
    return (text if text.isascii() else text.decode().lower().encode()).translate(_PLAIN)


def seeds(t: Texts, pairs: bool = True, singles: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of texts and their first words' places: words with the next and next but one, single words, or both."""
    text = np.repeat(np.arange(len(t.n_words)), t.n_words)
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for step in (1, 2) if pairs else ():
        at = np.flatnonzero(text[:-step] == text[step:])
        keys.append(mix(t.hash[at] * np.uint64(0xA0761D6478BD642F) + t.hash[at + step]))
        places.append(at)
    if singles:
        keys.append(mix(t.hash ^ np.uint64(0xA0761D6478BD642F)))
        places.append(np.arange(len(text)))
    return np.concatenate(keys), np.concatenate(places)


class Block:
    """Some benchmark items: their words, where each seed lies in them, how many hits a match has at least and in how many words."""

    def __init__(self, items: list[tuple[int, bytes]], least: float):
        self.ids = [i for i, _ in items]
        texts = Texts([plain(t) for _, t in items])
        self.words = [texts.hash[a:b] for a, b in zip(texts.first, texts.first[1:], strict=False)]
        pairs = np.ceil(least * texts.n_words - 1 - 1e-9).astype(np.int64)
        self.needed, self.span = np.maximum(pairs, 1), np.ceil(max(1, 3 - 2 * least) * texts.n_words).astype(np.int64)
        found, at = seeds(texts, singles=True)
        item, alone = np.searchsorted(texts.first, at, "right") - 1, np.arange(len(at)) >= len(at) - len(texts.hash)
        order = np.argsort(found, kind="stable")
        order = order[((pairs < 1)[item] == alone)[order]]
        self.seed, self.item, self.offset = found[order], item[order], (at - texts.first[item])[order]
        self.singles = bool(((pairs < 1) & (texts.n_words > 0)).any())
        self._table()

    def _table(self) -> None:
        self.distinct = np.unique(self.seed)
        self.bits = max(16, int(len(self.distinct)).bit_length() + 4)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.distinct >> np.uint64(64 - self.bits)] = True

    def keep(self, docs_with: dict[int, int]) -> None:
        """Drop the places of items that are common, the most common first, and ask for as many hits fewer; one at least is left."""
        n = np.array([docs_with.get(s, 0) for s in self.seed.tolist()])
        stay = np.ones(len(n), bool)
        by_item = np.argsort(self.item, kind="stable")
        for own in np.split(by_item, np.flatnonzero(np.diff(self.item[by_item])) + 1):
            if len(own):
                places, number = np.unique(self.offset[own], return_inverse=True)
                docs = np.bincount(number, n[own])
                common = np.argsort(-docs, kind="stable")
                common = common[docs[common] > FLOOR + FACTOR * np.median(docs)][: self.needed[self.item[own[0]]] - 1]
                stay[own] = ~np.isin(number, common)
                self.needed[self.item[own[0]]] -= len(common)
        self.seed, self.item, self.offset = self.seed[stay], self.item[stay], self.offset[stay]
        self._table()

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are seeds."""
        if not len(self.distinct):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - self.bits)])
        near = np.minimum(np.searchsorted(self.distinct, hashes[at]), len(self.distinct) - 1)
        return at[self.distinct[near] == hashes[at]]


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int]:
    """Best local alignment's score and the place after its last word in text."""
    slope = -GAP * np.arange(len(text) + 1)
    above, best, end = np.zeros(len(text) + 1), 0.0, 0
    for word in item:
        row = np.zeros(len(text) + 1)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP))
        row = np.maximum.accumulate(row + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k
        above = row
    return best, end


def matches(texts: list[bytes], block: Block, least: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item's number, score, first word, word after the last) of the items that texts hold."""
    t = Texts([plain(x) for x in texts])
    hashes, at = seeds(t, singles=block.singles)
    hit = block.hits(hashes)
    if not len(hit):
        return []
    lo, hi = np.searchsorted(block.seed, hashes[hit]), np.searchsorted(block.seed, hashes[hit], "right")
    times = hi - lo
    if times.sum() > HITS and len(texts) > 1:
        half = len(texts) // 2
        return matches(texts[:half], block, least) + [(r + half, *x) for r, *x in matches(texts[half:], block, least)]
    which = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    word, item = np.repeat(at[hit], times), block.item[which]
    row = np.searchsorted(t.first, word, "right") - 1
    order = np.lexsort((word, row * len(block.ids) + item))
    row, item, word = row[order], item[order], word[order]
    last = np.arange(len(row)) + block.needed[item] - 1
    inside = np.minimum(last, len(row) - 1)
    enough = np.flatnonzero((last < len(row)) & (row[inside] == row) & (item[inside] == item) & (word[inside] - word <= block.span[item]))
    if not len(enough):
        return []
    row, item, word, last = row[enough], item[enough], word[enough], word[last[enough]]
    begin, end = np.maximum(t.first[row], word - block.span[item]), np.minimum(t.first[row + 1], last + block.span[item] + 1)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    starts = np.append(np.flatnonzero(new), len(row))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for a, b in zip(starts, starts[1:], strict=False):
        r, i, first = int(row[a]), int(item[a]), int(begin[a])
        part = t.hash[first : end[b - 1]]
        score, stop = align(block.words[i], part)
        if score >= least * len(block.words[i]) and score > best.get((r, i), (0.0,))[0]:
            back = align(block.words[i][::-1], part[:stop][::-1])[1]
            first -= int(t.first[r])
            best[r, i] = (score, first + stop - back, first + stop)
    return [(r, i, *x) for (r, i), x in best.items()]


def _blocks(docs: DataFrame, benchmark: DataFrame, least: float, item_col: str, item_text: str, text_col: str, block_bytes: int):
    """One Block after another, without its common seeds."""
    items = benchmark.select(F.col(item_col).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()
        block = Block([(r["i"], r["t"].encode()) for r in rows], least)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def count(batches, shared=shared):
            for batch in (part for big in batches for part in slices(big, 0)):
                t = Texts([plain(x) for x in as_bytes(batch.column(0))])
                hashes, at = seeds(t, singles=shared.value.singles)
                hit = shared.value.hits(hashes)
                pairs = np.unique(np.stack([hashes[hit], (np.searchsorted(t.first, at[hit], "right") - 1).astype(np.uint64)]), axis=1)
                held, docs_with = np.unique(pairs[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(docs_with.astype(np.int64))], names=["seed", "n"])

        found = docs.select(text_col).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()  # at most a row a seed
        block.keep({r["seed"] % (1 << 64): r["n"] for r in found})
        yield docs.sparkSession.sparkContext.broadcast(block)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """A row for each document and item it holds: ids of both, score (share of the item's words, 1 for a copy), start and end word.

    Case and ASCII punctuation don't count. Documents without a match have no row. Null texts hold
    nothing, and items without a word can't be found. Repeated rows, null ids and
    items that are equal are judged each. Other columns are not read. An empty table on either side
    gives an empty result.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"`{id_col}` {kind}, item_id {item_kind}, score double, start_word long, end_word long"
    out = None
    for shared in _blocks(docs, benchmark, least, item_col, item_text, text_col, block_bytes):

        def run(batches, shared=shared):
            for batch in (part for big in batches for part in slices(big, 1)):
                block = shared.value
                found = matches(as_bytes(batch.column(1)), block, least)
                item_ids = pa.array([block.ids[m[1]] for m in found], item_type)
                columns = [batch.column(0).take(pa.array([m[0] for m in found], pa.int64())), item_ids, pa.array([m[2] / len(block.words[m[1]]) for m in found], pa.float64()), *(pa.array([m[k] for m in found], pa.int64()) for k in (3, 4))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "item_id", "score", "start_word", "end_word"])

        one = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold an item; columns stay as they are, and nothing is shuffled."""
    place = docs.columns.index(text_col)
    out = docs
    for shared in _blocks(docs, benchmark, least, item_col, item_text, text_col, block_bytes):

        def run(batches, shared=shared):
            for batch in (part for big in batches for part in slices(big, place)):
                clean = np.ones(batch.num_rows, bool)
                clean[[m[0] for m in matches(as_bytes(batch.column(place)), shared.value, least)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
