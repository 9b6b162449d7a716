"""Passages that repeat across documents, by a sparse suffix array.

Only suffixes at minimiser positions are kept: places whose run of SEED words has the smallest hash in
some WINDOW runs beside each other. Equal passages choose equal places: a passage of LEAST words has one
among its first WINDOW words, whose suffix goes on for LEAST - WINDOW + 1 words (the key) at least.

1. Suffixes whose key occurs once are dropped by a Bloom filter of fixed size.
2. The rest are range-partitioned and sorted by key and following words, so a suffix lies beside those
   that agree with it longest to the right. It is compared with its nearest neighbours of another
   document before and after, and matches are extended left and right by the words around.
3. The nearest to the right need not agree most to the left. So windows of LEAST words around a suffix that the
   farthest agreement to the right and to the left allow, but that no match covers, are left open. For
   the suffixes with that key, a partition claims each hash of such windows once, with two of its
   documents; open windows that two documents claim are matches too. Where a key's suffixes may go on in
   another partition, all windows that the agreement to the right allows are claimed.

The sort also goes by document and place and claims are combined before they are shuffled, so a very
common passage spreads over many partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import Texts, as_bytes, checkpoint, mix, partitions, slices, window_hashes

#: Words of a seed, seeds beside each other of which the smallest is kept, words that a repeated passage has at least.
SEED, WINDOW, LEAST = 12, 20, 50
#: The Bloom filter's blocks and bits in a block (16 MB in all); bytes of text for each sorted partition.
BLOCKS, BITS, PART_BYTES = 1 << 16, 2048, 32_000_000


def minimisers(hashes: np.ndarray, at: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the seeds that are the (leftmost) smallest of some window seeds of one text beside each other."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = np.flatnonzero(text[at[:n]] == text[at[window - 1 :]])
    best, pick = hashes[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, window):
        less = hashes[k : k + n] < best
        best[less], pick[less] = hashes[k : k + n][less], k
    return np.unique(whole + pick[whole])


class _Suffixes:
    """The minimiser suffixes of some texts that go on for key words: key, text and place."""

    def __init__(self, texts: list[bytes], seed: int, window: int, least: int):
        self.made = t = Texts(texts)
        text = np.repeat(np.arange(len(texts)), t.n_words)
        hashes, at = t.windows(seed)
        at = at[minimisers(hashes, at, text, window)]
        self.least, self.width, self.reach = least, least - window + 1, window - 1
        at = at[at + self.width <= t.first[text[at] + 1]] if len(at) else np.zeros(0, np.int64)
        whole = window_hashes(t.hash, self.width, 0xE7037ED1A0B428DB)
        self.at, self.key = at, whole[at] if len(at) else np.zeros(0, np.uint64)
        self.text = text[at] if len(at) else np.zeros(0, np.int64)

    def around(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words after the key, and words before it (nearest first), of the chosen suffixes, as 4-byte hashes (0 past the text's ends)."""
        t, n = self.made, self.reach
        small = np.maximum((t.hash >> np.uint64(32)).astype(np.uint32), 1)
        lo, hi = t.first[self.text[chosen]], t.first[self.text[chosen] + 1]
        after = self.at[chosen][:, None] + self.width + np.arange(n)
        before = self.at[chosen][:, None] - 1 - np.arange(n)
        right = np.where(after < hi[:, None], small[np.minimum(after, len(small) - 1)], 0)
        left = np.where(before >= lo[:, None], small[np.maximum(before, 0)], 0)
        return right.astype(">u4"), left.astype(">u4")


def _window_hashes(key: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Hashes of the windows that start 0, 1, .. words before each suffix: of the key, of so many words left, and of as many fewer right."""
    n = right.shape[1]
    after, before = np.zeros((len(key), n + 1), np.uint64), np.zeros((len(key), n + 1), np.uint64)
    for k in range(n):
        after[:, k + 1] = after[:, k] * np.uint64(0xA0761D6478BD642F) + right[:, k].astype(np.uint64)
        before[:, k + 1] = before[:, k] * np.uint64(0xD1342543DE82EF95) + left[:, k].astype(np.uint64)
    return mix(mix(key[:, None] + mix(after[:, ::-1])) + mix(before + np.uint64(1)))


def _blob(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _bloom_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block and two bits in it of each key."""
    return (keys >> np.uint64(48)).astype(np.int64), ((keys >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64), (keys % np.uint64(BITS)).astype(np.int64)


def _bloom(keys: DataFrame) -> np.ndarray:
    """Bloom filter (a row of bits for each block) of distinct keys (key long)."""

    def fill(table: pa.Table) -> pa.Table:
        block, a, b = _bloom_places(table.column("key").to_numpy().view(np.uint64))
        bits = np.zeros(BITS, np.uint8)
        bits[a] = bits[b] = 1
        return pa.table({"block": pa.array([int(block[0])], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros((BLOCKS, BITS // 8), np.uint8)
    blocks = keys.select("key", F.shiftrightunsigned("key", 48).cast("int").alias("block")).groupBy("block").applyInArrow(fill, "block int, bits binary")
    for r in blocks.collect():  # BLOCKS rows of BITS / 8 bytes at most
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def _in(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    block, a, b = _bloom_places(keys)
    bit = lambda k: (bloom[block, k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1
    return (bit(a) & bit(b)).astype(bool)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from the first on are equal in each row."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _neighbours(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted suffixes: the nearest one before and after with another document and the same key; -1 if there is none, -2 if another partition may have it."""
    n = len(key)
    new = np.ones(n + 1, bool)
    new[1:n] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    edge = np.flatnonzero(new)
    run = np.cumsum(new[:n]) - 1
    before, after = edge[run] - 1, edge[run + 1]
    before = np.where(before < 0, -2, np.where(key[np.maximum(before, 0)] == key, before, -1))
    after = np.where(after >= n, -2, np.where(key[np.minimum(after, n - 1)] == key, after, -1))
    return before, after


def repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """A row for each document with a passage of least words or more that another document has too: id,
    n_repeated (words in such passages), spans (array of first word and word after the last; all such passages), match_id (the
    smallest of the documents it was compared with that have one of them).

    Words end at ASCII white space and are compared as they are. Documents without such a passage, null
    and short texts have no row. Rows equal in id are one document, as are all rows with a null id, so
    what repeats only inside them isn't reported; rows equal in id add up their spans. Other columns are
    not read. An empty table gives an empty result. least is seed + window - 1 at least. Words are compared by
    hashes of 32 bits or more.
    """
    if least < seed + window - 1:
        raise ValueError("least is shorter than the words in which a minimiser is sure")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-total // part_bytes))
    reach, width = window - 1, least - window + 1

    def keys(batches):
        for batch in (part for big in batches for part in slices(big, 0)):
            s = _Suffixes(as_bytes(batch.column(0)), seed, window, least)
            yield pa.RecordBatch.from_arrays([pa.array(s.key.view(np.int64))], names=["key"])

    shared = docs.sparkSession.sparkContext.broadcast(_bloom(rows.select("text").mapInArrow(keys, "key long").groupBy("key").count().where("count > 1")))

    def suffixes(batches):
        for batch in (part for big in batches for part in slices(big, 1)):
            s = _Suffixes(as_bytes(batch.column(1)), seed, window, least)
            chosen = np.flatnonzero(_in(shared.value, s.key))
            right, left = s.around(chosen)
            place = s.at[chosen] - s.made.first[s.text[chosen]]
            yield pa.RecordBatch.from_arrays([pa.array(s.key[chosen].view(np.int64)), _blob(right), _blob(left), batch.column(0).take(pa.array(s.text[chosen])), pa.array(place, pa.int64())], names=["key", "right", "left", "id", "place"])

    order = ["key", "right", "left", "id", "place"]
    ranged = rows.mapInArrow(suffixes, f"key long, right binary, left binary, id {kind}, place long").repartitionByRange(n, *order).sortWithinPartitions(*order)

    def compare(batches):
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        words = lambda name: np.frombuffer(b"".join(table.column(name).to_pylist()), ">u4").reshape(-1, reach)
        key, right, left, place = table.column("key").to_numpy(), words("right"), words("left"), table.column("place").to_numpy()
        column = table.column("id").combine_chunks()
        doc = np.asarray(column.dictionary_encode().indices.fill_null(-1))
        out, covered, back = [], np.zeros((len(key), reach + 1), bool), np.arange(reach + 1)
        most = {"right": np.zeros(len(key), np.int64), "left": np.zeros(len(key), np.int64)}
        for near in _neighbours(key, doc):
            has = np.flatnonzero(near >= 0)
            r, l = _same(right[has], right[near[has]]), _same(left[has], left[near[has]])
            most["right"][has] = np.maximum(most["right"][has], r)
            most["right"][near == -2] = reach
            covered[has] |= (back <= l[:, None]) & (back >= (reach - r)[:, None])
            good = l + width + r >= least
            out.append((has[good], near[has][good], place[has][good] - l[good], place[has][good] + width + r[good]))
        own, other, start, end = (np.concatenate([x[k] for x in out]) for k in range(4))
        by_left = np.lexsort((np.ascontiguousarray(left).view(f"S{4 * reach}")[:, 0], key))
        for near in _neighbours(key[by_left], doc[by_left]):
            has = np.flatnonzero(near >= 0)
            most["left"][by_left[has]] = np.maximum(most["left"][by_left[has]], _same(left[by_left[has]], left[by_left[near[has]]]))
        most["left"][(key == key[0]) | (key == key[-1])] = reach  # these keys may go on elsewhere
        possible = (back >= (reach - np.minimum(most["right"], (right != 0).sum(axis=1)))[:, None]) & (back <= np.minimum(most["left"], (left != 0).sum(axis=1))[:, None])
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        wanted = np.logical_or.reduceat(possible & ~covered, starts)
        wanted[[0, -1]] = True
        row, col = np.nonzero(np.repeat(wanted, np.diff(np.r_[starts, len(key)]), axis=0) & possible)
        some, number = np.unique(row, return_inverse=True)
        hashes = _window_hashes(key[some].view(np.uint64), right[some], left[some])[number, col].view(np.int64)
        open_ = ~covered[row, col]
        by_window = np.lexsort((doc[row], hashes))
        new = np.flatnonzero(np.r_[True, hashes[by_window][1:] != hashes[by_window][:-1]]) if len(row) else by_window
        claim = by_window[np.unique(np.r_[new, new[1:] - 1, np.full(min(1, len(row)), len(row) - 1)].astype(np.int64))]  # the first and the last document of each
        rows_, none = np.r_[own, row[open_], row[claim]], pa.nulls(int(open_.sum()) + len(claim), column.type)
        zero = np.zeros(len(claim), np.int64)
        numbers = np.r_[start, (place[row] - col)[open_], zero], np.r_[end, np.full(int(open_.sum()), -1), zero - 2], np.r_[np.zeros(len(own), np.int64), hashes[open_], hashes[claim]]
        yield pa.RecordBatch.from_arrays([column.take(pa.array(rows_)), pa.concat_arrays([column.take(pa.array(other)), none]), *map(pa.array, numbers)], names=["id", "other", "start", "end", "window"])

    made = checkpoint(ranged.mapInArrow(compare, f"id {kind}, other {kind}, start long, end long, window long"))
    twice = made.where("end = -2").groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count_if(F.col("id").isNull()).alias("nulls")).where("low <> high OR (nulls > 0 AND low IS NOT NULL)")
    other = F.when(F.col("id").eqNullSafe(F.col("low")), F.when(F.col("low") != F.col("high"), F.col("high"))).otherwise(F.col("low"))
    late = made.where("end = -1").select("window", "id", "start").join(twice, "window").select("id", other.alias("other"), "start", (F.col("start") + least).alias("end"))
    found = made.where("end >= 0").select("id", "other", "start", "end").unionByName(late)

    def unite(batches):
        for batch in batches:
            spans, sizes = [], []
            for own in batch.column(2).to_pylist():
                out: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in own):
                    if out and s[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], s[1])
                    else:
                        out.append(list(s))
                spans.append([{"start": a, "end": b} for a, b in out])
                sizes.append(sum(b - a for a, b in out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), batch.column(1)], names=[id_col, "n_repeated", "spans", "match_id"])

    by_doc = found.groupBy("id").agg(F.min("other").alias("other"), F.collect_set(F.struct("start", "end")).alias("all"))
    return by_doc.mapInArrow(unite, f"`{id_col}` {kind}, n_repeated long, spans array<struct<start:bigint,end:bigint>>, match_id {kind}")
