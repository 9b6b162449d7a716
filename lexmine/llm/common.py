"""Small helpers shared by the text operators: ASCII-space words, hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexmine.sources.shared import checkpoint  # noqa: F401

#: The characters that end a word: space and U+0009 to U+000D (what bytes.split() splits at).
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def has_word(text: Column) -> Column:
    return F.translate(text, SPACES, "") != ""


def let(value: Column, body) -> Column:
    """body(value) with value computed once, although body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_key(text: Column) -> Column:
    """With the id it names a row: rows equal in id and text count as one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000):
    """Parts of a batch whose texts have most bytes at most (a longer text is a part of its own), to bound what is held at once."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    start = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and held + size > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if batch.num_rows:
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


_made: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers from 0 to n - 1; kept for the next texts up to a few million."""
    known = _made.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 1 << 22:
            _made[int(base)] = known
    return known[:n]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a text, by sums of powers over its bytes, and where the words start and end."""
    raw = np.frombuffer(text, np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start = np.flatnonzero(space[:-1] & ~space[1:])
    end = np.flatnonzero(~space[:-1] & space[1:])
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * powers(BASE, len(raw)), out=total[1:])
    size = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * powers(INVERSE, len(raw) + 1)[start] + size), start, end


#: Bytes of text that are hashed at once.
BLOCK = 1 << 20


class Texts:
    """The words of many texts in one row: their hashes, where they start and end in raw, and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.raw = b"\n".join(texts)
        blocks, held, base = [[]], 0, 0
        for text, size in zip(texts, sizes.tolist(), strict=True):  # a block at a time, to bound what hashing needs
            if held and held + size > BLOCK:
                blocks.append([])
                held = 0
            blocks[-1].append(text)
            held += size
        found = []
        for block in blocks:
            found.append([x + base if k else x for k, x in enumerate(word_hashes(b"\n".join(block)))])
            base += sum(map(len, block)) + len(block)
        self.hash, self.start, self.end = (np.concatenate(x) for x in zip(*found, strict=True))
        ends = np.cumsum(sizes)
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends])) if len(texts) else np.zeros(1, np.int64)
        self.n_words = np.diff(self.first)

    def windows(self, width: int, base: int = 0xA0761D6478BD642F) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of width words that lie in one text, and their first words' places."""
        text = np.repeat(np.arange(len(self.n_words)), self.n_words)
        if len(text) < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(text[: len(text) - width + 1] == text[width - 1 :])
        return window_hashes(self.hash, width, base)[at], at


def window_hashes(words_: np.ndarray, width: int, base: int = 0xA0761D6478BD642F) -> np.ndarray:
    """A hash of every run of width words, from their hashes."""
    n = len(words_) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(base) + words_[k : k + n]
    return mix(out)
