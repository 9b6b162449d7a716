"""Language-model scores: causal self-attention over subword pieces, trained by exact counts of the whole corpus.

Words are cut into subword pieces by greedy longest match; a piece's number is a class and a place in the
class, so its chance has two small steps. At each place of a window the model attends, under a causal
mask, to

- three memories, whose values are the chances of the next piece after the last two pieces, after the
  last piece, and after anything. These values are counted over all training documents: pieces are
  hashed to rows, and a row's counts make a distribution, so all chances add up to 1 at any size;
- every earlier place of the window whose piece, or whose last two pieces, equal the query's. Its value
  is the piece that followed there.

The attention's logits (a memory's by how often its row was seen) are trained in numpy by gradient ascent
of the likelihood of all training pieces, each one left out of the counts that predict it. For that, the
corpus is summed up as a histogram of what the slots say. Counts and histogram are sums of whole numbers, so the
weights don't depend on how Spark deals the rows.

Scores. A text is cut into windows of WINDOW pieces that overlap by CONTEXT; every piece is scored once, and
many windows are scored at once under the mask. The log chances of its pieces add up to the text's.

Words. Documents are dealt into buckets; each bucket sends the distinct words that it holds with their counts
in training documents, and gets back their sums over the corpus, for base_score.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmine.llm.common import Texts, as_bytes, partitions, slices
from lexmine.llm.token_counts import byte_of_symbol

#: Pieces are the first so many of the vocabulary's (and a mark for a word's end); classes and places in a class.
PIECES, CLASSES, PLACES = 4000, 64, 64
#: Window (its attention masks are 32-bit numbers), and pieces of it that are only context.
WINDOW, CONTEXT = 32, 8
#: Bits of the row numbers of the memories: two pieces, two pieces and a class, a piece, a piece and a class.
ROW_BITS = (17, 19, 12, 16)
#: Cells of counts that one record holds; records that one task adds up; text bytes counted at once.
PART, FAN, COUNT_BYTES = 1 << 16, 64, 4_000_000
#: Text bytes of a bucket, of its texts that are scored at once, of distinct words that are cut at once; bytes of a word that is cut by itself.
BUCKET_BYTES, SCORE_BYTES, CUT_BYTES, LONG = 8_000_000, 4_000_000, 250_000, 40
#: A word that no text has: the end of a text.
END = np.uint64(0x9E3779B97F4A7C15)
#: Counts are kept as one of 256 levels: exact up to 20, then steps of a tenth.
LEVELS = np.concatenate([np.arange(20), np.round(20 * 1.1 ** np.arange(236))]).astype(np.float32)
#: Steps of the histogram: chances of the two-piece and one-piece memories and of any piece (in factors of 4), how often the two pieces were seen, matches and hits of one and of two pieces.
STEPS = (10, 10, 7, 14, 4, 3, 3, 3)


class Pieces:
    """Greedy longest-match pieces of words that end in a space; numbers by the vocabulary's order, then START and STOP."""

    def __init__(self, path: str, most: int = PIECES):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        symbol = byte_of_symbol()
        found: dict[bytes, int] = {b" ": 0}
        for b in range(256):
            found.setdefault(bytes([b]), len(found))
        for token in sorted(vocabulary, key=vocabulary.get):
            end = token.endswith("</w>")
            body = token.removesuffix("</w>")
            if len(found) < most and all(c in symbol for c in body):
                found.setdefault(bytes(symbol[c] for c in body) + (b" " if end else b""), len(found))
        self.start, self.stop, self.size = len(found), len(found) + 1, len(found) + 2
        self.numbers = found
        #: Numbers of the single bytes; a tree of the longer pieces: the node of two bytes, of a node and the column of a byte (0: none), and the nodes' pieces (-1: none).
        self.single = np.array([found[bytes([b])] for b in range(256)], np.int64)
        nodes = {p: k for k, p in enumerate(dict.fromkeys(p[:k] for p in found for k in range(2, len(p) + 1)), 1)}
        later = sorted({p[-1] for p in nodes if len(p) > 2})
        self.column, self.width = np.zeros(256, np.int64), len(later) + 1
        self.column[later] = np.arange(1, self.width)
        self.pair, self.next, self.piece = np.zeros(1 << 16, np.int16), np.zeros((len(nodes) + 1) * self.width, np.int16), np.full(len(nodes) + 1, -1, np.int16)
        for p, k in nodes.items():
            self.piece[k] = found.get(p, -1)
            if len(p) == 2:
                self.pair[p[0] << 8 | p[1]] = k
            else:
                self.next[nodes[p[:-1]] * self.width + self.column[p[-1]]] = k

    def longest(self, raw: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For words that each end in a space: what gives number and size of the longest piece at some places of them, down the tree."""
        raw = np.append(raw, np.uint8(0))

        def find(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            byte, size = raw.take(at), np.ones(len(at), np.int64)
            number, node = self.single.take(byte), self.pair.take(byte.astype(np.int64) << 8 | raw.take(at + 1))
            live = np.flatnonzero(node)
            node, place = node[live].astype(np.int64), at[live] + 2
            while len(live):
                found = self.piece.take(node)
                good = np.flatnonzero(found >= 0)
                number[live[good]], size[live[good]] = found[good], (place - at[live])[good]
                node = self.next.take(node * self.width + self.column.take(raw.take(place)))
                on = np.flatnonzero(node)
                live, node, place = live[on], node[on].astype(np.int64), place[on] + 1
            return number, size

        return find

    def cut_all(self, words: list[bytes], most: int = CUT_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of many words, one after another, and how many each has; words of most bytes at once (a longer one by itself), to bound what is held."""
        ends, parts, a = np.cumsum([len(w) + 1 for w in words], dtype=np.int64), [], 0
        while a < len(words):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            parts.append(self._cut(words[a:b]))
            a = b
        flat, count = zip(*parts, strict=True) if parts else ([np.zeros(0, np.uint16)], [np.zeros(0, np.int64)])
        return np.concatenate(flat), np.concatenate(count)

    def _cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A step takes the next piece of all words that aren't long."""
        find = self.longest(np.frombuffer(b" ".join(words) + b" ", np.uint8))
        end = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
        begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
        count, live, place, steps = np.zeros(len(words), np.int64), np.flatnonzero(end - begin <= LONG), begin.copy(), []
        while len(live):
            number, size = find(place[live])
            steps.append((live, number))
            count[live] += 1
            place[live] += size
            live = live[place[live] < end[live]]
        long_ = []
        for w in np.flatnonzero(end - begin > LONG).tolist():
            number, size = find(np.arange(begin[w], end[w]))
            at, step = [0], size.tolist()
            while at[-1] < len(step):
                at.append(at[-1] + step[at[-1]])
            long_.append((w, number[at[:-1]]))
            count[w] = len(at) - 1
        flat, first = np.empty(int(count.sum()), np.uint16), np.cumsum(count) - count
        for k, (live, own) in enumerate(steps):
            flat[first[live] + k] = own
        for w, own in long_:
            flat[first[w] : first[w] + len(own)] = own
        return flat, count

    def stream(self, made: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of lowered texts from START to STOP, one text after another, and how many each text has."""
        distinct, number = np.unique(made.hash, return_inverse=True)
        first = np.empty(len(distinct), np.int64)
        first[number] = np.arange(len(number))  # any place of the word
        flat, count = self.cut_all([made.raw[a:b] for a, b in zip(made.start[first].tolist(), made.end[first].tolist(), strict=True)])
        own = count[number]
        at = np.repeat((np.cumsum(count) - count)[number] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        text = np.repeat(np.arange(len(made.n_words)), made.n_words)
        sizes = np.bincount(text, own, len(made.n_words)).astype(np.int64) + 2
        out = np.empty(int(sizes.sum()), np.uint16)
        ends = np.cumsum(sizes)
        out[ends - sizes], out[ends - 1] = self.start, self.stop
        out[np.arange(len(at)) + np.repeat(2 * text + 1, own)] = flat[at]
        return out, sizes


@functools.lru_cache(maxsize=2)
def pieces(path: str, most: int = PIECES) -> Pieces:
    return Pieces(path, most)


class Windows:
    """Windows of a stream of texts: WINDOW inputs and, one further, targets (-1 beyond the text's end), of which each text's later windows score all but the first CONTEXT."""

    def __init__(self, stream: np.ndarray, sizes: np.ndarray, window: int = WINDOW, context: int = CONTEXT):
        count = 1 + np.maximum(0, -(-(sizes - 1 - window) // (window - context)))
        self.stream, self.width = stream.astype(np.int16), window
        self.text = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(len(self.text)) - np.repeat(np.cumsum(count) - count, count)
        self.at, self.end = (np.cumsum(sizes) - sizes)[self.text] + number * (window - context), np.cumsum(sizes)[self.text]
        self.first = np.where(number > 0, context, 0)

    def blocks(self, most: int = 4096):
        """Windows, first scored targets and texts' numbers, most windows at once."""
        for k in range(0, len(self.at), most):
            at = self.at[k : k + most, None] + np.arange(self.width + 1)
            yield np.where(at < self.end[k : k + most, None], self.stream.take(np.minimum(at, len(self.stream) - 1)), np.int16(-1)), self.first[k : k + most], self.text[k : k + most]


def _row(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


#: Where the rows of each memory begin among all rows.
BASES = np.cumsum([0, *(1 << b for b in ROW_BITS)]).tolist()
CELLS = (BASES[-1] + CLASSES) * CLASSES


def rows_of(two: np.ndarray, one: np.ndarray, target: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of the counts that predict target after the pieces two and one before it, and the columns in them: of the four memories' class and place, and of any piece."""
    of, place, one = target >> 6, target & 63, one.astype(np.int64)
    pair = two.astype(np.int64) * (CLASSES * PLACES) + one
    rows = _row(pair, ROW_BITS[0]), _row(pair * CLASSES + of, ROW_BITS[1]), one, _row(one * CLASSES + of, ROW_BITS[3])
    return [*((base + row, col) for base, row, col in zip(BASES, rows, (of, place, of, place), strict=False)), (BASES[-1] + of, place)]


def _scored(windows_: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places (in all windows, one after another) of the targets that are scored."""
    return np.flatnonzero((windows_[:, 1:] >= 0) & (np.arange(windows_.shape[1] - 1) >= first[:, None]))


def attend(windows_: np.ndarray) -> list[np.ndarray]:
    """For every place of every window, under the causal mask: earlier places with the same piece, those of them whose next piece is the target, and the same for the last two pieces.

    Windows have 32 places, so a row of the masked attention matrix is one 32-bit number.
    """
    equal = windows_[:, :, None] == windows_[:, None, 1:]
    bits = np.packbits(equal, axis=2, bitorder="little").view("<u4")[:, :, 0]  # bit i: as at place i + 1
    mask = np.array([(1 << t) - 1 for t in range(WINDOW)], np.uint32)
    one = ((bits[:, :-1] << np.uint32(1)) | (windows_[:, :-1] == windows_[:, :1])) & mask  # bit i: as at place i
    two = np.zeros_like(one)
    two[:, 1:] = one[:, 1:] & (one[:, :-1] << np.uint32(1))
    return [np.bitwise_count(x) for x in (one, one & bits[:, 1:], two, two & bits[:, 1:])]


class Model:
    """Levels of the counts, and the attention's logits: of the two-piece memory by how often it was seen, of the one-piece memory, of a place with the same piece, with the same two (that of the memory of any piece is 0).

    A model travels compressed; a worker keeps the arrays of the one that it used last.
    """

    last: Model | None = None

    def __init__(self, levels: np.ndarray, logits: np.ndarray | None = None):
        self.held = {"levels": levels}
        self.logits = np.r_[np.linspace(-3, 4, STEPS[3]), 2.0, -2.0, -1.0] if logits is None else logits

    def __getstate__(self):
        return {"packed": zlib.compress(self.levels.tobytes(), 1), "logits": self.logits, "held": {}}

    @property
    def levels(self) -> np.ndarray:
        if "levels" not in self.held:
            if Model.last is not None:
                Model.last.held.clear()
            Model.last = self
            self.held["levels"] = np.frombuffer(zlib.decompress(self.packed), np.uint8)
        return self.held["levels"]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the rows' counts, and the chances of any piece (made once in a worker)."""
        rows = self.levels.reshape(-1, CLASSES)
        if "sums" not in self.held:
            every = LEVELS[self.levels[BASES[-1] * CLASSES :]] + np.float32(0.5)
            self.held["sums"] = np.concatenate([LEVELS[rows[k : k + PART]].sum(axis=1) for k in range(0, len(rows), PART)]), every / every.sum()
        return self.held["sums"]

    def values(self, two: np.ndarray, one: np.ndarray, target: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chances of target by the three memories, and how often the two pieces were seen; less: occurrences left out."""
        (sums, every), found, small, levels = self.sums(), [], np.float32(less), self.levels
        for row, col in rows_of(two, one, target)[:4]:
            n, of = LEVELS.take(levels.take((row << 6) + col)), sums.take(row)
            if less:
                n, of = np.maximum(n - small, np.float32(0)), np.maximum(of - small, np.float32(0))
            found.append(np.where(of > 0, n / np.maximum(of, np.float32(0.5)), np.float32(1 / PLACES)))  # all alike in an unseen row
            if len(found) == 1:
                seen = of
        return found[0] * found[1], found[2] * found[3], every.take(target), seen

    def log_chances(self, windows_: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log of the chance of every scored target, window after window."""
        at = _scored(windows_, first)
        v2, v1, v0, seen = self.values(*_last(windows_, at))
        return np.log(mixed(self.logits, (v2, v1, v0), _seen_step(seen), [m.ravel().take(at) for m in attend(windows_)]))


def _last(windows_: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two pieces before each target (before the first one is the first itself), and the target."""
    width = windows_.shape[1] - 1
    row, flat = at // width, windows_.ravel()
    place = at + row  # the window's inputs and its last target are width + 1 numbers
    return flat.take(np.maximum(place - 1, row * (width + 1))), flat.take(place), flat.take(place + 1).astype(np.int64)


def _seen_step(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(seen + 1).astype(np.int64), STEPS[3] - 1)


def mixed(logits: np.ndarray, values: tuple, step: np.ndarray, matches: list[np.ndarray], shares: bool = False):
    """The softmax-weighted sum of the slots' values; with shares, each slot's weight and its part of the sum."""
    n = STEPS[3]
    weight = [np.where(step > 0, np.exp(logits[:n])[step], 0), np.exp(logits[n]), 1.0, matches[0] * np.exp(logits[n + 1]), matches[2] * np.exp(logits[n + 2])]
    part = [weight[0] * values[0], weight[1] * values[1], values[2], matches[1] * np.exp(logits[n + 1]), matches[3] * np.exp(logits[n + 2])]
    total, good = sum(weight), sum(part)
    return (weight, total, part, good) if shares else good / total


def gradient(logits: np.ndarray, values: tuple, step: np.ndarray, matches: list[np.ndarray], share: np.ndarray) -> np.ndarray:
    """Of the sum of share times the log of mixed(), by the logits."""
    weight, total, part, good = mixed(logits, values, step, matches, shares=True)
    gain = [share * (p / good - w / total) for w, p in zip(weight, part, strict=True)]
    return np.r_[np.bincount(step, gain[0], STEPS[3]), gain[1].sum(), gain[3].sum(), gain[4].sum()]


def fit_logits(cell: np.ndarray, n: np.ndarray, rounds: int = 400, rate: float = 0.05) -> np.ndarray:
    """Gradient ascent (Adam) of the histogram's log likelihood."""
    logits = Model(np.zeros(0, np.uint8)).logits.copy()
    digit = np.unravel_index(cell, STEPS)
    chance = [np.where(d > 0, 4.0 ** (1 - np.maximum(d, 1) - 0.5), 0) for d in digit[:3]]
    chance[2] = np.maximum(chance[2], 1e-6)
    matches = [digit[4], np.minimum(digit[5], digit[4]), digit[6], np.minimum(digit[7], digit[6])]
    m, v, share = np.zeros_like(logits), np.zeros_like(logits), n / max(1, n.sum())
    for t in range(1, rounds + 1):
        g = gradient(logits, tuple(chance), digit[3], matches, share)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        logits = logits + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return logits


def _chance_step(x: np.ndarray, steps: int) -> np.ndarray:
    """1 - log2(x) / 2, rounded down, from 1 to steps - 1; 0 where x is 0. The exponent of the float says it: up to 1 is step 1, up to 1/4 is step 2."""
    above = (x.view(np.int32) + 0x7FFFFF >> 23) - 127  # log2, rounded up
    return np.where(x > 0, np.clip(1 - (above + 1 >> 1), 1, steps - 1), 0)


def histogram(model: Model, windows_: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The histogram's cell of every scored target, itself left out of the counts."""
    at = _scored(windows_, first)
    values = model.values(*_last(windows_, at), less=1)
    digits = [_chance_step(x.astype(np.float32, copy=False), s) for x, s in zip(values[:3], STEPS, strict=False)]
    digits += [_seen_step(values[3]), *(np.minimum(m.ravel().take(at), s - 1) for m, s in zip(attend(windows_), STEPS[4:], strict=True))]
    return np.ravel_multi_index(digits, STEPS)


def _tallied(cells_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and how often each occurs."""
    return np.unique(cells_.astype(np.int32), return_counts=True)


def pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """Places below 65536 in order, as gaps, and counts: first all lowest bytes, then all next ones, which compress well."""
    cells_ = np.empty(len(at), [("gap", "<u2"), ("n", "<u4")])
    cells_["gap"], cells_["n"] = np.diff(at, prepend=0), n
    return cells_.view(np.uint8).reshape(-1, 6).T.tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    cells_ = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(6, -1).T).view([("gap", "<u2"), ("n", "<u4")])[:, 0]
    return np.cumsum(cells_["gap"], dtype=np.int64), cells_["n"]


def train(rows: DataFrame, vocabulary: str, total: int) -> Model:
    """A model from all rows (text) of training documents; total: their bytes, or more."""

    def count(batches):
        cut = pieces(vocabulary)
        for batch in (part for big in batches for part in slices(big, 0, COUNT_BYTES)):
            stream, sizes = cut.stream(Texts([t.lower() for t in as_bytes(batch.column(0))]))
            begins = np.zeros(len(stream), bool)
            begins[np.cumsum(sizes) - sizes] = True
            target = np.flatnonzero(~begins)
            two, one, target = stream[target - np.where(begins[target - 1], 1, 2)], stream[target - 1], stream[target].astype(np.int64)
            # One memory after another, to bound what is sorted at once; their rows follow each other, so all cells are in order.
            at, n = map(np.concatenate, zip(*(_tallied((row << 6) + col) for row, col in rows_of(two, one, target)), strict=True))
            parts, begin = np.unique(at // PART, return_index=True)
            ends = [*begin.tolist(), len(at)]
            blobs = [pack(at[a:b] % PART, n[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> np.ndarray:
        sums = np.zeros(PART, np.int64)
        for counts in table.column("counts").to_pylist():
            at, n = unpack(counts)
            sums[at] += n
        return sums

    def some(table: pa.Table) -> pa.Table:
        sums = add(table)
        at = np.flatnonzero(sums)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([pack(at, np.minimum(sums[at], 2**32 - 1))], pa.binary())})

    def level(table: pa.Table) -> pa.Table:
        found = np.searchsorted(LEVELS, add(table), "right") - 1
        return pa.table({"part": table.column("part")[:1], "levels": pa.array([found.astype(np.uint8).tobytes()], pa.binary())})

    sent, records = rows.mapInArrow(count, "part int, counts binary"), -(-total // COUNT_BYTES)
    while records > FAN * FAN:  # no task adds up more than some thousand records
        records = -(-records // FAN)
        sent = sent.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(records))).groupBy("part", "salt").applyInArrow(some, "part int, counts binary")
    levels = np.zeros(-(-CELLS // PART) * PART, np.uint8)
    for r in sent.groupBy("part").applyInArrow(level, "part int, levels binary").toLocalIterator():  # CELLS bytes in all
        levels[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["levels"], np.uint8)
    model = Model(levels[:CELLS])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def tell(batches):
        cut = pieces(vocabulary)
        for batch in (part for big in batches for part in slices(big, 0)):
            windows_ = Windows(*cut.stream(Texts([t.lower() for t in as_bytes(batch.column(0))])))
            found = [histogram(shared.value, w, first) for w, first, _ in windows_.blocks()]
            if found:
                cell, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "n"])

    told = rows.mapInArrow(tell, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row a cell of the histogram at most
    if told:
        cell, n = (np.array([r[k] for r in sorted(told)], np.int64) for k in ("cell", "n"))
        model = Model(model.levels, fit_logits(cell, n.astype(float)))
    shared.destroy()
    return model


def lm_scores(docs: DataFrame, training: Column, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's chance by the attention model).

    training is a condition on docs; only rows that meet it are learned from (null: not met), and all of
    them are. Tokens are the words (A-Z lowered, cut at ASCII white space) and one end. base_score adds
    log10((c + 1) / (N + V + 1)) over the tokens. Null texts count as empty. Repeated rows count, and are scored,
    each; null ids are ids like others. Without training rows every piece is alike. Other columns are
    not read. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(train(rows.where("train").select("text"), vocabulary, total))
    buckets = max(partitions(docs.sparkSession), -(-total // bucket_bytes))
    dealt = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "id", "text", "train").repartition("bucket")

    def words_of(table: pa.Table) -> tuple[Texts, np.ndarray, np.ndarray]:
        """The words of the texts, the bucket's distinct ones (END too), and each word's number in those."""
        made = Texts([t.lower() for t in as_bytes(table.column("text"))])
        return made, *np.unique(np.append(made.hash, END), return_inverse=True)

    def send(table: pa.Table) -> pa.Table:
        made, words, number = words_of(table)
        train_ = np.array(table.column("train").to_pylist(), np.int64)
        counts = np.bincount(number, np.append(np.repeat(train_, made.n_words), train_.sum()), len(words)).astype(np.int64)
        return pa.table({"bucket": pa.repeat(table.column("bucket")[0], len(words)), "word": pa.array(words.view(np.int64)), "n": pa.array(counts)})

    def result(ids, *columns) -> pa.Table:
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        return pa.table([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:  # no document came into this bucket
            return result(table.column("id"), *[[]] * 5)
        made, words, number = words_of(table)
        n_texts = table.num_rows
        counts = np.zeros(len(words), np.int64)
        size = answers.filter(pc.is_valid(answers.column("types")))
        n, v = size.column("n")[0].as_py(), size.column("types")[0].as_py()
        answers = answers.filter(pc.is_null(answers.column("types")))
        counts[np.searchsorted(words, answers.column("word").to_numpy().view(np.uint64))] = answers.column("n").to_numpy()
        of, end = counts[number[:-1]], int(counts[number[-1]])
        text = np.repeat(np.arange(n_texts), made.n_words)
        logs = np.bincount(text, np.log10(of + 1.0), n_texts) + np.log10(end + 1.0)
        known = np.bincount(text, of > 0, n_texts).astype(np.int64) + (end > 0)
        tokens = made.n_words + 1
        base = logs - tokens * np.log10(n + v + 1.0)
        del answers, made, words, number, counts, of, text  # before the windows are made
        return result(table.column("id"), tokens, known, np.full(n_texts, n), base, attention(table))

    def attention(table: pa.Table) -> np.ndarray:
        """log10 chances of the texts, of which SCORE_BYTES are scored at once."""
        column = table.column("text").combine_chunks()
        return np.concatenate([chances(Texts([t.lower() for t in as_bytes(part.column(0))])) for part in slices(pa.record_batch([column], names=["text"]), 0, SCORE_BYTES)]) / np.log(10)

    def chances(made: Texts) -> np.ndarray:
        out = np.zeros(len(made.n_words))
        for w, first, text in Windows(*pieces(vocabulary).stream(made)).blocks():
            out += np.bincount(text[_scored(w, first) // WINDOW], shared.value.log_chances(w, first), len(out))
        return out

    sent = dealt.groupBy("bucket").applyInArrow(send, "bucket int, word long, n long").repartition("word")
    # Both uses of sent need all its columns, so that Spark makes and shuffles it once.
    totals = sent.groupBy("word").agg(F.sum("n").alias("n"), F.min("bucket").alias("low")).where("low >= 0")
    sizes = totals.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("types")).select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(0).cast("long").alias("word"), "n", "types")  # a row a bucket
    whole = F.sum("n").over(W.partitionBy("word"))
    answers = sent.select("bucket", "word", whole.alias("n"), F.lit(None).cast("long").alias("types")).unionByName(sizes)
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
