"""Toxicity by a linear-chain conditional random field over words.

1. For the words of a bounded sample of labelled documents, and their first letters, Spark counts the
   toxic and the clean documents that hold them; a word's evidence is the best lower bound of the log
   odds of its features.
2. Words with strong evidence in toxic documents are the first labelled tokens. A chain of two states (other,
   toxic) is trained on them by gradient ascent of the conditional likelihood, from forward-backward
   marginals; its inputs are the evidence of the word and of its neighbours. Then the chain tags the sample
   itself, held to the documents' labels, and is trained on these tags, a few times over.
3. Every text is tagged whole. A logistic curve over the sum and the largest of the marginals gives the
   document's score; runs of words with a marginal of one half or more are the offending spans.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import as_bytes

#: Labelled rows that are learned from at most (those with the smallest hash), and words that a worker remembers.
SAMPLE, MEMO = 4000, 1_000_000
#: Times that labelled tokens are taken anew from marginals.
RETAGS = 3
#: Letters in the prefixes that count as features; the least toxic documents of a feature; evidence of a labelled token.
PREFIXES, LEAST_DOCS, STRONG = (4, 5, 6, 7), 4, 1.5

_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: bytes) -> list[str]:
    text = word.decode().strip(_EDGE).lower()
    return [f"={text}", *(text[:k] for k in PREFIXES if len(text) >= k)] if text else []


@dataclass
class Model:
    weight: dict[str, float]
    chain: np.ndarray  # inputs' weights (bias, word, before, after), then log transition odds from other and from toxic
    curve: np.ndarray  # bias, log(1 + sum), largest, log(1 + words)
    memo: dict[bytes, float]

    def evidence(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        for w in set(words).difference(self.memo):
            self.memo[w] = max([0.0, *(self.weight.get(f, 0.0) for f in features(w))])
        return np.fromiter(map(self.memo.__getitem__, words), np.float32, len(words))

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(marginals) @ self.curve, -40, 40)))


def inputs(evidence: list[np.ndarray]) -> list[np.ndarray]:
    """For each text the columns bias, word, word before, word after."""
    return [np.stack([np.ones_like(e), e, np.concatenate([[0], e[:-1]]), np.concatenate([e[1:], [0]])], axis=1).astype(np.float32) if len(e) else np.zeros((0, 4), np.float32) for e in evidence]


def _chains(emission: list[np.ndarray], chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of toxic from the words up to each place, and from those after it; by step, longest text first."""
    order = np.argsort([-len(e) for e in emission], kind="stable")
    sizes = np.array([len(emission[i]) for i in order])
    steps = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")
    wide = np.zeros((steps, len(order)), np.float32)
    for k, i in enumerate(order):
        wide[: sizes[k], k] = emission[i]
    stay, leave = chain[4], chain[5]  # log odds of toxic after other, after toxic
    p0, p1 = 1 / (1 + np.exp(-stay)), 1 / (1 + np.exp(-leave))
    before, after = np.zeros_like(wide), np.zeros_like(wide)
    r = np.full(len(order), -4.0, np.float32)
    for t in range(steps):
        n = live[t]
        if t:
            q = 1 / (1 + np.exp(-r[:n]))
            p = q * p1 + (1 - q) * p0
            r[:n] = np.log(p / (1 - p))
        r[:n] = np.clip(r[:n] + wide[t, :n], -30, 30)
        before[t, :n] = r[:n]
    for t in range(steps - 2, -1, -1):
        n = live[t + 1]
        x = np.exp(np.clip(wide[t + 1, :n] + after[t + 1, :n], -30, 30))
        after[t, :n] = np.log((1 - p1 + p1 * x) / (1 - p0 + p0 * x))
    return order, sizes, before, after


def marginals(emission: list[np.ndarray], chain: np.ndarray, cells: int = 2_000_000) -> list[np.ndarray]:
    """Chance of toxic at every word of each text, by forward-backward; texts of like length together, cells places at once at most (or one text)."""
    out: list[np.ndarray] = [np.zeros(0)] * len(emission)
    by_length = sorted(range(len(emission)), key=lambda i: -len(emission[i]))
    while by_length:
        count = max(1, cells // max(1, len(emission[by_length[0]])))
        block, by_length = by_length[:count], by_length[count:]
        order, sizes, before, after = _chains([emission[i] for i in block], chain)
        both = 1 / (1 + np.exp(-np.clip(before + after, -30, 30)))
        for k, i in enumerate(order):
            out[block[i]] = both[: sizes[k], k].copy()
    return out


def summary(probabilities: list[np.ndarray]) -> np.ndarray:
    return np.array([[1.0, np.log1p(p.sum()), p.max() if len(p) else 0.0, np.log1p(len(p))] for p in probabilities]).reshape(-1, 4)


def fit_chain(evidence: list[np.ndarray], tags: list[np.ndarray], rounds: int = 60, piece: int = 64, start: np.ndarray | None = None) -> np.ndarray:
    """Gradient ascent (Adam) on the likelihood of the tags; texts are cut into pieces for it. start: weights to go on from."""
    x = [i[k : k + piece] for i in inputs(evidence) for k in range(0, len(i), piece)]
    y = [t[k : k + piece] for t in tags for k in range(0, len(t), piece)]
    sizes = [len(t) for t in y]
    chain = np.array([-3.0, 1.0, 0.0, 0.0, -4.0, 0.0]) if start is None else start
    total = max(1, sum(sizes))
    if not y:
        return chain
    flat_x, flat_y, cuts = np.concatenate(x), np.concatenate(y), np.cumsum(sizes)[:-1]
    del x, y
    inner = np.ones(len(flat_y), np.float32)
    inner[np.cumsum(sizes) - sizes] = 0
    last = np.r_[0, flat_y[:-1]].astype(np.float32)
    m, v = np.zeros(6), np.zeros(6)
    for k in range(1, rounds + 1):
        p = np.concatenate(marginals(np.split(flat_x @ chain[:4].astype(np.float32), cuts), chain))
        p_last = np.r_[0, p[:-1]].astype(np.float32)
        gap = (flat_y - p).astype(np.float32)
        odds = 1 / (1 + np.exp(-chain[4:6]))
        grad = np.r_[flat_x.T @ gap, (inner * (1 - last) * (flat_y - odds[0])).sum() - (inner * (1 - p_last) * (p - odds[0])).sum(), (inner * last * (flat_y - odds[1])).sum() - (inner * p_last * (p - odds[1])).sum()] / total
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        chain = chain + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return chain


def retagged(p: np.ndarray, toxic: float) -> np.ndarray:
    """Tags that marginals and a document's label agree on: none in a clean document; in a toxic one words more likely toxic than not, at least the likeliest."""
    tags = (p >= 0.5) & (toxic > 0)
    if toxic > 0 and len(p) and not tags.any():
        tags[p.argmax()] = True
    return tags.astype(np.float32)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, retags: int = RETAGS) -> Model:
    """A model from at most sample labelled rows, taken by the hash of their id. The chain learns from strong words, then, retags times, from its own marginals against the documents' labels. Rows with a null label or id teach nothing; without rows every score is about 0."""
    some = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL").orderBy(F.xxhash64("i"), "i", "y").limit(sample)
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(some), "i").select("i", "t", "y")

    def count(batches):
        for batch in batches:
            found: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found[int(y > 0)].update({f for w in set(text.split()) for f in features(w)})
            keys = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([found[y][k] for k in keys], pa.int64()) for y in (1, 0))], names=["f", "bad", "good"])

    n_bad, n_good = rows.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    counts = rows.select("t", "y").mapInArrow(count, "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1)) - F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    kept = counts.where(F.col("bad") >= LEAST_DOCS).withColumn("w", odds).where("w > 0").collect()  # of the sample's words
    model = Model({r["f"]: r["w"] for r in kept}, np.zeros(6), np.array([-4.0, 0, 0, 0]), {})
    if not n_bad:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches):
        for batch in batches:
            data = [shared.value.evidence(t.split()).tobytes() for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(data, pa.binary())], names=["i", "y", "e"])

    kind = rows.schema["i"].dataType.simpleString()
    found = rows.select("t", "i", "y").mapInArrow(weigh, f"i {kind}, y int, e binary").orderBy(F.xxhash64("i"), "i", "y", "e").limit(sample).collect()  # numbers of at most sample rows
    evidence = [np.frombuffer(r["e"], np.float32) for r in found]
    y = np.array([float(r["y"] > 0) for r in found])
    del found
    model.chain = fit_chain(evidence, [((e >= STRONG) * t).astype(np.float32) for e, t in zip(evidence, y, strict=True)])
    tell = lambda: marginals([i @ model.chain[:4] for i in inputs(evidence)], model.chain)
    for _ in range(retags):
        model.chain = fit_chain(evidence, [retagged(p, t) for p, t in zip(tell(), y, strict=True)], rounds=20, start=model.chain)
    model.curve = fit_curve(summary(tell()), y)
    model.memo = {}
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 if score >= 0.5), spans (array of start and end code points).

    Only the text is an input. Null and empty texts have no words and get the curve's lowest score.
    Repeated rows and null ids are scored like others, very long texts whole. An empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for big in batches:
            for k in range(0, big.num_rows, 2000):
                batch = big.slice(k, 2000)
                texts = as_bytes(batch.column(1))
                evidence = [m.evidence(t.split()) for t in texts]
                p = marginals([i @ m.chain[:4] for i in inputs(evidence)], m.chain)
                score = m.score(p)
                spans = [_spans(t, q >= 0.5) for t, q in zip(texts, p, strict=True)]
                columns = [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "score", "predicted", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, spans array<struct<start:int,end:int>>")


def _spans(text: bytes, bad: np.ndarray) -> list[dict[str, int]]:
    if not bad.any():
        return []
    at = [m.span() for m in _WORD.finditer(text.decode())]
    edge = np.flatnonzero(np.diff(np.r_[0, bad.astype(np.int8), 0]))
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
