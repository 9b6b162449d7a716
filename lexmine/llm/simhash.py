"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link if they differ in at most RADIUS bits. Links are never listed pair by pair
inside a group of near copies:

1. Fingerprints that share a neighbour at one bit's distance differ in at most two bits; each hangs on
   the smallest that shares it. At most 65 fingerprints share one, so no group is large. This joins most
   of what belongs together.
2. Bits that go together are put into the same part. If the parts' thresholds t add up to
   RADIUS - parts + 1, two fingerprints within RADIUS differ in at most t bits in one part at least.
   Dynamic programming picks unequal thresholds (and the number of parts) by estimates of the
   candidates each would bring. Values near each other in a part meet in a join that verifies the whole
   distance and keeps only links between fingerprints that step 1 left apart.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import as_bytes, checkpoint, partitions, slices, text_key
from lexmine.llm.graph import components

#: Bits that linked fingerprints may differ in, words in a shingle, seed of the hash.
RADIUS, SHINGLE, SEED = 4, 4, 42
BITS = 64


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without a word."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        view, digest = memoryview(joined), xxhash.xxh64_intdigest
        hashes = np.array([digest(view[a:b], SEED) for a, b in zip(starts[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], "<u8")
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def _fingerprinted(batches):
    """Batches of id and text's hash with the text's fingerprint in its place; some texts at a time, as each is held several times over."""
    for batch in (part for big in batches for part in slices(big, 2, 1_000_000)):
        fps = [fingerprint(t) for t in as_bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], names=["id", "key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key long, fp long) per row of docs; key is the text's hash."""
    return docs.select(id_col, text_key(F.col(text_col)), text_col).mapInArrow(_fingerprinted, f"id {docs.schema[id_col].dataType.simpleString()}, key long, fp long")


def bit_groups(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits dealt to parts of nearly equal size: each part starts with a free bit and takes the bits most correlated with it."""
    p = np.diag(together) / n
    cov = together / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    strong = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(strong, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = -(-len(free) // (parts - k))
        group = [max(free, key=lambda b: (strong[b, free].max(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (strong[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def near_share(p: np.ndarray, most: int) -> np.ndarray:
    """Share of pairs that differ in at most 0, 1, .. most of bits that are 1 with chances p, if bits were independent."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Least total cost of thresholds t >= -1, one for each part, with sum of t + 1 equal to radius + 1; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, radius - used + 1):
                key, value = used + t + 1, (total + cost[t + 1], [*chosen, t])
                if t + 1 < len(cost) and (key not in step or value[0] < step[key][0]):
                    step[key] = value
        best = step
    return best[radius + 1]


def plan(fps: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """Parts (bits, threshold) for the fingerprints at hand, from counts over all of them."""

    def count(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1), pa.int32()), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r["cell"]] = r["n"]
    n, together = max(int(flat[-1]), 1), flat[:-1].reshape(BITS, BITS)
    chance = np.diag(together) / n
    best = (float("inf"), [])
    for parts in range(2, radius + 2):
        groups = bit_groups(together, n, parts)
        costs = []
        for g in groups:
            near = near_share(chance[g], radius) * float(n) ** 2 / 2
            probes = [n * (sum(comb(len(g), k) for k in range(t // 2 + 1)) + sum(comb(len(g), k) for k in range(t - t // 2 + 1))) for t in range(radius + 1)]
            costs.append([0.0, *(p + 0.2 * c for p, c in zip(probes, near, strict=True))])
        total, chosen = allocate(costs, radius)
        if total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0])
    return best[1]


def _flips(bits: list[int], most: int) -> list[int]:
    out = [0]
    for k in range(1, most + 1):
        out += [sum(1 << b for b in c) for c in combinations(bits, k)]
    return [x - (1 << BITS) if x >= 1 << (BITS - 1) else x for x in out]


def _mask(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def near_pairs(fps: DataFrame, parts: list[tuple[list[int], int]], radius: int) -> DataFrame:
    """Links (u, v) between labels m of fingerprints (fp, m) that differ in at most radius bits, for different labels only."""

    def keyed(half):
        def probes(part, bits, most):
            fixed = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
            return F.transform(F.lit(_flips(bits, most)).cast("array<bigint>"), lambda x: F.struct(F.lit(part).alias("part"), x.bitwiseXOR(fixed).alias("key")))

        each = F.concat(*[probes(i, g, half(t)) for i, (g, t) in enumerate(parts)])
        return fps.select("fp", "m", F.explode(each).alias("p")).select("fp", "m", "p.part", "p.key")

    a = keyed(lambda t: t - t // 2)
    b = keyed(lambda t: t // 2).select(F.col("fp").alias("fp2"), F.col("m").alias("m2"), "part", "key")
    link = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius) & (F.col("m") != F.col("m2"))
    return a.join(b, (a["part"] == b["part"]) & (a["key"] == b["key"]) & link).select(F.least("m", "m2").alias("u"), F.greatest("m", "m2").alias("v")).distinct()


def clusters(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, m) for the distinct fingerprints fp: m is the same for all that are linked over any number of links."""
    keys = F.transform(F.lit(_flips(list(range(BITS)), 1)).cast("array<bigint>"), lambda x: F.col("fp").bitwiseXOR(x))
    fps = fps.repartition(4 * partitions(fps.sparkSession), "fp")  # fingerprints are small, but not what they become
    met = fps.select("fp", F.explode(keys).alias("key")).groupBy("key").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    first = components(met.select(F.explode("all").alias("u"), "v"))
    some = checkpoint(fps.join(first, fps["fp"] == first["u"], "left").select("fp", F.coalesce("m", "fp").alias("m")))
    second = components(near_pairs(some, plan(some, radius), radius))
    return some.join(second, some["m"] == second["u"], "left").select("fp", F.coalesce(second["m"], some["m"]).alias("m"))


def _components(docs: DataFrame, radius: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, fp, component_id) per row of docs."""
    made = checkpoint(fingerprints(docs, id_col, text_col))
    groups = clusters(made.select("fp").distinct(), radius)
    lowest = made.groupBy("fp").agg(F.min("id").alias("low")).join(groups, "fp")
    named = groups.join(lowest.groupBy("m").agg(F.min("low").alias("component_id")), "m").select("fp", "component_id")
    return made.join(named, "fp")


def simhash_components(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id linked with it, itself included).

    Texts are lowered (A-Z), cut at ASCII white space; shingles are SHINGLE words, of shorter texts all
    words. Texts without words, null ones too, have fingerprint 0 and are linked like others. Repeated
    rows are kept, and null ids too; a component of null ids alone has a null component_id. Other
    columns are not read. An empty table gives an empty result.
    """
    return _components(docs, radius, id_col, text_col).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that have a smaller id in their component; columns stay as they are, whatever they are called.

    A row is judged by its id and text: of two texts with one id each goes by its own component. Rows equal in
    both are one document and stay or go together. Null ids stay only in components of null ids.
    """
    found = _components(docs, radius, id_col, text_col)
    keep = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["kept_id"]) & (text_key(docs[text_col]) == keep["kept_key"]), "left_semi")
