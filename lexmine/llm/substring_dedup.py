"""Substring dedup of word windows, with a count-min sketch before the exact grouping.

Documents are dealt into buckets that follow the order of their ids, so that of two copies in different
buckets the one in the smaller bucket is first, and only buckets need to be compared.

1. Each bucket adds its windows to a count-min sketch (DEPTH rows). The sketch is cut into slices by the
   window's hash; a bucket sends each slice the cells it touched, as gaps of about two bytes.
2. A slice merges the buckets' sketches and answers with one bit a window: is its cell touched twice or
   more? The least of the rows' counts is never below the window's count, so no repeated window is lost.
3. Only windows estimated as repeated are grouped exactly, by 96-bit keys: each bucket sends a key once,
   however many copies it holds, and learns by one bit whether an earlier bucket has it.
4. Each bucket removes the words that later windows cover.

A slice holds at most WIDTH counters a row, whatever the input's size; more input makes more slices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import Texts, mix, partitions

#: Text bytes of a bucket; counters of a slice's row and rows; counters for each window expected.
BUCKET_BYTES, WIDTH, DEPTH, ROOM = 4_000_000, 1 << 25, 2, 8
_STEP = 65535


def pack(cells: np.ndarray) -> bytes:
    """Sorted numbers as 2-byte gaps; a gap of _STEP or more takes several, _STEP meaning "go on"."""
    gap = np.diff(cells, prepend=0)
    more = gap // _STEP
    out = np.full(int(more.sum()) + len(cells), _STEP, "<u2")
    out[np.cumsum(more + 1) - 1] = gap % _STEP
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    gap = np.frombuffer(data, "<u2")
    return np.cumsum(gap, dtype=np.int64)[gap != _STEP]


class _Bucket:
    """A bucket's documents in order, each (id, text) once, and the hashes of its windows."""

    def __init__(self, table: pa.Table, width: int, slices: int):
        rows = sorted(zip(table.column(1).to_pylist(), [x or b"" for x in table.column(2).cast(pa.binary()).to_pylist()], strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        self.rows, self.times = [], []
        for r in rows:
            if self.rows and self.rows[-1] == r:
                self.times[-1] += 1
            else:
                self.rows.append(r)
                self.times.append(1)
        self.texts = Texts([t for _, t in self.rows])
        self.hash, self.at = self.texts.windows(width)
        self.more = self.texts.windows(width, 0xE7037ED1A0B428DB)[0].astype(np.uint32)
        self.slice = ((self.hash >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)

    def cells(self, row: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows ordered by slice and cell of a sketch's row, and the cells in that order."""
        cell = (mix(self.hash + np.uint64(row + 1)) % np.uint64(size)).astype(np.int64)
        order = np.argsort(self.slice * size + cell)
        return order, cell[order]

    def parts(self, order: np.ndarray, slices: int) -> np.ndarray:
        return np.searchsorted(self.slice[order], np.arange(slices + 1))

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chosen windows ordered by slice and key, for each the number of its key, and each key's first place in that order."""
        order = chosen[np.lexsort((self.at[chosen], self.more[chosen], self.hash[chosen], self.slice[chosen]))]
        h, m = self.hash[order], self.more[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
        return order, np.cumsum(new) - 1, np.flatnonzero(new)

    def chosen(self, answers: pa.Table, slices: int, size: int, depth: int) -> np.ndarray:
        """Windows that every row of the sketch estimates as repeated."""
        hot = np.ones(len(self.hash), bool)
        bits = {(r["row"], r["slice"]): r["bits"] for r in answers.to_pylist() if r["row"] >= 0}
        for row in range(depth):
            order, _ = self.cells(row, size)
            ends = self.parts(order, slices)
            for s in range(slices):
                if ends[s] < ends[s + 1]:
                    own = order[ends[s] : ends[s + 1]]
                    hot[own] &= np.unpackbits(np.frombuffer(bits[row, s], np.uint8), count=len(own)).astype(bool)
        return np.flatnonzero(hot)


def _records(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"bits": pa.binary(), "cells": pa.binary()}
    return pa.table({n: pa.array([r[k] for r in rows], kinds.get(n, pa.int32())) for k, n in enumerate(names)})


def _buckets(docs: DataFrame, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """Documents dealt by bucket, the number of buckets, and the bytes of text."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(spark), -(-total // bucket_bytes))
    bounds = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10 * n + 1000)).first()[0] or []
    bounds = np.unique(np.array(bounds, np.float64 if docs.schema["doc_id"].dataType.typeName() in ("double", "float") else np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy().astype(bounds.dtype))
        return pd.Series(out)

    return docs.select(bucket("doc_id").alias("bucket"), "doc_id", "text").repartition("bucket"), n, total


def substring_dedup(
    docs: DataFrame, width: int = 20, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, sketch_width: int = WIDTH, depth: int = DEPTH
) -> DataFrame:
    """Per row: id, n_words, n_removed, and kept (the words left, joined by one space) or its SHA-256 if digest.

    Words end at ASCII white space and are compared as they are. A word goes if a window of width words
    covers it whose word sequence also starts earlier: at a smaller id, or before it in the document.
    Rows equal in id and text count as one document, all are returned; rows equal in id alone are
    ordered by text. Ids are numbers; null ids come first. Null texts have no words. Texts shorter than
    width stay whole. Other columns are not read. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    kept_as = "kept_sha256" if digest else "kept"
    dealt, n_buckets, total = _buckets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), bucket_bytes)
    slices = max(32, -(-(total // 5) * ROOM // sketch_width))

    def sketch(table: pa.Table) -> pa.Table:
        b, rows = _Bucket(table, width, slices), []
        number = table.column(0)[0].as_py()
        for row in range(depth):
            order, cells = b.cells(row, sketch_width)
            ends = b.parts(order, slices)
            rows += [(s, row, number, pack(cells[ends[s] : ends[s + 1]])) for s in range(slices) if ends[s] < ends[s + 1]]
        return _records(rows, ["slice", "row", "bucket", "cells"])

    def merge(table: pa.Table) -> pa.Table:
        counts, rows = np.zeros(sketch_width, np.uint8), []
        row, number = table.column("row").to_pylist()[0], table.column("slice").to_pylist()[0]
        found = [(b, unpack(c)) for b, c in zip(table.column("bucket").to_pylist(), table.column("cells").to_pylist(), strict=True)]
        for _, cells in found:
            counts[cells] = np.minimum(counts[cells] + 1, 2)
            counts[cells[1:][cells[1:] == cells[:-1]]] = 2
        rows = [(b, row, number, np.packbits(counts[cells] > 1).tobytes()) for b, cells in found]
        return _records(rows, ["bucket", "row", "slice", "bits"])

    def send(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Bucket(docs_, width, slices)
        order, _, new = b.keys(b.chosen(answers, slices, sketch_width, depth))
        order = order[new]
        keys = np.empty(len(order), [("h", "<u8"), ("m", "<u4")])
        keys["h"], keys["m"] = b.hash[order], b.more[order]
        ends, number = b.parts(order, slices), docs_.column(0)[0].as_py()
        rows = [(s, number, keys[ends[s] : ends[s + 1]].tobytes()) for s in range(slices) if ends[s] < ends[s + 1]]
        return _records(rows, ["slice", "bucket", "cells"])

    def group(table: pa.Table) -> pa.Table:
        number, buckets = table.column("slice").to_pylist()[0], table.column("bucket").to_pylist()
        parts = [np.frombuffer(c, [("h", "<u8"), ("m", "<u4")]) for c in table.column("cells").to_pylist()]
        keys, owner = np.concatenate(parts), np.repeat(buckets, [len(p) for p in parts])
        order = np.lexsort((owner, keys["m"], keys["h"]))
        k = keys[order]
        seen = np.zeros(len(order), bool)
        seen[order[1:]] = (k["h"][1:] == k["h"][:-1]) & (k["m"][1:] == k["m"][:-1])
        ends = np.cumsum([0, *(len(p) for p in parts)])
        return _records([(b, -1, number, np.packbits(seen[i:j]).tobytes()) for b, i, j in zip(buckets, ends, ends[1:], strict=False)], ["bucket", "row", "slice", "bits"])

    def remove(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Bucket(docs_, width, slices)
        order, key, new = b.keys(b.chosen(answers, slices, sketch_width, depth))
        later = np.ones(len(order), bool)
        later[new] = False
        bits = {r["slice"]: r["bits"] for r in answers.to_pylist() if r["row"] < 0}
        ends = b.parts(order[new], slices)
        earlier = np.zeros(len(new), bool)
        for s in range(slices):
            if ends[s] < ends[s + 1]:
                earlier[ends[s] : ends[s + 1]] = np.unpackbits(np.frombuffer(bits[s], np.uint8), count=ends[s + 1] - ends[s])
        later |= earlier[key]
        cover = np.zeros(len(b.texts.hash) + width + 1, np.int32)
        starts = b.at[order[later]]
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + width, -1)
        stay = np.cumsum(cover)[: len(b.texts.hash)] == 0
        out = []
        for k, ((id_, text), times) in enumerate(zip(b.rows, b.times, strict=True)):
            own = stay[b.texts.first[k] : b.texts.first[k + 1]]
            found = text.split()
            gone = len(own) - int(own.sum())
            kept = b" ".join(found if not gone else [found[i] for i in np.flatnonzero(own)])
            out += [(id_, len(own), gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode())] * times
        ids = pa.array([x[0] for x in out], docs_.schema.field(1).type)
        return pa.table([ids, *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2)), pa.array([x[3] for x in out], pa.string())], names=[id_col, "n_words", "n_removed", kept_as])

    answer = "bucket int, row int, slice int, bits binary"
    cells = dealt.groupBy("bucket").applyInArrow(sketch, "slice int, row int, bucket int, cells binary")
    hot = cells.groupBy("slice", "row").applyInArrow(merge, answer)
    keys = dealt.groupBy("bucket").cogroup(hot.groupBy("bucket")).applyInArrow(send, "slice int, bucket int, cells binary")
    seen = keys.groupBy("slice").applyInArrow(group, answer)
    return dealt.groupBy("bucket").cogroup(hot.unionByName(seen).groupBy("bucket")).applyInArrow(remove, f"`{id_col}` {kind}, n_words long, n_removed long, {kept_as} string")
