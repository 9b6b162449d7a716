"""Running counts and sums along an order, however many rows one key has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lexmine.llm.common import checkpoint, partitions

#: Names a row's partition while rows are counted.
PART = "_ordered_part"


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _columns(batch: pa.RecordBatch, sums: tuple[str, ...]) -> list[np.ndarray]:
    return [np.ones(batch.num_rows, np.uint64)] + [batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in sums]


def running(df: DataFrame, key: str, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """df with n (the row's number within its key, from 1) and, for each c of sums, run_<c> and before_<c>: the sums of c with and before the row, modulo 2^64.

    key and sums are longs without nulls. Rows are dealt by ranges of (key, order), so a key of any size is
    spread over tasks; each partition tells the first and the last key it holds with their totals (two rows
    a partition, all that the driver sees), and from these what went before each partition is known. The
    partitions are written down with their numbers, so both readings see the same ones.
    """
    laid = checkpoint(df.repartitionByRange(partitions(df.sparkSession), key, *order).sortWithinPartitions(key, *order).withColumn(PART, F.spark_partition_id()))

    def totals(batches):
        """The first and the last run of equal keys of a partition."""
        first = last = part = None  # [key, totals]
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            at = _groups(keys)
            held = [np.add.reduceat(c, at[:-1]) for c in _columns(batch, sums)]
            for k in range(len(at) - 1) if len(at) < 4 else (0, len(at) - 2):
                one = [int(keys[at[k]]), [int(c[k]) for c in held]]
                if last is not None and k == 0 and last[0] == one[0]:
                    last[1] = [(a + b) % 2**64 for a, b in zip(last[1], one[1], strict=True)]
                else:
                    last = one
                first = last if first is None else first
                part = batch.column(PART)[0].as_py()
        if first is not None:
            ends = [first, last]
            yield pa.RecordBatch.from_pydict({"part": [part] * 2, "key": [e[0] for e in ends], "one": [first is last] * 2, "total": [[t - 2**64 if t >= 2**63 else t for t in e[1]] for e in ends]}, pa.schema([("part", pa.int32()), ("key", pa.int64()), ("one", pa.bool_()), ("total", pa.list_(pa.int64()))]))

    rows = laid.mapInArrow(totals, "part int, key long, one boolean, total array<long>").collect()
    before: dict[int, tuple[int, list[int]]] = {}
    carried: tuple[int, list[int]] | None = None
    by_part: dict[int, list] = {}
    for r in rows:
        by_part.setdefault(r["part"], []).append(r)
    for part in sorted(by_part):
        first, last = by_part[part]
        if carried and carried[0] == first["key"]:
            before[part] = carried
        if first["one"] and carried and carried[0] == first["key"]:
            carried = (carried[0], [a + b for a, b in zip(carried[1], first["total"], strict=True)])
        else:
            carried = (last["key"], list(last["total"]))

    kept = df.columns
    added = [f"{what}_{c}" for c in sums for what in ("run", "before")]

    def counted(batches):
        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if part != (part := batch.column(PART)[0].as_py()):
                held = before.get(part)
                known, so_far = (held[0], [t % 2**64 for t in held[1]]) if held else (None, [0] * (1 + len(sums)))
            keys = batch.column(key).to_numpy()
            at = _groups(keys)
            base, out = np.repeat(at[:-1], np.diff(at)), []
            for k, values in enumerate(_columns(batch, sums)):
                total = np.cumsum(values)
                run = total - (total[base] - values[base])
                if known is not None and keys[0] == known:
                    run[: at[1]] += np.uint64(so_far[k])
                so_far[k] = int(run[-1])
                out += [pa.array(x.view(np.int64)) for x in ((run, run - values) if k else (run,))]
            known = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *out], names=[*kept, "n", *added])

    schema = S.StructType([*df.schema.fields, *[S.StructField(c, S.LongType()) for c in ("n", *added)]])
    return laid.mapInArrow(counted, schema)
