"""Structured Streaming jobs. Each takes a streaming (or static) DataFrame and returns one, so it has a batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from lexmine.operators.concordance import concordance
from lexmine.operators.text import sentences
from lexmine.sources.shared import shared_folder

#: How late a row may come; seconds after a user's last event when a run of failures is forgotten.
LATE, FORGET = "10 minutes", 90 * 86400


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC11. Files of a folder (or pattern) as a stream; with a checkpoint each file is taken once, restarts included."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})  # watermarks need instants


def run_available(stream: DataFrame, mode: str = "append", to: str | None = None) -> DataFrame:
    """Run a stream over all input there is; its rows, from the last batch for a complete result, from all batches for an appended one.

    Every batch overwrites its own folder, so one that is run again after a failure changes nothing. With `to`, a
    folder that an earlier run had, it goes on from there.
    """
    spark = stream.sparkSession
    to = to or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{to}/checkpoint")
        .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{to}/out/batch={batch}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", f"{to}/out").parquet(f"{to}/out/*")
    if mode == "complete":
        rows = rows.where(F.col("batch") == (query.lastProgress["batchId"] if query.lastProgress else 0))
    return rows.drop("batch")


def intake(docs: DataFrame) -> DataFrame:
    """STR1. New documents to sentences, exactly once; no state is kept."""
    return sentences(docs)


def dedupe(events: DataFrame, keys: list[str]) -> DataFrame:
    """STR2. The first row of each key, whatever its time; keys are forgotten once the watermark is past."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(keys)


def rate(events: DataFrame, window: str = "15 minutes", slide: str | None = None, most: int = 8) -> DataFrame:
    """STR3. Failures of a user in each window, and whether they reach the limit."""
    failed = events.where("event_type = 'error'").withWatermark("ts", LATE)
    counted = failed.groupBy("user_id", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("failures"))
    return counted.select("user_id", F.col("w.start").alias("start"), "failures", (F.col("failures") >= most).alias("limited"))


def debounce(events: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """STR4. Requests of a user without a gap between them as one, with the newest reason; it runs a gap after the last."""
    s = events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("reason"), F.count("*").alias("requests"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("run_after"), "reason", "requests")


def liveness(events: DataFrame, workers: int = 10) -> DataFrame:
    """STR5. The last heartbeat of each worker."""
    return events.groupBy((F.col("user_id") % workers).alias("worker")).agg(F.max("ts").alias("last_seen"))


def not_deleted(events: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """STR8. Rows whose key was not deleted; the tombstones are read anew for each batch."""
    return events.join(tombstones.select(key).distinct(), key, "left_anti")


def not_deleted_within(rows: DataFrame, tombstones: DataFrame, key: str, wait: str = LATE) -> DataFrame:
    """STR8. Rows (key, ts) without a tombstone (key, deleted_at) up to `wait` before or after them, whichever comes first.

    A stream-stream outer join: a row is held until no tombstone can come any more, so one that is still on its
    way removes it too. Both sides' state goes with the watermark.
    """
    r = rows.withWatermark("ts", LATE).alias("r")
    t = tombstones.select(F.col(key).alias("_key"), "deleted_at").withWatermark("deleted_at", LATE).alias("t")
    span = F.expr(f"INTERVAL {wait}")
    near = (F.col(f"r.{key}") == F.col("_key")) & (F.col("deleted_at") >= F.col("ts") - span) & (F.col("deleted_at") <= F.col("ts") + span)
    return r.join(t, near, "leftOuter").where("_key IS NULL").drop("_key", "deleted_at")


def stale(events: DataFrame, as_of, seconds: int = 300) -> DataFrame:
    """STR9. Running jobs that have stood still."""
    return events.where((F.col("event_type") == "view") & (F.unix_timestamp(as_of) - F.unix_timestamp("ts") > seconds))


def hourly(events: DataFrame) -> DataFrame:
    """STR10. Events by hour and type."""
    counted = events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("hour"), "event_type", "n")


def assemble(chunks: DataFrame) -> DataFrame:
    """STR11. Numbered chunks (conv_id, role, turn, text) of a response joined in order, for each role."""
    parts = chunks.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return parts.select("conv_id", "role", F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"), F.size("c").alias("chunks"))


def assemble_sessions(chunks: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """STR11. Numbered chunks (conv_id, role, turn, text, ts) of a response joined in order once no more can come: a response ends with a gap.

    Append mode: a session's chunks are state until the watermark is past its end, then it is emitted and dropped.
    """
    parts = chunks.withWatermark("ts", LATE).groupBy("conv_id", "role", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return parts.select("conv_id", "role", F.col("w.start").alias("start"), F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"), F.size("c").alias("chunks"))


def write_tables(stream: DataFrame, to: str, tables: dict[str, Callable[[DataFrame, DataFrame | None], DataFrame]]) -> None:
    """STR1. Run a stream over all input there is into several tables below `to`, each row once, restarts included.

    tables names functions of a batch's rows and of what the table has from earlier batches (null if nothing).
    Every table's share of a batch is a folder of its number, which a batch that is run again overwrites, and earlier
    batches alone decide what is new; so it doesn't matter at which table a run was broken off.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            for name, make in tables.items():
                make(rows, read_table(rows.sparkSession, to, name, before=batch)).write.mode("overwrite").parquet(f"{to}/{name}/batch={batch}")
        finally:
            rows.unpersist()

    stream.writeStream.option("checkpointLocation", f"{to}/_checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def read_table(spark: SparkSession, to: str, name: str, before: int | None = None) -> DataFrame | None:
    """A table of write_tables; with before, what batches of lower numbers wrote; null if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{to}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    numbers = [int(f.getPath().getName().partition("=")[2]) for f in files.listStatus(path)]
    some = [n for n in numbers if before is None or n < before]
    return spark.read.parquet(*[f"{to}/{name}/batch={n}" for n in sorted(some)]) if some else None


def mined_tables(targets: DataFrame) -> dict[str, Callable[[DataFrame, DataFrame | None], DataFrame]]:
    """STR1. What new documents (doc_id, text) add: their sentences, highlights of targets with contexts, and a card for each target that had none, with its first context."""

    def highlights(docs: DataFrame) -> DataFrame:
        said = sentences(docs)
        return concordance(said, said, targets)

    def cards(docs: DataFrame, there: DataFrame | None) -> DataFrame:
        first = highlights(docs).groupBy("target").agg(F.min_by(F.struct("doc_id", "id", "sentence_html"), F.struct("doc_id", "sent_id", "place")).alias("f")).select("target", "f.*")
        return first if there is None else first.join(there.select("target"), "target", "left_anti")

    return {"sentences": lambda docs, _: sentences(docs), "highlights": lambda docs, _: highlights(docs), "cards": cards}


def _keep(state: GroupState, value: tuple, last: pd.Timestamp, seconds: int) -> None:
    """Set a state that is forgotten when the watermark is so many seconds past a time."""
    state.update(value)
    state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + seconds * 1000, state.getCurrentWatermarkMs() + 1))


def streaks(events: DataFrame, forget: int = FORGET) -> DataFrame:
    """STR6 and STR7. Every failure with its number in the user's unbroken run of failures; any other event ends a run.

    The run's length so far is the state of a user, forgotten so many seconds after its last event. A batch's events of a user are taken in order of time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return state.remove()
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        run, out = (state.get[0] if state.exists else 0), []
        for kind in rows["event_type"]:
            run = run + 1 if kind == "error" else 0
            out.append(run)
        _keep(state, (run,), rows["ts"].iloc[-1], forget)
        rows = rows.assign(streak=out)
        yield rows[rows["streak"] > 0][["user_id", "event_id", "ts", "streak"]]

    return events.withWatermark("ts", LATE).select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ts timestamp, streak long", "run long", "append", GroupStateTimeout.EventTimeTimeout)


def cleared_failures(events: DataFrame, seconds: int = 900) -> DataFrame:
    """STR3 with clearing. Each failure with the number of the user's failures in the trailing time since the last success; a user is forgotten once that time is past."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            return state.remove()
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        recent, out = (list(state.get[0]) if state.exists else []), []
        for kind, ts in zip(rows["event_type"], rows["ts"], strict=True):
            now = int(ts.timestamp())
            if kind == "signup":
                recent = []
            if kind == "error":
                recent = [t for t in recent if t > now - seconds] + [now]
            out.append(len(recent) if kind == "error" else 0)
        _keep(state, (recent,), rows["ts"].iloc[-1], seconds)
        rows = rows.assign(failures=out)
        yield rows[rows["failures"] > 0][["user_id", "event_id", "failures"]]

    return events.withWatermark("ts", LATE).select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, failures long", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)
