"""Streaming jobs run over all input there is, with the SQL of their batch twins."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from lexmine.functions import status as S
from lexmine.plans.base import query, table
from lexmine.sources.shared import shared_folder
from lexmine.streaming import jobs as J
from lexmine.streaming import timers as T


def _stream(spark, d, name):
    return J.read_folder(spark, f"{d}/{name}.parquet*")


def _plain(df):
    """Instants as the tables hold them: without a time zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


@query("SELECT doc_id, sent_id, sentence FROM sentences", "corpus", "sentences")
def str1_intake(spark, d):
    docs = _stream(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return J.run_available(J.intake(docs))


@query("SELECT DISTINCT lang, source FROM documents")
def src11_folder_intake(spark, d):
    return J.run_available(_stream(spark, d, "documents").groupBy("lang", "source").count(), "complete").select("lang", "source")


@query("SELECT event_id, ts, user_id FROM events")
def str2_dedupe(spark, d):
    """Every event comes twice."""
    twice = _stream(spark, d, "events").withColumn("copy", F.explode(F.lit([1, 2])))
    return _plain(J.run_available(J.dedupe(twice, ["event_id"])).select("event_id", "ts", "user_id"))


@query("SELECT user_id, date_trunc('day', ts) AS start, count(*) AS failures, count(*) >= 4 AS limited FROM events WHERE event_type = 'error' GROUP BY user_id, date_trunc('day', ts)")
def str3_rate(spark, d):
    return _plain(J.run_available(J.rate(_stream(spark, d, "events"), "1 day", most=4), "complete"))


@query(
    """WITH s AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT a.user_id, a.event_id, count(*) AS failures FROM s a JOIN s b ON a.user_id = b.user_id AND a.k = b.k AND b.event_type = 'error' AND (b.ts, b.event_id) <= (a.ts, a.event_id) AND b.t > a.t - 864000 WHERE a.event_type = 'error' GROUP BY a.user_id, a.event_id"""
)
def str3_rate_cleared(spark, d):
    return J.run_available(J.cleared_failures(_stream(spark, d, "events"), seconds=10 * 86400))


@query(
    """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS run_after, arg_max(event_type, (ts, event_id)) AS reason, count(*) AS requests FROM s GROUP BY user_id, k"""
)
def str4_debounce(spark, d):
    return _plain(J.run_available(J.debounce(_stream(spark, d, "events"), "30 minutes"), "complete"))


@query("SELECT user_id % 10 AS worker, max(ts) AS last_seen FROM events GROUP BY 1")
def str5_liveness(spark, d):
    return _plain(J.run_available(J.liveness(_stream(spark, d, "events")), "complete"))


_RUNS = "runs AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), streaks AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS streak FROM runs WHERE event_type = 'error')"


@query(f"WITH {_RUNS} SELECT user_id, event_id, streak AS attempt, CASE WHEN streak < 5 THEN [1, 5, 15, 60][least(streak, 4)] END AS minutes, streak >= 5 AS final FROM streaks")
def str6_retries(spark, d):
    s = J.run_available(J.streaks(_stream(spark, d, "events")))
    return s.select("user_id", "event_id", F.col("streak").alias("attempt"), S.backoff_minutes(F.col("streak")).alias("minutes"), (F.col("streak") >= S.MOST_ATTEMPTS).alias("final"))


@query(f"WITH {_RUNS} SELECT user_id, event_id FROM streaks WHERE streak = 2")
def str7_failure_streak(spark, d):
    return J.run_available(J.streaks(_stream(spark, d, "events"))).where("streak = 2").select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def str8_tombstones(spark, d):
    dead = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return J.run_available(J.not_deleted(_stream(spark, d, "events"), dead, "user_id")).select("event_id")


@query("SELECT event_id FROM events, (SELECT max(date_trunc('second', ts)) AS as_of FROM events) WHERE event_type = 'view' AND date_diff('second', date_trunc('second', ts), as_of) > 86400")
def str9_stale(spark, d):
    as_of = F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0])
    return J.run_available(J.stale(_stream(spark, d, "events"), as_of, 86400)).select("event_id")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str10_hourly(spark, d):
    return _plain(J.run_available(J.hourly(_stream(spark, d, "events")), "complete"))


@query("SELECT conv_id, role, sha256(string_agg(text, '' ORDER BY turn, text)) AS text_sha, count(*) AS chunks FROM conversations GROUP BY conv_id, role")
def str11_assemble(spark, d):
    return J.run_available(J.assemble(_stream(spark, d, "conversations")), "complete").select("conv_id", "role", F.sha2("text", 256).alias("text_sha"), F.col("chunks").cast("long").alias("chunks"))


#: The watermark at the end of a run: rows and timers before it have been taken.
_MARK = "mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS w FROM events), e AS (SELECT *, date_trunc('milliseconds', ts) AS t FROM events, mark WHERE date_trunc('milliseconds', ts) < w)"


@query(
    f"""WITH {_MARK}, g AS (SELECT user_id % 10 AS worker, t, w, lag(t) OVER o AS before, lead(t) OVER o AS next FROM e WINDOW o AS (PARTITION BY user_id % 10 ORDER BY t, event_id))
SELECT worker, t + INTERVAL 90 SECOND AS at, 'gone' AS state FROM g WHERE t + INTERVAL 90 SECOND < w AND (next IS NULL OR next > t + INTERVAL 90 SECOND) UNION ALL SELECT worker, t, 'back' FROM g WHERE before + INTERVAL 90 SECOND < t"""
)
def str5_silence(spark, d):
    return _plain(J.run_available(T.silence(_stream(spark, d, "events").withColumn("worker", F.col("user_id") % 10), "worker")))


@query(
    f"""WITH {_MARK}, k AS (SELECT * FROM e WHERE event_type IN ('view', 'click', 'purchase')), g AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next FROM k)
SELECT user_id, t + INTERVAL 5 MINUTE AS at, event_id FROM g WHERE event_type IN ('view', 'click') AND t + INTERVAL 5 MINUTE < w AND (next IS NULL OR next > t + INTERVAL 5 MINUTE)"""
)
def str9_standstill(spark, d):
    """Views and clicks tell that a user's job runs, a purchase ends it."""
    return _plain(J.run_available(T.standstill(_stream(spark, d, "events"), "user_id", ("view", "click"), ("purchase",))))


@query(
    f"""WITH {_MARK}, k AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM e WHERE event_type IN ('error', 'signup')),
n AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run, event_type ORDER BY t, event_id) - 1) % 5 + 1 AS attempt FROM k),
x AS (SELECT *, CASE WHEN event_type = 'error' AND attempt < 5 THEN t + INTERVAL 1 DAY * [1, 5, 15, 60][attempt] END AS due FROM n),
y AS (SELECT *, lag(due) OVER o AS waits, lead(t) OVER o AS next FROM x WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, CASE WHEN attempt = 5 THEN t ELSE due END AS at, event_id, CAST(attempt AS INTEGER) AS attempt, CASE WHEN attempt = 5 THEN 'failed' WHEN waits >= t THEN 'coalesced' ELSE 'queued' END AS action FROM y WHERE event_type = 'error'
UNION ALL SELECT user_id, due, event_id, CAST(attempt AS INTEGER), 'retry' FROM y WHERE due < w AND (next IS NULL OR due < next)"""
)
def str6_retry_timers(spark, d):
    """With days in place of minutes, as events are few."""
    return _plain(J.run_available(T.retries(_stream(spark, d, "events"), "user_id", "error", "signup", [1440 * m for m in S.BACKOFF])))


@query(
    """WITH mark AS (SELECT date_trunc('milliseconds', max(CASE WHEN event_type = 'error' THEN ts END)) - INTERVAL 10 MINUTE AS w FROM events)
SELECT event_id, ts FROM events r, mark WHERE event_type <> 'error' AND date_trunc('milliseconds', ts) < w - INTERVAL 1 DAY AND NOT EXISTS (SELECT 1 FROM events t WHERE t.event_type = 'error' AND t.user_id = r.user_id AND t.ts BETWEEN r.ts - INTERVAL 1 DAY AND r.ts + INTERVAL 1 DAY)"""
)
def str8_late_tombstones(spark, d):
    """Errors are tombstones of what their user did up to a day before or after; the errors' stream is the one that lags."""
    rows = _stream(spark, d, "events").where("event_type <> 'error'")
    dead = _stream(spark, d, "events").where("event_type = 'error'").select("user_id", F.col("ts").alias("deleted_at"))
    return _plain(J.run_available(J.not_deleted_within(rows, dead, "user_id", "1 day")).select("event_id", "ts"))


@query("WITH c AS (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * conv_id + INTERVAL 1 SECOND * turn AS ts FROM conversations), mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM c), g AS (SELECT conv_id, role, min(ts) AS start, max(ts) + INTERVAL 30 SECOND AS done, sha256(string_agg(text, '' ORDER BY turn, text)) AS text_sha, count(*) AS chunks FROM c GROUP BY conv_id, role) SELECT conv_id, role, start, text_sha, chunks FROM g, mark WHERE done <= w")
def str11_sessions(spark, d):
    """A conversation an hour, a chunk a second."""
    seconds = F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn")
    chunks = _stream(spark, d, "conversations").withColumn("ts", F.timestamp_seconds(seconds))
    return _plain(J.run_available(J.assemble_sessions(chunks)).select("conv_id", "role", "start", F.sha2("text", 256).alias("text_sha"), F.col("chunks").cast("long").alias("chunks")))


@query("WITH mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS w FROM events) SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events, mark WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= w GROUP BY 1, 2")
def str10_hourly_append(spark, d):
    """Hours that are over; their state is gone."""
    return _plain(J.run_available(J.hourly(_stream(spark, d, "events"))))


@query(
    """WITH mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS w FROM events), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
r AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS run_after, arg_max(event_type, (ts, event_id)) AS reason, count(*) AS requests FROM s GROUP BY user_id, k) SELECT r.* FROM r, mark WHERE run_after <= w"""
)
def str4_debounce_append(spark, d):
    """Requests whose time to run has come."""
    return _plain(J.run_available(J.debounce(_stream(spark, d, "events"), "30 minutes")))


@query(
    """, hits AS (SELECT w.doc_id, w.sent_id, w.start, t.target, s.sentence FROM words w JOIN (VALUES ('ention'), ('thatin'), ('retion')) t(target) ON lower(w.token) = t.target JOIN sentences s USING (doc_id, sent_id)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, target ORDER BY sent_id, start) AS n FROM hits) WHERE n <= 12),
h AS (SELECT doc_id, sent_id, target, row_number() OVER (PARTITION BY doc_id, target, CASE WHEN length(sentence) > 420 THEN doc_id || '/' || sent_id || '/' || start ELSE lower(sentence) END ORDER BY sent_id, start) AS m FROM k)
SELECT 'sentences' AS name, doc_id, count(*) AS n FROM sentences GROUP BY doc_id UNION ALL SELECT 'highlights', doc_id, count(*) FROM h WHERE m = 1 GROUP BY doc_id UNION ALL SELECT 'cards', min(doc_id), 1 FROM h GROUP BY target""",
    "corpus", "sentences", "words",
)
def str1_tables(spark, d):
    """Rows a document adds to each table; a card counts for the document that made it."""
    docs = _stream(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    to = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    targets = spark.createDataFrame([("ention",), ("thatin",), ("retion",)], "target string")
    J.write_tables(docs, to, J.mined_tables(targets))
    tables = [J.read_table(spark, to, name).select(F.lit(name).alias("name"), "doc_id") for name in ("sentences", "highlights", "cards")]
    return functools.reduce(lambda a, b: a.unionByName(b), tables).groupBy("name", "doc_id").agg(F.count("*").alias("n"))


@query("WITH mark AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS w FROM events WHERE event_type = 'error') SELECT user_id, date_trunc('day', ts) AS start, count(*) AS failures, count(*) >= 4 AS limited FROM events, mark WHERE event_type = 'error' AND date_trunc('day', ts) + INTERVAL 1 DAY <= w GROUP BY 1, 2")
def str3_rate_append(spark, d):
    """Days that are over."""
    return _plain(J.run_available(J.rate(_stream(spark, d, "events"), "1 day", most=4)))
