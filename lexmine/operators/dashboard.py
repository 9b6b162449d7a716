"""What a user sees of documents, cards and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.functions.status import error_class
from lexmine.operators.notes import first_by

ACTIVE = ("queued", "running")


def documents_of(documents: DataFrame, highlights: DataFrame) -> DataFrame:
    """AGG1, SRT1. documents (document_id, user_id, opened_at, created_at) with highlight_count, the last opened first, unopened ones last."""
    counts = highlights.groupBy("document_id", "user_id").agg(F.count("*").alias("highlight_count"))
    both = documents.join(counts, ["document_id", "user_id"], "left").withColumn("highlight_count", F.coalesce("highlight_count", F.lit(0)))
    return both.orderBy("user_id", F.desc_nulls_last("opened_at"), F.desc("created_at"), "document_id")


def sync_status(users: DataFrame, cards: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """PIP20. A row for each user (user_id): documents, cards, pending (without synced_at), the oldest active job, the latest job with its state and error class, status.

    cards (card_id, user_id, document_id, synced_at) count if their document exists (JOI1); jobs: job_id,
    user_id, state, error_code, created_at. status is the first that holds of: syncing (an active job), error (the
    latest failed), pending (cards wait), idle.
    """
    owned = cards.join(documents.select("document_id", "user_id").distinct(), ["document_id", "user_id"], "left_semi")
    held = owned.groupBy("user_id").agg(F.count("*").alias("cards"), F.count_if(F.col("synced_at").isNull()).alias("pending"))
    had = documents.groupBy("user_id").agg(F.count("*").alias("documents"))
    latest = first_by(jobs, ["user_id"], [F.desc("created_at"), F.desc("job_id")]).select("user_id", F.col("job_id").alias("latest_job"), F.col("state").alias("latest_state"), error_class(F.col("error_code")).alias("latest_error"))
    active = first_by(jobs.where(F.col("state").isin(*ACTIVE)), ["user_id"], ["created_at", "job_id"]).select("user_id", F.col("job_id").alias("active_job"))
    out = users.select("user_id")
    for part in (had, held, latest, active):
        out = out.join(part, "user_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("documents", "cards", "pending")})
    status = F.when(F.col("active_job").isNotNull(), "syncing").when(F.col("latest_state") == "failed", "error").when(F.col("pending") > 0, "pending").otherwise("idle")
    return out.withColumn("status", status)
