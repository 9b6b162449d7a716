"""Column functions for activity: expiry, back-off, status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes before a retry, by attempt; attempts at most; seconds until a worker counts as gone, and until a running job counts as stale.
BACKOFF, MOST_ATTEMPTS, GONE_S, STALE_S = [1, 5, 15, 60], 5, 90, 300


def age_s(ts: Column, as_of: Column) -> Column:
    return F.unix_timestamp(as_of) - F.unix_timestamp(ts)


def backoff_minutes(attempt: Column) -> Column:
    """FUN32. Minutes before the next attempt; null after the last."""
    return F.when(attempt < MOST_ATTEMPTS, F.element_at(F.lit(BACKOFF), F.least(attempt, F.lit(len(BACKOFF))).cast("int")))


def error_class(code: Column) -> Column:
    """FUN31. The class of an error code such as auth:x, configuration:y, temporary:z."""
    head = F.split_part(code, F.lit(":"), F.lit(1))
    known = head.isin("auth", "configuration", "temporary", "internal", "coalesced")
    return F.when(code.isNull() | (code == ""), F.lit(None)).when(known, head).otherwise("other")


def progress(page: Column, pages: Column) -> Column:
    """FIL20. Percent read, with the page kept within 0 and pages."""
    return F.when(pages > 0, F.floor(100 * F.greatest(F.lit(0), F.least(page, pages)) / pages)).otherwise(0)
