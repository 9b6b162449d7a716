"""Jobs whose state has timers: silence, standstill, retries. Events of a key are taken in order of time, late ones within the watermark too."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmine.functions.status import BACKOFF, GONE_S, MOST_ATTEMPTS, STALE_S
from lexmine.streaming.jobs import FORGET, LATE

#: What a machine does: with its own state and an event (time in ms, id, kind), or with its state and the time its timer fires. It returns the rows it emits.
Machine = Callable[[dict, int, int | None, str | None], list[tuple]]


def in_order(events: DataFrame, key: str, machine: Machine, row: str, late: str = LATE) -> DataFrame:
    """Run a machine for each key over events (key, ts, event_id, event_type): its rows, which begin with key and an instant in ms (at).

    Events wait in the state until the watermark is past them and are then taken by time and id, so the order in
    which they come doesn't matter; those behind the watermark are too late and left out. Machines keep their
    timer, in ms, under "timer"; it fires before any later event, and after one of the same instant. The state
    of a key holds its events of the last `late` (and of a batch), and goes when nothing is waiting, or 90 days later
    if the machine remembers something.
    """
    names = [c.split()[0] for c in row.split(", ")]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        held = json.loads(state.get[0]) if state.exists else {"waiting": [], "own": {}}
        own, out = held["own"], []
        if not state.hasTimedOut:
            for part in batches:
                ms = part["ts"].astype("datetime64[us]").astype("int64") // 1000
                held["waiting"] += [list(e) for e in zip(ms.tolist(), part["event_id"].tolist(), part["event_type"].tolist(), strict=True) if e[0] >= now]
        waiting = sorted(held["waiting"])
        done, fired = 0, False
        while True:
            event = waiting[done] if done < len(waiting) and waiting[done][0] < now else None
            timer = own.get("timer")
            if timer is not None and timer < now and (event is None or timer < event[0]):
                own["timer"], fired = None, True
                out += machine(own, timer, None, None)
            elif event is not None:
                done += 1
                out += machine(own, *event)
            else:
                break
        held["waiting"] = waiting[done:]
        nexts = [waiting[done][0]] if done < len(waiting) else []
        nexts += [own["timer"]] if own.get("timer") is not None else []
        idle = state.hasTimedOut and not (done or fired)  # nothing for so long
        if nexts or (any(own.values()) and not idle):
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(min(nexts), now + 1) if nexts else now + FORGET * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(k[0], *r) for r in out], columns=names)

    some = events.withWatermark("ts", late).select(key, "ts", "event_id", "event_type")
    kind = some.schema[key].dataType.simpleString()
    first, rest = row.split(", ", 1)
    out = some.groupBy(key).applyInPandasWithState(step, f"{first.split()[0]} {kind}, {rest}", "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("at", F.timestamp_millis("at"))


def silence(events: DataFrame, worker: str, seconds: int = GONE_S) -> DataFrame:
    """STR5. (worker, at, state): "gone" when so many seconds have passed since a worker's last event, "back" at its next one."""

    def machine(own: dict, at: int, event: int | None, kind: str | None) -> list[tuple]:
        if event is None:
            own["gone"] = True
            return [(at, "gone")]
        back = [(at, "back")] if own.get("gone") else []
        own |= {"gone": False, "timer": at + seconds * 1000}
        return back

    return in_order(events, worker, machine, f"{worker} long, at long, state string")


def standstill(events: DataFrame, job: str, running: tuple[str, ...], done: tuple[str, ...], seconds: int = STALE_S) -> DataFrame:
    """STR9. (job, at, event_id): a running job is queued again when so many seconds have passed since it last told that it runs; event_id is that event."""

    def machine(own: dict, at: int, event: int | None, kind: str | None) -> list[tuple]:
        if event is None:
            return [(at, own.pop("event"))]
        if kind in running:
            own |= {"timer": at + seconds * 1000, "event": event}
        elif kind in done:
            own.clear()
        return []

    return in_order(events, job, machine, f"{job} long, at long, event_id long")


def retries(events: DataFrame, user: str, failed: str, succeeded: str, minutes: list[int] = BACKOFF, most: int = MOST_ATTEMPTS) -> DataFrame:
    """STR6. (user, at, event_id, attempt, action): what failures lead to; event_id is the failure's.

    A failure is "queued" for a retry after its attempt's delay (at: when it is to run), or "coalesced" into the retry
    that waits already, which then has its attempt and time; the last attempt's is "failed", and counting begins
    anew. "retry" comes when the time is there. A success ends attempts and takes back what waits.
    """

    def machine(own: dict, at: int, event: int | None, kind: str | None) -> list[tuple]:
        if event is None:
            return [(at, own["event"], own["attempt"], "retry")]
        if kind == succeeded:
            own.clear()
        elif kind == failed:
            attempt, waits = own.get("attempt", 0) + 1, own.get("timer") is not None
            if attempt >= most:
                own.clear()
                return [(at, event, attempt, "failed")]
            due = at + minutes[min(attempt, len(minutes)) - 1] * 60_000
            own |= {"attempt": attempt, "event": event, "timer": due}
            return [(due, event, attempt, "coalesced" if waits else "queued")]
        return []

    return in_order(events, user, machine, f"{user} long, at long, event_id long, attempt int, action string")
