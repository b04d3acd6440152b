"""Limits that depend on the order of a key's events.

Events are dealt by key and sorted within the partition, then read once: a key's state is a few numbers or one window of
times, so a key with very many events needs no more memory than another.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Decide = Callable[[dict, int], bool]


def in_order(events: DataFrame, decide: Decide) -> DataFrame:
    """event_id, user_id and allowed, decided event by event in order of time and id, with fresh state for each user."""
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = None, {}
        for batch in batches:
            allowed = []
            for u, at in zip(batch["user_id"].to_pylist(), batch["at"].to_pylist(), strict=True):
                if u != user:
                    user, state = u, {}
                allowed.append(decide(state, at))
            yield pa.RecordBatch.from_arrays([batch["event_id"], batch["user_id"], pa.array(allowed, pa.bool_())], ["event_id", "user_id", "allowed"])

    return ordered.mapInArrow(run, "event_id long, user_id long, allowed boolean")


def sliding_log(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """At most so many allowed events within the last seconds; rejected ones are not recorded."""

    def decide(state: dict, at: int) -> bool:
        log = state.setdefault("log", deque())
        while log and log[0] <= at - seconds * 1_000_000:
            log.popleft()
        if len(log) >= most:
            return False
        log.append(at)
        return True

    return in_order(events, decide)


def fixed_window(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """A window begins with a user's first event and anew once it is over; rejected events count too."""

    def decide(state: dict, at: int) -> bool:
        if "start" not in state or at - state["start"] > seconds * 1_000_000:
            state["start"], state["n"] = at, 0
        state["n"] += 1
        return state["n"] <= most

    return in_order(events, decide)


def circuit_breaker(events: DataFrame, failures: int, seconds: int) -> DataFrame:
    """Opens after so many failures in a row, lets one through after the timeout and closes when that succeeds.

    events: event_id, user_id, ts and failed.
    """
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "failed")
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state, bad, since = None, "CLOSED", 0, 0
        for batch in batches:
            out = []
            for u, at, failed in zip(*(batch[c].to_pylist() for c in ("user_id", "at", "failed")), strict=True):
                if u != user:
                    user, state, bad, since = u, "CLOSED", 0, 0
                if state == "OPEN" and at - since >= seconds * 1_000_000:
                    state = "HALF_OPEN"
                if state != "OPEN":
                    bad = bad + 1 if failed else 0
                    if failed and (state == "HALF_OPEN" or bad >= failures):
                        state, since = "OPEN", at
                    elif not failed:
                        state = "CLOSED"
                out.append(state)
            yield pa.RecordBatch.from_arrays([batch["event_id"], batch["user_id"], pa.array(out, pa.string())], ["event_id", "user_id", "state"])

    return ordered.mapInArrow(run, "event_id long, user_id long, state string")
