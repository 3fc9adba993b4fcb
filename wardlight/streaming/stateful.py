"""Stateful versions of the event-driven parts, for Structured Streaming; the folds also run on batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Failures that lock, the window they count in, and how long a lock lasts.
FAILURES, WINDOW_MS, LOCK_MS = 5, 600_000, 900_000
#: How long the state of a silent user is kept at least.
IDLE_MS = 3_600_000
# Hours between two firings of an alert.
COOLDOWN_HOURS = {"1h": 1, "4h": 4, "24h": 24}


def limiter_step(failures: list[int], locked_until: int, at: int, kind: str) -> tuple[list[int], int, bool]:
    """State after an attempt at `at` (ms) and whether it was let in; a lock is set when an attempt is checked."""
    failures = [t for t in failures if at - t < WINDOW_MS]
    if at < locked_until:
        return failures, locked_until, False
    if len(failures) >= FAILURES:
        return failures, at + LOCK_MS, False
    if kind == "success":
        return [], 0, True
    return [*failures, at], 0, True


def login_limiter(attempts: DataFrame) -> DataFrame:
    """Attempts (key, at_ms, kind) with `allowed`; state for each key, which ends with the lock's time at the latest."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        failures, locked = state.get if state.exists else ([], 0)
        rows = pd.concat(list(frames)).sort_values("at_ms", kind="stable")
        out = []
        for at, kind in zip(rows["at_ms"], rows["kind"]):
            failures, locked, allowed = limiter_step(list(failures), int(locked), int(at), kind)
            out.append((key[0], at, kind, allowed))
        state.update((failures, locked))
        state.setTimeoutDuration(WINDOW_MS + LOCK_MS)
        yield pd.DataFrame(out, columns=["key", "at_ms", "kind", "allowed"])

    return attempts.groupBy("key").applyInPandasWithState(step, "key string, at_ms long, kind string, allowed boolean", "failures array<long>, locked long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def rapid_queries(events: DataFrame, seconds: float = 60, most: int = 10) -> DataFrame:
    """Events (user_id, seq, at_us, action) with more than `most` earlier QUERY_RUNs of the user in the trailing window; exact, by state.

    The state of a user without events goes after the window's length or IDLE_MS, whichever is longer.
    """
    width = int(seconds * 1e6)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at_us", "seq"], kind="stable")
        out = []
        for seq, at, action in zip(rows["seq"], rows["at_us"], rows["action"]):
            recent = [t for t in recent if t >= at - width]
            out.append((key[0], seq, len(recent), len(recent) > most))
            if action == "QUERY_RUN":
                recent.append(int(at))
        state.update((recent,))
        state.setTimeoutDuration(max(width // 1000, IDLE_MS))
        yield pd.DataFrame(out, columns=["user_id", "seq", "earlier", "rapid"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, seq long, earlier long, rapid boolean", "recent array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def cool_down(hits: DataFrame) -> DataFrame:
    """Of the moments (name, at, hours) at which alerts are met, those that fire: not within `hours` of the last firing."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", kind="stable")
        last, keep = None, []
        for at, hours in zip(frame["at"], frame["hours"]):
            fires = last is None or at - last >= pd.Timedelta(hours=int(hours))
            last = at if fires else last
            keep.append(fires)
        return frame[keep]

    return hits.groupBy("name").applyInPandas(fold, hits.schema)


def billing_change(event: Column) -> Column:
    """The licence status that a billing event leads to; null where it leads to none."""
    return (
        F.when(event == "payment_succeeded", "active")
        .when(event.isin("payment_failed", "payment_action_required"), "grace")
        .when(event == "subscription_deleted", "suspended")
        .when(event == "checkout_completed", "active")
    )


def apply_billing(licenses: DataFrame, events: DataFrame) -> DataFrame:
    """Licences (customer, status, grace_end, tier, cycle) after a batch of events (customer, type, at, seq, tier, cycle).

    Of each customer, the newest status change and the newest tier and cycle that an update names
    count. Unknown customers are added by a completed checkout only, with its tier and cycle or the
    smallest tier by month; what other events of theirs came before it does not count.
    """
    none = F.lit(None).cast("string")
    licenses, events = (df.withColumns({c: none for c in ("tier", "cycle") if c not in df.columns}) for df in (licenses, events))
    kind = F.col("type")
    known = licenses.select("customer", F.lit(True).alias("known"))
    rows = events.join(known, "customer", "left").withColumns({"to": billing_change(kind), "order": F.struct("at", "seq")})
    first = rows.groupBy("customer").agg(F.min(F.when(kind == "checkout_completed", F.col("order"))).alias("opened"))
    rows = rows.join(first, "customer").filter(F.col("known") | (F.col("order") >= F.col("opened")))
    opens = F.col("known").isNull() & (F.col("order") == F.col("opened"))
    named = (kind == "subscription_updated") | opens
    newest = lambda value, when: F.max_by(value, F.when(when, F.col("order")))
    last = rows.groupBy("customer").agg(
        newest(F.struct("to", "at"), F.col("to").isNotNull()).alias("x"),
        newest(F.when(opens, F.coalesce("tier", F.lit("starter"))).otherwise(F.col("tier")), named & (opens | F.col("tier").isNotNull())).alias("new_tier"),
        newest(F.when(opens, F.coalesce("cycle", F.lit("monthly"))).otherwise(F.col("cycle")), named & (opens | F.col("cycle").isNotNull())).alias("new_cycle"),
    )
    met = licenses.join(last, "customer", "full")
    grace = F.when(F.col("x.to") == "grace", F.col("x.at") + F.expr("interval 7 days")).when(F.col("x.to").isNull(), F.col("grace_end"))
    return met.select("customer", F.coalesce("x.to", "status").alias("status"), grace.alias("grace_end"), F.coalesce("new_tier", "tier").alias("tier"), F.coalesce("new_cycle", "cycle").alias("cycle"))


def keep_licenses(events: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str):
    """A streaming query that merges each batch of billing events into the stored licences."""
    return events.writeStream.foreachBatch(lambda batch, _: write(apply_billing(read(), batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by action and tumbling window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "action").count()


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Events without those whose key came before, as far as the watermark looks back."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
