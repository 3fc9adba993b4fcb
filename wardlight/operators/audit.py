"""The hash-chained audit log: appending, verification, search, and access anomalies."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
OFFSET_HOURS, FIRST_HOUR, LAST_HOUR = 3, 7, 22


def chain(events: list[dict], previous_line: str | None = None) -> list[str]:
    """Log lines of new events in order. Each line depends on the one before, so this is a fold, for one writer."""
    lines = []
    for event in events:
        previous = hashlib.sha256(previous_line.encode()).hexdigest() if previous_line else GENESIS
        body = {k: v for k, v in event.items() if v is not None} | {"previousHash": previous}
        text = json.dumps(body, separators=(",", ":"), ensure_ascii=False)
        own = hashlib.sha256((previous + text).encode()).hexdigest()
        previous_line = f'{text[:-1]},"hash":"{own}"}}'
        lines.append(previous_line)
    return lines


def chained(events: DataFrame, position: str = "id", start: int = 0, line: str | None = None) -> DataFrame:
    """(pos, line): the chained log of all events in order, after an earlier line. One task is the one writer; it holds a batch at a time."""

    def run(batches):
        pos, last = start, line
        for batch in batches:
            lines = chain(batch.to_pylist(), last)
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(range(pos, pos + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["pos", "line"])
                pos, last = pos + len(lines), lines[-1]

    return events.repartition(1).sortWithinPartitions(position).mapInArrow(run, "pos long, line string")


def append(spark: SparkSession, path: str, events: DataFrame, position: str = "id") -> None:
    """Chains events to the log table (pos, line) at path and adds them. One writer at a time."""
    log = read_log(spark, path)
    last = log.orderBy(F.col("pos").desc()).limit(1).collect()
    start, line = (last[0].pos + 1, last[0].line) if last else (0, None)
    chained(events, position, start, line).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of the log table at path; a missing one is empty."""
    try:
        return spark.read.schema("pos long, line string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "pos long, line string")
        raise


def anomaly_records(flagged: DataFrame) -> DataFrame:
    """(timestamp, eventId, userId, flags) of the events that have flags."""
    return flagged.filter(F.size("flags") > 0).select(F.col("ts").cast("string").alias("timestamp"), F.col("seq").alias("eventId"), F.col("user_id").alias("userId"), "flags")


def append_anomalies(flagged: DataFrame, path: str) -> None:
    anomaly_records(flagged).write.mode("append").json(path)


def with_feedback(log: DataFrame, flagged: DataFrame) -> DataFrame:
    """The log in which each flagged event is followed by the QUERY_RUN that reports it, as (seq, reports, user_id, ts, action), in the order of seq and reports."""
    plain = log.select("seq", F.lit(False).alias("reports"), "user_id", "ts", "action")
    return plain.unionByName(flagged.filter(F.size("flags") > 0).select("seq", F.lit(True).alias("reports"), "user_id", "ts", F.lit("QUERY_RUN").alias("action")))


def verify(lines: DataFrame, position: str = "pos", line: str = "line", segment: int = 10_000) -> DataFrame:
    """One row: valid, tampered_at (1-based number of the first bad line) and total_entries.

    Lines are checked in parallel: a line's predecessor comes by position within segments of the
    log, and each segment's first line meets the last line of the segment before by a join.
    Empty lines don't count; an empty log is valid.
    """
    rows = lines.filter(F.trim(line) != "").select(F.col(position).cast("long").alias("pos"), F.col(line).alias("line"))
    part = F.floor(F.col("pos") / segment)
    rows = rows.withColumn("segment", part)
    w = Window.partitionBy("segment").orderBy("pos")
    # Digests stand in for the lines, so that only short rows are sorted.
    rows = rows.select(
        "pos",
        "segment",
        F.sha2("line", 256).alias("digest"),
        F.get_json_object("line", "$.previousHash").alias("link"),
        F.get_json_object("line", "$.hash").alias("own"),
        F.regexp_replace("line", r',"hash":"[0-9a-f]*"\}$', "}").alias("body"),
    )
    rows = rows.withColumns({"before": F.lag("digest").over(w), "ok_self": F.coalesce(F.sha2(F.concat("link", "body"), 256) == F.col("own"), F.lit(False)), "n": F.row_number().over(w)}).drop("body")
    sizes = rows.groupBy("segment").agg(F.count("*").alias("size"), F.max_by("digest", "pos").alias("last"))
    # One row for each segment of the log.
    order = Window.orderBy("segment")
    sizes = sizes.select("segment", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.lag("last").over(order).alias("carried"))
    rows = rows.join(sizes, "segment")
    expected = F.coalesce("before", "carried", F.lit(GENESIS))
    bad = ~F.col("ok_self") | ~F.coalesce(F.col("link") == expected, F.lit(False))
    out = rows.agg(F.min(F.when(bad, F.col("offset") + F.col("n"))).alias("tampered_at"), F.count("*").alias("total_entries"))
    return out.select(F.col("tampered_at").isNull().alias("valid"), "tampered_at", "total_entries")


def search(log: DataFrame, user=None, action=None, since=None, until=None, newest_first: bool = True) -> DataFrame:
    for name, value in (("user_id", user), ("action", action)):
        if value is not None:
            log = log.filter(F.col(name) == value)
    if since is not None:
        log = log.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        log = log.filter(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    return log.orderBy(F.col("seq").desc()) if newest_first else log


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bulk_export(rows: Column, most: int = 1000) -> Column:
    return F.coalesce(rows, F.lit(0)) > most


def off_hours(ts: Column) -> Column:
    h = F.pmod(F.hour(ts) + OFFSET_HOURS, F.lit(24))
    return (h < FIRST_HOUR) | (h > LAST_HOUR)


def prior_by_user(log: DataFrame, actions: list[str], seconds: float, name: str, peers: bool = False) -> DataFrame:
    """log with the number of earlier events of the same user with those actions in the trailing window, both ends included.

    Events of the same instant count by sequence, or, with `peers`, all of them but the event itself.
    """
    w = Window.partitionBy("user_id").orderBy(micros(F.col("ts"))).rangeBetween(-int(seconds * 1e6), Window.currentRow)
    hit = F.col("action").isin(*actions)
    later = Window.partitionBy("user_id", "ts").orderBy("seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return log.withColumn(name, F.count_if(hit).over(w) - (F.coalesce(hit, F.lit(False)).cast("long") if peers else F.count_if(hit).over(later)))


def prior_anywhere(log: DataFrame, action: str, seconds: float, name: str, peers: bool = False) -> DataFrame:
    """log with the number of earlier events of that action by anyone in the trailing window, both ends included.

    Events of the same instant count by sequence, or, with `peers`, all of them but the event itself.
    A global window would put the log in one task: events are cut into buckets of the window's
    length. What the bucket before leaves counts from the start of a bucket until it is too old.
    """
    width = int(seconds * 1e6)
    own = F.coalesce(F.col("action") == action, F.lit(False)).cast("long")
    events = log.withColumns({"__at": micros(F.col("ts")), "__hit": own, "__step": own, "__event": F.lit(True)}).withColumn("__bucket", F.floor(F.col("__at") / width))
    after = F.col("__bucket") + 1
    steps = F.array(F.struct((after * width).alias("at"), F.lit(1).cast("long").alias("step")), F.struct((F.col("__at") + width + 1).alias("at"), F.lit(-1).cast("long").alias("step")))
    left = events.filter((F.col("__hit") == 1) & F.col("__at").isNotNull()).select(after.alias("__bucket"), F.inline(steps).alias("__at", "__step"))
    left = left.withColumns({"__hit": F.lit(0).cast("long"), "__event": F.lit(False)})
    both = events.unionByName(left, allowMissingColumns=True)
    w = Window.partitionBy("__bucket").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy("__bucket", "__at").orderBy("seq").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    counted = both.withColumn(name, F.sum("__step").over(w) - (F.col("__hit") if peers else F.sum("__hit").over(later)))
    return counted.filter("__event").drop("__at", "__hit", "__step", "__event", "__bucket")


def anomalies(log: DataFrame, rapid: tuple = (60, 10), failed: tuple = (600, 5), exports: tuple = (3600, 3), peers: bool = False) -> DataFrame:
    """log with the array `flags`, in the order bulk export, off hours, rapid queries, failed logins, excessive exports."""
    out = prior_by_user(log, ["QUERY_RUN"], rapid[0], "__rapid", peers)
    out = prior_by_user(out, ["DATA_EXPORT_CSV", "DATA_EXPORT_EXCEL"], exports[0], "__exports", peers)
    out = prior_anywhere(out, "LOGIN_FAILED", failed[0], "__failed", peers)
    flags = F.array(
        F.when(bulk_export(F.col("rows_affected")), "BULK_EXPORT"),
        F.when(off_hours(F.col("ts")), "OFF_HOURS"),
        F.when(F.col("__rapid") > rapid[1], "RAPID_QUERIES"),
        F.when(F.col("__failed") > failed[1], "FAILED_AUTH_SPIKE"),
        F.when(F.col("__exports") > exports[1], "EXCESSIVE_EXPORT"),
    )
    return out.withColumn("flags", F.filter(flags, lambda x: x.isNotNull())).drop("__rapid", "__failed", "__exports")


def prior_in_history(log: DataFrame, action: str, seconds: float, cap: int = 199) -> DataFrame:
    """(seq, n): events of that action among the last `cap` before each event that are in the window; sequence numbers have no gaps.

    The cap bounds partners: both sides are dealt by ranges of `cap` numbers, which makes it an equi-join.
    """
    e = log.select("seq", "ts", F.floor(F.col("seq") / cap).alias("part"))
    h = log.filter(F.col("action") == action).select(F.col("seq").alias("h_seq"), F.col("ts").alias("h_ts"), F.explode(F.array(F.floor(F.col("seq") / cap), F.floor(F.col("seq") / cap) + 1)).alias("part"))
    near = F.col("h_seq").between(F.col("seq") - cap, F.col("seq") - 1) & (micros(F.col("h_ts")) >= micros(F.col("ts")) - int(seconds * 1e6))
    met = e.join(h, "part", "left").withColumn("hit", F.coalesce(near, F.lit(False)))
    return met.groupBy("seq").agg(F.count_if("hit").alias("n"))
