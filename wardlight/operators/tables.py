"""Merging, retention, paging and ranking of stored records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.engine.session import shared_folder, stored

# Days that each store keeps its records.
RETENTION_DAYS = {"charts": 90, "dashboards": 90, "comments": 180, "notifications": 30, "alerts": 365, "reports": 365}


def local_first(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """All local rows, and remote rows whose key is not local."""
    return local.unionByName(remote.join(local.select(key), key, "left_anti"), allowMissingColumns=True)


def numbered(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """df with row numbers from 0 in that order, without a task for all rows: a row's number is that in its part of the sorted table, after all earlier parts.

    The sorted table must stand still between counting and numbering; without a shared folder for it, one window numbers all rows.
    """
    if not shared_folder(df.sparkSession):
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    rows = stored(df.orderBy(*order).withColumn("__row", F.monotonically_increasing_id()), "numbered")
    part, begins, after = F.shiftright("__row", 33), [], 0
    for p, n in sorted(tuple(r) for r in rows.groupBy(part).agg(F.count("*")).collect()):  # a row for each part
        begins += [F.lit(p), F.lit(after)]
        after += n
    first = F.element_at(F.create_map(*begins), part) if begins else F.lit(0)
    return rows.withColumn(name, (first + F.col("__row").bitwiseAND((1 << 33) - 1)).cast("long")).drop("__row")


def in_order(first: DataFrame, second: DataFrame, key: str, order: str = "position") -> DataFrame:
    """Rows of both (with a position) and only the first's where keys are equal: all of the first in their order, then what is new in the second."""
    rest = second.join(first.select(key), key, "left_anti")
    both = first.withColumn("source", F.lit(0)).unionByName(rest.withColumn("source", F.lit(1)), allowMissingColumns=True)
    return numbered(both, ["source", order, key], "__at").withColumn(order, F.col("__at")).drop("__at", "source")


def upsert_in_place(old: DataFrame, new: DataFrame, key: str, order: str = "position", prepend: bool = True) -> DataFrame:
    """New rows take the place of stored ones of the same key; others come before all stored rows, or after them."""
    places = old.select(key, F.col(order).alias("__old"))
    known = new.drop(order).join(places, key, "left")
    added = F.lit(-1 if prepend else 1)
    kept = old.join(new.select(key), key, "left_anti").withColumns({"__side": F.lit(0), "__old": F.col(order)}).drop(order)
    rows = known.withColumn("__side", F.when(F.col("__old").isNull(), added).otherwise(0)).unionByName(kept, allowMissingColumns=True)
    return numbered(rows, ["__side", "__old", key], order).drop("__side", "__old")


def lookup(df: DataFrame, key: str, value, order: list) -> DataFrame:
    """The first row with that key, or none."""
    return df.filter(F.col(key) == value).orderBy(*order).limit(1)


def sample_rows(df: DataFrame, order: list, most: int = 15) -> DataFrame:
    return df.orderBy(*order).limit(most)


def sorted_by(df: DataFrame, column: str, descending: bool, key: str) -> DataFrame:
    """A list sorted by one of its headers; equal values by key."""
    return df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first(), key)


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, name: str = "latest") -> DataFrame:
    """left with the value of the key's last right row at or before its time (of equal times the greatest value), null without one.

    Both sides are dealt by key once and walked in order; no pair of rows is formed. A hot key's
    rows are one window, which spills but is not split.
    """
    a = left.withColumns({"__side": F.lit(1), "__value": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, F.col(at), F.col(value).alias("__value")).withColumn("__side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy(at, "__side", "__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.last("__value", ignorenulls=True).over(before)).filter("__side = 1").select(*left.columns, name)


def alert_errors(name: Column, value: Column, channels: Column) -> Column:
    """What an alert form lacks."""
    number = F.trim(value).try_cast("double").isNotNull()
    return _missing({"name": F.trim(name) == "", "value": ~F.coalesce(number, F.lit(False)), "channels": F.size(channels) == 0})


def report_errors(name: Column, dashboards: Column, deliveries: Column, email: Column) -> Column:
    """What a report form lacks."""
    return _missing({"name": F.trim(name) == "", "dashboards": F.size(dashboards) == 0, "deliveries": F.size(deliveries) == 0, "email": F.array_contains(deliveries, "Email") & (F.trim(email) == "")})


def _missing(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), field) for field, bad in rules.items()]))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key or are added."""
    return local_first(new, old, key)


def merge_fields(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Field by field: a non-null value of the patch wins; keys only in the patch are added."""
    s, p = old.alias("s"), patch.alias("p")
    columns = [F.coalesce(f"p.{c}", f"s.{c}").alias(c) if c in patch.columns else F.col(f"s.{c}") for c in old.columns]
    return s.join(p, F.col(f"s.{key}") == F.col(f"p.{key}"), "full").select(columns)


def expired(updated: Column, created: Column, days: Column, now: Column) -> Column:
    """Older than so many days (exactly that old is kept); records without any time are kept."""
    age = F.unix_micros(now) - F.unix_micros(F.coalesce(updated, created).cast("timestamp"))
    return F.coalesce(age > days * 86_400_000_000, F.lit(False))


def purge(records: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, numbers purged by store) of records (store, updated_at, created_at, ...)."""
    days = F.create_map(*[F.lit(x) for kv in RETENTION_DAYS.items() for x in kv])[F.col("store")]
    gone = F.coalesce(expired(F.col("updated_at"), F.col("created_at"), days, now), F.lit(False))
    marked = records.withColumn("__gone", gone)
    return marked.filter(~F.col("__gone")).drop("__gone"), marked.groupBy("store").agg(F.count_if("__gone").alias("purged"))


def page(df: DataFrame, order: list[Column], number: int, size: int = 50) -> DataFrame:
    """Page `number` (from 1): a sorted limit, so tasks keep only what the pages so far hold."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def renumber(df: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def relevance(messages: DataFrame, tables: list[tuple[str, list[str]]], most: int = 4, primary: str | None = None) -> DataFrame:
    """(message columns, table, score, rank): tables by the number of their keywords that the message contains.

    Equal scores keep the declared order. A primary table that is not among the first is put before
    them and the last goes. The tables are a short fixed list, so the score is an array expression:
    no join at all.
    """
    low = F.lower("message")
    score = lambda words: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words], F.lit(0))
    scored = F.array(*[F.struct((-score(words)).alias("minus"), F.lit(i).alias("declared"), F.lit(name).alias("table")) for i, (name, words) in enumerate(tables)])
    ranked = F.slice(F.array_sort(scored), 1, most)
    if primary:
        own = F.filter(scored, lambda x: x["table"] == primary)
        ranked = F.when(F.exists(ranked, lambda x: x["table"] == primary), ranked).otherwise(F.concat(own, F.slice(ranked, 1, most - 1)))
    out = messages.select("*", F.posexplode(ranked).alias("rank", "x"))
    return out.select(*messages.columns, (F.col("rank") + 1).alias("rank"), F.col("x.table").alias("table"), (-F.col("x.minus")).alias("score"))


def license_active(status: Column, grace_end: Column, now: Column) -> Column:
    return status.isin("active", "trial") | ((status == "grace") & F.coalesce(grace_end > now, F.lit(False)))


def access_decision(licenses: DataFrame, now: Column) -> DataFrame:
    """One row: has_active, has_grace, and allow, warn or suspend."""
    d = licenses.agg(
        F.coalesce(F.bool_or(F.col("status").isin("active", "trial")), F.lit(False)).alias("has_active"),
        F.coalesce(F.bool_or((F.col("status") == "grace") & license_active(F.col("status"), F.col("grace_end"), now)), F.lit(False)).alias("has_grace"),
    )
    return d.withColumn("decision", F.when(F.col("has_active"), "allow").when(F.col("has_grace"), "warn").otherwise("suspend"))


# Prices of the tiers (annual, monthly).
PRICES = {"starter": (30000, 2750), "growth": (60000, 5500), "enterprise": (96000, 8800), "system": (0, 0)}


def revenue(licenses: DataFrame) -> DataFrame:
    """One row: mrr and acv over active and grace licences."""
    spark = licenses.sparkSession
    prices = F.broadcast(spark.createDataFrame([(t, a, m) for t, (a, m) in PRICES.items()], "tier string, annual int, monthly int"))
    live = licenses.filter(F.col("status").isin("active", "grace")).join(prices, "tier")
    monthly = F.col("cycle") == "monthly"
    return live.agg(
        F.sum(F.when(monthly, F.col("monthly")).otherwise(F.col("annual") / 12)).alias("mrr"),
        F.sum(F.when(monthly, F.col("monthly") * 12).otherwise(F.col("annual"))).cast("double").alias("acv"),
    )
