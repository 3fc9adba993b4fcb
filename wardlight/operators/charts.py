"""Chart and dashboard specifications as queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.scalars import leading_number


@dataclass
class Filter:
    column: str
    op: str
    value: object

    def condition(self) -> Column:
        c, v = F.col(self.column), self.value
        if self.op == "IN":
            return c.isin([x.strip() for x in v.split(",")] if isinstance(v, str) else list(v))
        if self.op == "LIKE":
            return c.like(v)
        return {"=": c == v, "!=": c != v, ">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v}[self.op]


@dataclass
class Chart:
    """Groups by the dimensions and adds up the metrics; filters of the chart and of its dashboard apply first."""

    metrics: list[str]
    dimensions: list[str]
    filters: list[Filter] = field(default_factory=list)

    def query(self, data: DataFrame, dashboard: list[Filter] = ()) -> DataFrame:
        for f in [*self.filters, *(f for f in dashboard if f.value is not None)]:
            data = data.filter(f.condition())
        return data.groupBy(*self.dimensions).agg(*[exact_sum(m).alias(f"sum_{m}") for m in self.metrics])


def exact_sum(column: str) -> Column:
    """Sum of two-digit decimals that doesn't depend on the order of addition."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def big_number(data: DataFrame, value: str | None = None) -> DataFrame:
    """One row: the sum of a column (the second by default); texts count as the number they begin with."""
    name = value or data.columns[min(1, len(data.columns) - 1)]
    column = F.col(name)
    number = F.coalesce(column.cast("double"), F.lit(0.0)) if isinstance(data.schema[name].dataType, T.NumericType) else F.coalesce(leading_number(column.cast("string")), F.lit(0.0))
    return data.agg(F.coalesce(F.sum(number), F.lit(0.0)).alias("total"))


def shares(grouped: DataFrame, label: str, value: str) -> DataFrame:
    """(label, share, text) of a grouped result: the share of the total, and its pie label. The total is one row."""
    total = F.broadcast(grouped.agg(F.sum(value).alias("__total")))
    out = grouped.crossJoin(total).withColumn("share", F.col(value) / F.col("__total"))
    return out.select(label, "share", F.concat(F.col(label), F.lit(" "), F.round(F.col("share") * 100, 0).cast("int").cast("string"), F.lit("%")).alias("text"))


def pivot(data: DataFrame, rows: str, columns: str, values: list, metric: str) -> DataFrame:
    return data.groupBy(rows).pivot(columns, values).agg(F.count(metric))


def suggest(kinds: list[tuple[str, str]]) -> str:
    """A chart type by rule from (column, kind)."""
    found = [k for _, k in kinds]
    if found == ["numeric"]:
        return "bigNumber"
    if "date" in found and "numeric" in found:
        return "line"
    return "bar" if "text" in found and "numeric" in found else "table"


def toggled_role(role: str | None, kind: str) -> str | None:
    return {None: "metric" if kind == "numeric" else "dimension", "metric": "dimension", "dimension": None}[role]


def alert_fires(metric: Column, op: Column, limit: Column) -> Column:
    return F.when(op == ">", metric > limit).when(op == "<", metric < limit).when(op == ">=", metric >= limit).when(op == "<=", metric <= limit).when(op == "==", metric == limit).otherwise(F.lit(False))


def evaluate_alerts(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """Active rules (name, metric, op, value, status) met by metrics (metric, at, reading); rules are few by nature."""
    met = metrics.join(F.broadcast(rules.filter("status = 'Active'")), "metric")
    return met.filter(alert_fires(F.col("reading"), F.col("op"), F.col("value")))


def axes(columns: list[str], x: str | None = None, y: str | None = None) -> tuple[str, str]:
    """The columns of the axes: those named, else the first and the second."""
    return x or columns[0], y or columns[min(1, len(columns) - 1)]


def of_category(items: DataFrame, category: str = "All") -> DataFrame:
    return items if category == "All" else items.filter(F.col("category") == category)


def of_dashboard(widgets: dict[str, DataFrame], filters: list[Filter]) -> dict[str, DataFrame]:
    """Every widget's data under the dashboard's filters, as far as it has their columns; filters without a value don't count."""
    out = {}
    for name, data in widgets.items():
        for f in filters:
            if f.value is not None and f.column in data.columns:
                data = data.filter(f.condition())
        out[name] = data
    return out


def clinical_readings(acceptances: DataFrame) -> DataFrame:
    """(at, metric, reading) by day of admission. An admission is one Id; status P counts as ventilated, F as a mortality flag.

    A readmission begins within 30 days of the same patient's previous admission.
    """
    visits = acceptances.groupBy("Id", "PatientId", "AcceptanceDate", "Status").agg(F.sum("LengthOfStay").alias("days"), F.count("*").alias("stays"))
    before = F.lag("AcceptanceDate").over(Window.partitionBy("PatientId").orderBy("AcceptanceDate", "Id"))
    visits = visits.withColumn("again", F.coalesce(F.datediff("AcceptanceDate", before) <= 30, F.lit(False)))
    n = F.count("*").cast("double")
    daily = visits.groupBy(F.col("AcceptanceDate").alias("at")).agg(
        n.alias("Daily Admissions"),
        (F.count_if("again") / n).alias("Readmission Rate"),
        F.count_if(F.col("Status") == "P").cast("double").alias("Ventilator Count"),
        F.count_if(F.col("Status") == "F").cast("double").alias("Mortality Flag Count"),
        (F.sum("days") / F.sum("stays")).alias("Average LOS (days)"),
    )
    return daily.unpivot("at", [c for c in daily.columns if c != "at"], "metric", "reading")


def occupancy(units: DataFrame, acceptances: DataFrame, day: str) -> DataFrame:
    """(unit, reading): stays open on that day per hundred beds, units without any included."""
    on = F.lit(day).cast("date")
    used = acceptances.filter((F.col("AcceptanceDate") <= on) & (F.col("DischargeDate") > on)).groupBy("UnitId").agg(F.count("*").alias("used"))
    met = units.join(used, F.col("Id") == F.col("UnitId"), "left")
    return met.select(F.col("Id").alias("unit"), (100.0 * F.coalesce("used", F.lit(0)) / F.col("Capacity")).alias("reading"))


def waiting_minutes(events: DataFrame, who: str, at: str, served: Column) -> DataFrame:
    """(at, reading): average minutes from a person's first event of the day to the first at which they are served."""
    day = events.groupBy(who, F.to_date(at).alias("at")).agg(F.min(at).alias("arrived"), F.min(F.when(served, F.col(at))).alias("served"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    waited = day.filter("served is not null").withColumn("us", micros("served") - micros("arrived"))
    return waited.groupBy("at").agg((F.sum("us").cast("double") / F.count("*") / 60_000_000).alias("reading"))
