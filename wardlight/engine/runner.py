"""Guarded SQL with a row cap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wardlight.engine.dialect import translate
from wardlight.engine.guard import check

DEFAULT_ROWS = 1000


@dataclass
class Result:
    columns: list[dict]
    rows: list[dict]
    row_count: int


def keep_last_of_equal_names(df: DataFrame) -> DataFrame:
    """Of columns with the same name, the last, at the place of the first."""
    last = {name: i for i, name in enumerate(df.columns)}
    if len(last) == len(df.columns):
        return df
    unique = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return unique.select(*[unique[f"c{i}"].alias(name) for name, i in last.items()])


def query(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """The checked statement as a frame of at most `limit` rows (none or 0: the default)."""
    sql = translate(sql)
    check(spark, sql)
    return keep_last_of_equal_names(spark.sql(sql)).limit(limit or DEFAULT_ROWS)


def run_sql(spark: SparkSession, sql: str, limit: int | None = None) -> Result:
    df = query(spark, sql, limit)
    rows = [r.asDict(recursive=True) for r in df.collect()]
    columns = [{"key": f.name, "label": f.name, "type": f.dataType.simpleString()} for f in df.schema]
    return Result(columns, rows, len(rows))


def pages(df: DataFrame, size: int = 1000):
    """The rows in lists of `size`; the driver holds one partition at a time."""
    page = []
    for row in df.toLocalIterator():
        page.append(row.asDict(recursive=True))
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page
