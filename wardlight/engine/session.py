"""Spark session settings that the engine relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",
}


def build_session(name: str = "wardlight", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, if the session names one."""
    return spark.conf.get("spark.checkpoint.dir", None)


def stored(df: DataFrame, kind: str = "step") -> DataFrame:
    """df as a table in the shared folder; where spark.checkpoint.dir is not set it stays as it is."""
    spark = df.sparkSession
    top = shared_folder(spark)
    if not top:
        return df
    path = f"{top.rstrip('/')}/wardlight-{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
