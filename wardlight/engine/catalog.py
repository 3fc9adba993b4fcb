"""Logical clinical tables over the driver's star schema, and metadata of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# How event types stand for audited actions.
ACTIONS = {"view": "QUERY_RUN", "purchase": "DATA_EXPORT_CSV", "error": "LOGIN_FAILED", "click": "DATA_VIEW", "signup": "LOGIN"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    """The physical tables and the logical ones as views of the session."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, make in LOGICAL.items():
        make(spark, sf_dir).createOrReplaceTempView(name)


def hospitals(spark, d) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_regionkey").alias("Id"), F.col("r_name").alias("HospitalName"))


def departments(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("Id"), F.col("n_name").alias("Name"), F.col("n_regionkey").alias("HospitalId"))


def units(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("Id"), F.col("s_name").alias("Name"), F.col("s_nationkey").alias("DepartmentId"), (F.col("s_suppkey") % 20 + 10).alias("Capacity"))


def patients(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("Id"), F.col("c_name").alias("Name"), F.col("c_nationkey").alias("Nationality"), F.col("c_mktsegment").alias("Segment"))


def diagnoses(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("Id"), F.col("p_brand").alias("ICD10Code"), F.col("p_type").alias("Category"))


def acceptances(spark, d) -> DataFrame:
    """Stays; those that would end before they begin are left out."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    joined = line.join(o, line.l_orderkey == o.o_orderkey).filter("l_shipdate >= o_orderdate")
    return joined.select(
        F.col("o_orderkey").alias("Id"),
        F.col("o_custkey").alias("PatientId"),
        F.col("l_suppkey").alias("UnitId"),
        F.col("l_partkey").alias("DiagnosisId"),
        F.to_date("o_orderdate").alias("AcceptanceDate"),
        F.to_date("l_shipdate").alias("DischargeDate"),
        F.col("o_orderstatus").alias("Status"),
        F.datediff("l_shipdate", "o_orderdate").alias("LengthOfStay"),
    )


def vital_signs(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("PatientId"), F.col("ts").alias("RecordedAt"), F.col("value").alias("HeartRate"))


def audit(spark, d) -> DataFrame:
    """The audit log: seq, user_id, ts, action, rows_affected."""
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), "user_id", "ts", action[F.col("event_type")].alias("action"), F.floor(F.col("value") * 10).cast("long").alias("rows_affected"))


LOGICAL = {f.__name__: f for f in (hospitals, departments, units, patients, diagnoses, acceptances, vital_signs, audit)}


def column_kinds(schema: T.StructType) -> list[tuple[str, str]]:
    """(column, text | numeric | date): the roles a chart builder offers."""
    kinds = lambda t: "numeric" if isinstance(t, T.NumericType) else "date" if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else "text"
    return [(f.name, kinds(f.dataType)) for f in schema]


def schema_text(schema: T.StructType, name: str) -> str:
    return f"{name}({', '.join(f.name for f in schema)})"
