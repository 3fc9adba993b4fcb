"""The eleven question templates over the logical tables; `as_of` is the day that counts as today."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlight.engine import catalog as c

AS_OF = "2001-07-18"


def _day(as_of: str):
    return F.to_date(F.lit(as_of))


def _with_unit(spark, d) -> DataFrame:
    u = c.units(spark, d).select(F.col("Id").alias("UnitId"), F.col("Name").alias("unit"), "DepartmentId", "Capacity")
    return c.acceptances(spark, d).join(u, "UnitId")


def _with_department(spark, d) -> DataFrame:
    dep = c.departments(spark, d).select(F.col("Id").alias("DepartmentId"), F.col("Name").alias("department"))
    return _with_unit(spark, d).join(dep, "DepartmentId")


def patients_by_unit(spark: SparkSession, d: str) -> DataFrame:
    return _with_department(spark, d).groupBy("department", "unit").agg(F.countDistinct("PatientId").alias("patients"))


def admissions_per_day(spark, d, as_of: str = AS_OF) -> DataFrame:
    day = _day(as_of)
    a = c.acceptances(spark, d).filter((F.col("AcceptanceDate") >= F.trunc(day, "month")) & (F.col("AcceptanceDate") <= day))
    return a.groupBy(F.col("AcceptanceDate").alias("day")).agg(F.countDistinct("Id").alias("admissions"))


def discharges_today(spark, d, as_of: str = AS_OF) -> DataFrame:
    return _with_unit(spark, d).filter(F.col("DischargeDate") == _day(as_of)).groupBy("unit").agg(F.count("*").alias("discharges"))


def readmission_rate(spark, d, as_of: str = AS_OF, months: int = 3, days: int = 30) -> DataFrame:
    """Share of the last months' stays that began within so many days of the patient's previous admission."""
    first = _with_department(spark, d).select("Id", "PatientId", "AcceptanceDate", "department").distinct()
    visits = first.select("Id", "PatientId", "AcceptanceDate").distinct()
    before = F.lag("AcceptanceDate").over(Window.partitionBy("PatientId").orderBy("AcceptanceDate", "Id"))
    visits = visits.withColumn("again", F.coalesce(F.datediff("AcceptanceDate", before) <= days, F.lit(False))).select("Id", "again")
    recent = first.filter(F.col("AcceptanceDate").between(F.add_months(_day(as_of), -months), _day(as_of)))
    return recent.join(visits, "Id").groupBy("department").agg((F.count_if("again") / F.count("*")).alias("rate"), F.count("*").alias("stays"))


def average_stay_by_unit(spark, d, as_of: str = AS_OF) -> DataFrame:
    recent = _with_unit(spark, d).filter(F.col("AcceptanceDate").between(F.date_sub(_day(as_of), 30), _day(as_of)))
    return recent.groupBy("unit").agg((F.sum("LengthOfStay") / F.count("*")).alias("avg_stay"))


def top_diagnoses(spark, d, as_of: str = AS_OF, n: int = 10) -> DataFrame:
    code = c.diagnoses(spark, d).select(F.col("Id").alias("DiagnosisId"), F.col("ICD10Code").alias("code"))
    month = c.acceptances(spark, d).filter((F.col("AcceptanceDate") >= F.trunc(_day(as_of), "month")) & (F.col("AcceptanceDate") <= _day(as_of)))
    counted = month.join(code, "DiagnosisId").groupBy("code").agg(F.countDistinct("PatientId").alias("patients"))
    return counted.orderBy(F.col("patients").desc(), "code").limit(n)


def vitals_by_unit(spark, d, as_of: str = "2024-01-15") -> DataFrame:
    """Average reading of the week so far; a patient's readings count for the unit numbered like the patient."""
    week = c.vital_signs(spark, d).filter((F.to_date("RecordedAt") >= F.trunc(_day(as_of), "week")) & (F.to_date("RecordedAt") <= _day(as_of)))
    u = c.units(spark, d).select(F.col("Id").alias("PatientId"), F.col("Name").alias("unit"))
    return week.join(u, "PatientId").groupBy("unit").agg((F.sum(F.col("HeartRate").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("avg_reading"))


def occupancy_by_week(spark, d, as_of: str = AS_OF) -> DataFrame:
    """Stays open in this and in the last week, per hundred beds."""
    this = F.trunc(_day(as_of), "week")
    open_in = lambda start: (F.col("AcceptanceDate") < F.date_add(start, 7)) & (F.col("DischargeDate") >= start)
    out = _with_unit(spark, d).groupBy("unit", "Capacity").agg(F.count_if(open_in(this)).alias("this_week"), F.count_if(open_in(F.date_sub(this, 7))).alias("last_week"))
    return out.select("unit", (100 * F.col("this_week") / F.col("Capacity")).alias("this_week"), (100 * F.col("last_week") / F.col("Capacity")).alias("last_week"))


def patients_per_doctor(spark, d, as_of: str = AS_OF) -> DataFrame:
    recent = c.acceptances(spark, d).filter(F.col("AcceptanceDate").between(F.date_sub(_day(as_of), 30), _day(as_of)))
    return recent.groupBy(F.col("UnitId").alias("doctor")).agg(F.countDistinct("PatientId").alias("patients"))


def monthly_trend(spark, d, as_of: str = AS_OF) -> DataFrame:
    start = F.add_months(F.trunc(_day(as_of), "month"), -11)
    a = c.acceptances(spark, d).filter((F.col("AcceptanceDate") >= start) & (F.col("AcceptanceDate") <= _day(as_of)))
    by = a.groupBy(F.trunc("AcceptanceDate", "month").alias("month")).agg(F.countDistinct("Id").alias("admissions"))
    return by.withColumn("change", F.col("admissions") - F.lag("admissions").over(Window.orderBy("month")))  # twelve rows


def stay_by_department(spark, d, as_of: str = AS_OF) -> DataFrame:
    q = _with_department(spark, d).filter((F.col("AcceptanceDate") >= F.trunc(_day(as_of), "quarter")) & (F.col("AcceptanceDate") <= _day(as_of)))
    out = q.groupBy("department").agg((F.sum("LengthOfStay") / F.count("*")).alias("avg_stay"))
    return out.withColumn("place", F.rank().over(Window.orderBy(F.col("avg_stay").desc())).cast("long"))  # a row for each department
