"""T1 to T11."""

from __future__ import annotations

from wardlight.operators import templates as t
from wardlight.plans.registry import query

_unit = "JOIN units u ON u.Id = a.UnitId"
_dep = _unit + " JOIN departments d ON d.Id = u.DepartmentId"
DAY = f"DATE '{t.AS_OF}'"

query("T1", f"SELECT d.Name AS department, u.Name AS unit, count(DISTINCT PatientId) AS patients FROM acceptances a {_dep} GROUP BY 1, 2", "acceptances units departments")(t.patients_by_unit)
query("T2", f"SELECT AcceptanceDate AS day, count(DISTINCT Id) AS admissions FROM acceptances WHERE AcceptanceDate >= date_trunc('month', {DAY}) AND AcceptanceDate <= {DAY} GROUP BY 1", "acceptances")(t.admissions_per_day)
query("T3", f"SELECT u.Name AS unit, count(*) AS discharges FROM acceptances a {_unit} WHERE DischargeDate = {DAY} GROUP BY 1", "acceptances units")(t.discharges_today)
query(
    "T4",
    f"""WITH stays AS (SELECT DISTINCT a.Id, PatientId, AcceptanceDate, d.Name AS department FROM acceptances a {_dep}),
    visits AS (SELECT DISTINCT Id, PatientId, AcceptanceDate FROM stays),
    flagged AS (SELECT Id, coalesce(date_diff('day', lag(AcceptanceDate) OVER (PARTITION BY PatientId ORDER BY AcceptanceDate, Id), AcceptanceDate) <= 30, false) AS again FROM visits)
    SELECT department, CAST(sum(CASE WHEN again THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS rate, count(*) AS stays FROM stays JOIN flagged USING (Id)
    WHERE AcceptanceDate BETWEEN DATE '2001-04-18' AND {DAY} GROUP BY 1""",
    "acceptances units departments",
)(t.readmission_rate)
query("T5", f"SELECT u.Name AS unit, CAST(sum(LengthOfStay) AS DOUBLE) / count(*) AS avg_stay FROM acceptances a {_unit} WHERE AcceptanceDate BETWEEN DATE '2001-06-18' AND {DAY} GROUP BY 1", "acceptances units")(t.average_stay_by_unit)
query(
    "T6",
    f"""SELECT p_brand AS code, count(DISTINCT PatientId) AS patients FROM acceptances JOIN part ON p_partkey = DiagnosisId
    WHERE AcceptanceDate >= date_trunc('month', {DAY}) AND AcceptanceDate <= {DAY} GROUP BY 1 ORDER BY patients DESC, code LIMIT 10""",
    "acceptances",
)(t.top_diagnoses)
query(
    "T7",
    """SELECT s_name AS unit, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_reading FROM events JOIN supplier ON s_suppkey = user_id
    WHERE CAST(ts AS DATE) >= date_trunc('week', DATE '2024-01-15') AND CAST(ts AS DATE) <= DATE '2024-01-15' GROUP BY 1""",
)(t.vitals_by_unit)
query(
    "T8",
    f"""SELECT unit, 100.0 * n1 / Capacity AS this_week, 100.0 * n0 / Capacity AS last_week FROM (SELECT u.Name AS unit, CAST(Capacity AS DOUBLE) AS Capacity,
    CAST(sum(CASE WHEN AcceptanceDate < DATE '2001-07-23' AND DischargeDate >= DATE '2001-07-16' THEN 1 ELSE 0 END) AS DOUBLE) AS n1,
    CAST(sum(CASE WHEN AcceptanceDate < DATE '2001-07-16' AND DischargeDate >= DATE '2001-07-09' THEN 1 ELSE 0 END) AS DOUBLE) AS n0
    FROM acceptances a {_unit} GROUP BY 1, 2)""",
    "acceptances units",
)(t.occupancy_by_week)
query("T9", f"SELECT UnitId AS doctor, count(DISTINCT PatientId) AS patients FROM acceptances WHERE AcceptanceDate BETWEEN DATE '2001-06-18' AND {DAY} GROUP BY 1", "acceptances")(t.patients_per_doctor)
query(
    "T10",
    f"""WITH m AS (SELECT CAST(date_trunc('month', AcceptanceDate) AS DATE) AS month, count(DISTINCT Id) AS admissions FROM acceptances
    WHERE AcceptanceDate >= DATE '2000-08-01' AND AcceptanceDate <= {DAY} GROUP BY 1) SELECT month, admissions, admissions - lag(admissions) OVER (ORDER BY month) AS change FROM m""",
    "acceptances",
)(t.monthly_trend)
query(
    "T11",
    f"""WITH q AS (SELECT d.Name AS department, CAST(sum(LengthOfStay) AS DOUBLE) / count(*) AS avg_stay FROM acceptances a {_dep}
    WHERE AcceptanceDate >= DATE '2001-07-01' AND AcceptanceDate <= {DAY} GROUP BY 1) SELECT department, avg_stay, rank() OVER (ORDER BY avg_stay DESC) AS place FROM q""",
    "acceptances units departments",
)(t.stay_by_department)
