"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The logical tables in SQL, for the equivalents.
LOGICAL_SQL = {
    "acceptances": """acceptances AS (SELECT o_orderkey AS Id, o_custkey AS PatientId, l_suppkey AS UnitId, l_partkey AS DiagnosisId,
        CAST(o_orderdate AS DATE) AS AcceptanceDate, CAST(l_shipdate AS DATE) AS DischargeDate, o_orderstatus AS Status,
        date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS LengthOfStay
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate)""",
    "units": "units AS (SELECT s_suppkey AS Id, s_name AS Name, s_nationkey AS DepartmentId, s_suppkey % 20 + 10 AS Capacity FROM supplier)",
    "departments": "departments AS (SELECT n_nationkey AS Id, n_name AS Name, n_regionkey AS HospitalId FROM nation)",
    "audit": """audit AS (SELECT event_id AS seq, user_id, ts, CASE event_type WHEN 'view' THEN 'QUERY_RUN' WHEN 'purchase' THEN 'DATA_EXPORT_CSV'
        WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'click' THEN 'DATA_VIEW' ELSE 'LOGIN' END AS action, CAST(floor(value * 10) AS BIGINT) AS rows_affected FROM events)""",
    "licenses": """licenses AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'trial' WHEN 2 THEN 'grace' WHEN 3 THEN 'suspended' ELSE 'expired' END AS status,
        CASE c_custkey % 4 WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' WHEN 2 THEN 'enterprise' ELSE 'system' END AS tier,
        CASE WHEN c_custkey % 2 = 0 THEN 'monthly' ELSE 'annual' END AS cycle FROM customer)""",
}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Registers a query; `uses` names the logical tables that the SQL reads."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            names = uses.split()
            body = sql.strip()
            if names:
                ctes = ", ".join(LOGICAL_SQL[n] for n in names)
                body = f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
            ORACLE[name] = body
        return f

    return add


def delegated(name: str, sql: str) -> None:
    """A statement that both engines run as it is: the product's pass-through of SQL text."""

    def run(spark, sf_dir):
        from wardlight.engine.catalog import TABLES, table
        from wardlight.engine.guard import check

        check(spark, sql)
        for t in TABLES:
            if t in sql:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    run.__name__ = name
    query(name, sql)(run)
