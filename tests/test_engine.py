import json

import pytest
from pyspark.sql import functions as F

from wardlight.engine import catalog, dialect, guard, runner
from wardlight.functions import scalars as s
from wardlight.operators import audit, charts, privacy, tables
from wardlight.sources import stores
from wardlight.streaming import stateful

ALLOWED = ["SELECT 1", "VALUES (1)", "/* x */ WITH a AS (SELECT 1 AS x) SELECT * FROM a", "SELECT (SELECT max(id) FROM range(3))"]
REFUSED = [
    "INSERT INTO t VALUES (1)",
    "DROP TABLE t",
    "-- x\nDELETE FROM t",
    "UPDATE t SET a = 1",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
    "CALL p()",
    "SET x = 1",
    "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT 1 WHERE 1 IN (SELECT java_method('java.lang.Math', 'abs', 1))",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_queries_pass(spark, sql):
    guard.check(spark, sql)


@pytest.mark.parametrize("sql", REFUSED)
def test_writes_and_escapes_are_refused(spark, sql):
    with pytest.raises(guard.Refused) as e:
        guard.check(spark, sql)
    assert e.value.status == 403


def test_blank_and_several_statements(spark):
    with pytest.raises(guard.Refused) as e:
        guard.check(spark, "  ")
    assert e.value.status == 400
    with pytest.raises(Exception):
        guard.check(spark, "SELECT 1; DROP TABLE t")


def test_run_caps_rows_and_keeps_the_last_of_equal_names(spark):
    r = runner.run_sql(spark, "SELECT id AS a, id + 1 AS a FROM range(2000)")
    assert r.row_count == 1000 and r.rows[0]["a"] == r.rows[0]["a"] and [c["key"] for c in r.columns] == ["a"]
    assert runner.run_sql(spark, "SELECT 1 AS a, 2 AS a").rows == [{"a": 2}]
    assert runner.run_sql(spark, "SELECT id FROM range(50)", 7).row_count == 7


def test_dialect():
    assert "'yyyy-MM-dd'" in dialect.translate("SELECT to_char(d, 'YYYY-MM-DD')")
    assert dialect.flat_names('SELECT a.b FROM main."Shared"."Patients" JOIN x ON 1 = 1') == "SELECT a.b FROM main_shared_patients JOIN x ON 1 = 1"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def java_hash(text):
    h = 0
    for ch in text:
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_hashes_match_independent_versions(spark):
    words = ["", "a", "patient-17", "Zürich", "x" * 60]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", s.hash31(F.col("w")).alias("h"), s.cache_key(F.col("w")).alias("k"), s.patient_token(F.col("w")).alias("t")).collect()
    for r in rows:
        assert r.h == java_hash(r.w)
        k = 5381
        for ch in r.w:
            k = (k * 33 & 0xFFFFFFFF) ^ ord(ch)
        digits, n = "", k
        while n:
            digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
        assert r.k == (digits or "0")
        assert r.t == f"PT-{abs(r.h):08X}"
    assert one(spark, s.patient_token(F.lit(None).cast("string"))) == "[REDACTED]"


def test_avatar_color_against_an_independent_version(spark):
    for name in ("ann", "Bob Miller", "z" * 40):
        h = 0
        for ch in name:
            shifted = (h << 5) & 0xFFFFFFFF
            shifted = shifted - (1 << 32) if shifted >= 1 << 31 else shifted
            h = ord(ch) + shifted - h
        assert one(spark, s.avatar_color(F.lit(name))) == s.PALETTE[abs(h) % 8]


def test_numbers_and_labels(spark):
    for text, value in (("12.5abc", 12.5), ("abc", 0.0), (" -3e2x", -300.0), (".5", 0.5)):
        assert one(spark, s.leading_number(F.lit(text))) == value
    for x, label in ((999.0, "999"), (1000.0, "1.0K"), (1_000_000.0, "1.0M")):
        assert one(spark, s.abbreviate_number(F.lit(x))) == label
    assert one(spark, s.query_label(F.lit("a" * 41))) == "a" * 40 + "…"
    assert one(spark, s.slug(F.lit(" Dr. Ann  O'Neil! "))) == "dr-ann-o-neil"
    assert one(spark, s.mentions(F.lit("@Ann hi @bob_1 @Ann"))) == ["ann", "bob_1", "ann"]


def ts(text):
    return F.lit(text).cast("timestamp")


def test_off_hours_and_bulk_bounds(spark):
    for t, flagged in (("2024-01-01 03:59", True), ("2024-01-01 04:00", False), ("2024-01-01 19:59", False), ("2024-01-01 20:00", True)):
        assert one(spark, audit.off_hours(ts(t))) is flagged
    assert [one(spark, audit.bulk_export(F.lit(n))) for n in (1000, 1001)] == [False, True]
    assert one(spark, audit.bulk_export(F.lit(None).cast("int"))) is False


def log(spark, rows):
    return spark.createDataFrame(rows, "seq long, user_id long, t string, action string, rows_affected long").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")


def test_thresholds_are_strict_and_windows_inclusive(spark):
    rows = [(i, 1, "2024-01-01 10:00:00", "QUERY_RUN", 0) for i in range(10)] + [(10, 1, "2024-01-01 10:01:00", "QUERY_RUN", 0), (11, 1, "2024-01-01 10:01:00", "QUERY_RUN", 0), (12, 1, "2024-01-01 10:01:00.000001", "QUERY_RUN", 0)]
    got = {r.seq: r["flags"] for r in audit.anomalies(log(spark, rows)).collect()}
    assert got[10] == [] and got[11] == ["RAPID_QUERIES"] and got[12] == []


def test_failed_logins_count_any_user(spark):
    rows = [(i, i, f"2024-01-01 10:0{i}:00", "LOGIN_FAILED", 0) for i in range(6)] + [(6, 9, "2024-01-01 10:10:00", "DATA_VIEW", 0), (7, 9, "2024-01-01 10:10:01", "DATA_VIEW", 0)]
    got = {r.seq: r["flags"] for r in audit.anomalies(log(spark, rows)).collect()}
    assert got[6] == ["FAILED_AUTH_SPIKE"] and got[7] == [] and got[5] == []


def test_window_queries_count_events_of_the_same_instant_as_their_sql(spark, tmp_path):
    import duckdb

    from wardlight.engine.catalog import ACTIONS
    from wardlight.plans.catalog import ORACLE, QUERIES

    kinds = list(ACTIONS)
    hours = (0.0, 0.0, 0.5, 1.0, 1.0, 1.5, 2.0, 2.0, 3.0001, 3.0001, 30.0)
    rows = [(i, i % 2, 3600 * hours[i // 6], kinds[i % len(kinds)], 7.5) for i in range(6 * len(hours))] + [(900, 1, None, k, None) for k in kinds] + [(None, None, 0.0, k, 1.0) for k in kinds]
    events = spark.createDataFrame(rows, "event_id long, user_id long, t double, event_type string, value double")
    events = events.selectExpr("event_id", "cast(timestamp_micros(cast(t * 1000000 as bigint)) as timestamp_ntz) as ts", "user_id", "event_type", "value", "cast(null as string) as props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("W2", "W3", "W4", "W7"):
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()), key=key) == sorted(sql.execute(ORACLE[name]).fetchall(), key=key), name


@pytest.mark.parametrize("bad", [0, 7, 19])
def test_chain_finds_the_first_bad_line(spark, bad):
    lines = audit.chain([{"id": i, "action": "LOGIN", "detail": None if i % 2 else 'a "b" é'} for i in range(20)])
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "pos long, line string")
    assert tuple(audit.verify(frame(lines), segment=6).first()) == (True, None, 20)
    broken = [x.replace("LOGIN", "LOGOUT") if i == bad else x for i, x in enumerate(lines)]
    assert tuple(audit.verify(frame(broken), segment=6).first()) == (False, bad + 1, 20)
    assert audit.verify(frame(lines[:3] + ["not json"] + lines[3:])).first().tampered_at == 4
    if 0 < bad < 19:
        assert audit.verify(frame(lines[:bad] + lines[bad + 1 :])).first().tampered_at == bad + 1


def test_empty_log_is_valid(spark):
    assert audit.verify(spark.createDataFrame([], "pos long, line string")).first().valid


def test_retention_bounds(spark):
    now = ts("2024-04-01")
    for created, gone in (("2024-03-02 00:00:00", False), ("2024-03-01 23:59:59.999", True), (None, False)):
        assert one(spark, tables.expired(F.lit(None).cast("timestamp"), ts(created), F.lit(30), now)) is gone


def test_licence_grace_is_strict(spark):
    assert one(spark, tables.license_active(F.lit("grace"), ts("2024-01-01"), ts("2024-01-01"))) is False
    assert one(spark, tables.license_active(F.lit("trial"), ts(None), ts("2024-01-01"))) is True


def test_scrub(spark):
    rows = spark.createDataFrame([(1, "Ann", "12345678901", "x@y.z", "01234567890", "k"), (2, "Bob", None, None, " 12345678901", None), (3, "Ann", "5", "1", "1", "k")], "n int, name string, `Patient-ID` string, email string, note string, `name x` string")
    got = privacy.scrub(rows, ["n"]).orderBy("n").collect()
    assert [r["name"] for r in got] == ["Patient-A", "Patient-B", "Patient-A"]
    assert got[1]["Patient-ID"] == "[REDACTED]" and got[0]["Patient-ID"].startswith("PT-")
    assert [r["note"] for r in got] == ["01234567890", "[NATIONAL ID REDACTED]", "1"]
    assert got[0]["email"] == "[PHI REDACTED]"


def test_charts(spark):
    data = spark.createDataFrame([("ICU", 412), ("ED", 200), ("NICU", 85)], "unit string, count int")
    assert charts.big_number(data).first().total == 697
    assert sorted(r.text for r in charts.shares(data, "unit", "count").collect()) == ["ED 29%", "ICU 59%", "NICU 12%"]
    assert charts.suggest(catalog.column_kinds(data.schema)) == "bar"
    assert charts.toggled_role(charts.toggled_role(None, "numeric"), "numeric") == "dimension"


def test_csv_and_xlsx(spark):
    df = spark.createDataFrame([('a"b', 1), (None, None)], "t string, n int")
    assert stores.csv_text(df) == '"t","n"\n"a""b","1"\n"",""'
    assert stores.xlsx_bytes(df)[:2] == b"PK"


def test_encoded_values(spark):
    df = spark.range(1).select(F.struct(F.lit("é 1").alias("a")).alias("v"))
    encoded = df.select(stores.encode_value(F.col("v")).alias("e"))
    assert encoded.select(stores.decode_value(F.col("e"), "a string").alias("v")).first().v.a == "é 1"
    key = F.lit("0123456789abcdef")
    assert one(spark, stores.decrypt(stores.encrypt(F.lit("x"), key), key)) == "x"


def test_json_lines_skip_what_is_malformed(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id":"1"}\n\nnot json\n{"id":"2"}\n')
    assert sorted(r.id for r in stores.read_json_lines(spark, str(tmp_path / "log.jsonl")).collect()) == ["1", "2"]
    assert stores.read_json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_limiter_locks_after_five_failures_and_forgets_old_ones():
    failures, locked = [], 0
    for i in range(5):
        failures, locked, ok = stateful.limiter_step(failures, locked, i, "failure")
        assert ok
    failures, locked, ok = stateful.limiter_step(failures, locked, 10, "failure")
    assert not ok and locked == 10 + stateful.LOCK_MS
    assert stateful.limiter_step([0, 1, 2, 3, 4], 0, 600_000, "failure")[2]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("k", i * 1000, "failure") for i in range(7)], "key string, at_ms long, kind string").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("key string, at_ms long, kind string").json(str(source))
    q = stateful.login_limiter(stream).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    assert q.awaitTermination(120)
    assert [r.allowed for r in spark.table("limited").orderBy("at_ms").collect()] == [True] * 5 + [False] * 2


def test_cooldown(spark):
    hits = spark.createDataFrame([("a", f"2024-01-01 0{h}:00:00", 4) for h in (0, 1, 4, 7, 8)], "name string, t string, hours int").select("name", F.col("t").cast("timestamp").alias("at"), "hours")
    assert [r.at.hour for r in stateful.cool_down(hits).orderBy("at").collect()] == [0, 4, 8]


def test_billing(spark):
    licenses = spark.createDataFrame([("a", "active"), ("b", "grace"), ("c", "active")], "customer string, status string").withColumn("grace_end", F.lit(None).cast("timestamp"))
    events = spark.createDataFrame([("a", "payment_failed", 1), ("b", "payment_succeeded", 1), ("d", "checkout_completed", 1), ("e", "payment_failed", 1), ("a", "invoice_seen", 2)], "customer string, type string, seq int").withColumn("at", ts("2024-01-01"))
    got = {r.customer: (r.status, str(r.grace_end)) for r in stateful.apply_billing(licenses, events).collect()}
    assert got == {"a": ("grace", "2024-01-08 00:00:00"), "b": ("active", "None"), "c": ("active", "None"), "d": ("active", "None")}


def test_json_of_chain_is_json():
    assert json.loads(audit.chain([{"id": 1}])[0])["previousHash"] == audit.GENESIS
