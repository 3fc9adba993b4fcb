"""Stores, logs, forms, tokens and running streams."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wardlight.engine import cache, dialect, runner
from wardlight.functions.sql_tokens import FUNCTIONS, KEYWORDS, sql_tokens
from wardlight.operators import audit, charts, privacy, tables
from wardlight.sources import stores
from wardlight.streaming import stateful


def test_numeric_national_ids_are_hidden(spark):
    n = 12345678901
    rows = spark.createDataFrame([(1, n, float(n), Decimal(n), None, "x"), (2, 7, 0.5, Decimal(8), 3, f" {n} ")], "k int, a long, b double, c decimal(20,0), d long, `o.p` string")
    out = privacy.scrub(rows, ["k"])
    hidden = "[NATIONAL ID REDACTED]"
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, hidden, hidden, hidden, None, "x"), (2, "7", "0.5", "8", "3", hidden)]
    report = privacy.scrub_report(rows).first()
    assert (report.values_replaced, report.rows_processed) == (4, 2)


def test_names_and_identifiers_share_tokens(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, None, "c"), (4, "c", None)], "k int, mrn string, name string")
    got = {r.k: (r.mrn, r.name) for r in privacy.scrub(rows, ["k"]).collect()}
    assert got[1][0].startswith("PT-") and got[1][1] == "Patient-A"
    assert got[2] == ("Patient-A", got[1][0]) and got[3] == ("[REDACTED]", "Patient-B") and got[4] == ("Patient-B", "[REDACTED]")


def test_letters_start_over_after_26(spark):
    rows = spark.createDataFrame([(k, f"n{k}") for k in range(60)], "k int, name string").repartition(4)
    got = {r.k: r.name for r in privacy.scrub(rows, ["k"]).collect()}
    assert [got[str(k)] if str(k) in got else got[k] for k in range(60)] == [f"Patient-{chr(65 + k % 26)}" for k in range(60)]


@pytest.mark.parametrize("shared", [True, False])
def test_numbers_follow_the_order(spark, shared, monkeypatch):
    if not shared:
        monkeypatch.setattr(tables, "shared_folder", lambda _: None)
    frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    got = tables.numbered(frame, [F.col("k").desc()]).collect()
    assert len(got) == 1000 and all(r.n == 999 - r.k for r in got)
    assert tables.numbered(frame.limit(0), ["k"]).count() == 0


def test_upserts_keep_their_places(spark):
    held = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("c", 3, 2)], "id string, v int, position long")
    new = spark.createDataFrame([("b", 9), ("z", 8)], "id string, v int")
    order = lambda df: [(r.id, r.v) for r in df.orderBy("position").collect()]
    assert order(tables.upsert_in_place(held, new, "id")) == [("z", 8), ("a", 1), ("b", 9), ("c", 3)]
    assert order(tables.upsert_in_place(held, new, "id", prepend=False)) == [("a", 1), ("b", 9), ("c", 3), ("z", 8)]


def test_audit_log_grows_and_stays_valid(spark, tmp_path):
    path = str(tmp_path / "log")
    assert audit.read_log(spark, path).count() == 0
    events = [{"id": k, "action": "QUERY_RUN"} for k in range(50)]
    for part in (events[:20], events[20:21], events[21:]):
        audit.append(spark, path, spark.createDataFrame([(e["id"], e["action"]) for e in part], "id long, action string"))
    log = audit.read_log(spark, path)
    assert [r.line for r in log.orderBy("pos").collect()] == audit.chain(events)
    assert tuple(audit.verify(log).first()) == (True, None, 50)


def test_anomaly_lines_are_added(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "2024-01-01 10:00:00", ["OFF_HOURS"]), (2, 5, "2024-01-01 10:00:00", [])], "seq long, user_id long, ts string, flags array<string>")
    for _ in range(2):
        audit.append_anomalies(rows, str(tmp_path / "a"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "a")).select("eventId", "flags").collect()] == [(1, ["OFF_HOURS"])] * 2


def test_tables_of_all_kinds(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "k long, t string")
    for kind in ("parquet", "orc", "json"):
        frame.write.format(kind).save(str(tmp_path / kind))
    stores.write_csv(frame, str(tmp_path / "csv"))
    for kind in ("parquet", "orc", "json", "csv"):
        got = stores.read_table(spark, str(tmp_path / kind), kind, "k long, t string").orderBy("k").collect()
        assert got[0].t == 'a "b", c' and (got[1].t or "") == "", kind
    with pytest.raises(ValueError):
        stores.read_table(spark, str(tmp_path / "csv"), "csv")
    with pytest.raises(ValueError):
        stores.read_table(spark, str(tmp_path), "xml")


def test_replacing_a_table_it_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    stores.replace_table(spark.range(3), path)
    stores.replace_table(spark.read.parquet(path).selectExpr("id + 10 as id"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    assert not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a failure between the moves leaves it
    stores.replace_table(spark.range(1), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [0]


def test_seeds_stand_in_for_a_missing_table_only(spark, tmp_path):
    path = str(tmp_path / "notes")
    assert stores.seeded(spark, path, "k long", [(1,)]).count() == 1
    spark.range(0).selectExpr("id as k").write.parquet(path)
    assert stores.seeded(spark, path, "k long", [(1,)]).count() == 0


def test_audit_csv_and_billing_lines(spark, tmp_path):
    rows = spark.createDataFrame([("t", "u", "e", "A", "r", 'x"y', None, None, "s", "INFO")], ", ".join(f"{c} string" for c in stores.AUDIT_COLUMNS))
    head, line = stores.audit_csv_text(rows).split("\n")
    assert head.startswith("timestamp,userId") and line == '"t","u","e","A","r","x""y",,,"s","INFO"'
    stores.append_lines(spark.sql("select 'a' as l"), str(tmp_path / "b"))
    stores.append_lines(spark.sql("select 'b' as l"), str(tmp_path / "b"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "b")).collect()) == ["a", "b"]


def tokens(sql):
    """An independent tokenizer, character by character."""
    out, i, n = [], 0, len(sql)
    while i < n:
        rest = sql[i:]
        if rest.startswith("--"):
            kind, size = "cmt", len(rest.split("\n")[0])
        elif rest.startswith("/*"):
            end = rest.find("*/", 2)
            kind, size = "cmt", len(rest) if end < 0 else end + 2
        elif rest[0] in "\"'":
            j = 1
            while j < len(rest) and not (rest[j] == rest[0] and (rest[0] == '"' or rest[j - 1] != "\\")):
                j += 1
            kind, size = "str", min(j + 1, len(rest))
        elif rest[0] in "0123456789" and (i == 0 or sql[i - 1] in " \t\n\r,(=<>!+-*/"):
            kind, size = "num", len(re.match("[0-9.]+", rest)[0])
        elif re.match("[a-zA-Z_]", rest):
            word = re.match("[a-zA-Z0-9_]+", rest)[0]
            kind, size = "kw" if word.upper() in KEYWORDS else "fn" if word.upper() in FUNCTIONS else "plain", len(word)
        else:
            kind, size = "op" if rest[0] in ">=<!-+*/().,;" else "plain", 1
        out.append((kind, rest[:size]))
        i += size
    return out


def test_tokens(spark):
    texts = ["SELECT count(*) FROM t WHERE a>=12.5 AND b='it\\'s' -- c\nOR x1 = \"q r\" /* a\nb */ , 7;", "1+(22)3 a4 5", "'open", "/* open", '"open', "", ")9 é 3", "min(x)-max ( y )"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", sql_tokens(F.col("t")).alias("x"))
    got = {r.k: [(t.kind, t.value) for t in r.x] for r in frame.collect()}
    assert got == {k: tokens(t) for k, t in enumerate(texts)}


def test_remembered_results_age_and_go():
    now = [0.0]
    held = cache.Remembered(2, 10, lambda: now[0])
    held.set("a", 1)
    held.set("b", 2)
    assert held.get("a") == 1
    held.set("a", 3)  # at capacity the oldest goes even so
    assert (held.get("a"), held.get("b"), held.stats()) == (3, None, {"size": 1, "most": 2})
    now[0] = 11
    assert held.get("a") is None and held.stats()["size"] == 0


def test_pages(spark):
    assert [len(p) for p in runner.pages(spark.range(25), 10)] == [10, 10, 5] and list(runner.pages(spark.range(0))) == []


def test_names_in_literals_stay():
    sql = "select 'from a.b.c' as x from a.b.c -- from d.e.f"
    assert dialect.flat_names(sql) == "select 'from a.b.c' as x from a_b_c -- from d.e.f"


def test_as_of_takes_equal_times_and_none(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, at int")
    right = spark.createDataFrame([(1, 5, "x"), (1, 5, "y"), (1, 3, "w"), (1, 7, "z")], "k int, at int, v string")
    got = {(r.k, r.at): r.latest for r in tables.as_of(left, right, "k", "at", "v").collect()}
    assert got == {(1, 5): "y", (1, 1): None, (2, 9): None}


def test_axes_and_categories(spark):
    assert charts.axes(["a"]) == ("a", "a") and charts.axes(["a", "b", "c"], y="c") == ("a", "c")


def test_billing_updates_and_checkouts(spark):
    held = spark.createDataFrame([("a", "grace", "growth", "monthly")], "customer string, status string, tier string, cycle string").withColumn("grace_end", F.lit("2024-01-09").cast("timestamp"))
    rows = [("a", 1, "subscription_updated", "enterprise", None), ("a", 2, "subscription_updated", None, "annual"), ("b", 1, "subscription_updated", "growth", "annual"), ("b", 2, "checkout_completed", None, None), ("b", 3, "payment_failed", None, None), ("c", 1, "payment_succeeded", None, None)]
    events = spark.createDataFrame(rows, "customer string, seq int, type string, tier string, cycle string").withColumn("at", F.lit("2024-01-02").cast("timestamp"))
    got = {r.customer: (r.status, str(r.grace_end), r.tier, r.cycle) for r in stateful.apply_billing(held, events).collect()}
    assert got == {"a": ("grace", "2024-01-09 00:00:00", "enterprise", "annual"), "b": ("grace", "2024-01-09 00:00:00", "starter", "monthly")}


def run_stream(spark, make, parts, tmp_path):
    """The parts come one after the other, each in a run of its own that goes on from the checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(part.schema).parquet(source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start(out)
        assert query.awaitTermination(120)
    return spark.read.parquet(out)


def test_running_rapid_queries_keep_their_state(spark, tmp_path):
    parts = [spark.createDataFrame([(1, k, k * 1_000_000, "QUERY_RUN") for k in some], "user_id long, seq long, at_us long, action string").coalesce(1) for some in (range(0, 3), range(3, 6))]
    got = {r.seq: (r.earlier, r.rapid) for r in run_stream(spark, lambda s: stateful.rapid_queries(s, 3, 2), parts, tmp_path).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (2, False), 3: (3, True), 4: (3, True), 5: (3, True)}


def test_running_stream_drops_what_came_before(spark, tmp_path):
    part = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:01")], "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    assert run_stream(spark, stateful.first_of_each, [part, part], tmp_path).count() == 2
