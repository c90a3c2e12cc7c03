"""Hand-made rows for the rules that the big tables do not exercise."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tideline.functions import connection as cn, job_json as jj, shape as sh, sql_text as st
from tideline.operators import cdc, health, logs, mutation as mu, relational as re, rules as ru, series as se, statement_log as sl, sync as sy

NOW = 1_700_000_000_000


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first()["r"]


# ---- text --------------------------------------------------------------------


@pytest.mark.parametrize(
    "sql, kind, cls",
    [
        (None, "UNKNOWN", "UNKNOWN"),
        ("", "UNKNOWN", "UNKNOWN"),
        ("\n\t select\n1", "SELECT", "SELECT"),
        ("SELECT", "UNKNOWN", "SELECT"),
        ("WITH a AS (SELECT 1) SELECT * FROM a", "UNKNOWN", "SELECT"),
        ("insert into t select 1", "INSERT", "SELECT"),
        ("insert into t\nselect 1", "INSERT", "DML"),
        ("TRUNCATE TABLE t", "TRUNCATE", "DDL"),
        ("begin", "UNKNOWN", "TRANSACTION"),
        ("explain select", "UNKNOWN", "UNKNOWN"),
    ],
)
def test_kinds(spark, sql, kind, cls):
    assert one(spark, sql, st.query_type) == kind
    assert one(spark, sql, st.statement_class) == cls


@pytest.mark.parametrize(
    "sql, tables",
    [
        (None, []),
        ("select * from a.t, b.t", ["t", "t"]),
        ("select * from a.t join a.t on 1=1", ["t"]),
        ("select * from `s`.`x` left join [y] on 1=1 JOIN \"z\" ON 1=1", ["x", "y", "z"]),
        ("select 1 from (select 2 from inner_t) q, other", ["inner_t"]),
        ("delete from only_where", ["only_where"]),
        ("delete t from t", []),
        ("create table c (id int)", []),
    ],
)
def test_referenced_tables(spark, sql, tables):
    assert one(spark, sql, st.referenced_tables) == tables


def test_names_ignore_case(spark):
    got = one(spark, ["a.Users", "users", "'Orders'", "ORDERS", " "], st.referenced_tables_ci, "array<string>")
    assert got == ["Users", "Orders"]


def test_modified_tables(spark):
    sql = "UPDATE `a`.b SET x = 1; insert\n into s.T values (1); DELETE FROM t; insert into 'Q' values (2)"
    assert one(spark, sql, st.modified_tables) == ["a", "t", "q"]


def test_normalize_and_preview(spark):
    assert one(spark, "\t Select  \n 1 ", st.normalize_sql) == "select 1"
    assert one(spark, None, st.normalize_sql) == ""
    assert one(spark, None, st.preview_sql) == "null"
    assert one(spark, "x" * 101, st.preview_sql) == "x" * 100 + "..."
    assert one(spark, "x" * 100, st.preview_sql) == "x" * 100


@pytest.mark.parametrize("minutes, category, recent", [(4, "realtime", True), (5, "recent", True), (59, "recent", True), (60, "history", False)])
def test_age(spark, minutes, category, recent):
    got = one(spark, NOW - minutes * 60_000 - 59_999, lambda c: st.query_age(c, NOW), "bigint")
    assert (got["minutes"], got["category"], got["is_recent"]) == (minutes, category, recent)


# ---- connections -------------------------------------------------------------


@pytest.mark.parametrize(
    "url, db",
    [("jdbc:mysql://h/shop?x=1", "shop"), ("no-slash", None), ("jdbc:mysql://h/", None), ("a/b/c", "c"), ("h/?x=1", "")],
)
def test_database_name(spark, url, db):
    assert one(spark, url, cn.database_name) == db


def test_identity_masks_by_default(spark):
    df = spark.createDataFrame([("jdbc:mysql://h/db", "u ser", "p:w"), ("jdbc:mysql://h/db", " ", "p"), ("plain?x=1", "u", None)], "u string, n string, p string")
    masked = [r[0] for r in df.select(cn.conn_identity("u", "n", "p")).collect()]
    assert masked == ["jdbc:mysql://u+ser:***@h/db", "jdbc:mysql://h/db", "plain?x=1&user=u"]
    clear = df.select(cn.conn_identity("u", "n", "p", mask=False)).first()[0]
    assert clear == "jdbc:mysql://u+ser:p%3Aw@h/db"


def test_job_name(spark):
    got = spark.range(1).select(cn.job_name(F.lit("c"), F.lit("_My DB"), F.lit("Tab__le!"))).first()[0]
    assert got == "managed-4a8a08f0-my-db-tab-le"


# ---- JSON --------------------------------------------------------------------


def test_jobs_by_name_last_wins(spark):
    rows = [
        (1, '[{"jobName":"a","jobId":1},{"jobs":[{"jobName":"a","jobId":2},{"jobName":"b","jobId":3,"jobs":[{"jobName":"c","jobId":9}]}]}]'),
        (2, '{"jobName":"b","jobId":4}'),
        (3, '{"jobName":"x"}'),
    ]
    got = jj.jobs_by_name(spark.createDataFrame(rows, "pos int, json string"))
    assert {r["job_name"]: r["job_id"] for r in got.collect()} == {"a": "2", "b": "4", "c": "9"}


def test_translations_sorted_nulls_last(spark):
    rows = [
        ("k1", '{"queryId":"q1","originalSql":"A","translatedSql":"a","connHash":"C1","updateTime":5}'),
        ("k2", " legacy text "),
        ("k3", '{"queryId":"q3","originalSql":"B","translatedSql":"b","connHash":"c2","updateTime":7}'),
        ("k4", None),
    ]
    df = spark.createDataFrame(rows, "key string, raw string")
    assert [r["query_id"] for r in sl.translation_listing(df).collect()] == ["q3", "q1", "k2"]
    assert [r["query_id"] for r in sl.translation_listing(df, conn="c1").collect()] == ["q1"]
    assert [r["translated_sql"] for r in sl.translation_listing(df, search="LEGACY").collect()] == ["legacy text"]


# ---- log ---------------------------------------------------------------------

LOG = "id string, sql string, parameters string, execution_time bigint, has_error boolean, timestamp bigint, conn_hash string, method_name string, normalized_sql string, query_type string, table_names string"


def log_frame(spark):
    rows = [
        ("1", "select 1", None, 999, False, 1, "c1", "executeQuery", None, "SELECT", "a, b,,a"),
        ("2", "select 1", None, 1000, False, 2, "c1", "executeQuery", None, "SELECT", ""),
        ("3", "select 1", "P", 1000, False, 3, "c1", "executeQuery", None, "SELECT", None),
        ("4", "select 2", None, 5000, False, 4, None, "executeQuery", None, None, " B "),
        ("5", "update x", None, 10, True, 5, " ", "executeUpdate", None, "UPDATE", "x"),
        ("6", "select 3", None, 10, True, 6, "c2", "executeQuery", None, "SELECT", None),
        ("7", "select 3", None, 5001, False, 7, "c2", "executeQuery", None, "SELECT", "a,"),
    ]
    return spark.createDataFrame(rows, LOG)


def test_slowest_keeps_the_earlier_of_equals(spark):
    got = {r["statement_id"]: r["id"] for r in sl.slowest_per_statement(log_frame(spark)).collect()}
    assert sorted(got.values()) == ["2", "4", "7"]


def test_table_heat_counts_blanks_and_repeats(spark):
    got = {r["table"]: r["n"] for r in sl.table_heat(log_frame(spark), 10).collect()}
    assert got == {"a": 3, "b": 1, "": 2, "B": 1, "x": 1}


def test_filters(spark):
    log = log_frame(spark)
    assert sl.keyword_search(log, "  ").count() == 7
    assert sl.keyword_search(log, "p").count() == 2  # parameters P and "update"
    assert sl.type_filter(log, "select").count() == 5
    assert sl.min_time_filter(log, 0).count() == 7
    assert [r["id"] for r in sl.csv_member_filter(log, "table_names", "b").orderBy("id").collect()] == ["1", "4"]
    page = sl.slow_query_page(log, 0, 3).collect()
    assert [r["id"] for r in page] == ["7", "4", "2"] and page[0]["total"] == 7 and page[0]["total_pages"] == 3
    assert sl.slow_query_page(log, 9, 3).collect() == []


def test_facets_and_tables(spark):
    log = log_frame(spark)
    facets = {(r["facet"], r["value"]) for r in sl.facet_lists(log).collect()}
    assert facets == {
        ("connection", "c1"), ("connection", "c2"), ("type", "SELECT"), ("type", "UPDATE"), ("table", "a"), ("table", "b"),
        ("table", "B"), ("table", "x"), ("total", "7"),
    }
    assert {r["conn_hash"]: r["tables"] for r in sl.tables_by_connection(log).collect()} == {"c1": ["a", "b"], "c2": ["a"]}


def test_share_rounds_half_up(spark):
    df = spark.createDataFrame([("a",)] * 1 + [(None,)] * 4 + [("",)] * 3, "conn_hash string")
    assert [(r["name"], r["n"], r["percent"]) for r in sl.share_by_connection(df).collect()] == [("Unknown", 7, 88), ("a", 1, 13)]


# ---- health ------------------------------------------------------------------


def test_rates_of_nothing(spark):
    none = spark.createDataFrame([], "outcome string, execution_time bigint, has_error boolean")
    assert health.hit_rate(none).first()["hit_rate"] == 0.0
    assert health.slow_rate(none).first()["slow_rate"] == 0.0
    assert health.success_rate(none).first()["success_rate"] == 100.0
    assert health.mean_time(none).first()["mean_time"] == 0.0


def test_slow_is_strictly_above_the_limit(spark):
    df = spark.createDataFrame([(5000,), (5001,)], "execution_time bigint")
    assert health.slow_rate(df).first()["slow_rate"] == 0.5


def test_alerts_need_samples(spark):
    df = spark.createDataFrame([(0.10, 0.5, 50, 50), (0.11, 0.79, 80, 21)], "slow_rate double, hit_rate double, cache_hits bigint, cache_misses bigint")
    got = sorted((r["alert"], r["current"]) for r in health.threshold_alerts(df).collect())
    assert got == [("cache_hit_rate", 0.79), ("slow_query", 0.11)]


def test_ewma_first_value_has_full_weight_and_overall_floor(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, -1.0), (None, 4, 5.0), ("b", 5, 0.5)], "k string, ts int, x double")
    got = {r["k"]: (r["ewma"], r["executions"]) for r in health.ewma_per_statement(df, "k", "x", ["ts"]).collect()}
    assert got == {"a": (pytest.approx(12.0), 2), "b": (pytest.approx(0.5), 1)}
    fast = spark.createDataFrame([("a", 0.2), ("b", 1.0)], "k string, ewma double")
    assert not any(r["is_slow"] for r in health.slow_classification(fast).collect())


def test_breaker_reopens_after_expiry(spark):
    times = [(0, False), (1, False), (2, False), (60_002, True), (60_003, False), (60_004, True), (120_003, True), (120_004, True), (120_005, False)]
    df = spark.createDataFrame([("s", t, i, ok) for i, (t, ok) in enumerate(times)], "k string, ts bigint, id int, ok boolean")
    got = [(r["refused"], r["failures"]) for r in health.failure_breaker(df, "k", ["ts", "id"], "ok").orderBy("id").collect()]
    # open from 2 up to and at 60002; one failure opens it again up to 120003; the next success clears it
    assert got == [
        (False, 1), (False, 2), (False, 3), (True, 3), (False, 4), (True, 4), (True, 4), (False, 0), (False, 1),
    ]


# ---- rules and sync ----------------------------------------------------------

RULES = "id string, pos int, enabled boolean, conn_hash string, tables array<string>, slow_query_ids array<string>, job_ids map<string,string>"


def rule_frame(spark):
    c = "jdbc:mysql://u:p@h/db"
    return spark.createDataFrame(
        [
            ("r1", 1, True, c, ["T1"], ["s2"], {"t1": "j1"}),
            ("r2", 2, False, c, ["t2"], [], {}),
            ("r3", 3, True, c, [], ["s2", "s9"], {}),
            ("r4", 4, True, c, [], [], {}),
            ("r5", 5, True, c, ["t1", " T1 "], [], {}),
            ("r6", 6, True, None, ["T1"], [], {}),
        ],
        RULES,
    )


def statement_frame(spark):
    c = "jdbc:mysql://u:p@h/db"
    return spark.createDataFrame(
        [("s1", c, "x, T1"), ("s2", c, "t2"), ("s3", "other", "T1"), ("s4", None, "T1"), ("s9", "other", "t9")],
        "id string, conn_hash string, table_names string",
    )


def test_rule_match(spark):
    got = {(r["rule_id"], r["statement_id"]) for r in ru.rule_match(rule_frame(spark), statement_frame(spark)).collect()}
    # r1 has a table, so its id s2 does not count; r2 is off; r4 has no condition
    assert got == {("r1", "s1"), ("r3", "s2"), ("r5", "s1")}


def test_resolve_and_reconcile(spark):
    resolved = {(r["rule_id"], r["table_key"]): r["table"] for r in ru.resolve_tables(rule_frame(spark), statement_frame(spark)).collect()}
    assert resolved[("r1", "t1")] == "T1" and resolved[("r1", "t2")] == "t2" and resolved[("r5", "t1")] == "T1"
    assert ("r3", "t9") not in resolved  # that statement ran on another connection
    expected = ru.expected_jobs(rule_frame(spark), statement_frame(spark))
    names = {r["table"].lower(): (r["job_name"], r["rule_id"]) for r in expected.collect()}
    assert names["t1"][1] == "r1" and names["t2"][1] == "r1"
    running = spark.createDataFrame([(names["t1"][0], "7"), ("managed-old", "8"), ("mine", "9")], "job_name string, job_id string")
    got = {r["job_name"]: r["action"] for r in ru.reconcile(expected, running).collect()}
    assert got == {names["t1"][0]: "keep", names["t2"][0]: "submit", "managed-old": "cancel"}


def test_job_status_order(spark):
    rules = rule_frame(spark)
    none = spark.createDataFrame([], "job_name string, job_id string")
    got = {(r["rule_id"], r["table"]): r["status"] for r in ru.job_status(rules, statement_frame(spark), none).collect()}
    assert got[("r1", "T1")] == "missing" and got[("r1", "t2")] == "pending" and got[("r6", "T1")] == "invalid-connection"
    off = {r["status"] for r in ru.job_status(rules, statement_frame(spark), none, enabled=False).collect()}
    assert off == {"disabled"}


STATE = "job_name string, conn_hash string, database string, table_name string, job_id string, rule_id string, ready boolean, snapshot_finished boolean, update_time bigint"


def test_stale_boundary(spark):
    rows = [("a", "c", "d", "t", "j", None, True, True, NOW - 300_000), ("b", "c", "d", "t", "j", None, True, True, NOW - 300_001), ("e", "c", "d", "t", "j", None, False, True, 0)]
    state = spark.createDataFrame(rows, STATE)
    assert [r["job_name"] for r in sy.available_tables(state, NOW).collect()] == ["a"]
    assert {r["job_name"]: r["label"] for r in sy.sync_label(state, NOW).collect()} == {"a": "ready", "b": "stale", "e": "waiting"}
    assert sy.sync_bucket_counts(state, NOW).first().asDict() == {"total": 3, "ready": 1, "syncing": 0, "stale": 2, "waiting": 0}


def test_failed_keeps_the_snapshot_flag(spark):
    state = spark.createDataFrame([("a", "c", "d", "t", "j", None, True, True, 1)], STATE)
    feed = spark.createDataFrame([("a", "j2", "FAILED", 5, 1, None, None, None), (None, "x", "FAILED", 6, 1, None, None, None)], "job_name string, job_id string, state string, ts bigint, seq bigint, database string, table string, conn_hash string")
    row = sy.sync_state_update(state, feed).collect()
    assert len(row) == 1 and row[0]["ready"] is False and row[0]["snapshot_finished"] is True and row[0]["update_time"] == 5 and row[0]["job_id"] == "j2"


def test_route(spark):
    conn = "jdbc:mysql://h/db"
    job = lambda t: spark.range(1).select(cn.job_name(F.lit(conn), F.lit("db"), F.lit(t))).first()[0]
    state = spark.createDataFrame([(job("a"), True, NOW, "INCREMENTAL_SYNCING"), (job("b"), True, NOW, "INCREMENTAL_IDLE")], "job_name string, ready boolean, update_time bigint, cdc_state string")
    sql = {"1": "select * from a", "2": "select * from B", "3": "select * from a, zz", "4": "select 1", "5": None}
    stm = spark.createDataFrame([(k, conn, v) for k, v in sql.items()], "id string, conn_hash string, sql string")
    loose = {r["id"]: r["route"] for r in sy.route_decision(stm, state, NOW).collect()}
    assert loose == {"1": "replica", "2": "replica", "3": "source", "4": "source", "5": "source"}
    strict = {r["id"]: r["route"] for r in sy.route_decision(stm, state, NOW, strict=True).collect()}
    assert strict["1"] == "source" and strict["2"] == "replica"


# ---- change records ----------------------------------------------------------


def monitor(spark, rows, compat=False):
    df = spark.createDataFrame(rows, "job_id string, ts bigint, seq bigint, kind string, event_type string, source_received bigint, sink_written bigint")
    return [(r["state"], r["published"]) for r in cdc.sync_monitor(df, "job_id", compat=compat).orderBy("ts", "seq").collect()]


def tick(ts, source, sink):
    return ("j", ts, ts, "tick", None, source, sink)


def test_idle_after_thirty_seconds(spark):
    rows = [tick(40_000, 5, 0), tick(69_999, 5, 0), tick(70_000, 5, 0)]
    assert [s for s, _ in monitor(spark, rows)] == ["INCREMENTAL_SYNCING", "INCREMENTAL_SYNCING", "INCREMENTAL_IDLE"]


def test_write_waits_for_the_sink(spark):
    rows = [tick(40_000, 5, 3), ("j", 41_000, 1, "write", None, None, None), tick(42_000, 5, 3), tick(43_000, 5, 3), tick(44_000, 5, 4)]
    assert monitor(spark, rows)[-1] == ("INCREMENTAL_IDLE", True)
    assert monitor(spark, rows, compat=True)[-1] == ("INCREMENTAL_SYNCING", False)
    zero = [tick(40_000, 5, 0), ("j", 41_000, 1, "write", None, None, None), tick(42_000, 5, 0), tick(43_000, 5, 1), tick(44_000, 5, 2)]
    # a baseline of 0 is stored again by the next tick
    assert [s for s, _ in monitor(spark, zero)][-2:] == ["INCREMENTAL_SYNCING", "INCREMENTAL_IDLE"]


def test_feed_is_throttled(spark):
    rows = [("j", t, t, "event", "CHECKPOINT_COMPLETED", None, None) for t in (40_000, 70_000, 70_001, 100_001, 100_002)]
    assert [p for _, p in monitor(spark, rows)] == [True, False, True, False, True]


def test_reinsert_and_new_column(spark):
    snap = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    ch = spark.createDataFrame(
        [("d", 1, 1, 1, None, None), ("c", 1, 2, 1, "A", 5), ("d", 1, 1, 2, None, None), ("u", 2, 1, 7, "n", None)],
        "op string, ts int, seq int, id int, v string, extra int",
    )
    got = sorted(tuple(r) for r in cdc.cdc_apply(snap, ch, ["id"]).collect())
    assert got == [(1, "A", 5), (7, "n", None)]


# ---- mutation ----------------------------------------------------------------


def test_upsert_adds_counts(spark):
    have = spark.createDataFrame([(1, "Test Item", 1)], "id int, name string, count_val int")
    new = spark.createDataFrame([(1, "Updated Item", 2), (2, None, 4)], "id int, name string, count_val int")
    got = sorted(tuple(r) for r in mu.upsert_accumulate(have, new, ["id"], ["name"], ["count_val"]).collect())
    assert got == [(1, "Updated Item", 3), (2, None, 4)]


def test_null_condition_keeps_and_leaves_rows(spark):
    df = spark.createDataFrame([(1, 10), (2, None)], "id int, p int")
    assert sorted(r["id"] for r in mu.delete_where(df, F.col("p") > 5).collect()) == [2]
    got = {r["id"]: r["p"] for r in mu.update_where(df, F.col("p") > 5, {"p": F.col("p") + 1}).collect()}
    assert got == {1: 11, 2: None}


def test_aggregate_update_without_lines(spark):
    inv = spark.createDataFrame([(1, Decimal("5.00")), (2, Decimal("6.00"))], "id int, total decimal(10,2)")
    lines = spark.createDataFrame([(1, Decimal("1.50"))], "inv int, amt decimal(10,2)")
    plain = {r["id"]: r["total"] for r in mu.update_from_aggregate(inv, lines, "id", "inv", "total", F.sum("amt")).collect()}
    assert plain == {1: Decimal("1.50"), 2: None}
    kept = mu.update_from_aggregate(inv, lines, "id", "inv", "total", F.sum("amt"), only_with_lines=F.col("amt") > 0)
    assert {r["id"]: r["total"] for r in kept.collect()} == {1: Decimal("1.50"), 2: Decimal("6.00")}


# ---- series and logs ---------------------------------------------------------


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def test_counter_reset_and_gap(spark):
    rows = [(at(t), "c", {"job": "a"}, float(v)) for t, v in [(0, 10), (15, 14), (30, 3), (60, 9)]]
    df = spark.createDataFrame(rows, "ts timestamp, name string, labels map<string,string>, value double")
    got = {r["ts"].replace(tzinfo=dt.timezone.utc): r["value"] for r in se.counter_increase(df, 60, 30).collect()}
    base = at(0).replace(tzinfo=dt.timezone.utc)
    secs = {int((k - base).total_seconds()): v for k, v in got.items()}
    assert secs == {30: 4.0, 60: 7.0, 90: 9.0, 120: 6.0}


def test_quantile_edges(spark):
    def buckets(*pairs):
        return spark.createDataFrame([("s", at(0), float(le), float(c)) for le, c in pairs], "s string, ts timestamp, le double, value double")

    inf = float("inf")
    q = lambda df, p: se.histogram_quantile(p, df, ["s"]).first()["value"]
    assert q(buckets((1, 0), (2, 10), (inf, 10)), 0.5) == pytest.approx(1.5)
    assert q(buckets((1, 5), (2, 5), (inf, 10)), 0.9) == 2.0
    assert q(buckets((1, 0), (inf, 0)), 0.5) is None
    assert q(buckets((1, 4), (2, 8)), 0.5) is None
    assert q(buckets((1, 4), (inf, 4)), 0.5) == pytest.approx(0.5)


def test_step_table():
    assert [se.step_for(s) for s in (300, 3600, 6 * 3600, 6 * 3600 + 1, 86400 + 1, 7 * 86400, 7 * 86400 + 1)] == [15, 15, 15, 60, 300, 300, 3600]


def test_label_filter_matches_whole_values(spark):
    df = spark.createDataFrame([(at(0), "m", {"job": "api"}, 1.0), (at(0), "m", {"job": "api-2"}, 2.0), (at(0), "m", {}, 3.0)], "ts timestamp, name string, labels map<string,string>, value double")
    vals = lambda **c: sorted(r["value"] for r in se.label_filter(df, {"job": c["job"]}).collect())
    assert vals(job=("=~", "api")) == [1.0]
    assert vals(job=("!~", "api.*")) == [3.0]
    assert vals(job=("=", "")) == [3.0]


def test_log_defaults_and_traces(spark):
    u = "0123abcd-0123-0123-0123-0123456789ab"
    spellings = [f"会话[{u}]", f"Session {u}", f"session -> {u}", f"for session {u}", f"client uuid {u}", f"sessionUUID:{u}", f"trace_id:{u}"]
    values = [[str(1_700_000_000_000_000_000 + i * 1_999_999), m] for i, m in enumerate([*spellings, f"uuid {u}"])]
    df = spark.createDataFrame([([({}, values), ({"service": "app-x", "level": "ERROR"}, [["1700000000000000000", "boom"]])],)], f"result {logs.RESULT_SCHEMA}")
    rows = logs.log_flatten(df).collect()
    assert len(rows) == 9 and rows[0]["message"].startswith("uuid") and rows[0]["trace_id"] is None
    assert sum(r["trace_id"] == u for r in rows) == 7
    assert {(r["service"], r["level"], r["container"]) for r in rows} == {("unknown", "INFO", "unknown"), ("app-x", "ERROR", "unknown")}
    flat = logs.log_flatten(df)
    assert logs.log_filter(flat, default_services="app-.*").count() == 1
    assert logs.error_log_filter(flat).count() == 1


# ---- shapes ------------------------------------------------------------------


def test_typed_row_round_trip(spark):
    ddl = "a int, b bigint, c smallint, d tinyint, e decimal(19,2), f double, g float, h boolean, i string, j binary, k date, l timestamp, m timestamp_ntz, n time(6)"
    full = (1, 2, 3, 4, Decimal("5.10"), 6.5, 7.5, True, "x", bytearray(b"\x01"), dt.date(2024, 1, 2), at(1).replace(tzinfo=None), dt.datetime(2024, 1, 1), dt.time(10, 11, 12))
    df = spark.createDataFrame([full, (None,) * 14], ddl)
    shaped = sh.oracle_shape(df)
    assert shaped.columns == [c.upper() for c in df.columns]
    assert [f.dataType.simpleString() for f in shaped.schema.fields[:4]] == ["decimal(10,0)", "decimal(19,0)", "decimal(5,0)", "decimal(3,0)"]
    shown = sh.display_value(df).collect()
    assert shown[0]["e"] == "5.1" and shown[0]["j"] == "AQ==" and shown[0]["n"] == "10:11:12" and shown[0]["m"] == "2024-01-01T00:00Z"
    assert all(v is None for v in shown[1])


def test_display_text(spark):
    assert one(spark, "\x01\x02\x03a", sh.display_text) == "\x01\x02\x03a"
    assert one(spark, "\x01\x02\x03\x04é", sh.display_text) == "AQIDBOk="
    assert one(spark, "\t\n\r\x0b\x0c", sh.display_text) == "\t\n\r\x0b\x0c"


def test_decode_matches_null(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "v int")
    got = [r[0] for r in df.select(sh.oracle_decode("v", None, "none", 1, "one")).collect()]
    assert got == ["one", "none", None]


def test_union_ci_prefers_the_first_frame(spark):
    a = spark.createDataFrame([("Users",)], "name string")
    b = spark.createDataFrame([("users",), ("Orders",)], "name string")
    assert {r["key"]: r["name"] for r in re.union_distinct_ci(a, b).collect()} == {"users": "Users", "orders": "Orders"}


def test_jobs_nest_to_any_depth(spark):
    from tideline.functions.job_json import jobs_by_name

    inner = '{"jobName":"deep","jobId":"7"}'
    for k in range(6):
        inner = '{"jobName":"level%d","jobId":"%d","jobs":[%s]}' % (k, k, inner)
    got = {tuple(r) for r in jobs_by_name(spark.createDataFrame([(1, f"[{inner}]"), (2, '{"jobName":"level0","jobId":"new"}')], "pos int, json string")).collect()}
    assert got == {("deep", "7"), ("level0", "new"), *((f"level{k}", str(k)) for k in range(1, 6))}


def test_failures_count_on(spark):
    df = spark.createDataFrame([(i, "k", i * 70_000, False) for i in range(6)], "id int, k string, ts long, ok boolean")
    got = [r["failures"] for r in health.failure_breaker(df, "k", ["ts", "id"], "ok").orderBy("id").collect()]
    assert got == [1, 2, 3, 4, 5, 6]


def test_splits_have_no_ceiling(spark):
    from tideline.sources.snapshot import plan_splits

    assert plan_splits(spark.createDataFrame([(1, 10, 10**9)], "lower long, upper long, rows long")).first()["partitions"] == -(-(10**9) // 8096)


def test_trend_over_a_gap(spark):
    import datetime as d

    from tideline.plans.store import revenue_trend

    rows = [(d.datetime(2020, m, 5), 10.0 * m) for m in (1, 2, 4, 5, 6)]
    out = {r["BillingMonth"]: r for r in revenue_trend(spark.createDataFrame(rows, "InvoiceDate timestamp, Total double").selectExpr("InvoiceDate", "CAST(Total AS decimal(12,2)) AS Total")).collect()}
    assert out["2020-04"]["DeltaPrevMonth"] is None and out["2020-05"]["DeltaPrevMonth"] == 10.0
    assert out["2020-04"]["RollingAvg3m"] == 30.0


def test_listings_of_any_width_and_depth(spark):
    import json

    wide = [{"jobName": f"w{i}", "jobId": str(i), "jobs": [{"jobName": f"w{i}", "jobId": "inner"}, {"jobName": f"v{i}", "jobId": f"x{i}"}]} for i in range(10_000)]
    deep: dict = {"jobName": "deep", "jobId": "20"}
    for i in range(19, -1, -1):
        deep = {"jobName": f"d{i}", "jobId": "[\"" + str(i), "jobs": [deep]}
    listings = [(1, json.dumps(wide)), (2, json.dumps([deep, {"jobName": "w7", "jobId": "later"}])), (3, ""), (4, "not json"), (5, None), (6, "[]")]
    df = spark.createDataFrame(listings, "pos int, json string")
    out = jj.jobs_by_name(df, "json", "pos")
    got = {r["job_name"]: r["job_id"] for r in out.collect()}
    want = {f"w{i}": str(i) for i in range(10_000)} | {f"v{i}": f"x{i}" for i in range(10_000)} | {f"d{i}": f'["{i}' for i in range(20)}
    assert got == want | {"deep": "20", "w7": "later"}
    small = jj.jobs_by_name(df.filter("pos = 6"), "json", "pos")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert abs(plan(out) - plan(small)) <= 2  # as large for any data


def test_rule_pairs_are_written_out(spark):
    """Every pair of the two queries, and once: ids of statements and rules may repeat."""
    from tests.conftest import SMALL
    from tideline.catalogue import all_queries

    assert all_queries()["rule_match"](spark, SMALL).columns == ["rule_id", "statement_id"]
    assert all_queries()["matching_jobs"](spark, SMALL).columns == ["rule_id", "statement_id", "table", "job_id"]
    rules = spark.createDataFrame(
        [("r1", 0, True, "c", [" a ", "b"], [], {" a ": "j1", "b": "j2"}), ("r1", 0, True, "c", [" a ", "b"], [], {" a ": "j1", "b": "j2"}),
         ("r1", 1, True, "c", [], ["s1", "s1", "s3"], {}), ("r2", 2, False, "c", ["a"], [], {"a": "j3"}), ("r3", 3, True, "d", ["a"], [], {})],
        "id string, pos int, enabled boolean, conn_hash string, tables array<string>, slow_query_ids array<string>, job_ids map<string,string>",
    )
    statements = spark.createDataFrame(
        [("s1", "c", "a,b"), ("s1", "c", "a,b"), ("s1", "c", "a"), ("s2", "c", "b, x"), ("s3", "c", None), ("s4", "d", "A"), (None, "c", "a"), ("s5", None, "a"), ("s6", "d", "a")],
        "id string, conn_hash string, table_names string",
    )
    pairs = [tuple(r) for r in ru.rule_match(rules, statements).collect()]
    assert sorted(pairs, key=str) == sorted([("r1", "s1"), ("r1", "s2"), ("r1", None), ("r1", "s3"), ("r3", "s6")], key=str)
    jobs = [tuple(r) for r in ru.matching_jobs(rules, statements).collect()]
    want = [("r1", "s1", "a", "j1"), ("r1", "s1", "b", "j2"), ("r1", "s2", "b", "j2"), ("r1", None, "a", "j1"), ("r2", "s1", "a", "j3"), ("r2", None, "a", "j3")]
    assert sorted(jobs, key=str) == sorted(want, key=str)
    anywhere = {tuple(r) for r in ru.matching_jobs(rules, statements, same_connection=False).collect()}
    assert anywhere == {*want, *[(r, s, "a", j) for r, j in (("r1", "j1"), ("r2", "j3")) for s in ("s5", "s6")]}


def test_pairs_of_one_table_list_are_dealt_over_tasks(spark):
    """Statements that all name the same tables: their pairs are no single task's work, and each is there once."""
    rules = spark.createDataFrame([(f"r{i}", i, True, "c", ["a"], [], {"a": f"j{i}"}) for i in range(30)], RULES)
    statements = spark.range(6000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("id"), F.lit("c").alias("conn_hash"), F.lit("a, b").alias("table_names"))
    for out in (ru.rule_match(rules, statements), ru.matching_jobs(rules, statements)):
        tasks = [r["n"] for r in out.withColumn("_task", F.spark_partition_id()).groupBy("_task").agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(tasks) == 180_000 and max(tasks) <= 90_000
        assert out.select("rule_id", "statement_id").distinct().count() == 180_000
