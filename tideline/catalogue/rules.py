"""Rules, jobs, sync state and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline import bindings as b
from tideline.bindings import LOG_SQL, LOG_TABLES_SQL, NOW, RULES_SQL, RUNNING_SQL, STATE_SQL, case_sql, job_name_sql, statement_log, sync_state, table
from tideline.catalogue.base import query
from tideline.catalogue.health import transactions
from tideline.functions.connection import database_name, job_name
from tideline.functions.sql_text import csv_items
from tideline.operators import health, rules as ru, sync as sy

LT = f"WITH {LOG_SQL}, {LOG_TABLES_SQL} "
R = LT + f", {RULES_SQL}, rt AS (SELECT id AS rule_id, pos, enabled, conn_hash, conn, job_ids, unnest(tables) AS raw, generate_subscripts(tables, 1) AS tp FROM rules) "
ST = LT + f", {STATE_SQL} "
RS = R + f", {STATE_SQL}, {RUNNING_SQL} "
FRESH = f"{NOW} - update_time <= 300000"


def _rules(spark, sf):
    return b.cache_rules(spark, sf)


# ---- rules and statements ----------------------------------------------------


@query("rule_match", R + """SELECT DISTINCT rule_id, l.id AS statement_id FROM rt JOIN log_tables l ON l.conn_hash = rt.conn_hash AND l.tab = trim(raw) WHERE enabled
UNION SELECT r.id, l.id FROM (SELECT id, conn_hash, unnest(slow_query_ids) AS sid FROM rules WHERE enabled AND len(tables) = 0) r
JOIN log l ON l.id = r.sid AND l.conn_hash = r.conn_hash""")
def rule_match(spark, sf):
    return ru.rule_match(_rules(spark, sf), statement_log(spark, sf))


@query("matching_jobs", R + """SELECT DISTINCT rule_id, l.id AS statement_id, tab AS "table", job_ids[raw] AS job_id FROM rt
JOIN log_tables l ON l.conn_hash = rt.conn_hash AND l.tab = trim(raw) WHERE job_ids[raw] IS NOT NULL""")
def matching_jobs(spark, sf):
    return ru.matching_jobs(_rules(spark, sf), statement_log(spark, sf))


RESOLVED = """named AS (SELECT id, conn_hash, unnest(string_split(table_names, ',')) AS t, generate_subscripts(string_split(table_names, ','), 1) AS tp FROM log),
ids AS (SELECT id AS rule_id, conn_hash, unnest(slow_query_ids) AS sid, generate_subscripts(slow_query_ids, 1) AS qp FROM rules),
cand AS (SELECT rule_id, trim(raw) AS t, 0 AS src, -tp AS a, 0 AS b FROM rt UNION ALL
 SELECT i.rule_id, n.t, 1, i.qp, n.tp FROM ids i JOIN named n ON n.id = i.sid AND n.conn_hash = i.conn_hash WHERE n.t <> ''),
resolved AS (SELECT rule_id, lower(t) AS table_key, arg_min(t, (src, a, b)) AS tab FROM cand GROUP BY 1, 2)"""


@query("resolve_tables", R + f', {RESOLVED} SELECT rule_id, table_key, tab AS "table" FROM resolved')
def resolve_tables(spark, sf):
    return ru.resolve_tables(_rules(spark, sf), statement_log(spark, sf))


# database of the connections that replication can use
USABLE = case_sql("conn", [c[4] if c[6] and c[5] and c[4] else None for c in b.CONNECTIONS])
EXPECTED = f"""info AS (SELECT id AS rule_id, pos, enabled, conn_hash, {USABLE} AS db, job_ids FROM rules),
asked AS (SELECT rule_id, pos, table_key, tab, enabled, {job_name_sql('conn_hash', 'db', 'tab')} AS job_name FROM resolved JOIN info USING (rule_id) WHERE db IS NOT NULL),
expected AS (SELECT job_name, arg_min(rule_id, (pos, table_key)) AS rule_id, arg_min(tab, (pos, table_key)) AS tab FROM asked WHERE enabled GROUP BY 1)"""


@query("expected_jobs", R + f', {RESOLVED}, {EXPECTED} SELECT job_name, rule_id, tab AS "table" FROM expected')
def expected_jobs(spark, sf):
    return ru.expected_jobs(_rules(spark, sf), statement_log(spark, sf))


@query("reconcile", RS + f""", {RESOLVED}, {EXPECTED} SELECT COALESCE(e.job_name, r.job_name) AS job_name, r.job_id,
CASE WHEN e.job_name IS NOT NULL AND r.job_name IS NOT NULL THEN 'keep' WHEN e.job_name IS NOT NULL THEN 'submit' ELSE 'cancel' END AS action
FROM expected e FULL JOIN running r ON e.job_name = r.job_name WHERE e.job_name IS NOT NULL OR starts_with(r.job_name, 'managed-')""")
def reconcile(spark, sf):
    expected = ru.expected_jobs(_rules(spark, sf), statement_log(spark, sf))
    return ru.reconcile(expected, b.running_jobs(spark, sf)).select("job_name", "job_id", "action")


@query("job_status", RS + f""", {RESOLVED}, {EXPECTED}, stored AS (SELECT id AS rule_id, unnest(map_keys(job_ids)) AS table_key, unnest(map_values(job_ids)) AS stored_job_id FROM rules),
alltab AS (SELECT COALESCE(a.rule_id, s.rule_id) AS rule_id, COALESCE(a.tab, s.table_key) AS tab, s.stored_job_id FROM resolved a
 FULL JOIN stored s ON a.rule_id = s.rule_id AND a.table_key = s.table_key),
n AS (SELECT t.*, db, CASE WHEN db IS NOT NULL THEN {job_name_sql('conn_hash', 'db', 'tab')} END AS job_name FROM alltab t JOIN info USING (rule_id))
SELECT n.rule_id, n.tab AS "table", n.job_name, n.stored_job_id, r.job_id AS live_job_id, CASE WHEN n.db IS NULL THEN 'invalid-connection'
WHEN r.job_id IS NOT NULL THEN 'running' WHEN n.stored_job_id IS NOT NULL THEN 'missing' ELSE 'pending' END AS status
FROM n LEFT JOIN running r ON r.job_name = n.job_name""")
def job_status(spark, sf):
    return ru.job_status(_rules(spark, sf), statement_log(spark, sf), b.running_jobs(spark, sf))


@query("rules_by_table", R + """SELECT raw AS "table", (rn - 1) // 10 AS block, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids FROM
(SELECT raw, rule_id, row_number() OVER (PARTITION BY raw ORDER BY rule_id) AS rn FROM rt) GROUP BY 1, 2""")
def rules_by_table(spark, sf):
    out = ru.rules_by_table(_rules(spark, sf), 10)
    return out.select("table", "block", F.array_join("rule_ids", ",").alias("rule_ids"))


@query("tables_of_queries", R + """SELECT k.conn_hash, k.tab AS "table", count(DISTINCT rule_id) AS n_rules FROM
(SELECT DISTINCT conn_hash, tab FROM log_tables WHERE conn_hash <> '') k LEFT JOIN rt ON rt.conn_hash = k.conn_hash AND lower(trim(raw)) = lower(k.tab) GROUP BY 1, 2""")
def tables_of_queries(spark, sf):
    return ru.tables_of_queries(statement_log(spark, sf), _rules(spark, sf))


@query("rule_stats", R + "SELECT count(*) FILTER (enabled) AS enabled_rules, count(*) FILTER (cardinality(job_ids) > 0) AS rules_with_jobs FROM rules")
def rule_stats(spark, sf):
    return ru.rule_stats(_rules(spark, sf))


# ---- sync state --------------------------------------------------------------


@query("available_tables", ST + f"SELECT job_name, table_name FROM state WHERE ready AND {FRESH}")
def available_tables(spark, sf):
    return sy.available_tables(sync_state(spark, sf), NOW).select("job_name", "table_name")


VIEW = f"SELECT conn_hash, database, table_name, ready AND {FRESH} AS ready, snapshot_finished, NOT ({FRESH}) AS stale, update_time, job_name, job_id, rule_id FROM state"


@query("sync_status_view", ST + VIEW)
def sync_status_view(spark, sf):
    return sy.sync_status_view(sync_state(spark, sf), NOW)


@query("sync_bucket_counts", ST + f""", v AS ({VIEW}) SELECT count(*) AS total, count(*) FILTER (ready) AS ready, count(*) FILTER (NOT ready AND NOT snapshot_finished) AS syncing,
count(*) FILTER (NOT ready AND snapshot_finished AND stale) AS stale, count(*) FILTER (NOT ready AND snapshot_finished AND NOT stale AND update_time = 0) AS waiting FROM v""")
def sync_bucket_counts(spark, sf):
    return sy.sync_bucket_counts(sync_state(spark, sf), NOW)


@query("sync_label", ST + f""", v AS ({VIEW}) SELECT job_name, CASE WHEN update_time = 0 THEN 'waiting' WHEN ready THEN 'ready' WHEN NOT snapshot_finished THEN 'syncing'
WHEN stale THEN 'stale' ELSE 'not_ready' END AS label FROM v""")
def sync_label(spark, sf):
    return sy.sync_label(sync_state(spark, sf), NOW)


@query("job_health", f"""SELECT event_id, (event_id % 90) * 1000 <= 60000 AND user_id % 3 > 0 AND event_type <> 'error' AND CAST(floor(value * 100) AS BIGINT) < 5000 AS healthy FROM events""")
def job_health(spark, sf):
    jobs = table(spark, sf, "events").select(
        "event_id", (F.lit(NOW) - (F.col("event_id") % 90) * 1000).alias("update_time"),
        F.when(F.col("user_id") % 3 == 0, "SNAPSHOT").when(F.col("user_id") % 3 == 1, "incremental").otherwise("INCREMENTAL").alias("phase"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("RUNNING").alias("status"),
        F.floor(F.col("value") * 100).cast("long").alias("lag"),
    )
    return sy.job_health(jobs, NOW).select("event_id", "healthy")


STATES = {"view": "SNAPSHOT_SYNCING", "click": "INCREMENTAL_SYNCING", "signup": "INCREMENTAL_IDLE", "purchase": "FAILED", "error": "OTHER"}
STATE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"
FEED = f"""feed AS (SELECT {job_name_sql('conn_hash', 'db', 'tab')} AS job_name, 'e' || event_id AS job_id, {STATE_CASE} AS state, timestamp AS ts, event_id AS seq,
 CASE WHEN event_id % 3 = 0 THEN 'x' || event_id END AS database, lower(tab) AS tab, 'unknown' AS conn FROM
 (SELECT *, {b.DATABASE_OF_CONN} AS db, CASE WHEN event_id % 7 = 0 THEN 'new_' ELSE '' END || string_split(table_names, ',')[1] AS tab FROM log WHERE table_names <> '') WHERE db IS NOT NULL)"""


def _feed(spark, sf):
    log = statement_log(spark, sf).filter((F.col("table_names") != "") & database_name("conn_hash").isNotNull())
    e = F.col("id").cast("long")
    tab = F.concat(F.when(e % 7 == 0, "new_").otherwise(""), F.element_at(csv_items("table_names"), 1))
    events = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), "event_type")
    state = F.lit(None).cast("string")
    for k, v in STATES.items():
        state = F.when(F.col("event_type") == k, v).otherwise(state)
    return log.join(events, "id").select(
        job_name("conn_hash", database_name("conn_hash"), tab).alias("job_name"), F.concat(F.lit("e"), "id").alias("job_id"), state.alias("state"),
        F.col("timestamp").alias("ts"), e.alias("seq"), F.when(e % 3 == 0, F.concat(F.lit("x"), "id")).alias("database"),
        F.lower(tab).alias("table"), F.lit("unknown").alias("conn_hash"),
    )


# every seventh record is of a table that has no state yet
@query("sync_state_update", ST + f""", {FEED}, old AS (SELECT * FROM state),
f AS (SELECT job_name, arg_max(job_id, (ts, seq)) AS job_id, max(ts) AS ts, arg_max(state LIKE 'INC%', (ts, seq)) FILTER (state <> 'OTHER') AS ready,
 arg_max(state LIKE 'INC%', (ts, seq)) FILTER (state NOT IN ('OTHER', 'FAILED')) AS snap, arg_min(database, (ts, seq)) FILTER (database IS NOT NULL) AS database,
 arg_min(tab, (ts, seq)) AS tab, any_value(conn) AS conn FROM feed GROUP BY 1)
SELECT COALESCE(o.job_name, f.job_name) AS job_name, COALESCE(o.conn_hash, f.conn) AS conn_hash, COALESCE(o.database, f.database) AS database,
COALESCE(o.table_name, f.tab) AS table_name, COALESCE(f.job_id, o.job_id) AS job_id, o.rule_id, COALESCE(f.ready, o.ready, false) AS ready,
COALESCE(f.snap, o.snapshot_finished, false) AS snapshot_finished, COALESCE(f.ts, o.update_time) AS update_time FROM old o FULL JOIN f ON o.job_name = f.job_name""")
def sync_state_update(spark, sf):
    return sy.sync_state_update(sync_state(spark, sf).drop("cdc_state"), _feed(spark, sf))


@query("snapshot_finished_fanout", ST + """, note AS (SELECT lower(unnest(['archive', 'Reviews', tab])) AS t, CASE WHEN event_id % 2 = 0 THEN 'n' || id ELSE '' END AS job, timestamp AS ts
 FROM log_tables WHERE event_type = 'error'), last AS (SELECT t, arg_max(job, (ts, job)) AS job, max(ts) AS ts FROM note GROUP BY 1)
SELECT job_name, COALESCE(job, job_id) AS job_id, job IS NOT NULL OR ready AS ready, job IS NOT NULL OR snapshot_finished AS snapshot_finished,
COALESCE(ts, update_time) AS update_time FROM state LEFT JOIN last ON t = table_name""")
def snapshot_finished_fanout(spark, sf):
    names = F.concat(F.lit("[shop.archive, a.b.Reviews,shop."), F.regexp_replace("table_names", ",", ", shop."), F.lit("]"))
    notices = statement_log(spark, sf).filter(F.col("has_error") & (F.col("table_names") != "")).select(
        names.alias("tables"), F.when(F.col("id").cast("long") % 2 == 0, F.concat(F.lit("n"), "id")).alias("job_id"), F.col("timestamp").alias("ts")
    )
    out = sy.snapshot_finished_fanout(notices, sync_state(spark, sf))
    return out.select("job_name", "job_id", "ready", "snapshot_finished", "update_time")


@query("rule_state_seed", RS + f""", rs AS (SELECT rule_id, pos, tp, enabled, conn_hash, db, lower(trim(raw)) AS t, job_ids, {job_name_sql('conn_hash', 'db', 'raw')} AS job_name FROM
 (SELECT *, {b.DATABASE_OF_CONN} AS db FROM rt) WHERE db IS NOT NULL),
s AS (SELECT job_name, arg_min(conn_hash, (pos, tp)) AS conn_hash, arg_min(db, (pos, tp)) AS db, arg_min(t, (pos, tp)) AS t, arg_max(rule_id, (pos, tp)) AS rule_id,
 arg_max(job_ids[t], (pos, tp)) FILTER (job_ids[t] IS NOT NULL) AS job FROM rs WHERE enabled GROUP BY 1),
m AS (SELECT COALESCE(o.job_name, s.job_name) AS job_name, COALESCE(o.conn_hash, s.conn_hash) AS conn_hash, COALESCE(o.database, s.db) AS database,
 COALESCE(o.table_name, s.t) AS table_name, COALESCE(s.job, o.job_id) AS job_id, COALESCE(s.rule_id, o.rule_id) AS rule_id, COALESCE(o.ready, false) AS ready,
 COALESCE(o.snapshot_finished, false) AS snapshot_finished, COALESCE(o.update_time, 0) AS update_time FROM state o FULL JOIN s ON o.job_name = s.job_name)
SELECT * FROM m WHERE job_name NOT IN (SELECT job_name FROM rs WHERE pos % 11 = 3)""")
def rule_state_seed(spark, sf):
    rules = _rules(spark, sf)
    return sy.rule_state_seed(rules, sync_state(spark, sf).drop("cdc_state"), rules.filter(F.col("pos") % 11 == 3))


# ---- routing -----------------------------------------------------------------

# tables of a statement, t,t folded to t
READY = ST + f""", st AS (SELECT id, event_id, conn_hash, {b.DATABASE_OF_CONN} AS db, NULLIF(unnest(string_split(CASE table_names WHEN 't,t' THEN 't' ELSE table_names END, ',')), '') AS tab FROM log),
j AS (SELECT st.id, st.event_id, st.conn_hash, st.tab, CASE WHEN st.tab IS NOT NULL AND db IS NOT NULL THEN {job_name_sql('st.conn_hash', 'db', 'tab')} END AS job_name FROM st),
ready AS (SELECT j.id, j.event_id, j.conn_hash, j.tab, j.job_name, COALESCE(s.ready AND {NOW} - s.update_time <= 300000, false) AS available,
 COALESCE(s.ready AND {NOW} - s.update_time <= 300000 AND s.cdc_state = 'INCREMENTAL_IDLE', false) AS idle FROM j LEFT JOIN state s ON s.job_name = j.job_name) """


@query("table_ready_join", READY + 'SELECT id, conn_hash, tab AS "table", job_name, available FROM ready')
def table_ready_join(spark, sf):
    return sy.table_ready_join(statement_log(spark, sf), sync_state(spark, sf), NOW)


SKIPS = READY + """, t AS (SELECT event_id, CASE WHEN user_id % 10 = 9 THEN NULL ELSE user_id % 6 END AS session, event_id // 50 AS txn, timestamp,
query_type NOT IN ('SELECT', 'UNKNOWN') AS is_write, (event_id // 50) % 4 <> 3 AS active, user_id % 7 = 0 AS read_only FROM log),
k AS (SELECT event_id, active AND NOT read_only AND NOT is_write AND (session IS NULL OR COALESCE(bool_or(is_write) OVER
(PARTITION BY session, txn ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS skip FROM t)
SELECT id, CASE WHEN any_value(skip) THEN 'skip' WHEN bool_and({flag} AND tab IS NOT NULL) THEN 'replica' ELSE 'source' END AS route, count(tab) AS n_tables
FROM ready JOIN k ON k.event_id = ready.event_id GROUP BY id"""


def _route(spark, sf, strict):
    skip = health.dirty_transaction(transactions(spark, sf), order=["timestamp", "event_id"]).filter("skip")
    skips = skip.select(F.col("event_id").cast("string").alias("id"))
    return sy.route_decision(statement_log(spark, sf), sync_state(spark, sf), NOW, strict, skips)


@query("route_decision", SKIPS.replace("{flag}", "available"))
def route_decision(spark, sf):
    return _route(spark, sf, False)


@query("route_decision_strict", SKIPS.replace("{flag}", "idle"))
def route_decision_strict(spark, sf):
    return _route(spark, sf, True)


