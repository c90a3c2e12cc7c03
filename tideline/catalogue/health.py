"""Rates, latency, averages, alerts, transactions and breakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bindings import LOG_SQL, OUTCOMES_SQL, outcomes, statement_log, table
from tideline.catalogue.base import query
from tideline.functions.sql_text import is_write
from tideline.operators import health as h

O = f"WITH {OUTCOMES_SQL} "
L = f"WITH {LOG_SQL} "


def _round(df, **places):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


@query("outcome_counts", O + """SELECT datasource, count_if(outcome = 'hit') AS hit, count_if(outcome = 'miss') AS miss, count_if(outcome = 'skip') AS skip,
count_if(outcome = 'success') AS success, count_if(outcome = 'error') AS error FROM outcomes GROUP BY 1""".replace("count_if(outcome = ", "count(*) FILTER (outcome = "))
def outcome_counts(spark, sf):
    return h.outcome_counts(outcomes(spark, sf), ["datasource"])


HIT = "count(*) FILTER (outcome = 'hit')"
MISS = "count(*) FILTER (outcome = 'miss')"


@query("hit_rate", O + f"SELECT datasource, CASE WHEN {HIT} + {MISS} > 0 THEN round({HIT} / ({HIT} + {MISS}), 6) ELSE 0.0 END AS hit_rate FROM outcomes GROUP BY 1")
def hit_rate(spark, sf):
    return _round(h.hit_rate(outcomes(spark, sf), ["datasource"]), hit_rate=6)


@query("slow_rate", L + "SELECT conn_hash, round(count(*) FILTER (execution_time > 5000) / count(*), 6) AS slow_rate FROM log GROUP BY 1")
def slow_rate(spark, sf):
    return _round(h.slow_rate(statement_log(spark, sf), by=["conn_hash"]), slow_rate=6)


@query("success_rate", L + "SELECT conn_hash, round(100.0 * count(*) FILTER (NOT has_error) / count(*), 6) AS success_rate FROM log GROUP BY 1")
def success_rate(spark, sf):
    return _round(h.success_rate(statement_log(spark, sf), ["conn_hash"]), success_rate=6)


@query("mean_time", L + "SELECT conn_hash, round(avg(execution_time), 4) AS mean_time FROM log GROUP BY 1")
def mean_time(spark, sf):
    return _round(h.mean_time(statement_log(spark, sf), ["conn_hash"]), mean_time=4)


RUN = "outcome IN ('success', 'error')"
SUMMARY = f"""SELECT datasource, count(*) FILTER ({RUN}) AS total_queries, count(*) FILTER ({RUN} AND execution_time > 5000) AS slow_queries,
{HIT} AS cache_hits, {MISS} AS cache_misses, count(*) FILTER (outcome = 'skip') AS cache_skips, count(*) FILTER (outcome = 'error') AS errors,
round({HIT} / ({HIT} + {MISS}), 6) AS hit_rate, round(count(*) FILTER ({RUN} AND execution_time > 5000) / count(*) FILTER ({RUN}), 6) AS slow_rate,
round(100.0 * count(*) FILTER (outcome = 'success') / count(*) FILTER ({RUN}), 6) AS success_rate, round(avg(execution_time) FILTER ({RUN}), 4) AS mean_time
FROM outcomes GROUP BY 1"""


@query("performance_summary", O + SUMMARY)
def performance_summary(spark, sf):
    out = h.performance_summary(outcomes(spark, sf), ["datasource"])
    return _round(out, hit_rate=6, slow_rate=6, success_rate=6, mean_time=4)


@query("threshold_alerts", O + f""", s AS ({SUMMARY}), c AS (SELECT *, 80.0 + cache_skips % 20 AS cpu FROM s)
SELECT datasource, 'slow_query' AS alert, 'warning' AS level, CAST(slow_rate AS DOUBLE) AS current, CAST(0.1 AS DOUBLE) AS threshold FROM c WHERE slow_rate > 0.1 UNION ALL
SELECT datasource, 'cache_hit_rate', 'warning', hit_rate, 0.8 FROM c WHERE hit_rate < 0.8 AND cache_hits + cache_misses > 100 UNION ALL
SELECT datasource, 'cpu', 'error', cpu, 85.0 FROM c WHERE cpu > 85""")
def threshold_alerts(spark, sf):
    summary = h.performance_summary(outcomes(spark, sf), ["datasource"]).withColumn("cpu", 80.0 + F.col("cache_skips") % 20)
    return _round(h.threshold_alerts(summary, ["datasource"], "cpu"), current=6)


@query("latency_percentiles", """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def latency_percentiles(spark, sf):
    return _round(h.latency_percentiles(table(spark, sf, "events"), ["event_type"], "value"), p50=6, p95=6, p99=6)


@query("speedup", """WITH d AS (SELECT user_id % 5 AS host, event_type, value FROM events)
SELECT host, round(quantile_cont(value * 3, 0.5) FILTER (event_type = 'click'), 6) AS p50_original,
round(quantile_cont(value, 0.5) FILTER (event_type = 'view'), 6) AS p50_cached,
round(quantile_cont(value * 3, 0.5) FILTER (event_type = 'click') / quantile_cont(value, 0.5) FILTER (event_type = 'view'), 6) AS speedup FROM d GROUP BY 1""")
def speedup(spark, sf):
    click = F.col("event_type") == "click"
    rows = table(spark, sf, "events").select(
        (F.col("user_id") % 5).alias("host"),
        F.when(click, "original").when(F.col("event_type") == "view", "cached").alias("kind"),
        F.when(click, F.col("value") * 3).otherwise(F.col("value")).alias("latency"),
    )
    return _round(h.speedup(rows, ["host"]), p50_original=6, p50_cached=6, speedup=6)


EWMA = L + """, e AS (SELECT client_uuid, list_reduce(list(CAST(execution_time AS DOUBLE) ORDER BY timestamp, event_id), lambda a, x: (a * 4 + x) / 5) AS ewma,
count(*) AS executions FROM log GROUP BY 1) """


def _ewma(spark, sf):
    return h.ewma_per_statement(statement_log(spark, sf), "client_uuid", "execution_time", ["timestamp", "id"])


@query("ewma_per_statement", EWMA + "SELECT client_uuid, round(ewma, 4) AS ewma, executions FROM e")
def ewma_per_statement(spark, sf):
    return _round(_ewma(spark, sf), ewma=4)


@query("slow_classification", EWMA + """SELECT client_uuid, round(ewma, 4) AS ewma, executions, round((SELECT avg(ewma) FROM e), 4) AS overall,
ewma >= 2 * (SELECT avg(ewma) FROM e) AS is_slow FROM e""")
def slow_classification(spark, sf):
    return _round(h.slow_classification(_ewma(spark, sf)), ewma=4, overall=4)


TXN = L + """, t AS (SELECT event_id, CASE WHEN user_id % 10 = 9 THEN NULL ELSE user_id % 6 END AS session, event_id // 50 AS txn, timestamp,
query_type NOT IN ('SELECT', 'UNKNOWN') AS is_write, (event_id // 50) % 4 <> 3 AS active, user_id % 7 = 0 AS read_only FROM log)
SELECT event_id, active AND NOT read_only AND NOT is_write AND (session IS NULL OR COALESCE(bool_or(is_write) OVER
(PARTITION BY session, txn ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS skip FROM t"""


def transactions(spark, sf):
    log = statement_log(spark, sf)
    e = F.col("id").cast("long")
    user = F.split_part("client_uuid", F.lit("-"), F.lit(2)).cast("long")
    return log.select(
        e.alias("event_id"), F.when(user % 10 != 9, user % 6).alias("session"), F.floor(e / 50).alias("txn"), "timestamp",
        is_write("sql").alias("is_write"), (F.floor(e / 50) % 4 != 3).alias("in_transaction"), (user % 7 == 0).alias("read_only"),
    )


@query("dirty_transaction", TXN)
def dirty_transaction(spark, sf):
    return h.dirty_transaction(transactions(spark, sf), order=["timestamp", "event_id"]).select("event_id", "skip")


BREAKER = """WITH RECURSIVE calls AS MATERIALIZED (SELECT 'k' || (user_id % 12) AS key, event_id * 700 AS ts, event_id, event_type IN ('purchase', 'signup') AS ok,
 row_number() OVER (PARTITION BY user_id % 12 ORDER BY event_id) AS rn FROM events),
fold AS (SELECT key, 0::BIGINT AS rn, 0::BIGINT AS ts, 0::BIGINT AS event_id, false AS refused, 0 AS n, 0::BIGINT AS until FROM (SELECT DISTINCT key FROM calls)
 UNION ALL SELECT key, rn, ts, event_id, b, CASE WHEN b THEN n WHEN ok THEN 0 ELSE n + 1 END,
  CASE WHEN b THEN until WHEN ok THEN 0 WHEN n + 1 >= 3 THEN greatest(until, ts + 60000) ELSE until END
 FROM (SELECT c.key, c.rn, c.ts, c.event_id, c.ok, f.n, f.until, f.n >= 3 AND c.ts <= f.until AS b FROM fold f JOIN calls c ON c.key = f.key AND c.rn = f.rn + 1))
SELECT key, ts, event_id, refused, n AS failures, until AS open_until FROM fold WHERE rn > 0"""


def breaker_calls(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("k"), (F.col("user_id") % 12).cast("string")).alias("key"), (F.col("event_id") * 700).alias("ts"), "event_id",
        F.col("event_type").isin("purchase", "signup").alias("ok"),
    )


@query("failure_breaker", BREAKER)
def failure_breaker(spark, sf):
    return h.failure_breaker(breaker_calls(spark, sf), "key", ["ts", "event_id"], "ok")
