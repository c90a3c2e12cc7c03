"""Metric series and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bindings import COUNTERS_SQL, LINES_SQL, OUTCOMES_SQL, counters, labels_text, log_lines, outcomes, table
from tideline.catalogue.base import query
from tideline.operators import logs as lg, relational as re, series as se

K = f"WITH {COUNTERS_SQL} "
LABELS = "'host=' || host || ',type=' || type"


def _text(df, *cols):
    """Labels as text and the instant as epoch seconds."""
    return df.select(F.unix_seconds("ts").alias("sec"), labels_text().alias("labels"), *cols)


def _r(c, places=6):
    return F.round(c, places).alias(c)


# ---- samples -----------------------------------------------------------------

SAMPLES = """wide AS (SELECT epoch_us(ts) // 1000000 // 3600 * 3600 AS sec, ts, event_type, 'h' || (user_id % 3) AS host, value, CAST(event_id AS DOUBLE) AS event_id FROM events),
last AS (SELECT sec, event_type, host, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id FROM wide GROUP BY 1, 2, 3),
samples AS (SELECT sec, 'value' AS name, 'event_type=' || event_type || ',host=' || host AS labels, event_type AS type, host, value AS v FROM last
 UNION ALL SELECT sec, 'event_id', 'event_type=' || event_type || ',host=' || host, event_type, host, event_id FROM last)"""
W = f"WITH {SAMPLES} "


def hourly(spark, sf):
    wide = table(spark, sf, "events").withColumn("host", F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string")))
    return se.metric_samples(wide.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type", "host"], ["value", "event_id"], 3600)


@query("metric_samples", W + "SELECT sec, name, labels, v AS value FROM samples")
def metric_samples(spark, sf):
    return _text(hourly(spark, sf), "name", "value")


@query("label_filter", W + "SELECT sec, name, labels, v AS value FROM samples WHERE type IN ('view', 'click') AND host <> 'h1' AND type <> 'error'")
def label_filter(spark, sf):
    conds = {"event_type": ("=~", "view|cli.*"), "host": ("!=", "h1"), "zone": ("!~", ".+")}
    return _text(se.label_filter(hourly(spark, sf), conds), "name", "value")


# ---- counters ----------------------------------------------------------------

STEPS = """steps AS (SELECT sec, type, host, value, CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END AS step FROM
 (SELECT *, lag(value) OVER (PARTITION BY type, host ORDER BY ts) AS p FROM counters)),
grid AS (SELECT unnest(generate_series((SELECT min(sec) FROM counters) // 900 * 900, (SELECT max(sec) FROM counters) + 7200, 900)) AS e)"""
WINDOWED = f"SELECT e AS sec, {LABELS} AS labels, {{agg}} AS value FROM grid JOIN steps ON sec >= e - 3600 AND sec < e GROUP BY ALL"


@query("counter_increase", K + f", {STEPS} " + WINDOWED.format(agg="round(sum(step), 6)"))
def counter_increase(spark, sf):
    return _text(se.counter_increase(counters(spark, sf), 3600, 900), _r("value"))


@query("counter_rate", K + f", {STEPS} " + WINDOWED.format(agg="round(sum(step) / 3600, 9)"))
def counter_rate(spark, sf):
    return _text(se.counter_rate(counters(spark, sf), 3600, 900), _r("value", 9))


@query("max_over_time", K + f", {STEPS} " + WINDOWED.format(agg="max(value)"))
def max_over_time(spark, sf):
    return _text(se.max_over_time(counters(spark, sf), 3600, 900), "value")


# ---- aggregation over labels -------------------------------------------------


@query("sum_by", W + "SELECT sec, 'host=' || host AS labels, round(sum(v), 6) AS value FROM samples WHERE name = 'value' GROUP BY ALL")
def sum_by(spark, sf):
    return _text(se.sum_by(hourly(spark, sf).filter("name = 'value'"), ["host"]), _r("value"))


@query("count_by", W + "SELECT sec, 'event_type=' || type AS labels, CAST(count(*) AS DOUBLE) AS value FROM samples WHERE name = 'value' GROUP BY ALL")
def count_by(spark, sf):
    return _text(se.count_by(hourly(spark, sf).filter("name = 'value'"), ["event_type"]), "value")


@query("max_by", W + "SELECT sec, '' AS labels, max(v) AS value FROM samples WHERE name = 'value' GROUP BY sec")
def max_by(spark, sf):
    return _text(se.max_by(hourly(spark, sf).filter("name = 'value'")), "value")


VEC = W + """, a AS (SELECT sec, labels, type, host, v FROM samples WHERE name = 'value'), b AS (SELECT sec, labels, type, host, v FROM samples WHERE name = 'event_id') """


def _vectors(spark, sf):
    s = hourly(spark, sf)
    return s.filter("name = 'value'"), s.filter("name = 'event_id'")


@query("label_vector_join", VEC + 'SELECT sec, a.labels, a.v AS "left", b.v AS "right" FROM a JOIN b USING (sec, labels)')
def label_vector_join(spark, sf):
    return _text(se.label_vector_join(*_vectors(spark, sf)), "left", "right")


@query("vector_ratio", VEC + "SELECT sec, a.labels, round(a.v / NULLIF(b.v, 0) * 1000, 6) AS value FROM a JOIN b USING (sec, labels)")
def vector_ratio(spark, sf):
    return _text(se.vector_ratio(*_vectors(spark, sf), scale=1000), _r("value"))


@query("vector_share", VEC + ", ah AS (SELECT sec, host, sum(v) AS v FROM a GROUP BY ALL), bh AS (SELECT sec, host, sum(v) AS v FROM b GROUP BY ALL) SELECT sec, 'host=' || host AS labels, round(ah.v / (ah.v + bh.v), 6) AS value FROM ah JOIN bh USING (sec, host)")
def vector_share(spark, sf):
    """Hit-rate form: a / (a + b) after adding up each side per host."""
    left, right = _vectors(spark, sf)
    return _text(se.vector_ratio(se.sum_by(left, ["host"]), se.sum_by(right, ["host"]), on=["host"], part_of_sum=True), _r("value"))


@query("offset", W + "SELECT a.sec, a.name, a.labels, round(a.v - b.v, 6) AS delta FROM samples a JOIN samples b ON b.name = a.name AND b.labels = a.labels AND b.sec = a.sec - 3600")
def offset(spark, sf):
    return _text(se.offset(hourly(spark, sf), 3600), "name", _r("delta"))


@query("offset_delta", """WITH m AS (SELECT event_type, epoch_us(ts) // 60000000 * 60 AS sec, count(*) AS n FROM events GROUP BY ALL)
SELECT a.event_type, a.sec, a.n - b.n AS delta FROM m a JOIN m b ON b.event_type = a.event_type AND b.sec = a.sec - 60""")
def offset_delta(spark, sf):
    """Events per minute against the minute before."""
    minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    per = table(spark, sf, "events").groupBy("event_type", minute.alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    out = re.offset_delta(per, ["event_type"], "ts", "n", 60)
    return out.select("event_type", F.unix_seconds("ts").alias("sec"), "delta")


@query("top_k_per_instant", """SELECT day, user_id, n, place FROM (SELECT CAST(ts AS DATE)::VARCHAR AS day, user_id, count(*) AS n,
CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY count(*) DESC, user_id) AS INTEGER) AS place FROM events GROUP BY 1, CAST(ts AS DATE), 2) WHERE place <= 5""")
def top_k_per_instant(spark, sf):
    per_day = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    out = re.top_k_per_instant(per_day, "day", [F.desc("n"), F.asc("user_id")], 5)
    return out.withColumnRenamed("rn", "place")


@query("topk", W + """SELECT sec, name, labels, value, place FROM (SELECT sec, name, labels, v AS value,
CAST(row_number() OVER (PARTITION BY sec ORDER BY v DESC, name, labels) AS INTEGER) AS place FROM samples) WHERE place <= 5""")
def topk(spark, sf):
    return _text(se.topk(hourly(spark, sf), 5), "name", "value", "place")


BOUNDS = [1.0, 10.0, 50.0, 100.0, 200.0, float("inf")]
HIST = """WITH v AS (SELECT epoch_us(ts) // 1000000 // 21600 * 21600 AS sec, event_type, value FROM events),
b AS (SELECT sec, event_type, le, CAST(count(*) FILTER (value <= le) AS DOUBLE) AS c FROM v, (VALUES (1.0::DOUBLE), (10), (50), (100), (200), ('inf'::DOUBLE)) t(le) GROUP BY ALL),
w AS (SELECT *, max(c) OVER g AS total, lag(le) OVER s AS low, lag(c) OVER s AS lowc FROM b WINDOW g AS (PARTITION BY sec, event_type), s AS (PARTITION BY sec, event_type ORDER BY le)),
h AS (SELECT * FROM w WHERE c >= 0.95 * total QUALIFY row_number() OVER (PARTITION BY sec, event_type ORDER BY le) = 1)
SELECT event_type, sec, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE COALESCE(low, 0) + (le - COALESCE(low, 0)) * (0.95 * total - COALESCE(lowc, 0)) / (c - COALESCE(lowc, 0)) END, 6) AS value FROM h"""


@query("histogram_quantile", HIST)
def histogram_quantile(spark, sf):
    at = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600) * 21600)
    le = F.explode(F.array(*[F.lit(x) for x in BOUNDS]))
    rows = table(spark, sf, "events").select("event_type", at.alias("ts"), "value", le.alias("le"))
    buckets = rows.groupBy("event_type", "ts", "le").agg(F.count_if(F.col("value") <= F.col("le")).cast("double").alias("value"))
    out = se.histogram_quantile(0.95, buckets, ["event_type"])
    return out.select("event_type", F.unix_seconds("ts").alias("sec"), _r("value"))


@query("tumbling_outcomes", f"""WITH {OUTCOMES_SQL} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) FILTER (outcome = 'hit') AS hits,
count(*) FILTER (outcome = 'miss') AS misses FROM outcomes GROUP BY 1""")
def tumbling_outcomes(spark, sf):
    out = se.tumbling_outcomes(outcomes(spark, sf))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "hits", "misses")


# ---- logs --------------------------------------------------------------------

LN = f"WITH {LINES_SQL} "
FLAT = "COALESCE(service, 'unknown') AS service, COALESCE(level, 'INFO') AS level, container"


def nested_logs(spark, sf):
    """One nested answer per conversation, as a log store delivers it: the lines of a turn are a stream."""
    lines = log_lines(spark, sf)
    labels = F.map_filter(
        F.create_map(F.lit("service"), "service", F.lit("level"), "level", F.lit("container_name"), "container"), lambda k, v: v.isNotNull()
    )
    return lines.select(F.array(F.struct(labels.alias("stream"), F.array(F.array(F.col("ns").cast("string"), F.col("message"))).alias("values"))).alias("result"))


def flat(spark, sf):
    return lg.log_flatten(nested_logs(spark, sf))


@query("log_flatten", LN + f"SELECT ns // 1000000 AS ms, message, {FLAT}, trace_id FROM lines")
def log_flatten(spark, sf):
    return flat(spark, sf).select(F.unix_millis("ts").alias("ms"), "message", "service", "level", "container", "trace_id")


@query("log_filter", LN + f", f AS (SELECT message, {FLAT} FROM lines) SELECT message FROM f WHERE regexp_full_match(service, 'app-.*|shop') AND level = 'INFO' AND container = 'pod-user' AND contains(message, 'en') AND contains(message, 'ession')")
def log_filter(spark, sf):
    out = lg.log_filter(flat(spark, sf), "all", "INFO", "pod-user", "en", "ession", default_services="app-.*|shop")
    return out.select("message")


# the timing of a statement is written into its log line, in one of four spellings
TIMED = "CASE user_id % 5 WHEN 0 THEN '慢查询 ' || value WHEN 1 THEN '耗时 ' || event_id || 'ms' WHEN 2 THEN 'slow ' || event_type WHEN 3 THEN 'timeout' ELSE 'fine ' || event_type END"


@query("slow_log_filter", "SELECT event_id FROM events WHERE user_id % 5 <> 4")
def slow_log_filter(spark, sf):
    lines = table(spark, sf, "events").select("event_id", F.expr(TIMED).alias("message"))
    return lg.slow_log_filter(lines).select("event_id")


@query("error_log_filter", LN + f", f AS (SELECT message, {FLAT} FROM lines) SELECT message FROM f WHERE level = 'ERROR'")
def error_log_filter(spark, sf):
    return lg.error_log_filter(flat(spark, sf)).select("message")
