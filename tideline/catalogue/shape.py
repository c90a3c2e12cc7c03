"""Scalar functions and value shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bindings import table
from tideline.catalogue.base import query
from tideline.functions import shape as sh


@query("text_functions", """SELECT c_custkey, concat(c_mktsegment, ' ', c_name) AS joined, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS padded, lower(c_name) AS low,
upper(c_mktsegment) AS up, trim('  ' || c_name || ' ') AS trimmed FROM customer""")
def text_functions(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.concat("c_mktsegment", F.lit(" "), "c_name").alias("joined"), F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("padded"),
        F.lower("c_name").alias("low"), F.upper("c_mktsegment").alias("up"),
        F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("trimmed"),
    )


@query("number_functions", """SELECT p_partkey, CAST(round(CAST(p_retailprice AS DECIMAL(18,2)) * 3 + 1 - 0.25, 1) AS DOUBLE) AS r, greatest(p_size - 20, 0) AS need, p_partkey % 7 AS m FROM part""")
def number_functions(spark, sf):
    price = F.col("p_retailprice").cast("decimal(18,2)")
    quarter = F.lit("0.25").cast("decimal(3,2)")
    return table(spark, sf, "part").select(
        "p_partkey", F.round(price * 3 + 1 - quarter, 1).cast("double").alias("r"), F.greatest(F.col("p_size") - 20, F.lit(0)).alias("need"),
        (F.col("p_partkey") % 7).alias("m"),
    )


@query("case_functions", """SELECT s_suppkey, COALESCE(NULLIF(s_nationkey, 3), -1) AS nation, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END AS level,
CASE s_suppkey % 4 WHEN 0 THEN 'NY' WHEN 1 THEN 'CA' WHEN 2 THEN 'NSW' ELSE 'SP' END AS state FROM supplier""")
def case_functions(spark, sf):
    s = F.col("s_suppkey") % 4
    return table(spark, sf, "supplier").select(
        "s_suppkey", F.ifnull(F.nullif("s_nationkey", F.lit(3)), F.lit(-1)).alias("nation"),
        F.when(F.col("s_acctbal") < 0, "debt").when(F.col("s_acctbal") < 5000, "low").otherwise("high").alias("level"),
        F.when(s == 0, "NY").when(s == 1, "CA").when(s == 2, "NSW").otherwise("SP").alias("state"),
    )


@query("date_functions", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(CAST(strftime(o_orderdate, '%Y-%m') || '-01' AS DATE) - INTERVAL 2 MONTH, '%Y-%m-01') AS two_back,
strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS due FROM orders""")
def date_functions(spark, sf):
    month = F.date_format("o_orderdate", "yyyy-MM")
    first = F.to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey", month.alias("month"), F.date_format(F.add_months(first, -2), "yyyy-MM-'01'").alias("two_back"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), 40), "yyyy-MM-dd").alias("due"),
    )


@query("oracle_functions", """SELECT event_id, COALESCE(NULLIF(event_type, 'error'), 'Unknown') AS name, CASE user_id % 3 WHEN 1 THEN 'Active' WHEN 2 THEN 'Idle' ELSE 'Inactive' END AS status,
strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events""")
def oracle_functions(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", sh.oracle_nvl(F.nullif("event_type", F.lit("error")), "Unknown").alias("name"),
        sh.oracle_decode(F.col("user_id") % 3, 1, "Active", 2, "Idle", "Inactive").alias("status"), sh.oracle_to_char("ts").alias("at"),
    )


@query("oracle_shape", """SELECT CAST(event_id AS DECIMAL(19,0)) AS "EVENT_ID", CAST(user_id % 5 AS DECIMAL(10,0)) AS "BUCKET",
NULLIF(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '') AS "EVENT_TYPE", value AS "VALUE" FROM events""")
def oracle_shape(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 5).cast("int").alias("bucket"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("event_type"), "value"
    )
    return sh.oracle_shape(rows)


CTRL = "chr(1) || chr(2) || chr(3) || chr(4)"


@query("display_value", f"""SELECT event_id, base64(event_type::BLOB) AS raw, strftime(ts, '%Y-%m-%dT%H:%M') ||
 CASE WHEN epoch_us(ts) % 60000000 = 0 THEN '' WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, ':%S') WHEN epoch_us(ts) % 1000 = 0 THEN strftime(ts, ':%S') || '.' || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0')
 ELSE strftime(ts, ':%S.%f') END || 'Z' AS at,
 rtrim(rtrim(CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR), '0'), '.') AS amount,
 CASE user_id % 3 WHEN 0 THEN base64(({CTRL} || event_type)::BLOB) WHEN 1 THEN chr(1) || event_type ELSE event_type END AS note FROM events""")
def display_value(spark, sf):
    few, many = F.lit("\x01"), F.lit("\x01\x02\x03\x04")
    u = F.col("user_id") % 3
    rows = table(spark, sf, "events").select(
        "event_id", F.col("event_type").cast("binary").alias("raw"), F.col("ts").cast("timestamp").alias("at"),
        F.col("value").cast("decimal(18,4)").alias("amount"),
        F.when(u == 0, F.concat(many, "event_type")).when(u == 1, F.concat(few, "event_type")).otherwise(F.col("event_type")).alias("note"),
    )
    return sh.display_value(rows)


@query("year_value", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def year_value(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", sh.year_value("o_orderdate").alias("y"))


@query("offset_timestamp", "SELECT event_id, strftime(ts - to_minutes(CAST((user_id % 9 - 4) * 30 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def offset_timestamp(spark, sf):
    minutes = ((F.col("user_id") % 9 - 4) * 30).cast("int")
    return table(spark, sf, "events").select("event_id", F.date_format(sh.offset_timestamp("ts", minutes), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("json_fields", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", sh.json_fields("props", "k int").alias("j")).select("event_id", "j.k")


@query("json_or_text", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) END AS k,
CASE WHEN event_id % 2 = 1 THEN event_type END AS note FROM events""")
def json_or_text(spark, sf):
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", sh.json_or_text(raw, "k int, note string", "note").alias("j")).select("event_id", "j.*")


@query("map_lookup_ci", "SELECT event_id, CASE WHEN event_type = 'view' THEN user_id WHEN event_type = 'click' THEN event_id END AS hit FROM events")
def map_lookup_ci(spark, sf):
    mapping = F.create_map(F.lit("view"), F.col("user_id"), F.lit("click"), F.col("event_id"))
    key = F.concat(F.lit(" "), F.initcap("event_type"))
    return table(spark, sf, "events").select("event_id", sh.map_lookup_ci(mapping, key).alias("hit"))


@query("hash_functions", "SELECT c_custkey, md5(c_name) AS m, hex(c_name) AS h, url_encode('a ' || c_name) AS u FROM customer")
def hash_functions(spark, sf):
    # a blank is '+' in form encoding and %20 in plain percent encoding
    plain = F.replace(F.url_encode(F.concat(F.lit("a "), "c_name")), F.lit("+"), F.lit("%20"))
    return table(spark, sf, "customer").select("c_custkey", F.md5("c_name").alias("m"), F.hex("c_name").alias("h"), plain.alias("u"))


@query("seeded_int")
def seeded_int(spark, sf):
    """Spread of the repeatable numbers over ten buckets."""
    return table(spark, sf, "events").groupBy(sh.seeded_int("event_id", 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
