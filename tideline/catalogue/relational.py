"""Filters, joins, aggregates, windows, sorting and sets on the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.bindings import table
from tideline.catalogue.base import query
from tideline.operators import mutation as mu, relational as re
from tideline.operators.pages import page_index

# mean of money rounded half up to cents, in whole numbers
MEAN_CENTS = "((2 * CAST(SUM(b.rev) * 100 AS HUGEINT) + COUNT(*)) // (2 * COUNT(*))) / 100.0"


def _t(spark, sf, name):
    return table(spark, sf, name)


def _money(c):
    return F.col(c).cast("decimal(18,2)")


# ---- filters -----------------------------------------------------------------


@query("point_filter", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 77")
def point_filter(spark, sf):
    sql = "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_custkey = :cust"
    return re.bind_query(spark, sql, {"cust": 77}, orders=_t(spark, sf, "orders"))


@query("like_filter", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%2'")
def like_filter(spark, sf):
    return re.like_filter(_t(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "%2")


@query("contains_filter", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_brand), 'brand#1')")
def contains_filter(spark, sf):
    return re.contains_filter(_t(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), {"p_name": "RED", "p_brand": "brand#1"})


# ---- mutation ----------------------------------------------------------------


@query("update_where", """SELECT p_partkey, CASE WHEN p_size = 7 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice, p_size FROM part""")
def update_where(spark, sf):
    part = _t(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return mu.update_where(part, F.col("p_size") == 7, {"p_retailprice": F.col("p_retailprice") + 1})


# the condition is NULL for size 3, and such rows stay
@query("delete_where", """SELECT p_partkey, p_size, p_brand FROM part
WHERE NOT COALESCE(NULLIF(p_size, 3) < 10 AND p_brand <> 'Brand#1', false)""")
def delete_where(spark, sf):
    part = _t(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    return mu.delete_where(part, (F.nullif("p_size", F.lit(3)) < 10) & (F.col("p_brand") != "Brand#1"))


@query("insert_rows", """SELECT s_suppkey, s_name FROM supplier UNION ALL
SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey), c_name FROM customer WHERE c_acctbal < 0""")
def insert_rows(spark, sf):
    supplier = _t(spark, sf, "supplier").select("s_suppkey", "s_name")
    new = _t(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select("c_custkey", F.col("c_name").alias("s_name"))
    return mu.insert_rows(
        supplier.withColumn("c_custkey", F.lit(None).cast("bigint")), new, "s_suppkey", ["c_custkey"]
    ).drop("c_custkey")


@query("upsert_accumulate", """WITH n AS (SELECT l_partkey AS k, count(*) AS c, 'line ' || max(l_linenumber) AS label FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey AS k, p_name AS label, CAST(p_size AS BIGINT) AS c FROM part)
SELECT COALESCE(p.k, n.k) AS id, COALESCE(n.label, p.label) AS label, COALESCE(p.c + n.c, n.c, p.c) AS n FROM p FULL JOIN n ON p.k = n.k""")
def upsert_accumulate(spark, sf):
    """Lines repeat their part: the last one by line number names it, all of them count."""
    have = _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_size").cast("long").alias("n"))
    new = _t(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("label"),
        F.lit(1).cast("long").alias("n"), F.col("l_linenumber").alias("_seq"),
    )
    return mu.upsert_accumulate(have, new, ["id"], ["label"], ["n"])


@query("update_from_aggregate", """WITH s AS (SELECT l_orderkey, CAST(ROUND(SUM(CAST(l_extendedprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS v FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey >= 100 THEN COALESCE(v, 0) ELSE o_totalprice END AS o_totalprice
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def update_from_aggregate(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    total = F.round(F.sum(_money("l_extendedprice")), 2)
    return mu.update_from_aggregate(
        orders, lines, "o_orderkey", "l_orderkey", "o_totalprice", total, where=F.col("o_orderkey") >= 100, default=0
    )


@query("update_from_aggregate_exists", """WITH s AS (SELECT l_orderkey, CAST(ROUND(SUM(CAST(l_extendedprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS v,
 bool_or(l_linenumber > 5) AS hit FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN COALESCE(hit, false) THEN v ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def update_from_aggregate_exists(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    lines = _t(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_linenumber")
    total = F.round(F.sum(_money("l_extendedprice")), 2)
    return mu.update_from_aggregate(
        orders, lines, "o_orderkey", "l_orderkey", "o_totalprice", total, only_with_lines=F.col("l_linenumber") > 5
    )


@query("assert_unique_key", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def assert_unique_key(spark, sf):
    return re.duplicate_keys(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ids of the buyers are shifted, so that some point to no customer
@query("orphan_rows", """SELECT o_orderkey, o_custkey + 9 AS buyer FROM orders WHERE o_custkey + 9 NOT IN (SELECT c_custkey FROM customer)""")
def orphan_rows(spark, sf):
    orders = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") + 9).alias("buyer"))
    return re.orphan_rows(orders, _t(spark, sf, "customer"), "buyer", "c_custkey")


# ---- joins -------------------------------------------------------------------


@query("inner_join_chain", """SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def inner_join_chain(spark, sf):
    """Facts are reduced to one row per customer before the chain of dimensions."""
    per_order = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    chain = re.inner_join_chain(
        [per_order, _t(spark, sf, "orders"), _t(spark, sf, "customer"), _t(spark, sf, "nation"), _t(spark, sf, "region")],
        [
            F.col("l_orderkey") == F.col("o_orderkey"), F.col("o_custkey") == F.col("c_custkey"),
            F.col("c_nationkey") == F.col("n_nationkey"), F.col("n_regionkey") == F.col("r_regionkey"),
        ],
    )
    return chain.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"))


@query("left_join", """WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS mi, count(*) AS n FROM orders GROUP BY 1)
SELECT a.mi, a.n, b.n AS n_before FROM m a LEFT JOIN m b ON b.mi = a.mi - 1""")
def left_join(spark, sf):
    m = re.month_index(F.col("o_orderdate")).alias("mi")
    months = _t(spark, sf, "orders").groupBy(m).agg(F.count(F.lit(1)).alias("n"))
    before = months.select((F.col("mi") + 1).alias("next_mi"), F.col("n").alias("n_before"))
    return re.left_join(months, before, F.col("mi") == F.col("next_mi")).select("mi", "n", "n_before")


RANGE = """WITH m AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS mi, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS rev FROM orders GROUP BY 1) SELECT a.mi, CAST(a.rev AS DOUBLE) AS rev, """


def _months(spark, sf):
    m = re.month_index(F.col("o_orderdate")).alias("mi")
    return _t(spark, sf, "orders").groupBy(m).agg(F.sum(_money("o_totalprice")).alias("rev"))


@query("range_join", RANGE + f"{MEAN_CENTS} AS rolling_avg FROM m a JOIN m b ON b.mi BETWEEN a.mi - 2 AND a.mi GROUP BY a.mi, a.rev")
def range_join(spark, sf):
    """The BETWEEN join written as the window it stands for."""
    out = re.calendar_range_avg(_months(spark, sf), "mi", "rev")
    return out.select("mi", F.col("rev").cast("double").alias("rev"), F.round("rolling_avg", 2).cast("double").alias("rolling_avg"))


@query("self_join", RANGE + """CAST(a.rev - b.rev AS DOUBLE) AS delta, CAST(a.rev - y.rev AS DOUBLE) AS delta_year
FROM m a LEFT JOIN m b ON b.mi = a.mi - 1 LEFT JOIN m y ON y.mi = a.mi - 12""")
def self_join(spark, sf):
    m = _months(spark, sf)
    prev = m.select((F.col("mi") + 1).alias("pm"), F.col("rev").alias("prev"))
    year = m.select((F.col("mi") + 12).alias("ym"), F.col("rev").alias("last_year"))
    joined = re.left_join(re.left_join(m, prev, F.col("mi") == F.col("pm")), year, F.col("mi") == F.col("ym"))
    return joined.select(
        "mi", F.col("rev").cast("double").alias("rev"), (F.col("rev") - F.col("prev")).cast("double").alias("delta"),
        (F.col("rev") - F.col("last_year")).cast("double").alias("delta_year"),
    )


@query("cross_join", "SELECT s_suppkey, line_no, 1 + (s_suppkey + line_no) % 7 AS part FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3), (4)) v(line_no)")
def cross_join(spark, sf):
    rows = re.cross_constants(_t(spark, sf, "supplier").select("s_suppkey"), [0, 1, 2, 3, 4], "line_no")
    return rows.withColumn("part", F.lit(1) + (F.col("s_suppkey") + F.col("line_no")) % 7)


@query("semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semi_join(spark, sf):
    big = _t(spark, sf, "lineitem").filter(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("o_orderkey"))
    return re.semi_join(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), big, "o_orderkey")


@query("anti_join", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark, sf):
    lines = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return re.anti_join(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey")


@query("scalar_subquery_join", """SELECT p_brand, count(*) AS n, (SELECT round(avg(l_discount), 6) FROM lineitem JOIN part p2 ON l_partkey = p2.p_partkey
WHERE p2.p_brand = p.p_brand) AS mean_discount FROM part p GROUP BY p_brand""")
def scalar_subquery_join(spark, sf):
    part = _t(spark, sf, "part").select("p_partkey", "p_brand")
    outer = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    inner = _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_discount").join(part, "p_partkey")
    return re.scalar_subquery_join(outer, inner, ["p_brand"], F.round(F.avg("l_discount"), 6).alias("mean_discount"))


# ---- aggregates --------------------------------------------------------------


@query("global_aggs", "SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, round(avg(CAST(l_quantity AS BIGINT)), 6) AS mean FROM lineitem")
def global_aggs(spark, sf):
    out = re.global_aggs(_t(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("q")), "q")
    return out.withColumn("mean", F.round("mean", 6))


@query("group_agg", """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
round(avg(l_discount), 4) AS discount FROM lineitem GROUP BY ALL""")
def group_agg(spark, sf):
    aggs = [
        F.count(F.lit(1)).alias("n"), F.sum(_money("l_extendedprice")).cast("double").alias("total"),
        F.round(F.avg("l_discount"), 4).alias("discount"),
    ]
    return re.group_agg(_t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], aggs)


@query("expr_agg", """SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS INTEGER)) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1""")
def expr_agg(spark, sf):
    out = re.expr_agg(_t(spark, sf, "lineitem"), ["l_suppkey"], _money("l_extendedprice") * F.col("l_quantity").cast("int"), "revenue")
    return out.withColumn("revenue", F.col("revenue").cast("double"))


@query("having", """SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1
HAVING count(*) > 10 AND count(DISTINCT o_orderpriority) = 5""")
def having(spark, sf):
    aggs = [F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("priorities")]
    return re.having(_t(spark, sf, "orders"), ["o_custkey"], aggs, (F.col("n") > 10) & (F.col("priorities") == 5))


@query("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def count_distinct(spark, sf):
    return re.count_distinct(_t(spark, sf, "lineitem"), ["l_returnflag"], {"parts": "l_partkey", "suppliers": "l_suppkey"})


# ---- windows -----------------------------------------------------------------


@query("rank_over_agg", """SELECT * FROM (SELECT l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(rank() OVER (ORDER BY CAST(sum(l_quantity) AS BIGINT) DESC) AS INTEGER) AS rank
FROM lineitem GROUP BY 1) ORDER BY rank, l_suppkey LIMIT 20""")
def rank_over_agg(spark, sf):
    return re.rank_over_agg(_t(spark, sf, "lineitem"), ["l_suppkey"], F.sum("l_quantity").cast("long"), "qty", 20)


@query("row_number_top", """SELECT * FROM (SELECT c_nationkey, c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rn
FROM customer) WHERE rn <= 4""")
def row_number_top(spark, sf):
    rows = _t(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return re.row_number_top(rows, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 4)


CAL = """WITH m AS (SELECT o_orderpriority AS p, year(o_orderdate) * 12 + month(o_orderdate) AS mi, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS rev
FROM orders GROUP BY ALL) """


def _by_priority(spark, sf):
    m = re.month_index(F.col("o_orderdate")).alias("mi")
    return _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), m).agg(F.sum(_money("o_totalprice")).alias("rev"))


@query("calendar_range_avg", CAL + f"SELECT a.p, a.mi, {MEAN_CENTS} AS rolling_avg FROM m a JOIN m b ON a.p = b.p AND b.mi BETWEEN a.mi - 2 AND a.mi GROUP BY a.p, a.mi")
def calendar_range_avg(spark, sf):
    out = re.calendar_range_avg(_by_priority(spark, sf), "mi", "rev", 2, ["p"])
    return out.select("p", "mi", F.round("rolling_avg", 2).cast("double").alias("rolling_avg"))


@query("calendar_prev_delta", CAL + "SELECT a.p, a.mi, CAST(a.rev - b.rev AS DOUBLE) AS delta_prev FROM m a LEFT JOIN m b ON a.p = b.p AND b.mi = a.mi - 1")
def calendar_prev_delta(spark, sf):
    out = re.calendar_prev_delta(_by_priority(spark, sf), "mi", "rev", ["p"])
    return out.select("p", "mi", F.col("delta_prev").cast("double").alias("delta_prev"))


@query("rownum_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def rownum_limit(spark, sf):
    return re.rownum_limit(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 10, [F.desc("o_totalprice"), "o_orderkey"])


@query("rownum_page", """SELECT * FROM (SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rownum FROM orders)
WHERE rownum BETWEEN 11 AND 20""")
def rownum_page(spark, sf):
    return re.rownum_page(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 11, 20, [F.desc("o_totalprice"), F.asc("o_orderkey")])


# ---- sort, limit, blocks -----------------------------------------------------


@query("order_by", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey DESC, s_acctbal DESC, s_suppkey")
def order_by(spark, sf):
    rows = _t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return re.order_by(rows, [F.desc("s_nationkey"), F.desc("s_acctbal"), "s_suppkey"])


@query("top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 5")
def top_k(spark, sf):
    return re.top_k(_t(spark, sf, "events").select("event_id", "value"), [F.desc("value"), "event_id"], 5)


@query("page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def page(spark, sf):
    """By an index, as a service would keep it that serves many pages."""
    return page_index(_t(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"]).page(3, 20)


@query("page_totals", "SELECT count(*) AS total, CAST(ceil(count(*) / 32.0) AS BIGINT) AS total_pages FROM part")
def page_totals(spark, sf):
    return re.page_totals(_t(spark, sf, "part"), 32)


@query("nulls_last_sort", """SELECT o.o_orderkey, l.n FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
ORDER BY n DESC NULLS LAST, o_orderkey""")
def nulls_last_sort(spark, sf):
    counts = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return re.nulls_last_sort(_t(spark, sf, "orders").select("o_orderkey").join(counts, "o_orderkey", "left"), "n", "o_orderkey")


@query("result_blocks", """SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS pos, (row_number() OVER (ORDER BY value, event_id) - 1) // 100 AS block FROM events""")
def result_blocks(spark, sf):
    return re.result_blocks(_t(spark, sf, "events").select("event_id", "value"), ["value", "event_id"]).drop("value")


# ---- sets --------------------------------------------------------------------


@query("union_all", "SELECT c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier")
def union_all(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    s = _t(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return re.union_all(c, s)


@query("union_distinct_ci", """SELECT key, arg_min(name, (src, name)) AS name FROM (SELECT lower(p_name) AS key, upper(p_name) AS name, 0 AS src FROM part WHERE p_size > 40
UNION ALL SELECT lower(p_name), p_name, 1 FROM part UNION ALL SELECT lower(p_type), p_type, 1 FROM part) GROUP BY key""")
def union_distinct_ci(spark, sf):
    part = _t(spark, sf, "part")
    shouted = part.filter(F.col("p_size") > 40).select(F.upper("p_name").alias("name"))
    return re.union_distinct_ci(shouted, part.select(F.col("p_name").alias("name")).union(part.select("p_type")))


@query("except", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def except_(spark, sf):
    spenders = _t(spark, sf, "orders").filter(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("c_custkey"))
    return re.except_(_t(spark, sf, "customer").select("c_custkey", "c_name"), spenders, ["c_custkey"])


@query("distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct(spark, sf):
    return re.distinct(_t(spark, sf, "part"), ["p_brand", "p_type"])
