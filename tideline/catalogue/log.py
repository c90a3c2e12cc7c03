"""Statement-log queries: text columns, search, facets, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline import bindings as b
from tideline.bindings import LOG_SQL, LOG_TABLES_SQL, case_sql, statement_log, table
from tideline.catalogue.base import query
from tideline.functions import connection as cn, job_json as jj, sql_text as st
from tideline.operators import statement_log as sl

L = f"WITH {LOG_SQL} "
LT = f"WITH {LOG_SQL}, {LOG_TABLES_SQL} "


def _joined(c):
    return F.array_join(c, ",")


# ---- columns over the text ---------------------------------------------------


@query("normalize_sql", L + r"SELECT id, lower(regexp_replace(trim(sql), '\s+', ' ', 'g')) AS normalized FROM log")
def normalize_sql(spark, sf):
    return statement_log(spark, sf).select("id", st.normalize_sql("sql").alias("normalized"))


@query("statement_fingerprint", L + r"SELECT md5(lower(regexp_replace(trim(sql), '\s+', ' ', 'g'))) AS fingerprint, count(*) AS n FROM log GROUP BY 1")
def statement_fingerprint(spark, sf):
    log = statement_log(spark, sf)
    return log.groupBy(st.statement_fingerprint("sql", "md5").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


@query("slow_query_id", L + "SELECT id, md5(COALESCE(conn_hash, 'null') || '_' || COALESCE(sql, 'null')) AS statement_id FROM log")
def slow_query_id(spark, sf):
    return statement_log(spark, sf).select("id", st.slow_query_id("conn_hash", "sql").alias("statement_id"))


@query("query_type", L + "SELECT id, query_type FROM log")
def query_type(spark, sf):
    return statement_log(spark, sf).select("id", st.query_type("sql").alias("query_type"))


@query("statement_class", L + "SELECT id, statement_class FROM log")
def statement_class(spark, sf):
    return statement_log(spark, sf).select("id", st.statement_class("sql").alias("statement_class"))


@query("is_write", L + "SELECT query_type, query_type NOT IN ('SELECT', 'UNKNOWN') AS is_write, query_type = 'SELECT' AS is_read, count(*) AS n FROM log GROUP BY 1")
def is_write(spark, sf):
    log = statement_log(spark, sf)
    cols = [st.query_type("sql").alias("query_type"), st.is_write("sql").alias("is_write"), st.is_read("sql").alias("is_read")]
    return log.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("is_read", L + "SELECT id FROM log WHERE query_type = 'SELECT'")
def is_read(spark, sf):
    return statement_log(spark, sf).filter(st.is_read("sql")).select("id")


@query("referenced_tables", L + "SELECT id, table_names AS tables FROM log")
def referenced_tables(spark, sf):
    return statement_log(spark, sf).select("id", _joined(st.referenced_tables("sql")).alias("tables"))


# t,t folds to one name
@query("referenced_tables_ci", L + "SELECT id, CASE table_names WHEN 't,t' THEN 't' ELSE table_names END AS tables FROM log")
def referenced_tables_ci(spark, sf):
    names = st.referenced_tables_ci(st.referenced_tables("sql"))
    return statement_log(spark, sf).select("id", _joined(names).alias("tables"))


@query("modified_tables", L + "SELECT id, modified AS tables FROM log")
def modified_tables(spark, sf):
    return statement_log(spark, sf).select("id", _joined(st.modified_tables("sql")).alias("tables"))


C = b.CONNECTIONS


@query("parse_connection", f"""SELECT user_id, {', '.join(f"{case_sql('user_id % 10', [c[i] for c in C])} AS {n}" for n, i in
 [('db_type', 1), ('host', 2), ('port', 3), ('database', 4), ('username', 5), ('has_password', 6), ('name', 7)])} FROM events GROUP BY user_id""")
def parse_connection(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    conn = b.pick(F.col("user_id") % 10, [c[0] for c in C])
    return users.select("user_id", cn.parse_connection(conn).alias("p")).select("user_id", "p.*")


@query("db_kind", f"SELECT {case_sql('user_id % 10', [c[9] for c in C])} AS kind, count(*) AS n FROM events GROUP BY 1")
def db_kind(spark, sf):
    return statement_log(spark, sf).groupBy(cn.db_kind("conn_hash").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("database_name", L + f"SELECT id, {b.DATABASE_OF_CONN} AS database FROM log")
def database_name(spark, sf):
    return statement_log(spark, sf).select("id", cn.database_name("conn_hash").alias("database"))


@query("strip_proxy_prefix", f"SELECT event_id, {case_sql('user_id % 10', [c[0].replace('proxy[127.0.0.1:1059]_', '') if c[0] else c[0] for c in C])} AS url FROM events")
def strip_proxy_prefix(spark, sf):
    conn = b.pick(F.col("user_id") % 10, [c[0] for c in C])
    return table(spark, sf, "events").select("event_id", cn.strip_proxy_prefix(conn).alias("url"))


@query("job_name", LT + f"""SELECT conn_hash, tab AS "table", {b.job_name_sql('conn_hash', 'database', 'tab')} AS job_name FROM
(SELECT DISTINCT conn_hash, {b.DATABASE_OF_CONN} AS database, tab FROM log_tables) WHERE database IS NOT NULL""")
def job_name(spark, sf):
    rows = sl.exploded_tables(statement_log(spark, sf), "conn_hash").distinct()
    db = cn.database_name("conn_hash")
    return rows.filter(db.isNotNull()).select("conn_hash", "table", cn.job_name("conn_hash", db, "table").alias("job_name"))


# the password shows as ***; URLs that carry credentials already keep theirs, masked
IDENTITIES = [
    "jdbc:mysql://app:***@db0:3306/shop0", "proxy[127.0.0.1:1059]_mysql://app:***@db1/shop1?useSSL=false",
    "jdbc:oracle:thin:@ora2:1522/SVC2?user=app&password=***&user=@&password=***", "jdbc:oracle:thin:@ora3:1521:SID3?user=@&password=***",
    "jdbc:mysql://@:***@db4:3307/shop4?user=u%204&password=***", "jdbc:postgresql://@:***@pg5:5432/shop5",
    "mysql://root:***@db6:3306/shop6", "oracle://scott:***@ora7", "", "",
]


@query("conn_identity", f"""SELECT event_id, CASE WHEN user_id % 10 > 7 THEN '' ELSE replace({case_sql('user_id % 10', IDENTITIES)}, '@:***@', 'u+' || user_id || ':***@') END AS raw
FROM events WHERE user_id % 10 NOT IN (2, 3) UNION ALL SELECT event_id, replace({case_sql('user_id % 10', IDENTITIES)}, 'user=@', 'user=u+' || user_id) FROM events WHERE user_id % 10 IN (2, 3)""")
def conn_identity(spark, sf):
    ev = table(spark, sf, "events")
    conn = b.pick(F.col("user_id") % 10, [c[0] for c in C])
    user = F.concat(F.lit("u "), F.col("user_id").cast("string"))
    return ev.select("event_id", cn.conn_identity(conn, user, F.lit("p@ss")).alias("raw"))


@query("trace_id", f"WITH {b.LINES_SQL} SELECT conv_id, turn, trace_id FROM lines")
def trace_id(spark, sf):
    return b.log_lines(spark, sf).select("conv_id", "turn", st.trace_id("message").alias("trace_id"))


@query("preview_sql", L + "SELECT id, CASE WHEN length(sql) > 100 THEN substr(sql, 1, 100) || '...' ELSE sql END AS preview FROM log")
def preview_sql(spark, sf):
    return statement_log(spark, sf).select("id", st.preview_sql("sql").alias("preview"))


AT = 1_706_000_000_000


@query("query_age", L + f"""SELECT id, ({AT} - timestamp) // 60000 + CASE WHEN {AT} < timestamp AND ({AT} - timestamp) % 60000 <> 0 AND ({AT} - timestamp) // 60000 * 60000 < {AT} - timestamp THEN 1 ELSE 0 END AS minutes,
CASE WHEN trunc(({AT} - timestamp) / 60000) < 5 THEN 'realtime' WHEN trunc(({AT} - timestamp) / 60000) < 60 THEN 'recent' ELSE 'history' END AS category,
trunc(({AT} - timestamp) / 60000) < 60 AS is_recent FROM log""")
def query_age(spark, sf):
    return statement_log(spark, sf).select("id", st.query_age("timestamp", AT).alias("a")).select("id", "a.*")


@query("translation_listing", """WITH d AS (SELECT event_id, event_type, user_id, value, epoch_us(ts) // 1000 AS ms,
 CASE WHEN event_id % 3 = 0 THEN 'plain ' || event_type ELSE NULL END AS plain FROM events)
SELECT CASE WHEN plain IS NULL THEN 'q' || event_id ELSE 'k' || event_id END AS query_id,
CASE WHEN plain IS NULL THEN 'SELECT ' || event_type || ' FROM DUAL' ELSE '' END AS original_sql,
CASE WHEN plain IS NULL THEN 'select ' || user_id ELSE plain END AS translated_sql, CASE WHEN plain IS NULL THEN 'conn' || (user_id % 10) ELSE '' END AS conn_hash,
CASE WHEN plain IS NULL AND event_id % 7 <> 0 THEN ms END AS update_time FROM d WHERE event_type = 'click'""")
def translation_listing(spark, sf):
    e = F.col("event_id")
    fields = F.struct(
        F.concat(F.lit("q"), e.cast("string")).alias("queryId"),
        F.concat(F.lit("SELECT "), "event_type", F.lit(" FROM DUAL")).alias("originalSql"),
        F.concat(F.lit("select "), F.col("user_id").cast("string")).alias("translatedSql"),
        F.concat(F.lit("conn"), (F.col("user_id") % 10).cast("string")).alias("connHash"),
        F.when(e % 7 != 0, b.millis("ts")).alias("updateTime"),
    )
    stored = table(spark, sf, "events").select(
        F.concat(F.lit("k"), e.cast("string")).alias("key"),
        F.when(e % 3 == 0, F.concat(F.lit(" plain "), "event_type")).otherwise(F.to_json(fields)).alias("raw"),
    )
    return sl.translation_listing(stored, search="CLICK")


JOB_JSON = """CASE user_id % 5
 WHEN 0 THEN '{"jobDag":{"vertices":[{"id":1},{"pluginConfig":{"database-names":["db' || user_id || '"],"table-names":"t1"}}]}}'
 WHEN 1 THEN '{"jobDag":{"vertexInfoMap":[{"tablePaths":["db' || user_id || '.s.t2","x.y"]}]}}'
 WHEN 2 THEN '{"jobDag":{"vertices":[{"pluginConfig":{"database-names":["only"]}},{"tablePaths":["nodot"]}]}}'
 WHEN 3 THEN '{"jobDag":{"vertices":"none"}}'
 ELSE '{"jobDag":{"vertices":[{"pluginConfig":{"database-names":[],"table-names":[]},"tablePaths":["d.t' || user_id || '"]}]}}' END"""


@query("job_table", """SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'db' || user_id WHEN 1 THEN 'db' || user_id WHEN 4 THEN 'd' END AS database,
CASE user_id % 5 WHEN 0 THEN 't1' WHEN 1 THEN 's.t2' WHEN 4 THEN 't' || user_id END AS "table" FROM events""")
def job_table(spark, sf):
    return table(spark, sf, "events").select("event_id", jj.job_table(F.expr(JOB_JSON)).alias("t")).select("event_id", "t.database", "t.table")


@query("jobs_by_name", """WITH j AS (SELECT event_id, 'n' || (user_id % 40) AS name, 'a' || event_id AS id, 0 AS p FROM events
UNION ALL SELECT event_id, 'n' || (value::INTEGER % 60), 'b' || event_id, 1 FROM events WHERE event_type = 'click')
SELECT name AS job_name, arg_max(id, (event_id, p)) AS job_id FROM j GROUP BY 1""")
def jobs_by_name(spark, sf):
    outer = F.struct(F.concat(F.lit("n"), (F.col("user_id") % 40).cast("string")).alias("jobName"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("jobId"))
    inner = F.struct(F.concat(F.lit("n"), (F.round("value").cast("int") % 60).cast("string")).alias("jobName"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("jobId"))
    plain = F.to_json(outer)
    nested = F.concat(F.lit("["), plain, F.lit(',{"jobs":['), F.to_json(inner), F.lit("]}]"))
    listings = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", nested).otherwise(plain).alias("json"))
    return jj.jobs_by_name(listings, "json", "event_id")


# ---- search ------------------------------------------------------------------


@query("keyword_search", L + "SELECT id FROM log WHERE contains(lower(sql), 'users') OR contains(lower(parameters), 'users') OR contains(lower(method_name), 'users')")
def keyword_search(spark, sf):
    return sl.keyword_search(statement_log(spark, sf), "USERS").select("id")


@query("min_time_filter", L + "SELECT id, execution_time FROM log WHERE execution_time >= 5000")
def min_time_filter(spark, sf):
    return sl.min_time_filter(statement_log(spark, sf), 5000).select("id", "execution_time")


@query("type_filter", L + "SELECT id, query_type FROM log WHERE query_type = 'UPDATE'")
def type_filter(spark, sf):
    return sl.type_filter(statement_log(spark, sf), "update").select("id", "query_type")


@query("csv_member_filter", LT + "SELECT DISTINCT id, table_names FROM log_tables WHERE lower(tab) = 'users'")
def csv_member_filter(spark, sf):
    return sl.csv_member_filter(statement_log(spark, sf), "table_names", "USERS").select("id", "table_names")


PAGE = LT + """, hits AS (SELECT id, execution_time FROM log WHERE conn_hash = '""" + C[0][0] + """' AND contains(lower(sql), 'from')
AND execution_time >= 1000 AND query_type = 'SELECT' AND id IN (SELECT id FROM log_tables WHERE lower(tab) = 'users'))
SELECT id, execution_time, (SELECT count(*) FROM hits) AS total, CAST(ceil((SELECT count(*) FROM hits) / 10.0) AS BIGINT) AS total_pages
FROM hits ORDER BY execution_time DESC, id LIMIT 10 OFFSET 10"""


@query("slow_query_page", PAGE)
def slow_query_page(spark, sf):
    out = sl.slow_query_page(
        statement_log(spark, sf), 2, 10, conn_hash=C[0][0], keyword="FROM", min_ms=1000, query_type="select", table="Users"
    )
    return out.select("id", "execution_time", "total", "total_pages")


# ---- facets and rankings -----------------------------------------------------


@query("facet_lists", LT + """SELECT DISTINCT 'connection' AS facet, conn_hash AS value FROM log WHERE conn_hash <> '' UNION ALL
SELECT DISTINCT 'type', query_type FROM log UNION ALL SELECT DISTINCT 'table', tab FROM log_tables UNION ALL SELECT 'total', CAST(count(*) AS VARCHAR) FROM log""")
def facet_lists(spark, sf):
    return sl.facet_lists(statement_log(spark, sf))


@query("group_to_list", L + """, n AS (SELECT conn_hash, id, (row_number() OVER (PARTITION BY conn_hash ORDER BY timestamp, id) - 1) // 200 AS block, timestamp FROM log)
SELECT conn_hash, block, count(*) AS size, string_agg(id, ',' ORDER BY timestamp, id) AS ids FROM n GROUP BY conn_hash, block""")
def group_to_list(spark, sf):
    out = sl.group_to_list(statement_log(spark, sf), "conn_hash", ["timestamp", "id"], 200)
    ids = F.array_join(F.transform("statements", lambda s: s["id"]), ",")
    return out.select("conn_hash", "block", F.size("statements").cast("long").alias("size"), ids.alias("ids"))


@query("tables_by_connection", L + """SELECT conn_hash, COALESCE(string_agg(DISTINCT tab, ',' ORDER BY tab), '') AS tables FROM
(SELECT conn_hash, NULLIF(unnest(string_split(table_names, ',')), '') AS tab FROM log WHERE conn_hash <> '') GROUP BY conn_hash""")
def tables_by_connection(spark, sf):
    return sl.tables_by_connection(statement_log(spark, sf)).select("conn_hash", _joined("tables").alias("tables"))


@query("slowest_per_statement", L + """, kept AS (SELECT *, md5(COALESCE(conn_hash, 'null') || '_' || sql) AS statement_id FROM log
WHERE CASE WHEN has_error THEN method_name = 'executeQuery' ELSE execution_time >= 1000 END)
SELECT statement_id, id, execution_time, has_error FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY execution_time DESC, timestamp) AS rn FROM kept) WHERE rn = 1""")
def slowest_per_statement(spark, sf):
    return sl.slowest_per_statement(statement_log(spark, sf)).select("statement_id", "id", "execution_time", "has_error")


@query("table_heat", L + """SELECT tab AS "table", count(*) AS n FROM (SELECT trim(unnest(string_split(table_names, ','))) AS tab FROM log WHERE table_names <> '')
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def table_heat(spark, sf):
    return sl.table_heat(statement_log(spark, sf))


@query("share_by_connection", L + """SELECT COALESCE(NULLIF(conn_hash, ''), 'Unknown') AS name, count(*) AS n,
CAST(floor(100.0 * count(*) / (SELECT count(*) FROM log) + 0.5) AS BIGINT) AS percent FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def share_by_connection(spark, sf):
    return sl.share_by_connection(statement_log(spark, sf))


