"""The library's input shapes, derived from the benchmark tables.

Every function reads whole tables. ``*_SQL`` texts give the same shapes to a plain SQL engine; columns
the library computes (types, tables, fingerprints) are spelled out there by hand per template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tideline.functions.sql_text import normalize_sql, query_type, referenced_tables

NOW = 1_706_659_200_000  # 2024-01-31T00:00:00Z, after the last event


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A benchmark table; its schema is read from the files once per process."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# ---- statement templates -----------------------------------------------------
# text, type, class, tables, modified tables
LONG_TAIL = " AND note = 'this statement is longer than the preview shows, so that it gets cut'"
TEMPLATES = [
    ("SELECT * FROM users WHERE id = ?", "SELECT", "SELECT", "users", ""),
    ("SELECT o.id, u.name FROM orders o JOIN users u ON o.user_id = u.id", "SELECT", "SELECT", "orders,users", ""),
    ("INSERT INTO shop.order_items (order_id) VALUES (?)", "INSERT", "DML", "order_items", "order_items"),
    ("  update  `Products` SET price = price + 1   WHERE id = ? ", "UPDATE", "DML", "Products", "products"),
    ("DELETE FROM reviews WHERE id = ? AND rating < 3", "DELETE", "DML", "reviews", "reviews"),
    ("WITH t AS (SELECT * FROM orders) SELECT * FROM t", "UNKNOWN", "SELECT", "", ""),
    ("INSERT INTO archive SELECT * FROM orders", "INSERT", "SELECT", "archive", "archive"),
    ("SELECT * FROM s1.t, s2.t WHERE s1.t.id = s2.t.id", "SELECT", "SELECT", "t,t", ""),
    ("SELECT COUNT(*) FROM (SELECT id FROM users) q JOIN orders o ON o.user_id = q.id", "SELECT", "SELECT", "users,orders", ""),
    ('select * from "Users" order by id', "SELECT", "SELECT", "Users", ""),
    ("CREATE TABLE audit (id INT)", "CREATE", "DDL", "", ""),
    ("TRUNCATE TABLE staging", "TRUNCATE", "DDL", "", ""),
    ("COMMIT", "UNKNOWN", "TRANSACTION", "", ""),
    ("SHOW TABLES", "UNKNOWN", "UNKNOWN", "", ""),
    ("SELECT * FROM users, orders,products WHERE users.id = orders.user_id" + LONG_TAIL, "SELECT", "SELECT", "users,orders,products", ""),
    ("UPDATE users SET name = 'x'; INSERT INTO logs VALUES (1)", "UPDATE", "DML", "users", "users,logs"),
]
# url, kind, host, port, database, user, has password, display name, last path part, mapped kind
CONNECTIONS = [
    ("jdbc:mysql://app:pw@db0:3306/shop0", "MySQL", "db0", 3306, "shop0", "app", True, "db0:3306/shop0", "shop0", "MYSQL"),
    ("proxy[127.0.0.1:1059]_mysql://app:s3cret@db1/shop1?useSSL=false", "MySQL", "db1", 3306, "shop1", "app", True, "db1:3306/shop1", "shop1", "MYSQL"),
    ("jdbc:oracle:thin:@ora2:1522/SVC2?user=app&password=pw", "Oracle", "ora2", 1522, "SVC2", "app", True, "ora2:1522/SVC2", "SVC2", "ORACLE"),
    ("jdbc:oracle:thin:@ora3:1521:SID3", "Oracle", "ora3", 1521, "SID3", None, False, "ora3:1521/SID3", None, "ORACLE"),
    ("jdbc:mysql://db4:3307/shop4?user=u%204&password=p4", "MySQL", "db4", 3307, "shop4", "u 4", True, "db4:3307/shop4", "shop4", "MYSQL"),
    ("jdbc:postgresql://pg5:5432/shop5", None, None, None, None, None, False, "Unknown DB", "shop5", "POSTGRES"),
    ("mysql://root:pw@db6:3306/shop6", "MySQL", "db6", 3306, "shop6", "root", True, "db6:3306/shop6", "shop6", "MYSQL"),
    ("oracle://scott:tiger@ora7", "Oracle", "ora7", 1521, "ORCL", "scott", True, "ora7:1521/ORCL", "scott:tiger@ora7", "ORACLE"),
    (None, None, None, None, None, None, False, None, None, "UNMAPPED"),
    ("", None, None, None, None, None, False, None, None, "UNMAPPED"),
]
CDC_EVENTS = [
    "JOB_START", "CHECKPOINT_COMPLETED", "READER_CLOSE", "ENUMERATOR_CLOSE", "BATCH_CHECKPOINT", "LIFECYCLE_READER_CLOSE",
    "CHECKPOINT_COMPLETED", "SOURCE_START", "JOB_FAIL", "OTHER", "TASK_FAIL",
]
RULE_TABLES = [["orders", "Users"], ["Products", " users "], [], ["reviews", "REVIEWS", "logs"], [], ["t", "archive"]]


def sql_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def case_sql(selector: str, values: list) -> str:
    """CASE by position, for the SQL side."""
    return f"CASE {selector} " + " ".join(f"WHEN {i} THEN {sql_text(v)}" for i, v in enumerate(values)) + " END"


def pick(selector: Column, values: list) -> Column:
    """The same on the Spark side: one look-up in a constant list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), selector.cast("int") + 1)


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def statement_log(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    sql = pick(k_of() % 16, [t[0] for t in TEMPLATES])
    rows = ev.select(
        F.col("event_id").cast("string").alias("id"),
        sql.alias("sql"),
        F.col("props").alias("parameters"),
        F.floor(F.col("value") * 100).cast("long").alias("execution_time"),
        (F.col("event_id") % 3 == 0).alias("in_transaction"),
        (F.col("event_type") == "error").alias("has_error"),
        millis("ts").alias("timestamp"),
        F.concat(F.lit("client-"), F.col("user_id").cast("string")).alias("client_uuid"),
        pick(F.col("user_id") % 10, [c[0] for c in CONNECTIONS]).alias("conn_hash"),
        F.when(F.col("event_type") == "purchase", "executeUpdate").otherwise("executeQuery").alias("method_name"),
    )
    return rows.withColumn("normalized_sql", normalize_sql("sql")).withColumn("query_type", query_type("sql")).withColumn(
        "table_names", F.array_join(referenced_tables("sql"), ",")
    )


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)"
LOG_SQL = f"""log AS (
  SELECT CAST(event_id AS VARCHAR) AS id, {case_sql(f'{_K} % 16', [t[0] for t in TEMPLATES])} AS sql, props AS parameters,
         CAST(floor(value * 100) AS BIGINT) AS execution_time, event_id % 3 = 0 AS in_transaction,
         event_type = 'error' AS has_error, epoch_us(ts) // 1000 AS timestamp, 'client-' || user_id AS client_uuid,
         {case_sql('user_id % 10', [c[0] for c in CONNECTIONS])} AS conn_hash,
         CASE WHEN event_type = 'purchase' THEN 'executeUpdate' ELSE 'executeQuery' END AS method_name,
         {case_sql(f'{_K} % 16', [t[1] for t in TEMPLATES])} AS query_type,
         {case_sql(f'{_K} % 16', [t[2] for t in TEMPLATES])} AS statement_class,
         {case_sql(f'{_K} % 16', [t[3] for t in TEMPLATES])} AS table_names,
         {case_sql(f'{_K} % 16', [t[4] for t in TEMPLATES])} AS modified,
         {_K} % 16 AS tpl, user_id % 10 AS conn, user_id, event_id, event_type, value, ts
  FROM events)"""
# one row per (statement, table); blank elements are left out
LOG_TABLES_SQL = "log_tables AS (SELECT * FROM (SELECT *, unnest(string_split(table_names, ',')) AS tab FROM log) WHERE tab <> '')"


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Decision and execution outcomes: view hit, click miss, signup skip, purchase success, error error."""
    ev = table(spark, sf, "events")
    names = {"view": "hit", "click": "miss", "signup": "skip", "purchase": "success", "error": "error"}
    out = F.lit(None).cast("string")
    for event, name in names.items():
        out = F.when(F.col("event_type") == event, name).otherwise(out)
    return ev.select(
        "event_id", "ts", "user_id", "event_type", out.alias("outcome"),
        F.concat(F.lit("source-"), (F.col("user_id") % 4).cast("string")).alias("datasource"),
        F.floor(F.col("value") * 100).cast("long").alias("execution_time"), "value",
    )


OUTCOMES_SQL = """outcomes AS (
  SELECT event_id, ts, user_id, event_type,
         CASE event_type WHEN 'view' THEN 'hit' WHEN 'click' THEN 'miss' WHEN 'signup' THEN 'skip'
              WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' END AS outcome,
         'source-' || (user_id % 4) AS datasource, CAST(floor(value * 100) AS BIGINT) AS execution_time, value
  FROM events)"""


# ---- music store and shop ----------------------------------------------------


class Tables(dict):
    """Frames built on first use, so a query opens only the files it reads."""

    def __getitem__(self, name: str) -> DataFrame:
        value = super().__getitem__(name)
        return value() if callable(value) else value


def _brand() -> Column:
    return F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def store(spark: SparkSession, sf: str) -> Tables:
    def read(name: str) -> DataFrame:
        return table(spark, sf, name)

    def genres() -> DataFrame:
        return read("part").select(_brand().alias("GenreId"), F.col("p_brand").alias("Name")).distinct()

    return Tables(
        tracks=lambda: read("part").select(
            F.col("p_partkey").alias("TrackId"), F.col("p_name").alias("Name"), F.col("p_size").alias("AlbumId"),
            F.col("p_type").alias("MediaTypeId"), _brand().alias("GenreId"), _money("p_retailprice").alias("UnitPrice"),
        ),
        genres=genres,
        media=lambda: read("part").select(
            F.col("p_type").alias("MediaTypeId"), F.concat(F.lit("Media "), "p_type").alias("Name")
        ).distinct(),
        albums=lambda: read("part").select(
            F.col("p_size").alias("AlbumId"), (F.col("p_size") % 25 + 1).alias("ArtistId")
        ).distinct(),
        # some artists share a name: grouping is by name
        artists=lambda: genres().select(
            F.col("GenreId").alias("ArtistId"), F.concat(F.lit("Artist "), (F.col("GenreId") % 20).cast("string")).alias("Name")
        ),
        invoices=lambda: read("orders").select(
            F.col("o_orderkey").alias("InvoiceId"), F.col("o_custkey").alias("CustomerId"),
            F.col("o_orderdate").alias("InvoiceDate"), _money("o_totalprice").alias("Total"),
        ),
        lines=lambda: read("lineitem").select(
            F.col("l_orderkey").alias("InvoiceId"), F.col("l_partkey").alias("TrackId"),
            _money("l_extendedprice").alias("UnitPrice"), F.col("l_quantity").cast("int").alias("Quantity"),
        ),
        customers=lambda: read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("CustomerId"), F.split_part("c_name", F.lit("#"), F.lit(1)).alias("FirstName"),
            F.split_part("c_name", F.lit("#"), F.lit(2)).alias("LastName"), F.col("c_mktsegment").alias("City"),
            F.col("n_name").alias("Country"), F.col("c_nationkey").alias("SupportRepId"),
        ),
        employees=lambda: read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("EmployeeId"), F.lit("Rep").alias("FirstName"), F.col("n_name").alias("LastName"),
            F.col("r_name").alias("City"), F.col("n_name").alias("Country"),
        ),
        playlists=lambda: read("supplier").select(
            F.col("s_suppkey").alias("PlaylistId"), F.concat(F.lit("List "), (F.col("s_suppkey") % 40).cast("string")).alias("Name")
        ),
        playlist_tracks=lambda: read("lineitem").select(
            F.col("l_suppkey").alias("PlaylistId"), F.col("l_partkey").alias("TrackId")
        ).distinct(),
    )


STORE_SQL = """tracks AS (SELECT p_partkey AS TrackId, p_name AS Name, p_size AS AlbumId, p_type AS MediaTypeId,
    CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS GenreId, CAST(p_retailprice AS DECIMAL(18,2)) AS UnitPrice FROM part),
  genres AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS GenreId, p_brand AS Name FROM part),
  media AS (SELECT DISTINCT p_type AS MediaTypeId, 'Media ' || p_type AS Name FROM part),
  albums AS (SELECT DISTINCT p_size AS AlbumId, p_size % 25 + 1 AS ArtistId FROM part),
  artists AS (SELECT GenreId AS ArtistId, 'Artist ' || (GenreId % 20) AS Name FROM genres),
  invoices AS (SELECT o_orderkey AS InvoiceId, o_custkey AS CustomerId, o_orderdate AS InvoiceDate,
    CAST(o_totalprice AS DECIMAL(18,2)) AS Total FROM orders),
  lines AS (SELECT l_orderkey AS InvoiceId, l_partkey AS TrackId, CAST(l_extendedprice AS DECIMAL(18,2)) AS UnitPrice,
    CAST(l_quantity AS INTEGER) AS Quantity FROM lineitem),
  customers AS (SELECT c_custkey AS CustomerId, split_part(c_name, '#', 1) AS FirstName, split_part(c_name, '#', 2) AS LastName,
    c_mktsegment AS City, n_name AS Country, c_nationkey AS SupportRepId FROM customer JOIN nation ON c_nationkey = n_nationkey),
  employees AS (SELECT n_nationkey AS EmployeeId, 'Rep' AS FirstName, n_name AS LastName, r_name AS City, n_name AS Country
    FROM nation JOIN region ON n_regionkey = r_regionkey),
  playlists AS (SELECT s_suppkey AS PlaylistId, 'List ' || (s_suppkey % 40) AS Name FROM supplier),
  playlist_tracks AS (SELECT DISTINCT l_suppkey AS PlaylistId, l_partkey AS TrackId FROM lineitem)"""


def shop(spark: SparkSession, sf: str) -> Tables:
    def read(name: str) -> DataFrame:
        return table(spark, sf, name)

    def reviews() -> DataFrame:
        line = read("lineitem").select(
            "l_orderkey", F.col("l_partkey").alias("product_id"), (F.col("l_linenumber") % 5 + 1).cast("long").alias("rating"),
            F.when(F.col("l_linestatus") == "O", "pending").otherwise("done").alias("status"),
            F.col("l_extendedprice").alias("stamp"),
        )
        owner = read("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
        joined = line.join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select("product_id", "user_id", "rating", "status", "stamp")

    return Tables(
        users=lambda: read("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
            F.when(F.col("c_acctbal") > 0, "active").otherwise("inactive").alias("status"),
            F.date_add(F.lit("1998-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int")).alias("created_at"),
        ),
        products=lambda: read("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), _money("p_retailprice").alias("price"),
            F.when(F.col("p_size") > 5, "active").otherwise("retired").alias("status"), F.col("p_size").alias("stock"),
        ),
        orders=lambda: read("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("order_date")
        ),
        items=lambda: read("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("long").alias("quantity"), "l_linenumber", "l_suppkey", "l_extendedprice",
        ),
        reviews=reviews,
    )


SHOP_SQL = """users AS (SELECT c_custkey AS id, c_name AS username, CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'inactive' END AS status,
    DATE '1998-01-01' + CAST(c_custkey % 30 AS INTEGER) AS created_at FROM customer),
  products AS (SELECT p_partkey AS id, p_name AS name, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
    CASE WHEN p_size > 5 THEN 'active' ELSE 'retired' END AS status, p_size AS stock FROM part),
  shop_orders AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS order_date FROM orders),
  items AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, l_linenumber, l_suppkey,
    l_extendedprice FROM lineitem),
  reviews AS (SELECT l_partkey AS product_id, o_custkey AS user_id, CAST(l_linenumber % 5 + 1 AS BIGINT) AS rating,
    CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'done' END AS status, l_extendedprice AS stamp
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# ---- rules, jobs and sync state ----------------------------------------------


def cache_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One rule per supplier; each names two statements of the log, from anywhere in it."""
    s = F.col("s_suppkey")
    statements = table(spark, sf, "events").agg(F.max("event_id") + 1).scalar()
    tables = F.when(s % 6 == 0, F.array(*[F.lit(t) for t in RULE_TABLES[0]]))
    for i, names in enumerate(RULE_TABLES[1:], start=1):
        tables = tables.when(s % 6 == i, F.array(*[F.lit(t) for t in names]).cast("array<string>"))
    text = s.cast("string")
    jobs = F.when(
        s % 4 == 0, F.create_map(F.lit("orders"), F.concat(F.lit("o-"), text), F.lit("products"), F.concat(F.lit("p-"), text))
    ).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf, "supplier").select(
        F.concat(F.lit("rule-"), text).alias("id"), s.alias("pos"), (s % 5 != 0).alias("enabled"),
        pick(s % 10, [c[0] for c in CONNECTIONS]).alias("conn_hash"), tables.alias("tables"),
        F.array(*[(x % statements).cast("string") for x in (s * 7919, s * 104_729 + 11)]).alias("slow_query_ids"), jobs.alias("job_ids"),
    )


def _list_sql(names: list[str]) -> str:
    return "[" + ", ".join(sql_text(n) for n in names) + "]::VARCHAR[]"


RULES_SQL = f"""rules AS (
  SELECT 'rule-' || s_suppkey AS id, s_suppkey AS pos, s_suppkey % 5 <> 0 AS enabled,
         {case_sql('s_suppkey % 10', [c[0] for c in CONNECTIONS])} AS conn_hash, s_suppkey % 10 AS conn,
         CASE s_suppkey % 6 {' '.join(f'WHEN {i} THEN {_list_sql(t)}' for i, t in enumerate(RULE_TABLES))} END AS tables,
         [CAST((s_suppkey * 7919) % (SELECT max(event_id) + 1 FROM events) AS VARCHAR), CAST((s_suppkey * 104729 + 11) % (SELECT max(event_id) + 1 FROM events) AS VARCHAR)] AS slow_query_ids,
         CASE WHEN s_suppkey % 4 = 0 THEN MAP {{'orders': 'o-' || s_suppkey, 'products': 'p-' || s_suppkey}}
              ELSE MAP {{}}::MAP(VARCHAR, VARCHAR) END AS job_ids
  FROM supplier)"""


def job_name_sql(conn: str, db: str, tab: str) -> str:
    slug = f"regexp_replace(lower({db} || '-' || {tab}), '[^a-z0-9]+', '-', 'g')"
    return f"'managed-' || substr(md5({conn}), 1, 8) || '-' || trim({slug}, '-')"


DATABASE_OF_CONN = case_sql("conn", [c[8] for c in CONNECTIONS])


def sync_state(spark: SparkSession, sf: str) -> DataFrame:
    """One state per connection and table that the log names."""
    from tideline.functions.connection import database_name, job_name
    from tideline.functions.sql_text import csv_items, explode_each

    log = statement_log(spark, sf).filter(database_name("conn_hash").isNotNull())
    per = explode_each(log, csv_items("table_names"), "t", "conn_hash").groupBy(
        "conn_hash", F.lower("t").alias("table_name")
    ).agg(F.count(F.lit(1)).alias("n"))
    update = F.when(F.col("n") % 25 == 0, F.lit(0)).otherwise(F.lit(NOW) - (F.col("n") % 60) * 10_000)
    db = database_name("conn_hash")
    return per.select(
        job_name("conn_hash", db, "table_name").alias("job_name"), "conn_hash", db.alias("database"), "table_name",
        F.concat(F.lit("job-"), F.col("n").cast("string")).alias("job_id"), F.lit(None).cast("string").alias("rule_id"),
        (F.col("n") % 3 != 0).alias("ready"), (F.col("n") % 4 != 0).alias("snapshot_finished"), update.cast("long").alias("update_time"),
        F.when(F.col("n") % 2 == 0, "INCREMENTAL_IDLE").otherwise("INCREMENTAL_SYNCING").alias("cdc_state"),
    )


# expects log and log_tables
STATE_SQL = f"""state AS (
  SELECT {job_name_sql('conn_hash', 'database', 'table_name')} AS job_name, conn_hash, database, table_name, 'job-' || n AS job_id,
         CAST(NULL AS VARCHAR) AS rule_id, n % 3 <> 0 AS ready, n % 4 <> 0 AS snapshot_finished,
         CASE WHEN n % 25 = 0 THEN 0 ELSE {NOW} - (n % 60) * 10000 END AS update_time,
         CASE WHEN n % 2 = 0 THEN 'INCREMENTAL_IDLE' ELSE 'INCREMENTAL_SYNCING' END AS cdc_state
  FROM (SELECT conn_hash, {DATABASE_OF_CONN} AS database, lower(tab) AS table_name, count(*) AS n
        FROM log_tables GROUP BY ALL) WHERE database IS NOT NULL)"""


def running_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Every state has a running job; customers add unmanaged jobs and managed orphans."""
    state = sync_state(spark, sf).select("job_name", "job_id")
    c = F.col("c_custkey")
    other = table(spark, sf, "customer").select(
        F.concat(F.when(c % 3 == 0, "managed-orphan-").otherwise("other-"), c.cast("string")).alias("job_name"),
        F.concat(F.lit("c-"), c.cast("string")).alias("job_id"),
    )
    return state.unionByName(other)


RUNNING_SQL = """running AS (
  SELECT job_name, job_id FROM state
  UNION ALL SELECT CASE WHEN c_custkey % 3 = 0 THEN 'managed-orphan-' ELSE 'other-' END || c_custkey, 'c-' || c_custkey FROM customer)"""


def cdc_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events, metric ticks and write marks of seven jobs, 0.7 s apart."""
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "event").when(F.col("event_type") == "purchase", "write").otherwise("tick")
    return table(spark, sf, "events").select(
        F.concat(F.lit("job-"), (F.col("user_id") % 7).cast("string")).alias("job_id"),
        (e * 700).alias("ts"), e.alias("seq"), kind.alias("kind"),
        pick(k_of() % 11, CDC_EVENTS).alias("event_type"),
        F.floor(e / 60).cast("long").alias("source_received"), F.floor(e / 25).cast("long").alias("sink_written"),
    )


RECORDS_SQL = f"""records AS (
  SELECT 'job-' || (user_id % 7) AS job_id, event_id * 700 AS ts, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'event' WHEN 'purchase' THEN 'write' ELSE 'tick' END AS kind,
         {case_sql(f'{_K} % 11', CDC_EVENTS)} AS event_type,
         event_id // 60 AS source_received, event_id // 25 AS sink_written
  FROM events)"""


# ---- series and logs ---------------------------------------------------------


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """A counter per event type and host that starts again every 1000 events."""
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.lit("requests").alias("name"),
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("host"), F.concat(F.lit("h"), (F.col("user_id") % 3).cast("string"))).alias("labels"),
        (F.col("event_id") % 1000).cast("double").alias("value"),
    )


COUNTERS_SQL = """counters AS (
  SELECT ts, epoch_us(ts) // 1000000 AS sec, event_type AS type, 'h' || (user_id % 3) AS host, CAST(event_id % 1000 AS DOUBLE) AS value FROM events)"""


def labels_text() -> Column:
    """Label map as text, keys sorted."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(pairs, ",")


UUID_SQL = "substr(md5(text), 1, 8) || '-' || substr(md5(text), 9, 4) || '-' || substr(md5(text), 13, 4) || '-' || substr(md5(text), 17, 4) || '-' || substr(md5(text), 21, 12)"
TRACE_PREFIXES = ["会话[", "Session ", "session -> ", "for session ", "client uuid ", "sessionUUID:", "trace_id:"]


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Flat log lines out of the conversations."""
    turn = F.col("turn").cast("int")
    marker = pick(turn % 9, [*TRACE_PREFIXES, "id ", ""])
    mark = F.concat(marker, F.expr(UUID_SQL), F.when(turn % 9 == 0, "]").otherwise(""), F.lit(" "))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.concat(mark, "text").alias("message"),
        pick((F.col("conv_id") % 4).cast("int"), ["app-gateway", "app-cache", "shop", None]).alias("service"),
        pick((turn + F.col("conv_id").cast("int")) % 3, ["INFO", "ERROR", None]).alias("level"),
        F.concat(F.lit("pod-"), "role").alias("container"),
        (F.lit(1_704_067_200_000_000_000) + (F.col("conv_id") * 1000 + F.col("turn")) * 1_234_567_891).alias("ns"),
    )


LINES_SQL = f"""lines AS (
  SELECT conv_id, turn, {case_sql('turn % 9', [*TRACE_PREFIXES, 'id ', ''])} || {UUID_SQL} || CASE WHEN turn % 9 = 0 THEN ']' ELSE '' END || ' ' || text AS message,
         {case_sql('conv_id % 4', ['app-gateway', 'app-cache', 'shop', None])} AS service,
         {case_sql('(turn + conv_id) % 3', ['INFO', 'ERROR', None])} AS level, 'pod-' || role AS container,
         1704067200000000000 + (conv_id * 1000 + turn) * 1234567891 AS ns,
         CASE WHEN turn % 9 < 7 THEN {UUID_SQL} END AS trace_id, text, role
  FROM conversations)"""
