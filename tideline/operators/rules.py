"""Replication rules: which statements they cover, which jobs they need, which of those run.

rules: id, pos (creation order), enabled, conn_hash, tables ARRAY, slow_query_ids ARRAY, job_ids MAP.
statements: id, conn_hash, table_names (comma list). running: job_name, job_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.connection import job_name, parse_connection
from tideline.functions.sql_text import csv_items, explode_each, let
from tideline.operators.ordered import numbered
from tideline.session import stored

MANAGED_PREFIX = "managed-"
#: statements that are gathered by what they name at once, and of those the most that leave with a block of items
GATHERED, BLOCK = 100_000, 1000


def _norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def _rule_tables(rules: DataFrame) -> DataFrame:
    return rules.select(
        F.col("id").alias("rule_id"), "conn_hash", F.explode("tables").alias("raw"), "job_ids"
    ).withColumn("table", F.trim("raw"))


def _groups(statements: DataFrame, *by: str) -> DataFrame:
    """Statements with one list of tables: all that rules can tell apart by table. (by, table_names, table, n_statements)."""
    groups = statements.groupBy(*by, "table_names").agg(F.count(F.lit(1)).alias("n_statements"))
    return explode_each(groups, F.array_distinct(csv_items("table_names")), "table", *by, "table_names", "n_statements")


def rule_groups(rules: DataFrame, statements: DataFrame, block: int = 1000) -> DataFrame:
    """Every match, as groups: (conn_hash, table_names, statement_id, block, rule_ids, n_statements).

    A rule with tables matches by table name (exact case), never by id; only a rule without tables matches by id. Statements of a
    connection with the same ``table_names`` are matched by the same rules, so they are matched once: a group lists its rules in
    blocks of bounded size. Matches by id have a ``statement_id`` and no ``table_names``. The result grows with the rules and the
    different table lists, not with pairs of rules and statements; :func:`expand_groups` writes these out.
    """
    live = rules.filter(F.col("enabled"))
    by_table = _rule_tables(live).select("rule_id", "conn_hash", "table").distinct().join(_groups(statements, "conn_hash"), ["conn_hash", "table"])
    none = F.lit(None).cast("string")
    by_table = by_table.select("conn_hash", "table_names", none.alias("statement_id"), "n_statements", "rule_id").distinct()
    by_id = (
        live.filter(F.size("tables") == 0)
        .select(F.col("id").alias("rule_id"), "conn_hash", F.explode(F.array_distinct("slow_query_ids")).alias("statement_id"))
        .join(statements.select(F.col("id").alias("statement_id"), "conn_hash"), ["conn_hash", "statement_id"])
        .select("conn_hash", none.alias("table_names"), "statement_id", F.lit(1).cast("long").alias("n_statements"), "rule_id")
    )
    return in_blocks(by_table.unionByName(by_id), ["conn_hash", "table_names", "statement_id"], "rule_id", "rule_ids", block, ["n_statements"])


def expand_groups(groups: DataFrame, statements: DataFrame, item: str = "rule_ids") -> DataFrame:
    """(statement_id, one element of ``item``) of every match that the groups stand for."""
    s = statements.select(F.col("id").alias("_id"), "conn_hash", "table_names")
    by_table = groups.filter(F.col("table_names").isNotNull()).join(s, ["conn_hash", "table_names"]).withColumn("statement_id", F.col("_id"))
    kept = ["statement_id", F.explode(item).alias("_item")]
    return by_table.select(*kept).unionByName(groups.filter(F.col("statement_id").isNotNull()).select(*kept))


def _met(statements: DataFrame, *by: str) -> DataFrame:
    """(statement_id, met): per statement id, once, all tables it names as a sorted array of (by, table). Ids with one ``met`` are
    matched by the same rules, so rules are matched with the different arrays alone and the pairs need no distinct. Written once:
    the texts behind ``table_names`` are taken apart a single time."""
    items = F.transform(F.array_distinct(csv_items("table_names")), lambda t: F.struct(*by, t.alias("table")))
    met = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return stored(statements.select("id", items.alias("items")).groupBy(F.col("id").alias("statement_id")).agg(met.alias("met")), "met")


def _matched(met: DataFrame, left: DataFrame, *by: str) -> DataFrame:
    """(met, columns of left) of every array that names a table of left."""
    named = met.select("met").distinct().select("met", F.explode("met").alias("_t")).select("met", "_t.*")
    return named.join(left, [*by, "table"])


def _written_out(met: DataFrame, found: DataFrame, item: str) -> DataFrame:
    """(statement_id, item) of the statements of every array, pairs of blocks of bounded size dealt over all tasks: neither a join
    nor a task meets all statements of an array."""
    parts = math.ceil(met.count() / GATHERED) or 1
    ids = F.collect_list(F.struct("statement_id")).alias("_ids")  # in a struct, a null id stays
    gathered = met.groupBy("met", F.pmod(F.xxhash64("statement_id"), F.lit(parts)).alias("_part")).agg(ids)
    cuts = F.transform(F.sequence(F.lit(1), F.size("_ids"), F.lit(BLOCK)), lambda at: F.slice("_ids", at, BLOCK))
    pairs = gathered.select("met", F.explode(cuts).alias("_ids")).join(in_blocks(found, ["met"], item, "_items", BLOCK), "met")
    dealt = pairs.select("_ids", "_items").repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # an explode of a transform is not compiled together with the next one, so ids come one by one and no million rows are held
    each = dealt.select(F.explode(F.transform("_ids", lambda i: i["statement_id"])).alias("statement_id"), "_items")
    return each.select("statement_id", F.explode("_items").alias(item))


def rule_match(rules: DataFrame, statements: DataFrame) -> DataFrame:
    """(rule_id, statement_id) of every match, once.

    A rule with tables matches by table name (exact case), never by id; only a rule without tables matches by id.
    """
    live, met = rules.filter(F.col("enabled")), _met(statements, "conn_hash")
    found = _matched(met, _rule_tables(live).select("rule_id", "conn_hash", "table").distinct(), "conn_hash").select("met", "rule_id").distinct()
    by_id = (
        live.filter(F.size("tables") == 0)
        .select(F.col("id").alias("rule_id"), "conn_hash", F.explode("slow_query_ids").alias("statement_id"))
        .join(statements.select(F.col("id").alias("statement_id"), "conn_hash"), ["conn_hash", "statement_id"])
        .select("rule_id", "statement_id")
        .distinct()
    )
    # a rule id may stand for rules with and without tables
    new = by_id.join(met, "statement_id").join(found, ["met", "rule_id"], "left_anti")
    return _written_out(met, found, "rule_id").select("rule_id", "statement_id").unionByName(new.select("rule_id", "statement_id"))


def job_groups(rules: DataFrame, statements: DataFrame, same_connection: bool = True, block: int = 1000) -> DataFrame:
    """Jobs of those rule tables that occur in statements, per group as in :func:`rule_groups`.

    (conn_hash, table_names, table, block, jobs ARRAY of (rule_id, job_id), n_statements); conn_hash only with ``same_connection``.
    The job map is read under the rule's spelling of the table.
    """
    jobs = _rule_tables(rules).withColumn("job_id", F.try_element_at("job_ids", F.col("raw"))).filter(F.col("job_id").isNotNull())
    by = ["conn_hash"] if same_connection else []
    jobs = jobs.select(*by, "table", F.struct("rule_id", "job_id").alias("job")).distinct()
    met = jobs.join(_groups(statements, *by), [*by, "table"])
    return in_blocks(met, [*by, "table_names", "table"], "job", "jobs", block, ["n_statements"])


def matching_jobs(rules: DataFrame, statements: DataFrame, same_connection: bool = True) -> DataFrame:
    """(rule_id, statement_id, table, job_id), once, of those rule tables that occur in a statement; the job map is read under the
    rule's spelling."""
    by = ["conn_hash"] if same_connection else []
    jobs = _rule_tables(rules).withColumn("job_id", F.try_element_at("job_ids", F.col("raw"))).filter(F.col("job_id").isNotNull())
    met = _met(statements, *by)
    found = _matched(met, jobs.select(*by, "table", "rule_id", "job_id").distinct(), *by)
    found = found.select("met", F.struct("rule_id", "table", "job_id").alias("job")).distinct()
    return _written_out(met, found, "job").select("job.rule_id", "statement_id", "job.table", "job.job_id")


def resolve_tables(rules: DataFrame, statements: DataFrame) -> DataFrame:
    """Tables of a rule: its own and those of its statements on the same connection.

    Unique by lower-case trimmed name. The rule's spelling goes first (its last one if it has several),
    then the first one met along its statement ids.
    """
    own = rules.select(F.col("id").alias("rule_id"), F.posexplode("tables").alias("pos", "raw")).select(
        "rule_id", F.trim("raw").alias("table"), F.struct(F.lit(0).alias("src"), (-F.col("pos")).alias("a"), F.lit(0).alias("b")).alias("at")
    )
    ids = rules.select(F.col("id").alias("rule_id"), "conn_hash", F.posexplode("slow_query_ids").alias("qpos", "statement_id"))
    # only the statements some rule names are taken apart
    wanted = statements.select(F.col("id").alias("statement_id"), "conn_hash", "table_names").join(
        ids.select("statement_id", "conn_hash").distinct(), ["conn_hash", "statement_id"], "left_semi"
    )
    named = explode_each(wanted, csv_items("table_names"), "table", "statement_id", "conn_hash", position="tpos")
    found = ids.join(named, ["conn_hash", "statement_id"]).select(
        "rule_id", "table", F.struct(F.lit(1).alias("src"), F.col("qpos").alias("a"), F.col("tpos").alias("b")).alias("at")
    )
    both = own.filter(F.col("table") != "").unionByName(found)
    return both.groupBy("rule_id", _norm(F.col("table")).alias("table_key")).agg(F.min_by("table", "at").alias("table"))


def _endpoint(conn: Column) -> Column:
    """Database of a connection that replication can use: known kind, host, credentials and database."""
    def usable(p: Column) -> Column:
        complete = p["host"].isNotNull() & p["database"].isNotNull() & p["username"].isNotNull() & p["has_password"]
        return F.when(complete, p["database"])

    return let(parse_connection(conn), usable)


def expected_jobs(rules: DataFrame, statements: DataFrame, prefix: str = MANAGED_PREFIX) -> DataFrame:
    """One job per job name, owned by the first enabled rule that asks for it."""
    live = rules.filter(F.col("enabled")).withColumn("database", _endpoint(F.col("conn_hash"))).filter(
        F.col("database").isNotNull()
    )
    tables = resolve_tables(live, statements)
    asked = live.select(F.col("id").alias("rule_id"), "pos", "conn_hash", "database").join(tables, "rule_id")
    asked = asked.withColumn("job_name", job_name("conn_hash", "database", "table", prefix))
    first = F.min_by(F.struct("rule_id", "table"), F.struct("pos", "rule_id", "table_key"))
    return asked.groupBy("job_name").agg(first.alias("f")).select("job_name", "f.rule_id", "f.table")


def reconcile(expected: DataFrame, running: DataFrame, prefix: str = MANAGED_PREFIX) -> DataFrame:
    """keep / submit / cancel per job name; running jobs without the managed prefix are left alone."""
    joined = expected.join(running, "job_name", "full_outer")
    action = (
        F.when(F.col("rule_id").isNotNull() & F.col("job_id").isNotNull(), "keep")
        .when(F.col("rule_id").isNotNull(), "submit")
        .when(F.col("job_name").startswith(prefix), "cancel")
    )
    return joined.withColumn("action", action).filter(F.col("action").isNotNull())


def job_status(
    rules: DataFrame, statements: DataFrame, running: DataFrame, enabled: bool = True, prefix: str = MANAGED_PREFIX
) -> DataFrame:
    """Per rule and table: disabled > invalid-connection > running > missing > pending.

    Tables known only from the stored job map are listed under their map key.
    """
    stored = rules.select(F.col("id").alias("rule_id"), F.explode("job_ids").alias("table_key", "stored_job_id"))
    tables = resolve_tables(rules, statements).join(stored, ["rule_id", "table_key"], "full_outer")
    tables = tables.withColumn("table", F.coalesce("table", "table_key"))
    info = rules.select(F.col("id").alias("rule_id"), "conn_hash", _endpoint(F.col("conn_hash")).alias("database"))
    named = tables.join(info, "rule_id").withColumn("job_name", job_name("conn_hash", "database", "table", prefix))
    live = running.select("job_name", F.col("job_id").alias("live_job_id"))
    if not enabled:
        live = live.filter(F.lit(False))
    joined = named.join(live, "job_name", "left")

    def filled(c: str) -> Column:
        return F.coalesce(F.trim(c), F.lit("")) != ""

    status = (
        F.when(F.lit(not enabled), "disabled")
        .when(F.col("database").isNull(), "invalid-connection")
        .when(filled("live_job_id"), "running")
        .when(filled("stored_job_id"), "missing")
        .otherwise("pending")
    )
    return joined.select("rule_id", "table", "job_name", "stored_job_id", "live_job_id", status.alias("status"))


def in_blocks(pairs: DataFrame, keys: list[str], item: str, name: str, block: int = 1000, also: list[str] = ()) -> DataFrame:
    """Sorted lists of at most ``block`` items per key, numbered from 0; ``also`` are columns that a key decides."""
    placed = numbered(pairs, keys, [item], "_rn").withColumn("block", F.floor((F.col("_rn") - 1) / block).cast("long"))
    return placed.groupBy(*keys, *also, "block").agg(F.array_sort(F.collect_list(item)).alias(name))


def rules_by_table(rules: DataFrame, block: int = 1000) -> DataFrame:
    """Index table -> rule ids; long lists continue in further blocks."""
    pairs = rules.select(F.explode("tables").alias("table"), F.col("id").alias("rule_id")).distinct()
    return in_blocks(pairs, ["table"], "rule_id", "rule_ids", block)


def tables_of_queries(statements: DataFrame, rules: DataFrame, conns: list[str] | None = None) -> DataFrame:
    """Tables known for the chosen connections and how many rules of that connection name them."""
    rows = statements.filter(F.coalesce(F.trim("conn_hash"), F.lit("")) != "")
    if conns:
        rows = rows.filter(F.col("conn_hash").isin(conns))
    known = explode_each(rows, csv_items("table_names"), "table", "conn_hash").distinct()
    named = (
        rules.select("conn_hash", F.explode("tables").alias("raw"), F.col("id").alias("rule_id"))
        .select("conn_hash", _norm(F.col("raw")).alias("_k"), "rule_id")
        .distinct()
    )
    covered = named.groupBy("conn_hash", "_k").agg(F.count(F.lit(1)).alias("n_rules"))
    return (
        known.withColumn("_k", _norm(F.col("table")))
        .join(covered, ["conn_hash", "_k"], "left")
        .select("conn_hash", "table", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"))
    )


def rule_stats(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count_if("enabled").alias("enabled_rules"),
        F.count_if(F.size(F.coalesce("job_ids", F.create_map().cast("map<string,string>"))) > 0).alias("rules_with_jobs"),
    )

