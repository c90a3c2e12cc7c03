"""Sync state of replicated tables and the routing decision that rests on it.

state: job_name, conn_hash, database, table_name, job_id, rule_id, ready, snapshot_finished,
update_time (ms). ``now`` is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.connection import database_name, job_name
from tideline.functions.shape import map_lookup_ci
from tideline.functions.sql_text import referenced_tables, referenced_tables_ci
from tideline.operators.rules import MANAGED_PREFIX

# --- fixed values -------------------------------------------------------------
STALE_MS = 300_000
HEALTH_FRESH_MS = 60_000
HEALTH_LAG_MS = 5_000
# ------------------------------------------------------------------------------

STATE_COLUMNS = [
    "job_name", "conn_hash", "database", "table_name", "job_id", "rule_id", "ready", "snapshot_finished", "update_time",
]


def is_stale(now: int, max_age_ms: int = STALE_MS) -> Column:
    return F.lit(now) - F.coalesce(F.col("update_time"), F.lit(0)) > max_age_ms


def is_available(now: int, max_age_ms: int = STALE_MS) -> Column:
    return F.coalesce(F.col("ready"), F.lit(False)) & ~is_stale(now, max_age_ms)


def available_tables(state: DataFrame, now: int, max_age_ms: int = STALE_MS) -> DataFrame:
    return state.filter(is_available(now, max_age_ms))


def sync_status_view(state: DataFrame, now: int) -> DataFrame:
    return state.select(
        "conn_hash", "database", "table_name",
        is_available(now).alias("ready"),
        "snapshot_finished",
        is_stale(now).alias("stale"),
        "update_time", "job_name", "job_id", "rule_id",
    )


def sync_bucket_counts(state: DataFrame, now: int) -> DataFrame:
    """Total and the first bucket that fits: ready, syncing, stale, waiting."""
    view = sync_status_view(state, now)
    updated = F.coalesce(F.col("update_time"), F.lit(0)) > 0
    bucket = (
        F.when(F.col("ready"), "ready")
        .when(F.col("snapshot_finished") == F.lit(False), "syncing")
        .when(F.col("stale"), "stale")
        .when(~updated, "waiting")
    )
    return view.select(bucket.alias("b")).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("b") == b).alias(b) for b in ("ready", "syncing", "stale", "waiting")]
    )


def sync_label(state: DataFrame, now: int) -> DataFrame:
    """Label shown per table; here a missing update goes first."""
    label = (
        F.when(F.coalesce(F.col("update_time"), F.lit(0)) == 0, "waiting")
        .when(F.col("ready"), "ready")
        .when(F.col("snapshot_finished") == F.lit(False), "syncing")
        .when(F.col("stale"), "stale")
        .otherwise("not_ready")
    )
    return sync_status_view(state, now).select("job_name", label.alias("label"))


def job_health(jobs: DataFrame, now: int) -> DataFrame:
    healthy = (
        (F.lit(now) - F.col("update_time") <= HEALTH_FRESH_MS)
        & (F.upper("phase") == "INCREMENTAL")
        & (F.upper("status") == "RUNNING")
        & (F.col("lag") < HEALTH_LAG_MS)
    )
    return jobs.withColumn("healthy", F.coalesce(healthy, F.lit(False)))


def sync_state_update(state: DataFrame, feed: DataFrame) -> DataFrame:
    """Fold a feed (job_name, job_id, state, ts, seq, database, table, conn_hash) into the state table.

    The fold only needs a few places of a job's feed: its last record, the last known state, the last state other than FAILED and
    the first record that names each of database, table and connection. Places are (ts, seq) as one number, so finding them is a
    hash aggregate, combined map-side, for feeds of any length; texts are then read at those places. Records of one place are the
    same record; ts lies below 10^17, seq is not negative.
    """
    known = F.col("state").isin("SNAPSHOT_SYNCING", "INCREMENTAL_SYNCING", "INCREMENTAL_IDLE", "FAILED")
    wide, one = "decimal(38,0)", F.lit(10).cast("decimal(2,0)")
    at = F.col("ts").cast("decimal(17,0)") * F.expr("10000000000000000000BD") + F.col("seq").cast("decimal(19,0)")
    rows = feed.filter(F.col("job_name").isNotNull()).withColumns({
        "_at": at.cast(wide), "_syncing": F.col("state").startswith("INCREMENTAL").cast("int")
    })
    flagged = (F.col("_at") * one + F.col("_syncing")).cast(wide)
    texts = ["database", "table", "conn_hash"]
    places = rows.groupBy("job_name").agg(
        F.max("ts").alias("e_ts"),
        F.max("_at").alias("_last"),
        F.max(F.when(known, flagged)).alias("_known"),
        F.max(F.when(known & (F.col("state") != "FAILED"), flagged)).alias("_working"),
        *[F.min(F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_{c}_at") for c in texts],
    )
    met = rows.select("job_name", "_at", "job_id", *texts).join(places.select("job_name", "_last", *[f"_{c}_at" for c in texts]), "job_name")
    met = met.filter(" OR ".join(["_at = _last", *[f"_at = _{c}_at" for c in texts]]))
    read = met.groupBy("job_name").agg(
        F.collect_set(F.when(F.col("_at") == F.col("_last"), F.col("job_id"))).alias("e_job"),
        *[F.collect_set(F.when(F.col("_at") == F.col(f"_{c}_at"), F.col(c))).alias(f"e_{c}") for c in texts],
    )
    folded = places.join(read, "job_name").select(
        "job_name", "e_ts",
        *[F.array_max(c).alias(c) for c in ("e_job", *[f"e_{t}" for t in texts])],
        *[(F.col(c) % one == 1).alias(to) for c, to in (("_known", "e_ready"), ("_working", "e_snapshot"))],
    )
    touched = F.col("e_ts").isNotNull()
    return state.join(folded, "job_name", "full_outer").select(
        "job_name",
        F.coalesce("conn_hash", "e_conn_hash").alias("conn_hash"),
        F.coalesce("database", "e_database").alias("database"),
        F.coalesce("table_name", "e_table").alias("table_name"),
        F.when(touched, F.col("e_job")).otherwise(F.col("job_id")).alias("job_id"),
        "rule_id",
        F.coalesce("e_ready", "ready", F.lit(False)).alias("ready"),
        F.coalesce("e_snapshot", "snapshot_finished", F.lit(False)).alias("snapshot_finished"),
        F.coalesce("e_ts", "update_time").alias("update_time"),
    )


def snapshot_finished_fanout(notices: DataFrame, state: DataFrame) -> DataFrame:
    """``[db.t1, db.t2]`` notices (tables, job_id, ts): every state of such a table becomes ready.

    On all connections. Of several notices the latest one is kept.
    """
    names = F.split(F.regexp_replace("tables", r"[\[\]]", ""), ",")
    hits = (
        notices.filter(F.col("tables").isNotNull())
        .select(F.explode(names).alias("path"), "job_id", "ts")
        .select(F.lower(F.trim(F.substring_index(F.trim("path"), ".", -1))).alias("table_name"), F.coalesce("job_id", F.lit("")).alias("n_job"), F.col("ts").alias("n_ts"))
        .groupBy("table_name")
        .agg(F.max_by("n_job", F.struct("n_ts", "n_job")).alias("n_job"), F.max("n_ts").alias("n_ts"))
    )
    hit = F.col("n_ts").isNotNull()
    joined = state.join(hits, "table_name", "left")
    return joined.select(
        "job_name", "conn_hash", "database", "table_name",
        F.when(hit, F.col("n_job")).otherwise(F.col("job_id")).alias("job_id"),
        "rule_id",
        F.when(hit, True).otherwise(F.col("ready")).alias("ready"),
        F.when(hit, True).otherwise(F.col("snapshot_finished")).alias("snapshot_finished"),
        F.when(hit, F.col("n_ts")).otherwise(F.col("update_time")).alias("update_time"),
    )


def _rule_states(rules: DataFrame, prefix: str) -> DataFrame:
    wanted = rules.withColumn("database", database_name("conn_hash")).filter(F.col("database").isNotNull())
    rows = wanted.select("id", "pos", "conn_hash", "database", "job_ids", F.posexplode("tables").alias("tpos", "table"))
    return rows.withColumn("job_name", job_name("conn_hash", "database", "table", prefix))


def rule_state_seed(
    rules: DataFrame, state: DataFrame, removed: DataFrame | None = None, prefix: str = MANAGED_PREFIX
) -> DataFrame:
    """State table after the enabled rules were (re)loaded and ``removed`` rules were dropped.

    Missing tables get an empty state; the last rule naming a table owns it; a known job id is attached.
    """
    asked = _rule_states(rules.filter(F.col("enabled")), prefix)
    at = F.struct("pos", "tpos")
    job = map_lookup_ci("job_ids", "table")
    seeds = asked.groupBy("job_name").agg(
        F.min_by("conn_hash", at).alias("r_conn"),
        F.min_by("database", at).alias("r_db"),
        F.min_by(F.lower(F.trim("table")), at).alias("r_table"),
        F.max_by("id", at).alias("r_rule"),
        F.max_by(job, F.when(job.isNotNull(), at)).alias("r_job"),
    )
    merged = state.join(seeds, "job_name", "full_outer").select(
        "job_name",
        F.coalesce("conn_hash", "r_conn").alias("conn_hash"),
        F.coalesce("database", "r_db").alias("database"),
        F.coalesce("table_name", "r_table").alias("table_name"),
        F.coalesce("r_job", "job_id").alias("job_id"),
        F.coalesce("r_rule", "rule_id").alias("rule_id"),
        F.coalesce("ready", F.lit(False)).alias("ready"),
        F.coalesce("snapshot_finished", F.lit(False)).alias("snapshot_finished"),
        F.coalesce("update_time", F.lit(0)).cast("long").alias("update_time"),
    )
    if removed is not None:
        merged = merged.join(_rule_states(removed, prefix).select("job_name").distinct(), "job_name", "left_anti")
    return merged


def _ready_per_text(statements: DataFrame, state: DataFrame, now: int, strict: bool, prefix: str) -> DataFrame:
    """(conn_hash, sql, table, job_name, available) of the different statements; one without tables keeps a row."""
    texts = statements.select("conn_hash", "sql").distinct()
    rows = texts.select("conn_hash", "sql", F.explode_outer(referenced_tables_ci(referenced_tables("sql"))).alias("table"))
    rows = rows.withColumn("job_name", job_name("conn_hash", database_name("conn_hash"), "table", prefix))
    usable = is_available(now)
    if strict:
        usable = usable & F.coalesce(F.col("cdc_state") == "INCREMENTAL_IDLE", F.lit(False))
    known = state.select("job_name", usable.alias("available"))
    return rows.join(known, "job_name", "left").withColumn("available", F.coalesce("available", F.lit(False)))


def _of_texts(statements: DataFrame, per_text: DataFrame) -> DataFrame:
    """What is known per text, for every statement."""
    s = statements.select("id", F.col("conn_hash").alias("_conn"), F.col("sql").alias("_sql"))
    same = s["_conn"].eqNullSafe(per_text["conn_hash"]) & s["_sql"].eqNullSafe(per_text["sql"])
    return s.join(per_text, same).drop("_conn", "_sql")


def table_ready_join(
    statements: DataFrame, state: DataFrame, now: int, strict: bool = False, prefix: str = MANAGED_PREFIX
) -> DataFrame:
    """One row per (statement, table) with its availability; a statement without tables keeps one row.

    ``strict`` asks for an idle table (column ``cdc_state`` of the state) instead of a ready one. A text is
    taken apart once per connection, however often it was run.
    """
    found = _of_texts(statements, _ready_per_text(statements, state, now, strict, prefix))
    return found.select("id", "conn_hash", "table", "job_name", "available")


def route_decision(
    statements: DataFrame,
    state: DataFrame,
    now: int,
    strict: bool = False,
    skips: DataFrame | None = None,
    prefix: str = MANAGED_PREFIX,
) -> DataFrame:
    """replica when all tables of a statement are available, source otherwise, skip for ids in ``skips``.

    Decided per connection and text, a row per statement.
    """
    per_table = _ready_per_text(statements, state, now, strict, prefix)
    route = F.when(F.bool_and(F.col("available") & F.col("table").isNotNull()), "replica").otherwise("source")
    per_text = per_table.groupBy("conn_hash", "sql").agg(route.alias("route"), F.count("table").alias("n_tables"))
    decided = _of_texts(statements, per_text).select("id", "route", "n_tables")
    if skips is None:
        return decided
    marked = decided.join(skips.select("id", F.lit(True).alias("_skip")).distinct(), "id", "left")
    return marked.select("id", F.when(F.col("_skip"), "skip").otherwise(F.col("route")).alias("route"), "n_tables")
