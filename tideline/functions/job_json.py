"""Reading job descriptions delivered as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.sql_text import _col
from tideline.operators.ordered import best_per_key

_VERTICES = "$.jobDag.vertices"
_VERTEX_MAP = "$.jobDag.vertexInfoMap"


def _first_text(vertex: Column, path: str) -> Column:
    """First element when the field is a list, the text when it is text."""
    raw = F.get_json_object(vertex, path)
    as_list = F.from_json(raw, "array<string>")
    return F.when(raw.startswith("["), F.try_element_at(as_list, F.lit(1))).otherwise(F.nullif(raw, F.lit("")))


def job_table(json: Column | str) -> Column:
    """(database, table) a job works on: the first vertex that tells both, else NULLs."""
    text = _col(json)
    listed = F.get_json_object(text, _VERTICES)
    listed = F.when(listed.startswith("["), listed).otherwise(F.get_json_object(text, _VERTEX_MAP))
    vertices = F.when(listed.startswith("["), F.from_json(listed, "array<string>"))

    def read(v: Column) -> Column:
        db = _first_text(v, "$.pluginConfig['database-names']")
        tb = _first_text(v, "$.pluginConfig['table-names']")
        path = F.try_element_at(F.from_json(F.get_json_object(v, "$.tablePaths"), "array<string>"), F.lit(1))
        parts = F.split(path, r"\.", 2)
        configured = db.isNotNull() & tb.isNotNull()
        has_path = path.contains(".")
        return F.struct(
            F.when(configured, db).when(has_path, F.try_element_at(parts, F.lit(1))).alias("database"),
            F.when(configured, tb).when(has_path, F.try_element_at(parts, F.lit(2))).alias("table"),
        )

    found = F.filter(F.transform(vertices, read), lambda s: s["database"].isNotNull() & s["table"].isNotNull())
    return F.try_element_at(found, F.lit(1))


def _bracket_depth(text: Column) -> Column:
    """How deep the lists of a JSON text nest."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]]", ""), "")

    def step(acc: Column, mark: Column) -> Column:
        now = acc["now"] + F.when(mark == "[", 1).when(mark == "]", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


_AFTER = 1 << 30  # sorts a job behind those listed inside it
_JOBS = "struct<todo: array<struct<path: array<int>, json: string>>, found: array<struct<name: string, id: string, path: array<int>>>>"


def listed_jobs(json: Column | str) -> Column:
    """name, id and place of every job of a listing: ARRAY of structs.

    A fold over the levels of the text: the jobs of one level are noted and the ``jobs`` lists inside them are the next level. The
    expression is the same for any depth and any number of lists; a row is folded as often as its own lists nest.
    """
    text = F.trim(_col(json))

    def as_items(c: Column) -> Column:
        return F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))

    def entries(items: Column, path: Column) -> Column:
        return F.transform(items, lambda v, i: F.struct(F.concat(path, F.array(i)).alias("path"), v.alias("json")))

    def level(acc: Column, _: Column) -> Column:
        inner = F.transform(
            acc["todo"], lambda t: F.coalesce(entries(F.from_json(F.get_json_object(t["json"], "$.jobs"), "array<string>"), t["path"]), F.array())
        )
        jobs = F.transform(
            acc["todo"],
            lambda t: F.struct(
                F.get_json_object(t["json"], "$.jobName").alias("name"), F.get_json_object(t["json"], "$.jobId").alias("id"),
                F.concat(t["path"], F.array(F.lit(_AFTER))).alias("path"),
            ),
        )
        named = F.filter(jobs, lambda j: j["name"].isNotNull() & j["id"].isNotNull())
        return F.struct(F.flatten(inner).alias("todo"), F.concat(acc["found"], named).alias("found")).cast(_JOBS)

    start = F.struct(F.coalesce(entries(as_items(text), F.array().cast("array<int>")), F.array()).alias("todo"), F.array().alias("found")).cast(_JOBS)
    rounds = F.sequence(F.lit(0), F.coalesce(_bracket_depth(text), F.lit(0)))
    return F.aggregate(rounds, start, level, lambda acc: acc["found"])


def jobs_by_name(df: DataFrame, json: str = "json", order: str = "pos") -> DataFrame:
    """(job_name, job_id) from listings that may nest ``jobs`` lists; the last mention of a name wins.

    A listing is a list of jobs, one job, or an object with a ``jobs`` list, nested to any depth. Each
    listing is one row; ``order`` tells which listing came later.
    """
    jobs = df.select(F.col(order).alias("_o"), F.explode(listed_jobs(json)).alias("_j"))
    jobs = jobs.select("_o", F.col("_j.name").alias("job_name"), F.col("_j.id").alias("job_id"), F.col("_j.path").alias("_path"))
    return best_per_key(jobs, ["job_name"], "_o", [F.desc("_path")]).select("job_name", "job_id")
