"""Column expressions over SQL text and log messages. No Python UDF: all of it stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values -------------------------------------------------------------
STATEMENT_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "TRUNCATE"]
WRITE_KEYWORDS = ["INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "TRUNCATE"]
UUID = "([a-f0-9-]{36})"
TRACE_PATTERNS = [
    r"会话\[" + UUID + r"\]",
    "Session " + UUID,
    "session -> " + UUID,
    "for session " + UUID,
    "client uuid " + UUID,
    "sessionUUID:" + UUID,
    "trace_id:" + UUID,
]
# ------------------------------------------------------------------------------

_NAME = r'[\w.`"\[\]]+'


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: long chains of expressions stay small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stripped(sql: Column | str) -> Column:
    """Text without leading and trailing white space of any kind (``trim`` only cuts blanks)."""
    return F.regexp_replace(F.coalesce(_col(sql), F.lit("")), r"^\s+|\s+$", "")


def normalize_sql(sql: Column | str) -> Column:
    return F.lower(F.regexp_replace(_stripped(sql), r"\s+", " "))


def statement_fingerprint(sql: Column | str, method: str = "xxhash64") -> Column:
    """Hash of the normalised text; ``md5`` gives an id other engines can compute too."""
    text = normalize_sql(sql)
    return F.md5(text) if method == "md5" else F.lower(F.hex(F.xxhash64(text)))


def slow_query_id(conn: Column | str, sql: Column | str) -> Column:
    """md5 over connection and raw text; a missing part is spelled ``null``."""
    return F.md5(F.concat(F.coalesce(_col(conn), F.lit("null")), F.lit("_"), F.coalesce(_col(sql), F.lit("null"))))


def query_type(sql: Column | str) -> Column:
    keyword = F.regexp_extract(F.upper(_stripped(sql)), r"^(" + "|".join(STATEMENT_KEYWORDS) + r")\s", 1)
    return F.when(keyword == "", F.lit("UNKNOWN")).otherwise(keyword)


def statement_class(sql: Column | str) -> Column:
    """SELECT wins whenever " select " occurs anywhere, so INSERT .. SELECT counts as SELECT."""
    text = F.lower(_stripped(sql))
    return (
        F.when(text.rlike("^(select|with)") | text.contains(" select "), "SELECT")
        .when(text.rlike("^(insert|update|delete)"), "DML")
        .when(text.rlike("^(create|alter|drop|truncate)"), "DDL")
        .when(text.rlike("^(commit|rollback|savepoint|begin)"), "TRANSACTION")
        .otherwise("UNKNOWN")
    )


def is_write(sql: Column | str) -> Column:
    return query_type(sql).isin(WRITE_KEYWORDS)


def is_read(sql: Column | str) -> Column:
    return query_type(sql) == "SELECT"


def _first(sql: Column, pattern: str) -> Column:
    return F.array(F.regexp_extract(sql, pattern, 1))


def referenced_tables(sql: Column | str) -> Column:
    """Tables named by a statement, in order.

    Duplicates go before the schema prefix is cut, so ``a.t`` and ``b.t`` give ``[t, t]``.
    """
    none = F.array().cast("array<string>")

    def named(p: Column) -> Column:
        text, kind = p["text"], p["kind"]
        from_list = F.split(F.regexp_extract(text, rf"(?i)\bFROM\s+({_NAME}(?:\s*,\s*{_NAME})*)", 1), r"\s*,\s*")
        joins = F.regexp_extract_all(text, F.lit(rf"(?i)\bJOIN\s+({_NAME})"), 1)
        return (
            F.when(kind == "SELECT", F.concat(from_list, joins))
            .when(kind == "INSERT", _first(text, rf"(?i)\bINSERT\s+INTO\s+({_NAME})"))
            .when(kind == "UPDATE", _first(text, rf"(?i)\bUPDATE\s+({_NAME})"))
            .when(kind == "DELETE", _first(text, rf"(?i)\bDELETE\s+FROM\s+({_NAME})"))
            .otherwise(none)
        )

    # text and type are bound once; the branches then look at them
    parts = let(let(F.coalesce(_col(sql), F.lit("")), lambda t: F.struct(t.alias("text"), query_type(t).alias("kind"))), named)
    clean = F.transform(parts, lambda n: F.regexp_replace(n, r'[`"\[\]]', ""))
    clean = F.array_distinct(F.filter(clean, lambda n: n != ""))
    return F.transform(clean, lambda n: F.substring_index(n, ".", -1))


def referenced_tables_ci(names: Column | str) -> Column:
    """Last part of each name, unique ignoring case; the first spelling stays."""
    last = F.transform(
        _col(names), lambda n: F.trim(F.substring_index(F.regexp_replace(n, r"""[`"'\[\]]""", ""), ".", -1))
    )
    kept = F.filter(last, lambda n: F.length(n) > 0)
    both = let(kept, lambda ns: F.struct(ns.alias("names"), F.transform(ns, lambda n: F.lower(n)).alias("lowered")))
    return let(
        both, lambda p: F.filter(p["names"], lambda n, i: F.array_position(p["lowered"], F.lower(n)) == i + 1)
    )


def modified_tables(sql: Column | str) -> Column:
    """Lower-case targets of every UPDATE / INSERT INTO / DELETE FROM in the text, each once."""
    hits = F.regexp_extract_all(
        F.coalesce(_col(sql), F.lit("")),
        F.lit(r"""(?i)(?:UPDATE|INSERT\s+INTO|DELETE\s+FROM)\s+[`"']?([\w.]+)[`"']?"""),
        1,
    )
    return F.array_distinct(F.transform(hits, lambda n: F.lower(F.substring_index(n, ".", -1))))


def preview_sql(sql: Column | str, width: int = 100) -> Column:
    text = F.coalesce(_col(sql), F.lit("null"))
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def query_age(ts_ms: Column | str, now_ms: Column | int) -> Column:
    """Whole minutes since the statement and the bucket it falls into."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    span = now - _col(ts_ms)
    minutes = F.when(span < 0, -F.floor(-span / 60000)).otherwise(F.floor(span / 60000)).cast("long")
    bucket = F.when(minutes < 5, "realtime").when(minutes < 60, "recent").otherwise("history")
    return F.struct(minutes.alias("minutes"), bucket.alias("category"), (minutes < 60).alias("is_recent"))


def trace_id(message: Column | str) -> Column:
    """First of the known session-id spellings found in a message, else NULL."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_col(message), p, 1), F.lit("")) for p in TRACE_PATTERNS])


def explode_each(df: DataFrame, items: Column, name: str, *keep: str | Column, position: str | None = None) -> DataFrame:
    """One row per element; rows without elements go.

    A plain ``explode`` makes the optimizer add a size filter that computes ``items`` a second time.
    """
    if position:
        out = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    else:
        out = df.select(*keep, F.explode_outer(items).alias(name))
    return out.filter(F.col(name).isNotNull())


def csv_items(names: Column | str) -> Column:
    """Trimmed non-blank elements of a comma list; NULL gives an empty array."""
    parts = F.transform(F.split(F.coalesce(_col(names), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda n: n != "")
