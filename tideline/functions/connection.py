"""Column expressions over connection URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tideline.functions.sql_text import _col, let

# --- fixed values -------------------------------------------------------------
DB_MARKS = [
    ("H2:", "H2"),
    ("MYSQL:", "MYSQL"),
    ("MARIADB:", "MARIADB"),
    ("POSTGRESQL:", "POSTGRES"),
    ("ORACLE:", "ORACLE"),
    ("SQLSERVER:", "SQL_SERVER"),
    ("DB2:", "DB2"),
]
DEFAULT_PORTS = {"MySQL": 3306, "Oracle": 1521}
DEFAULT_SERVICE = "ORCL"
# ------------------------------------------------------------------------------


def _hit(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def db_kind(url: Column | str) -> Column:
    text = F.upper(_col(url))
    out = F.when(text.contains(DB_MARKS[0][0]), DB_MARKS[0][1])
    for mark, name in DB_MARKS[1:]:
        out = out.when(text.contains(mark), name)
    return out.otherwise("UNMAPPED")


def database_name(url: Column | str) -> Column:
    """Text behind the last slash up to ``?``; NULL without a slash or when nothing follows it."""
    text = _col(url)
    return F.when(text.contains("/") & ~text.endswith("/"), F.regexp_extract(text, r"/([^/?]*)(?:\?[^/]*)?$", 1))


def strip_proxy_prefix(url: Column | str, tag: str = "proxy") -> Column:
    """Remove every ``tag[host]_`` routing mark."""
    return F.regexp_replace(_col(url), tag + r"\[[^\]]+\]_", "")


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def parse_connection(url: Column | str, tag: str = "proxy") -> Column:
    """Database kind, host, port, database, credentials and display name of a MySQL or Oracle URL.

    The password is returned only as ``has_password``: identities stored next to logs must not carry it.
    """

    def located(real: Column) -> Column:
        kind = F.when(real.contains(":mysql:") | real.startswith("mysql://"), "MySQL").when(
            real.contains(":oracle:") | real.startswith("oracle://"), "Oracle"
        )
        after_at = F.regexp_extract(real, r"@(.*)$", 1)
        sid_form = after_at.contains(":") & ~after_at.contains("/")
        thin = F.when(sid_form, F.regexp_replace(after_at, r"^([^:]*:[^:]*):", "$1/")).otherwise(after_at)
        tail = F.when(kind == "MySQL", _hit(real, r"mysql://(.*)$")).when(
            kind == "Oracle",
            F.when(real.startswith("oracle://"), _hit(real, r"^oracle://(.*)$")).when(real.contains("@"), thin),
        )
        return F.struct(real.alias("real"), kind.alias("kind"), tail.alias("tail"))

    def split(p: Column) -> Column:
        tail, kind = p["tail"], p["kind"]
        authority = F.regexp_extract(tail, r"^([^/?]*)", 1)
        host_port = F.regexp_replace(authority, r"^.*@", "")
        default = F.when(kind == "MySQL", DEFAULT_PORTS["MySQL"]).when(kind == "Oracle", DEFAULT_PORTS["Oracle"])
        port = F.coalesce(F.try_to_number(_hit(host_port, r":([0-9]+)$"), F.lit("99999")).cast("int"), default)
        path = _hit(tail, r"^[^/?]*/([^?]*)")
        return F.struct(
            p["real"].alias("real"),
            kind.alias("kind"),
            tail.isNotNull().alias("known"),
            _hit(authority, r"^(.*)@").alias("user_info"),
            _hit(host_port, r"^([^:]+)").alias("host"),
            port.alias("port"),
            F.when(kind == "Oracle", F.coalesce(path, F.lit(DEFAULT_SERVICE))).otherwise(path).alias("database"),
            _hit(tail, r"\?(.*)$").alias("query"),
        )

    def result(p: Column) -> Column:
        # the query string is read only when the inline part lacks one of the two, and then it wins
        complete = F.coalesce(p["user_info"].contains(":"), F.lit(False))
        inline_user = _decode(_hit(p["user_info"], r"^([^:]*)"))
        query_user = _decode(_hit(p["query"], r"(?i)(?:^|&)(?:user|username)=([^&]*)"))
        query_password = F.coalesce(p["query"].rlike(r"(?i)(?:^|&)(?:password|pwd)="), F.lit(False))
        shown = F.concat(
            p["host"], F.lit(":"), p["port"].cast("string"), F.lit("/"), F.coalesce(p["database"], F.lit("Unknown DB"))
        )
        known = p["known"]
        return F.struct(
            p["kind"].alias("db_type"),
            F.when(known, p["host"]).alias("host"),
            F.when(known, p["port"]).alias("port"),
            F.when(known, p["database"]).alias("database"),
            F.when(known, F.when(complete, inline_user).otherwise(F.coalesce(query_user, inline_user))).alias("username"),
            (known & (complete | query_password)).alias("has_password"),
            F.when(p["kind"].isNull() & (p["real"] != ""), "Unknown DB").when(known, shown).alias("name"),
        )

    real = strip_proxy_prefix(F.trim(_col(url)), tag)
    return let(let(let(real, located), split), result)


def job_name(conn: Column | str, database: Column | str, table: Column | str, prefix: str = "managed-") -> Column:
    """Stable name of the replication job of one table."""
    slug = F.regexp_replace(F.lower(F.concat(_col(database), F.lit("-"), _col(table))), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    return F.concat(F.lit(prefix), F.substring(F.md5(_col(conn)), 1, 8), F.lit("-"), slug)


def conn_identity(url: Column | str, user: Column | str, password: Column | str, mask: bool = True) -> Column:
    """URL with the credentials placed behind the scheme, unless it already has some.

    ``mask=True`` (the default) writes ``***`` for every password, also for those in the URL.
    """
    text = F.coalesce(_col(url), F.lit(""))
    usr, pwd = _col(user), _col(password)
    blank_user = F.trim(F.coalesce(usr, F.lit(""))) == ""
    blank_pwd = F.trim(F.coalesce(pwd, F.lit(""))) == ""
    shown = F.lit("***") if mask else F.url_encode(pwd)
    scheme = F.when(text.contains("_mysql://"), F.regexp_extract(text, r"^(.*?_mysql://)", 1)).otherwise(
        F.regexp_extract(text, r"^(.*?://)", 1)
    )
    rest = F.substr(text, F.length(scheme) + 1)
    inline = (scheme != "") & rest.rlike(r"^[^/?]*@")
    placed = F.concat(
        scheme, F.url_encode(usr), F.when(blank_pwd, "").otherwise(F.concat(F.lit(":"), shown)), F.lit("@"), rest
    )
    appended = F.concat(
        text,
        F.when(text.contains("?"), "&").otherwise("?"),
        F.lit("user="),
        F.url_encode(usr),
        F.when(blank_pwd, "").otherwise(F.concat(F.lit("&password="), shown)),
    )
    full = F.when((F.trim(text) == "") | blank_user | inline, text).when(scheme != "", placed).otherwise(appended)
    if not mask:
        return full
    full = F.regexp_replace(full, r"(://[^/?@:]*):[^/?@]*@", "$1:***@")
    return F.regexp_replace(full, r"(?i)([?&](?:password|pwd)=)[^&]*", "$1***")
