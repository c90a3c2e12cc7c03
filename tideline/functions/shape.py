"""Value shaping: Oracle-like output, display text, and small typed helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideline.functions.sql_text import _col

# --- fixed values -------------------------------------------------------------
ORACLE_FORMAT = [("YYYY", "yyyy"), ("HH24", "HH"), ("MI", "mm"), ("SS", "ss"), ("DD", "dd")]
INTEGER_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
CONTROL_THRESHOLD = 4
# ISO control characters that are not white space
NON_BLANK_CONTROLS = "\\x00-\\x08\\x0e-\\x1b\\x7f-\\x9f"
# ------------------------------------------------------------------------------


def oracle_nvl(col: Column | str, default) -> Column:
    return F.coalesce(_col(col), F.lit(default))


def oracle_decode(col: Column | str, *pairs) -> Column:
    """``DECODE(c, s1, r1, .. [, default])``; NULL searches match NULL."""
    value, rest = _col(col), list(pairs)
    default = rest.pop() if len(rest) % 2 else None
    out = None
    for search, result in zip(rest[::2], rest[1::2]):
        cond = value.eqNullSafe(F.lit(search))
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return out.otherwise(F.lit(default))


def oracle_to_char(col: Column | str, fmt: str = "YYYY-MM-DD HH24:MI:SS") -> Column:
    for theirs, ours in ORACLE_FORMAT:
        fmt = fmt.replace(theirs, ours)
    return F.date_format(_col(col), fmt)


def oracle_sysdate() -> Column:
    return F.current_timestamp()


def oracle_shape(df: DataFrame) -> DataFrame:
    """'' becomes NULL, whole numbers become decimals, names become upper case."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        digits = INTEGER_DIGITS.get(type(f.dataType))
        if isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        elif digits:
            c = c.cast(T.DecimalType(digits, 0))
        cols.append(c.alias(f.name.upper()))
    return df.select(*cols)


def display_text(c: Column) -> Column:
    """Text that holds several control characters is shown as base64 of its Latin-1 bytes."""
    controls = F.length(F.regexp_replace(c, f"[^{NON_BLANK_CONTROLS}]", ""))
    latin = F.regexp_replace(c, "[^\\x00-\\xff]", "?")
    return F.when(controls >= CONTROL_THRESHOLD, F.base64(F.encode(latin, "ISO-8859-1"))).otherwise(c)


def display_value(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.BinaryType):
            c = F.base64(c)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            fraction = F.regexp_replace(F.date_format(c, ".SSSSSS"), "(000)*$|^\\.000000$", "")
            fraction = F.when(fraction == ".", "").otherwise(fraction)
            seconds = F.when((F.second(c) == 0) & (fraction == ""), "").otherwise(
                F.concat(F.date_format(c, ":ss"), fraction)
            )
            c = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm"), seconds, F.lit("Z"))
        elif isinstance(t, T.DecimalType):
            text = c.cast("string")
            c = F.when(text.contains("."), F.regexp_replace(text, "\\.?0+$", "")).otherwise(text)
        elif isinstance(t, T.StringType):
            c = display_text(c)
        elif t.typeName().startswith("time"):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def year_value(col: Column | str) -> Column:
    return F.year(_col(col))


def offset_timestamp(local: Column | str, minutes: Column | str) -> Column:
    """Local wall time plus its offset in minutes -> the instant, as wall time in UTC."""
    return _col(local) - F.make_interval(mins=_col(minutes))


def json_fields(col: Column | str, schema: str) -> Column:
    return F.from_json(_col(col), schema)


def json_or_text(col: Column | str, schema: str, text_field: str) -> Column:
    """Records start with ``{``; anything else is kept whole in ``text_field``."""
    raw = F.trim(_col(col))
    parsed = F.from_json(raw, schema)
    names = [part.split()[0] for part in schema.split(",")]
    types = {part.split()[0]: part.split()[1] for part in schema.split(",")}
    plain = F.struct(
        *[
            (raw if n == text_field else F.lit(None).cast(types[n])).alias(n)
            for n in names
        ]
    )
    return F.when(raw.startswith("{"), parsed).otherwise(plain)


def map_lookup_ci(mapping: Column | str, key: Column | str) -> Column:
    """Maps are stored under lower-case trimmed keys."""
    return F.try_element_at(_col(mapping), F.lower(F.trim(_col(key))))


def seeded_int(key: Column | str, n: int, salt: int = 0) -> Column:
    """Repeatable stand-in for ``random() * n``: an integer in [0, n) fixed by the key."""
    return F.pmod(F.xxhash64(_col(key), F.lit(salt)), F.lit(n)).cast("int")
