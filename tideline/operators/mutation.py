"""Table mutation as DataFrame rewrites: each function returns the table after the statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.operators.ordered import numbered


def update_where(df: DataFrame, cond: Column, sets: dict[str, Column]) -> DataFrame:
    """Every right-hand side sees the old row; a NULL condition leaves the row alone."""
    hit = F.coalesce(cond, F.lit(False))
    return df.select(
        *[
            F.when(hit, sets[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)
            for c in df.columns
        ]
    )


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    return df.filter(~F.coalesce(cond, F.lit(False)))


def insert_rows(df: DataFrame, new: DataFrame, id_col: str | None = None, order: list[str] = ()) -> DataFrame:
    """Append rows; with ``id_col`` they get ids that continue after the largest one, along ``order``.

    The numbering is distributed: a big insert is not pulled through one task.
    """
    if id_col is None:
        return df.unionByName(new)
    largest = df.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("largest"))
    with_id = numbered(new, [], list(order), "_rn")
    new_id = (largest.scalar() + F.col("_rn")).cast(df.schema[id_col].dataType)
    return df.unionByName(with_id.withColumn(id_col, new_id).drop("_rn"))


def upsert_accumulate(
    df: DataFrame, new: DataFrame, keys: list[str], replace: list[str] = (), add: list[str] = ()
) -> DataFrame:
    """Insert, or on an existing key replace some columns and add up others.

    ``new`` may repeat a key: its rows carry ``_seq`` in that case, the last one gives the replaced
    columns and all of them are added.
    """
    seq = F.col("_seq") if "_seq" in new.columns else F.lit(0)
    folded = new.groupBy(*keys).agg(
        *[F.max_by(c, seq).alias(f"_new_{c}") for c in replace],
        *[F.sum(c).cast(new.schema[c].dataType).alias(f"_new_{c}") for c in add],
        F.lit(True).alias("_hit"),
    )
    joined = df.join(folded, keys, "full_outer")
    out = []
    for c in df.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in add:
            both = F.col(c) + F.col(f"_new_{c}")
            out.append(F.coalesce(both, F.col(f"_new_{c}"), F.col(c)).cast(df.schema[c].dataType).alias(c))
        elif c in replace:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def update_from_aggregate(
    df: DataFrame,
    lines: DataFrame,
    key: str,
    line_key: str,
    target: str,
    agg: Column,
    where: Column | None = None,
    default=None,
    only_with_lines: Column | None = None,
) -> DataFrame:
    """SET target = (aggregate over the row's lines).

    ``default`` fills rows without lines (else they get NULL). ``only_with_lines`` is a condition on
    the lines: rows with no such line keep their value (the EXISTS form).
    """
    aggs = [agg.alias("_agg")]
    if only_with_lines is not None:
        aggs.append(F.max(F.coalesce(only_with_lines, F.lit(False))).alias("_exists"))
    per_key = lines.groupBy(F.col(line_key).alias("_k")).agg(*aggs)
    joined = df.join(per_key, F.col(key) == F.col("_k"), "left")
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    if only_with_lines is not None:
        hit = hit & F.coalesce(F.col("_exists"), F.lit(False))
    value = F.coalesce(F.col("_agg"), F.lit(default)) if default is not None else F.col("_agg")
    kind = df.schema[target].dataType
    return joined.select(
        *[F.when(hit, value.cast(kind)).otherwise(F.col(c)).alias(c) if c == target else F.col(c) for c in df.columns]
    )
