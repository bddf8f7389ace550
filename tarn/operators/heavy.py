"""Results per key when a few keys hold most records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"(?U)^\s+|\s+$"


def clean_key(c: Column) -> Column:
    """Trimmed of any white space and lower-cased; null when null or blank."""
    t = F.lower(F.regexp_replace(c.cast("string"), BLANK, ""))
    return F.when(t != "", t)


def per_key(df: DataFrame, fields: list[str], partials: dict[str, Column] | None = None) -> DataFrame:
    """(field_name, key_value, <one column per partial>) for every key of every field.

    Map-side combining: each task folds its rows into a bounded hash table of mergeable states (Spark's partial hash
    aggregate, which spills to a sorted run when full), so that a key that holds a third of all rows reaches the shuffle as
    one row per map task. The source is scanned once, whatever the number of fields. `partials` may hold algebraic
    aggregates only (count, sum, min, max, avg, ...), over columns of df; default: row_count = count(*). States of fixed width
    (numbers, times, truth values) live in the hash table; with a min or max of strings among them Spark sorts a task's rows
    by key first, still combining before the shuffle.

    Null and blank keys are no keys. An empty table gives no rows. Other columns of df, whatever their names, are not read
    unless a partial names them.
    """
    partials = partials or {"row_count": F.count(F.lit(1))}
    used = [F.struct(F.lit(f).alias("field_name"), clean_key(F.col(f"`{f}`")).alias("key_value")) for f in fields]
    if not used:
        raise ValueError("no fields")
    keyed = df.withColumn("__key", F.explode(F.array(*used))).where("__key.key_value IS NOT NULL")
    return keyed.groupBy(F.col("__key.field_name").alias("field_name"), F.col("__key.key_value").alias("key_value")).agg(*[c.alias(n) for n, c in partials.items()])


def heavy_keys(df: DataFrame, fields: list[str], share: float = 0.02) -> DataFrame:
    """(field_name, key_value, row_count, total_rows): the keys that hold at least `share` of all rows of df.

    A key at exactly the share counts (the share is read with a tolerance of 1e-12). total_rows counts every row, also those without a key; it is a second, single-row aggregate joined as a scalar.
    """
    counts = per_key(df, fields)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return counts.join(F.broadcast(total), how="cross").where(F.col("row_count") >= F.lit(share - 1e-12) * F.col("total_rows"))
