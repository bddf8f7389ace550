"""Seeded samples of exact size, without collecting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_key(column: str, seed: int):
    """A pseudo-random but repeatable order of ids, the same in any engine with md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(column)))


def _first(rows: DataFrame, keys: list[str], wanted, by: list[str]) -> DataFrame:
    """rows(..., __o) -> + __in: whether a row is among the first `wanted` (a Column over n, the rows with its values of `by`) in
    the order of __o and keys.

    The first three hex digits of the order make 4,096 buckets in order. Buckets are counted; rows of buckets below the one at
    the limit are in, and only that bucket, a 4,096th of the rows, is put in order in one task.
    """
    cells = rows.withColumn("__b", F.substring("__o", 1, 3))
    sizes = cells.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*by).orderBy("__b")) - F.col("__c")
    limits = sizes.withColumns({"__before": before, "n": F.sum("__c").over(Window.partitionBy(*by))}).withColumn("__want", wanted).select(*by, "__b", "__before", "__want", "__c")
    at = cells.join(F.broadcast(limits), [*by, "__b"])
    whole = at.where(F.col("__before") + F.col("__c") <= F.col("__want")).withColumn("__in", F.lit(True))
    none = at.where(F.col("__before") >= F.col("__want")).withColumn("__in", F.lit(False))
    edge = at.where((F.col("__before") < F.col("__want")) & (F.col("__before") + F.col("__c") > F.col("__want")))
    ranked = edge.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__o", *keys)))
    edge = ranked.withColumn("__in", F.col("__before") + F.col("__r") <= F.col("__want")).drop("__r")
    return whole.unionByName(none).unionByName(edge).drop("__b", "__before", "__want", "__c")


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (all, when there are fewer) in the order of order_key; no task holds more than a bucket (_first)."""
    rows = df.withColumns({"__o": order_key(key, seed), "__all": F.lit(0)})
    return _first(rows, [key], F.lit(n), ["__all"]).where("__in").drop("__o", "__in", "__all")


def truth_preserving_sample(targets: DataFrame, needed: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Every target that needed(cand_id) names, and random others up to n rows in all."""
    ids = needed.select(F.col("cand_id").alias("entity_id")).distinct()
    kept = targets.join(ids, "entity_id", "left_semi")
    missing = max(0, n - kept.count())
    others = exact_sample(targets.join(ids, "entity_id", "left_anti"), "entity_id", missing, seed)
    return kept.unionByName(others)


def stratified_split(df: DataFrame, label: str, keys: list[str], share: float = 0.2, seed: int = 42, group: str | None = None) -> DataFrame:
    """df + is_validation: a share of the rows of each label, exact to one row. group puts all rows of one value on one side,
    by hash, near the share.

    Rows of a label are taken in hash order by buckets (_first), so a label with most rows is not ordered in one task.
    """
    if group:
        h = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(1_000_000))
        return df.withColumn("is_validation", h < int(share * 1_000_000))
    rows = df.withColumn("__o", F.md5(F.concat_ws("|", F.lit(str(seed)), *keys)))
    return _first(rows, keys, F.ceil(F.col("n") * share), [label]).drop("__o").withColumnRenamed("__in", "is_validation")
