"""Choosing matches among candidates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.functions.words import KEY_LEGAL
from tarn.operators.features import with_features
from tarn.storage import cut

MATCHES = 5


def tiered_match(s1: DataFrame, targets: DataFrame, most: int = MATCHES, enough: int = 3, allow_blank: bool = False) -> DataFrame:
    """(s1_id, cand_id, rank): exact key matches in three tiers: whole name, sorted tokens, core tokens.

    A tier is asked only while those before gave fewer than `enough` ids; inside a tier source 2 comes before 3, then id. Blocks
    can be as large as the most frequent name, so only the first most + enough ids of each key and source are joined: more
    could not be chosen. allow_blank lets empty names match each other.
    """
    def keyed(t: DataFrame) -> DataFrame:
        n = T.normalize_key(F.col("business_name"))
        keys = [(0, n), (1, T.sorted_tokens(n)), (2, T.core_tokens(n, KEY_LEGAL))]
        cells = [F.when(F.lit(allow_blank) | (v != ""), F.struct(F.lit(i).alias("tier"), v.alias("value"))) for i, v in keys]
        return t.select("entity_id", "src", "country_l", F.explode(F.array_compact(F.array(*cells))).alias("k")).select("entity_id", "src", "country_l", "k.tier", "k.value")

    on = ["country_l", "tier", "value"]
    first = Window.partitionBy("src", *on).orderBy("entity_id")
    index = keyed(targets).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= most + enough + most).drop("rn")
    hits = keyed(s1).select(*on, F.col("entity_id").alias("s1_id")).join(index.select(*on, "src", F.col("entity_id").alias("cand_id")), on)
    per = hits.repartition("s1_id").groupBy("s1_id", "cand_id", "src").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("s1_id")
    n = lambda t: F.sum((F.col("tier") <= t).cast("int")).over(w)
    per = per.withColumn("n0", n(0)).withColumn("n1", n(1))
    # the third tier is asked where the first two gave fewer than enough, even when the second wasn't needed
    asked = (F.col("tier") == 0) | (F.col("tier") == 1) & (F.col("n0") < enough) | (F.col("tier") == 2) & (F.col("n0") < enough) & (F.col("n1") < enough)
    ranked = per.where(asked).withColumn("rank", F.row_number().over(w.orderBy("tier", "src", "cand_id")).cast("int"))
    return ranked.where(F.col("rank") <= most).select("s1_id", "cand_id", "rank")


def linear(coefficients: dict[str, float], intercept: float) -> Column:
    """Score of a linear model; terms in the given order."""
    score = F.lit(float(intercept))
    for name, c in coefficients.items():
        score = score + F.lit(float(c)) * F.col(name)
    return score


def logistic(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def top_matches(scored: DataFrame, threshold: float, most: int = MATCHES) -> DataFrame:
    """(s1_id, cand_id, prob, rank): up to `most` pairs of each record with prob >= threshold, best first, ties by candidate rank and id."""
    tie = ["cand_rank", "cand_id"] if "cand_rank" in scored.columns else ["cand_id"]
    w = Window.partitionBy("s1_id").orderBy(F.desc("prob"), *tie)
    return scored.where(F.col("prob") >= threshold).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= most).select("s1_id", "cand_id", "prob", "rank")


def pruned_scores(attached: DataFrame, coefficients: dict[str, float], intercept: float, threshold: float, expensive: list[str], guarded: bool = True) -> DataFrame:
    """attached + `passes`: whether the linear model's probability reaches threshold; equals full scoring of every pair.

    Each expensive feature lies in [0, 1], so its term adds between min(c, 0) and max(c, 0). Pairs that pass with the least, or
    fail with the most, are decided without it; the others get the feature of the largest weight, and so on. Rows are filtered
    before each kernel, since a conditional would not keep Python from being called.
    """
    cheap = {n: c for n, c in coefficients.items() if n not in expensive}
    late = {n: c for n, c in coefficients.items() if n in expensive}
    limit = math.log(threshold / (1 - threshold))
    base = cut(with_features(attached, list(cheap), guarded).withColumn("base", linear(cheap, intercept)))  # both branches read it
    done, rest, left = [], base, dict(late)
    while True:
        low, high = sum(min(c, 0) for c in left.values()), sum(max(c, 0) for c in left.values())
        sure = (F.col("base") + low >= limit) | (F.col("base") + high < limit)
        done.append(rest.where(sure).withColumn("passes", F.col("base") + low >= limit))
        if not left:
            break
        name = max(left, key=lambda n: abs(left[n]))  # the one that decides most comes first
        weight = left.pop(name)
        scored = with_features(rest.where(~sure), [name], guarded)
        rest = cut(scored.withColumn("base", F.col("base") + F.lit(float(weight)) * F.col(name)).drop(name))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("base")


def match_lists(s1: DataFrame, matches: DataFrame, ordered: bool = True) -> DataFrame:
    """(source1_entity_id, matched_entity_ids): every source 1 record; ids in rank order, or sorted; "" when none."""
    if ordered:
        ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand_id"))), lambda x: x["cand_id"]), ",")
    else:
        ids = F.array_join(F.array_sort(F.collect_set("cand_id")), ",")
    lists = matches.groupBy("s1_id").agg(ids.alias("ids"))
    return s1.select(F.col("entity_id").alias("s1_id")).distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))
