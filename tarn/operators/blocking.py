"""Candidate generation by blocking keys, ranked and capped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_KEEP = 100
ADDRESS_RESERVE = 5


@dataclass(frozen=True)
class Key:
    tag: str
    column: str
    least: int  # shortest value that blocks
    priority: int


KEYS = (
    Key("p", "postal3", 1, 0), Key("s", "sorted_tokens", 1, 1), Key("k", "core_tokens", 1, 2), Key("t", "first_token", 1, 3),
    Key("f", "first3", 1, 4), Key("n", "street_num", 3, 5), Key("h", "addr_num_token4", 3, 6),
)
V1_KEYS = (Key("p", "postal3", 1, 0), Key("t", "first_token", 1, 1), Key("c", "first2", 1, 2))
RESERVE_TAG = "h"


def key_table(keyed: DataFrame, keys: tuple[Key, ...] = KEYS) -> DataFrame:
    """(src, entity_id, country_l, tag, value, prio): one row per usable key; one scan, no shuffle."""
    cells = [F.when(F.length(k.column) >= k.least, F.struct(F.lit(k.tag).alias("tag"), F.col(k.column).alias("value"), F.lit(k.priority).alias("prio"))) for k in keys]
    long = keyed.select("src", "entity_id", "country_l", F.explode(F.array_compact(F.array(*cells))).alias("k"))
    return long.select("src", "entity_id", "country_l", "k.tag", "k.value", "k.prio")


BLOCK = ["country_l", "tag", "value"]


def query_index(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of the targets' key table whose key some query row has: a semi-join."""
    return index.join(wanted.select(*BLOCK).distinct(), BLOCK, "left_semi")


def capped(index: DataFrame, keep: int = BLOCK_KEEP) -> DataFrame:
    """The first `keep` ids of each block and source in id order; bounds every block before anything is joined to it.

    Spark keeps only `keep` rows a block already before the shuffle (window group limit), so a hot block doesn't travel.
    """
    w = Window.partitionBy("src", *BLOCK).orderBy("entity_id")
    return index.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")


def first_of_block(index: DataFrame, n: int) -> DataFrame:
    """The first n ids of each block over both sources. Loses nothing where at most n ids are chosen in id order: what is
    beyond n in a block can't be among the first n of any union of blocks."""
    w = Window.partitionBy(*BLOCK).orderBy("entity_id")
    return index.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def block_hits(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(s1_id, cand_id, tag, prio, src): the blocking join."""
    q = wanted.select(*BLOCK, F.col("entity_id").alias("s1_id"))
    return q.join(index.select(*BLOCK, "prio", "src", F.col("entity_id").alias("cand_id")), BLOCK).select("s1_id", "cand_id", "tag", "prio", "src")


def candidates(s1: DataFrame, targets: DataFrame, cap: int, reserve: int = ADDRESS_RESERVE, keep: int = BLOCK_KEEP) -> DataFrame:
    """(s1_id, cand_id, rank): at most `cap` candidates per source 1 record.

    Blocks are visited by tag priority, then source, then id; distinct ids fill cap - reserve places; house-number blocks then
    fill all places left. Both tables need the key columns (with_keys).
    """
    wanted = key_table(s1)
    hits = block_hits(wanted, capped(query_index(wanted, key_table(targets)), keep))
    return rank_hits(hits, cap, reserve)


def rank_hits(hits: DataFrame, cap: int, reserve: int = ADDRESS_RESERVE) -> DataFrame:
    """The ranking of candidates(): one shuffle by source 1 record carries both steps."""
    reserve = min(reserve, max(0, cap))
    base_cap = max(0, cap - reserve)
    # one shuffle: partitioned by record first, the grouping and both windows find their rows in place
    per = hits.repartition("s1_id").groupBy("s1_id", "cand_id", "src").agg(F.min(F.when(F.col("tag") != RESERVE_TAG, F.col("prio"))).alias("o"), F.max(F.col("tag") == RESERVE_TAG).alias("in_reserve"))
    w = Window.partitionBy("s1_id")
    ranked = per.withColumn("r", F.when(F.col("o").isNotNull(), F.row_number().over(w.orderBy(F.col("o").asc_nulls_last(), "src", "cand_id"))))
    ranked = ranked.withColumn("base", F.coalesce(F.col("r") <= base_cap, F.lit(False)))
    ranked = ranked.withColumn("n", F.sum(F.col("base").cast("int")).over(w))
    late = F.when(~F.col("base") & F.col("in_reserve"), F.struct("src", "cand_id"))
    ranked = ranked.withColumn("h", F.when(late.isNotNull(), F.row_number().over(w.orderBy(late.asc_nulls_last())) + F.col("n")))
    rank = F.when(F.col("base"), F.col("r")).otherwise(F.col("h"))
    return ranked.select("s1_id", "cand_id", rank.cast("int").alias("rank")).where(F.col("rank") <= cap)


def kept_at(hits: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """(s1_id, cand_id, kept array<boolean>): for each (cap, reserve) of settings, whether rank_hits() would keep the pair.

    One shuffle by record and two sorts for all settings: the base order is the same for every cap, and a late pair's place
    under a cap is a running count in the order of the reserve.
    """
    per = hits.repartition("s1_id").groupBy("s1_id", "cand_id", "src").agg(F.min(F.when(F.col("tag") != RESERVE_TAG, F.col("prio"))).alias("o"), F.max(F.col("tag") == RESERVE_TAG).alias("in_reserve"))
    w = Window.partitionBy("s1_id")
    ranked = per.withColumn("r", F.when(F.col("o").isNotNull(), F.row_number().over(w.orderBy(F.col("o").asc_nulls_last(), "src", "cand_id")))).withColumn("n", F.count("o").over(w))
    late, kept = w.orderBy("src", "cand_id").rowsBetween(Window.unboundedPreceding, 0), []
    for cap, reserve in settings:
        base_cap = max(0, cap - min(reserve, max(0, cap)))
        base = F.coalesce(F.col("r") <= base_cap, F.lit(False))
        waits = ~base & F.col("in_reserve")
        place = F.sum(waits.cast("int")).over(late) + F.least("n", F.lit(base_cap))
        kept.append(base | waits & (place <= cap))
    return ranked.select("s1_id", "cand_id", F.array(*kept).alias("kept"))


def candidates_v1(s1: DataFrame, targets: DataFrame, cap: int = 200) -> DataFrame:
    """First generation: three keys, whole blocks, the first `cap` ids in id order (the order was left open there)."""
    wanted = key_table(s1, V1_KEYS)
    pairs = block_hits(wanted, first_of_block(query_index(wanted, key_table(targets, V1_KEYS)), cap)).select("s1_id", "cand_id").distinct()
    w = Window.partitionBy("s1_id").orderBy("cand_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def candidates_tiered(s1: DataFrame, targets: DataFrame, cap: int, reserve: int = ADDRESS_RESERVE) -> DataFrame:
    """Second generation: whole blocks in three tiers (p s k, then t f, then n), ties by id, and at most `reserve` new ids of
    house-number blocks on top."""
    reserve = min(reserve, max(0, cap))
    wanted = key_table(s1)
    hits = block_hits(wanted, first_of_block(query_index(wanted, key_table(targets)), cap + reserve))
    tier = F.when(F.col("tag").isin("p", "s", "k"), 0).when(F.col("tag").isin("t", "f"), 1).when(F.col("tag") == "n", 2)
    per = hits.withColumn("tier", tier).repartition("s1_id").groupBy("s1_id", "cand_id", "src").agg(F.min("tier").alias("tier"), F.max(F.col("tag") == RESERVE_TAG).alias("in_reserve"))
    w = Window.partitionBy("s1_id")
    r = per.withColumn("r", F.when(F.col("tier").isNotNull(), F.row_number().over(w.orderBy(F.col("tier").asc_nulls_last(), "cand_id"))))
    r = r.withColumn("base", F.coalesce(F.col("r") <= max(0, cap - reserve), F.lit(False))).withColumn("n", F.sum(F.col("base").cast("int")).over(w))
    late = F.when(~F.col("base") & F.col("in_reserve"), F.struct("src", "cand_id"))
    r = r.withColumn("h", F.when(late.isNotNull(), F.row_number().over(w.orderBy(late.asc_nulls_last()))))
    return r.where(F.col("base") | (F.col("h") <= reserve)).select("s1_id", "cand_id", F.when(F.col("base"), F.col("r")).otherwise(F.col("n") + F.col("h")).cast("int").alias("rank"))


def candidate_lists(s1: DataFrame, ranked: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids): distinct ids in order of code points, joined by commas; "" when none."""
    lists = ranked.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("ids"))
    return s1.select(F.col("entity_id").alias("s1_id")).distinct().join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("candidate_entity_ids"))
