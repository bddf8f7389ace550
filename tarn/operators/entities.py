"""The business tables as entities: one row per id, normalised, with blocking keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.sources.tables import table

FIELDS = ["business_name", "business_address", "country"]


def one_per_id(rows: DataFrame) -> DataFrame:
    """One row per entity_id: of repeated rows the least by name, address, country (nulls first)."""
    least = rows.groupBy("entity_id").agg(F.min(F.struct(*FIELDS)).alias("r"))
    return least.select("entity_id", *[F.col(f"r.{f}").alias(f) for f in FIELDS])


def enrich(rows: DataFrame, exact: bool = False) -> DataFrame:
    """+ norm_name, norm_addr, postal, country_l."""
    return rows.withColumns({
        "norm_name": T.normalize_name(F.col("business_name"), exact), "norm_addr": T.normalize_address(F.col("business_address"), exact),
        "postal": T.extract_postal(F.col("business_address")), "country_l": T.country_key(F.col("country")),
    })


def with_keys(enriched: DataFrame) -> DataFrame:
    """+ the blocking keys."""
    name, addr = F.col("norm_name"), F.col("norm_addr")
    return enriched.withColumns({
        "postal3": F.substring("postal", 1, 3), "first_token": T.first_token(name), "first3": F.substring("norm_name", 1, 3), "first2": F.substring("norm_name", 1, 2),
        "sorted_tokens": T.sorted_tokens(name), "core_tokens": T.core_tokens(name), "street_num": T.street_number(addr), "addr_num_token4": T.number_and_token(addr),
    })


def source(spark: SparkSession, d: str, number: int) -> DataFrame:
    """Source 1, 2 or 3, enriched, one row per id, with src S1, S2 or S3 (the id's prefix)."""
    rows = enrich(one_per_id(table(spark, d, f"train_source{number}").select("entity_id", *FIELDS)))
    return rows.withColumn("src", F.substring("entity_id", 1, 2))


def targets(spark: SparkSession, d: str) -> DataFrame:
    return source(spark, d, 2).unionByName(source(spark, d, 3))


def truth(spark: SparkSession, d: str, field: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, cand_id): the labelled pairs; every id in the field counts, however the list is written."""
    ids = F.regexp_extract_all(F.coalesce(F.col(field), F.lit("")), F.lit(r"S[23]-\d{9}"), F.lit(0))
    return table(spark, d, "train_matches").select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids).alias("cand_id")).distinct()


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(s1_id): every labelled source 1 id, unmatched ones too."""
    return table(spark, d, "train_matches").select(F.col("source1_entity_id").alias("s1_id")).distinct()
