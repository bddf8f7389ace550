"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators.heavy import heavy_keys, per_key
from tarn.operators.packed import split_packed
from tarn.sources.tables import table

FIELDS = ["country", "business_name"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "train_source2"), FIELDS, 0.02).select("field_name", "key_value")


def p2_key_counts(spark: SparkSession, d: str) -> DataFrame:
    return per_key(
        table(spark, d, "train_source2"), FIELDS,
        {"row_count": F.count(F.lit(1)), "smallest_number": F.min(F.substring("entity_id", 4, 9).cast("long")), "with_address": F.count("business_address")},
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "train_source2").select("entity_id").union(table(spark, d, "train_source3").select("entity_id"))
    out = split_packed(table(spark, d, "train_matches"), "source1_entity_id", "matched_entity_ids", ids, "entity_id", known_only=True)  # a field may state in words that there is no match
    return out.select(F.col("key").alias("source1_entity_id"), "pos", F.col("value").alias("matched_entity_id"))


QUERIES = {"p2_found": p2_found, "p2_key_counts": p2_key_counts, "p3_found": p3_found}

_KEYS = """
keyed AS (
  SELECT 'country' AS field_name, lower(regexp_replace(country, '^\\s+|\\s+$', '', 'g')) AS key_value, entity_id, business_address FROM train_source2
  UNION ALL
  SELECT 'business_name', lower(regexp_replace(business_name, '^\\s+|\\s+$', '', 'g')), entity_id, business_address FROM train_source2)
"""

SQL = {
    "p2_found": f"WITH {_KEYS} SELECT field_name, key_value FROM keyed WHERE key_value <> '' GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM train_source2)",
    "p2_key_counts": f"WITH {_KEYS} SELECT field_name, key_value, count(*) AS row_count, min(CAST(substring(entity_id, 4, 9) AS BIGINT)) AS smallest_number, count(business_address) AS with_address FROM keyed WHERE key_value <> '' GROUP BY ALL",
    "p3_found": """
WITH f AS (SELECT source1_entity_id, regexp_extract_all(matched_entity_ids, 'S[23]-[0-9]{9}') AS ids FROM train_matches),
one AS (SELECT DISTINCT source1_entity_id, ids FROM f WHERE len(ids) > 0)
SELECT source1_entity_id, CAST(p AS INTEGER) AS pos, ids[p] AS matched_entity_id FROM one, unnest(range(1, len(ids) + 1)) AS u(p)
""",
}
