"""Tab-separated files: readers and writers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tarn.functions.words import NA_TOKENS

SOURCE = Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: Ty.StructType = SOURCE, columns: list[str] | None = None) -> DataFrame:
    """A headed tab-separated file with a fixed schema; cells that mean null become null. columns: read only these."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", True).csv(path)
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.select(*columns) if columns else df


def head(df: DataFrame, order: str, n: int, skip: int = 0) -> DataFrame:
    """n rows after the first `skip`, in the order of a column: file order means nothing in Spark."""
    return df.orderBy(order).offset(skip).limit(n)


def wanted(df: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows of the ids in ids[key]."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def load_split(spark: SparkSession, folder: str, split: str) -> dict[str, DataFrame]:
    """{"s1", "s2", "s3"[, "truth"]} of the train or test files of a folder."""
    out = {f"s{i}": read_tsv(spark, f"{folder}/{split}_source{i}.tsv") for i in (1, 2, 3)}
    if split == "train":
        out["truth"] = read_tsv(spark, f"{folder}/train_ground_truth.tsv", TRUTH)
    return out


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists; an error naming all when none does."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines as they are, for the quality rules."""
    return spark.read.text(path)


def read_candidates(spark: SparkSession, path: str, first: int = 3) -> DataFrame:
    """(s1_id, cand_id, rank): the first ids of each comma-joined list, in their order."""
    rows = read_tsv(spark, path, Ty.StructType([Ty.StructField("s1_id", Ty.StringType()), Ty.StructField("ids", Ty.StringType())]))
    ids = F.slice(F.filter(F.split(F.coalesce("ids", F.lit("")), ","), lambda x: x != ""), 1, first)
    return rows.select("s1_id", F.posexplode(ids).alias("p", "cand_id")).select("s1_id", "cand_id", (F.col("p") + 1).cast("int").alias("rank"))


def write_tsv(df: DataFrame, path: str, single: bool = False) -> None:
    """Headed tab-separated files; empty strings stay empty, nothing is quoted. single: one file, for small outputs."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "\u0000").csv(path)


def cached(spark: SparkSession, folder: str, settings: dict, build) -> DataFrame:
    """The table that build() gives for these settings: read from folder when written before, else written there first.

    The folder's name holds a digest of the settings, so other settings never meet an old table.
    """
    name = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{folder}/{name}"
    try:
        first_existing(spark, f"{path}/_SUCCESS")
    except FileNotFoundError:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
