"""Which of ten diagnostic keys hold for true pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.functions import words as W

#: tag -> column. These keys come from text that is only lower-cased and spaced.
DIAGNOSTIC_KEYS = {
    "ph": "postal_house", "p": "postal", "p3": "postal3", "n": "street_num", "t": "first_token", "f3": "first3", "f4": "first4", "s": "sorted_tokens", "k": "core_tokens", "a": "addr_sorted_tokens",
}


def diagnostic_keys(rows: DataFrame) -> DataFrame:
    """(entity_id, <the ten keys>), "" where a key is missing."""
    base = rows.select("entity_id", T.normalize_plain(F.col("business_name")).alias("n"), T.normalize_plain(F.col("business_address")).alias("a"), T.extract_postal(F.col("business_address"), (4, 6), last=True).alias("postal"))
    n, a = F.col("n"), F.col("a")
    keyed = base.withColumns({
        "postal3": F.substring("postal", 1, 3), "street_num": F.regexp_extract(a, r"^\s*(\d+[A-Za-z]?(?:/\d+)?)", 1), "first_token": T.first_token(n), "first3": F.substring(n, 1, 3),
        "first4": F.substring(n, 1, 4), "sorted_tokens": T.sorted_tokens(n), "core_tokens": T.core_tokens(n), "addr_sorted_tokens": F.array_join(F.array_sort(T.token_set(a)), " "),
    })
    house = F.when((F.col("postal") != "") & (F.col("street_num") != ""), F.concat_ws("|", "postal", "street_num")).otherwise("")
    return keyed.withColumn("postal_house", house).select("entity_id", *DIAGNOSTIC_KEYS.values())


def diagnostic_recall(true: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(tag, pairs_found, n_pairs, recall) per key and for any of them ("union"), over true pairs whose records exist."""
    side = lambda t, n, key: diagnostic_keys(t).select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{n}") for c in DIAGNOSTIC_KEYS.values()])
    pairs = true.join(side(s1, 1, "s1_id"), "s1_id").join(side(targets, 2, "cand_id"), "cand_id")
    hit = {tag: (F.col(f"{c}_1") != "") & (F.col(f"{c}_1") == F.col(f"{c}_2")) for tag, c in DIAGNOSTIC_KEYS.items()}
    any_ = F.lit(False)
    for h in hit.values():
        any_ = any_ | h
    counts = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), *[F.count_if(h).alias(t) for t, h in [*hit.items(), ("union", any_)]])
    out = counts.select("n_pairs", F.explode(F.map_from_arrays(F.array(*[F.lit(t) for t in [*hit, "union"]]), F.array(*[F.col(t) for t in [*hit, "union"]]))).alias("tag", "pairs_found"))
    return out.select("tag", "pairs_found", "n_pairs", F.coalesce(F.try_divide("pairs_found", "n_pairs"), F.lit(0.0)).alias("recall"))


def prepared_keys(rows: DataFrame) -> DataFrame:
    """(entity_id, country_l, <the keys of KEYS but the house-number one>) by the diagnostic's own dictionaries; a null country is ""."""
    name, addr = (F.col(c) for c in ("n", "a"))
    base = rows.select(
        "entity_id", "src", F.coalesce(F.lower(F.regexp_replace("country", r"(?U)^\s+|\s+$", "")), F.lit("")).alias("country_l"),
        T.normalize_diagnostic(F.col("business_name"), W.DIAGNOSTIC_NAME_ABBREVIATIONS).alias("n"), T.normalize_diagnostic(F.col("business_address"), W.DIAGNOSTIC_ADDRESS_ABBREVIATIONS).alias("a"),
        T.extract_postal(F.col("business_address")).alias("postal"),
    )
    return base.select(
        "entity_id", "src", "country_l", F.substring("postal", 1, 3).alias("postal3"), T.sorted_tokens(name).alias("sorted_tokens"), T.core_tokens(name).alias("core_tokens"), T.first_token(name).alias("first_token"),
        F.substring(name, 1, 3).alias("first3"), T.street_number(addr).alias("street_num"),
    )


def experiment_keys(rows: DataFrame) -> DataFrame:
    """(entity_id, country_l, <the keys of KEYS>) of the reserve experiment: accents stay, no abbreviation is written out, the
    postal code is the last run of five digits, and the house-number key comes from the address as typed."""
    name, addr = F.col("n"), F.col("a")
    base = rows.select(
        "entity_id", "src", "country_l", T.normalize_experiment(F.col("business_name")).alias("n"), T.normalize_experiment(F.col("business_address")).alias("a"),
        F.coalesce("business_address", F.lit("")).alias("raw"), T.extract_postal(F.col("business_address"), (5, 5), last=True).alias("postal"),
    )
    return base.select(
        "entity_id", "src", "country_l", F.substring("postal", 1, 3).alias("postal3"), T.sorted_tokens(name).alias("sorted_tokens"), T.core_tokens(name).alias("core_tokens"), T.first_token(name).alias("first_token"),
        F.substring(name, 1, 3).alias("first3"), T.street_number(addr).alias("street_num"), T.number_and_token(F.col("raw")).alias("addr_num_token4"),
    )
