"""Feature vectors of candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import similarity as S
from tarn.functions.text import strip_legal

# The features of the models, by name and in their order.
ATTRIBUTES = ["norm_name", "norm_addr", "country_l", "postal"]
CHEAP = ["name_jaccard", "addr_jaccard", "country_match", "postal_match"]
E11 = ["name_jaccard", "name_lev", "name_token_sort", "name_partial", "name_token_set", "addr_jaccard", "addr_lev", "addr_token_sort", "addr_partial", "country_match", "postal_match"]
EXPENSIVE = ["name_partial", "addr_partial"]
EDIT = {"name_lev", "name_token_sort", "name_token_set", "name_partial", "core_name_similarity", "addr_lev", "addr_token_sort", "addr_token_set", "addr_partial"}
E26 = [
    "name_jaccard", "name_lev", "name_token_sort", "name_token_set", "name_partial", "common_token_count", "name_token_overlap", "name_token_diff_count",
    "name_token_count_diff", "first_token_match", "last_token_match", "name_len_ratio", "core_name_jaccard", "core_name_similarity", "core_token_overlap",
    "core_token_diff_count", "core_name_len_ratio", "addr_jaccard", "addr_lev", "addr_token_sort", "addr_token_set", "addr_partial", "addr_len_ratio",
    "country_match", "postal_match", "postal_prefix3_match",
]
E13 = [
    "name_jaccard", "name_lev", "name_token_sort", "name_partial", "addr_jaccard", "addr_lev", "addr_token_sort", "addr_partial", "country_match", "postal_match",
    "smallest_token_match", "name_len_ratio", "addr_len_ratio",
]


def attach(pairs: DataFrame, s1: DataFrame, targets: DataFrame, strict: bool = True) -> DataFrame:
    """pairs(s1_id, cand_id, ...) + both sides' attributes as <name>_1 and <name>_2.

    strict drops pairs whose record is missing; otherwise its attributes are "".
    """
    side = lambda t, n, key: t.select(F.col("entity_id").alias(key), *[F.col(a).alias(f"{a}_{n}") for a in ATTRIBUTES])
    how = "inner" if strict else "left"
    out = pairs.join(side(s1, 1, "s1_id"), "s1_id", how).join(side(targets, 2, "cand_id"), "cand_id", how)
    return out if strict else out.fillna("", [f"{a}_{n}" for a in ATTRIBUTES for n in (1, 2)])


def columns(guarded: bool) -> dict[str, Column]:
    """Every feature by name, over attach()'s columns. guarded: edit measures of an empty string are 0 (else as the kernels say)."""
    n1, n2, a1, a2 = (F.col(c) for c in ("norm_name_1", "norm_name_2", "norm_addr_1", "norm_addr_2"))
    c1, c2 = strip_legal(n1), strip_legal(n2)
    p1, p2 = F.col("postal_1"), F.col("postal_2")
    least = lambda c: F.coalesce(F.array_min(S.token_set(c)), F.lit(""))
    return {
        "name_jaccard": S.jaccard(n1, n2), "name_lev": S.indel_ratio(n1, n2, guarded), "name_token_sort": S.token_sort_ratio(n1, n2, guarded),
        "name_token_set": S.token_set_ratio(n1, n2, guarded), "name_partial": S.partial_ratio(n1, n2, guarded), "common_token_count": S.common_tokens(n1, n2),
        "name_token_overlap": S.token_overlap(n1, n2), "name_token_diff_count": S.token_diff_count(n1, n2), "name_token_count_diff": S.token_count_diff(n1, n2),
        "first_token_match": S.first_token_match(n1, n2), "last_token_match": S.last_token_match(n1, n2), "smallest_token_match": S.both_equal(least(n1), least(n2)),
        "name_len_ratio": S.length_ratio(n1, n2), "core_name_jaccard": S.jaccard(c1, c2), "core_name_similarity": S.indel_ratio(c1, c2, guarded),
        "core_token_overlap": S.token_overlap(c1, c2), "core_token_diff_count": S.token_diff_count(c1, c2), "core_name_len_ratio": S.length_ratio(c1, c2),
        "addr_jaccard": S.jaccard(a1, a2), "addr_lev": S.indel_ratio(a1, a2, guarded), "addr_token_sort": S.token_sort_ratio(a1, a2, guarded),
        "addr_token_set": S.token_set_ratio(a1, a2, guarded), "addr_partial": S.partial_ratio(a1, a2, guarded), "addr_len_ratio": S.length_ratio(a1, a2),
        "country_match": S.both_equal(F.col("country_l_1"), F.col("country_l_2")), "postal_match": S.both_equal(p1, p2),
        "postal_prefix3_match": S.both_equal(F.substring(p1, 1, 3), F.substring(p2, 1, 3)),
    }


def with_features(attached: DataFrame, names: list[str], guarded: bool = True) -> DataFrame:
    """attached + the named features as doubles; only these are computed.

    Edit measures take long per row, so pairs are first spread evenly over spark.sql.shuffle.partitions tasks: partitions that
    adaptive execution made by size would be few and busy.
    """
    all_ = columns(guarded)
    if set(names) & EDIT:
        attached = attached.repartition(int(attached.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return attached.withColumns({n: all_[n].cast("double") for n in names})


def fill_missing(df: DataFrame, names: list[str]) -> DataFrame:
    """Features that df lacks become 0.0."""
    return df.withColumns({n: F.lit(0.0) for n in names if n not in df.columns})
