"""Queries of the operators for language-model training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.addresses import same_location
from tarn.llm.components import connected_components, pairs_within
from tarn.llm.leaks import find_leaks
from tarn.llm.lookalike import form_classes, look_alike_pairs
from tarn.llm.matching import match_entities
from tarn.llm.names import same_organisation
from tarn.llm.splits import BINS, split_linked
from tarn.llm.tokenize import encode_corpus
from tarn.operators.packed import split_packed
from tarn.sources.tables import table
from tarn.storage import cut

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _links(spark: SparkSession, d: str) -> DataFrame:
    """(source1_entity_id, matched_entity_id) of train_matches."""
    ids = table(spark, d, "train_source2").select("entity_id").union(table(spark, d, "train_source3").select("entity_id"))
    out = split_packed(table(spark, d, "train_matches"), "source1_entity_id", "matched_entity_ids", ids, "entity_id", known_only=True)
    return out.select(F.col("key").alias("source1_entity_id"), F.col("value").alias("matched_entity_id"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return split_linked(_links(spark, d), "source1_entity_id", "matched_entity_id", PROPORTIONS, table(spark, d, "train_matches").select("source1_entity_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one split and group, as the operator dealt them."""
    dealt = _splits(spark, d).select("entity_id", F.concat_ws("|", "split", "group_id").alias("kept"))
    return pairs_within(dealt, "entity_id", "kept").toDF("source1_entity_id_a", "source1_entity_id_b")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)


def p4_proportions(spark: SparkSession, d: str) -> DataFrame:
    """(split, n_ids, near_share): of each split the ids dealt in all, and whether it holds its proportion of them within a bin or
    the largest group, which can't be parted."""
    groups = cut(_splits(spark, d).groupBy("split", "group_id").agg(F.count(F.lit(1)).alias("size")))
    dealt = groups.groupBy("split").agg(F.sum("size").alias("own"))
    total = groups.agg(F.sum("size").alias("n_ids"), F.max("size").alias("largest"))
    wanted = spark.createDataFrame(list(PROPORTIONS.items()), "split string, share double")
    near = F.abs(F.coalesce("own", F.lit(0)) / F.col("n_ids") - F.col("share")) <= F.greatest(F.lit(1 / BINS), F.col("largest") / F.col("n_ids"))
    return wanted.join(dealt, "split", "left").join(F.broadcast(total), how="cross").select("split", "n_ids", near.alias("near_share"))


def _matches(spark: SparkSession, d: str) -> DataFrame:
    labels = _links(spark, d).toDF("l_id", "r_id").where("r_id LIKE 'S2-%'")
    known = table(spark, d, "train_matches").select(F.col("source1_entity_id").alias("l_id"))
    return match_entities(table(spark, d, "train_source1"), table(spark, d, "train_source2"), "entity_id", "business_name", "business_address", "country", labels, known=known)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "train_matches").select(F.col("source1_entity_id").alias("l_id"))
    return _matches(spark, d).join(labelled, "l_id", "left_anti").where("confidence >= 0.5").select(F.col("l_id").alias("s1_entity_id"), F.col("r_id").alias("s2_entity_id"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "train_source1").unionByName(table(spark, d, "train_source2"))
    return same_location(rows, "entity_id", "business_address").toDF("entity_id_a", "entity_id_b")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(_links(spark, d), "source1_entity_id", "matched_entity_id", table(spark, d, "train_matches"), "source1_entity_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"), "doc_id", "text").toDF("doc_id_a", "doc_id_b")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return form_classes(table(spark, d, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", "answer")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", F.col("item").alias("item_id"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "train_source1").unionByName(table(spark, d, "train_source3"))
    return same_organisation(rows, "entity_id", "business_name").toDF("entity_id_a", "entity_id_b")


QUERIES = {
    "p1_found": p1_found,
    "p9_found": p9_found, "p9_leaks": p9_leaks,
    "p4_found": p4_found, "p4_splits": p4_splits, "p4_proportions": p4_proportions, "p5_found": p5_found, "p5_matches": p5_matches, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p10_found": p10_found, "p10_forms": p10_forms,
}

_GROUPS = """
RECURSIVE l AS (SELECT DISTINCT source1_entity_id AS a, unnest(regexp_extract_all(matched_entity_ids, 'S[23]-[0-9]{9}')) AS b FROM train_matches),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
v AS (SELECT a AS entity_id FROM e UNION SELECT source1_entity_id FROM train_matches),
r AS (SELECT entity_id, entity_id AS other FROM v UNION SELECT r.entity_id, e.b FROM r JOIN e ON r.other = e.a),
g AS (SELECT entity_id, min(other) AS group_id FROM r GROUP BY entity_id)
"""

# The form of p10 again, letter by letter and apart from the operator's own tables: code points of what the documents hold
# (Greek and Cyrillic letters drawn as Latin ones, spaces, hyphens, ligatures, characters without a glyph), full-width forms by
# their distance from ASCII.
_ALIKE = """MAP {913: 'A', 914: 'B', 917: 'E', 918: 'Z', 919: 'H', 921: 'I', 922: 'K', 924: 'M', 925: 'N', 927: 'O', 929: 'P', 932: 'T', 933: 'Y', 935: 'X', 957: 'v', 959: 'o', 972: 'ó',
1040: 'A', 1042: 'B', 1045: 'E', 1050: 'K', 1052: 'M', 1053: 'H', 1054: 'O', 1056: 'P', 1057: 'C', 1058: 'T', 1061: 'X', 1072: 'a', 1077: 'e', 1086: 'o', 1088: 'p', 1089: 'c', 1091: 'y', 1093: 'x',
1105: 'ë', 1109: 's', 1110: 'i', 1111: 'ï', 1112: 'j', 1025: 'Ë', 1031: 'Ï', 160: ' ', 8199: ' ', 8239: ' ', 12288: ' ', 8208: '-', 8209: '-', 181: chr(956), 64257: 'fi', 64258: 'fl',
173: '', 8203: '', 8204: '', 8205: '', 8206: '', 8207: '', 8288: '', 65279: ''}"""
_FORMS = f"""
forms AS (SELECT doc_id, text, nfc_normalize(array_to_string(list_transform(string_split(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) ELSE coalesce({_ALIKE}[unicode(c)], c) END), '')) AS form FROM documents)
"""
SQL = {
    "p4_proportions": "SELECT s AS split, count(*) AS n_ids, true AS near_share FROM (SELECT DISTINCT source1_entity_id FROM train_matches), (VALUES ('train'), ('validation'), ('test')) AS t(s) GROUP BY 1",
    "p4_found": f"WITH {_GROUPS} SELECT x.entity_id AS source1_entity_id_a, y.entity_id AS source1_entity_id_b FROM g x JOIN g y USING (group_id) WHERE x.entity_id < y.entity_id AND x.entity_id LIKE 'S1-%' AND y.entity_id LIKE 'S1-%'",
    "p10_found": f"WITH {_FORMS} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.form, '\\S')",
    "p10_forms": f"WITH {_FORMS} SELECT doc_id, CASE WHEN regexp_matches(form, '\\S') THEN md5(form) END AS form, CASE WHEN regexp_matches(form, '\\S') THEN md5(text) END AS exact FROM forms",
    "p7_found": f"WITH {_GROUPS} SELECT entity_id, group_id FROM g",
}
