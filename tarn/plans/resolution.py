"""Queries of entity resolution over the business tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.functions import words as W
from tarn.operators import blocking as B
from tarn.operators.diagnostics import DIAGNOSTIC_KEYS, diagnostic_recall as _diagnostic_recall, experiment_keys, prepared_keys
from tarn.operators import entities as E
from tarn.operators import evaluate as V
from tarn.operators import features as X
from tarn.operators import matching as M
from tarn.operators import model as L
from tarn.operators import quality as Q
from tarn.operators import sampling as P
from tarn.sources.tables import table
from tarn.storage import cut

#: A fixed linear model, so that scoring can be checked without training.
CHEAP_MODEL, CHEAP_BIAS = {"name_jaccard": 6.0, "addr_jaccard": 4.0, "country_match": 0.5, "postal_match": 2.0}, -4.5
FULL_MODEL, FULL_BIAS = CHEAP_MODEL | {"name_token_sort": 3.0, "name_partial": 1.5, "addr_partial": 1.0}, -8.0
THRESHOLDS = [round(0.3 + 0.05 * i, 2) for i in range(13)]
CAPS = [20, 50, 100, 200, 300, 500, 5000]
#: Places and threshold of the second stage, which scores again what a candidate file lists first.
FIRST, SECOND_THRESHOLD = 3, 0.8
#: Least recall at which the check of the blocking passes.
GATE = 0.8
RESERVES = [0, 5, 10, 20, 30]


def _keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return E.with_keys(E.source(spark, d, 1)), E.with_keys(E.targets(spark, d))


def _candidates(spark: SparkSession, d: str, cap: int) -> DataFrame:
    return B.candidates(*_keyed(spark, d), cap)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    s1, t = _keyed(spark, d)
    wanted = B.key_table(s1)
    return B.block_hits(wanted, B.capped(B.query_index(wanted, B.key_table(t))))


def _true_attached(spark: SparkSession, d: str) -> DataFrame:
    return X.attach(E.truth(spark, d), E.source(spark, d, 1), E.targets(spark, d))


def _attached(spark: SparkSession, d: str, cap: int = 20) -> DataFrame:
    """Candidates with both sides' attributes. The enriched tables are written once, as blocking and both sides read them."""
    s1, t = (cut(x) for x in _keyed(spark, d))
    return X.attach(B.candidates(s1, t, cap).withColumnRenamed("rank", "cand_rank"), s1, t)


def _candidate_features(spark: SparkSession, d: str, names: list[str], cap: int = 20, guarded: bool = True) -> DataFrame:
    return X.with_features(_attached(spark, d, cap), names, guarded)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    df = _candidate_features(spark, d, list(CHEAP_MODEL))
    return df.withColumn("prob", F.round(M.logistic(M.linear(CHEAP_MODEL, CHEAP_BIAS)), 9))


def _labelled_scores(spark: SparkSession, d: str) -> DataFrame:
    true = E.truth(spark, d).withColumn("label", F.lit(1))
    return _scored(spark, d).join(E.labelled(spark, d), "s1_id", "left_semi").join(true, ["s1_id", "cand_id"], "left").na.fill(0, ["label"])


def normalize_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = E.source(spark, d, 1).unionByName(E.targets(spark, d))
    return rows.select("entity_id", "src", "norm_name", "norm_addr", "postal", "country_l")


def normalizer_variants(spark: SparkSession, d: str) -> DataFrame:
    n, a = F.col("business_name"), F.col("business_address")
    return E.one_per_id(table(spark, d, "train_source1")).select(
        "entity_id", T.normalize_v1(n).alias("v1_name"), T.normalize_key(n).alias("key_name"), T.normalize_plain(n).alias("plain_name"), T.normalize_experiment(n).alias("experiment_name"),
        T.extract_postal(a, (5, 6)).alias("postal_5_6"), T.extract_postal(a, (5, 5), last=True).alias("last_postal"), T.extract_postal(a, (4, 6), last=True).alias("last_4_6"),
    )


def block_keys(spark: SparkSession, d: str) -> DataFrame:
    s1, t = _keyed(spark, d)
    return B.key_table(s1.unionByName(t)).drop("prio")


def key_cardinality(spark: SparkSession, d: str) -> DataFrame:
    keys = block_keys(spark, d)
    return keys.groupBy("src", "tag").agg(F.count_distinct("country_l", "value").alias("n_keys"), F.count(F.lit(1)).alias("n_rows"))


def block_sizes(spark: SparkSession, d: str) -> DataFrame:
    return block_keys(spark, d).groupBy("src", "country_l", "tag", "value").agg(F.count(F.lit(1)).alias("n_ids"))


def block_members_capped(spark: SparkSession, d: str) -> DataFrame:
    return B.capped(B.key_table(_keyed(spark, d)[1])).drop("prio")


def query_aware_index(spark: SparkSession, d: str) -> DataFrame:
    s1, t = _keyed(spark, d)
    return B.query_index(B.key_table(s1), B.key_table(t)).select("src", "entity_id", "country_l", "tag", "value")


def candidates_cap20(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, 20)


def candidates_cap100(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, 100)


def candidates_v1(spark: SparkSession, d: str) -> DataFrame:
    return B.candidates_v1(*_keyed(spark, d), 200)


def candidates_tiered_v2(spark: SparkSession, d: str) -> DataFrame:
    return B.candidates_tiered(*_keyed(spark, d), 100)


def candidate_lists(spark: SparkSession, d: str) -> DataFrame:
    return B.candidate_lists(E.source(spark, d, 1), _candidates(spark, d, 20))


def token_features(spark: SparkSession, d: str) -> DataFrame:
    names = [
        "name_jaccard", "common_token_count", "name_token_overlap", "name_token_diff_count", "name_token_count_diff", "first_token_match", "last_token_match", "name_len_ratio",
        "core_name_jaccard", "addr_jaccard", "addr_len_ratio", "country_match", "postal_match", "postal_prefix3_match",
    ]
    out = X.with_features(_true_attached(spark, d), names)
    return out.select("s1_id", "cand_id", *[F.round(n, 6).alias(n) for n in names])


EDIT_FEATURES = ["name_lev", "name_token_sort", "addr_lev", "addr_token_sort", "core_name_similarity"]


def edit_features(spark: SparkSession, d: str) -> DataFrame:
    out = X.with_features(_true_attached(spark, d), EDIT_FEATURES)
    return out.select("s1_id", "cand_id", *[F.round(n, 6).alias(n) for n in EDIT_FEATURES])


def feature_vectors_26(spark: SparkSession, d: str) -> DataFrame:
    return _candidate_features(spark, d, X.E26).select("s1_id", "cand_id", *X.E26)


def feature_vectors_11(spark: SparkSession, d: str) -> DataFrame:
    return _candidate_features(spark, d, X.E11, guarded=False).select("s1_id", "cand_id", *X.E11)


def feature_vectors_13(spark: SparkSession, d: str) -> DataFrame:
    return _candidate_features(spark, d, X.E13, guarded=False).select("s1_id", "cand_id", *X.E13)


def tiered_match(spark: SparkSession, d: str) -> DataFrame:
    return M.tiered_match(E.source(spark, d, 1), E.targets(spark, d))


def linear_score_topk(spark: SparkSession, d: str) -> DataFrame:
    return M.top_matches(_scored(spark, d), 0.5).withColumn("prob", F.round("prob", 6))


def match_lists(spark: SparkSession, d: str) -> DataFrame:
    return M.match_lists(E.source(spark, d, 1), M.top_matches(_scored(spark, d), 0.5))


def bound_pruned_match(spark: SparkSession, d: str) -> DataFrame:
    return M.pruned_scores(_attached(spark, d), FULL_MODEL, FULL_BIAS, 0.5, X.EXPENSIVE).where("passes").select("s1_id", "cand_id")


def ground_truth_long(spark: SparkSession, d: str) -> DataFrame:
    return E.truth(spark, d).withColumn("target", F.substring("cand_id", 1, 2))


def block_recall(spark: SparkSession, d: str) -> DataFrame:
    s1, t = _keyed(spark, d)
    return V.key_recall(E.truth(spark, d), B.key_table(s1), B.key_table(t)).withColumn("recall", F.round("recall", 6))


def entity_and_pair_recall(spark: SparkSession, d: str) -> DataFrame:
    r = V.recall(_candidates(spark, d, 100), E.truth(spark, d))
    return r.withColumns({c: F.round(c, 6) for c in ("entity_recall", "pair_recall")})


def _sweep(spark: SparkSession, d: str, settings: list[tuple[int, int]]) -> DataFrame:
    s1 = E.source(spark, d, 1).select(F.col("entity_id").alias("s1_id"))
    out = V.recall_at_settings(cut(B.kept_at(_hits(spark, d), settings)), E.truth(spark, d), s1, len(settings))
    values = F.array(*[F.struct(F.lit(c).alias("cap"), F.lit(r).alias("reserve")) for c, r in settings])
    out = out.withColumn("s", F.element_at(values, F.col("setting") + 1)).withColumns({"cap": F.col("s.cap"), "reserve": F.col("s.reserve")})
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "entity_recall", "mean_candidates")})


def recall_at_caps(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d, [(c, B.ADDRESS_RESERVE) for c in CAPS]).select("cap", "pairs_found", "n_pairs", "recall", "entities_hit", "n_entities", "entity_recall", "mean_candidates")


def reserve_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d, [(100, r) for r in RESERVES]).select("reserve", "entities_hit", "pairs_found")


def blocking_gate(spark: SparkSession, d: str) -> DataFrame:
    """The check of the blocking: no record has more candidates than the cap, and recall of entities reaches the gate."""
    ranked = cut(_candidates(spark, d, 100))
    most = ranked.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_candidates"))
    out = V.recall(ranked, E.truth(spark, d)).join(most, how="cross").withColumn("cap_kept", F.col("most_candidates") <= 100)
    return out.select("most_candidates", "cap_kept", "n_entities", "entities_hit", F.round("entity_recall", 6).alias("entity_recall"), (F.col("entity_recall") >= GATE).alias("passes"))


def prepared_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of each of six keys and of any, by the diagnostic's own dictionaries."""
    keys = tuple(k for k in B.KEYS if k.tag != B.RESERVE_TAG)
    s1, t = (B.key_table(prepared_keys(x), keys) for x in (E.source(spark, d, 1), E.targets(spark, d)))
    return V.key_recall(E.truth(spark, d), s1, t).withColumn("recall", F.round("recall", 6))


def reserve_experiment(spark: SparkSession, d: str) -> DataFrame:
    """The reserve sweep by the experiment's own normaliser and keys."""
    s1, t = (B.key_table(experiment_keys(x)) for x in (E.source(spark, d, 1), E.targets(spark, d)))
    kept = cut(B.kept_at(B.block_hits(s1, B.capped(B.query_index(s1, t))), [(100, r) for r in RESERVES]))
    out = V.recall_at_settings(kept, E.truth(spark, d), E.source(spark, d, 1).select(F.col("entity_id").alias("s1_id")), len(RESERVES))
    return out.select(F.element_at(F.array(*[F.lit(r) for r in RESERVES]), F.col("setting") + 1).alias("reserve"), "entities_hit", "pairs_found")


def positive_rate(spark: SparkSession, d: str) -> DataFrame:
    """Of the candidates of labelled records, the share that is true."""
    known = _candidates(spark, d, 20).join(E.labelled(spark, d), "s1_id", "left_semi")
    true = E.truth(spark, d).withColumn("label", F.lit(1))
    return V.positive_rate(known.join(true, ["s1_id", "cand_id"], "left").na.fill(0, ["label"])).withColumn("positive_rate", F.round("positive_rate", 6))


def rescored_match(spark: SparkSession, d: str) -> DataFrame:
    """Two stages: the first places of every record's candidate list are scored again by the model of 26 features, fitted on
    labelled candidates; every source 1 record has a row."""
    s1, t = (cut(x) for x in _keyed(spark, d))
    listed = B.candidate_lists(s1, B.candidates(s1, t, 20))
    ids = F.slice(F.filter(F.split("candidate_entity_ids", ","), lambda x: x != ""), 1, FIRST)
    pairs = listed.select(F.col("source1_entity_id").alias("s1_id"), F.posexplode(ids).alias("cand_rank", "cand_id"))
    first = cut(X.with_features(X.attach(pairs, s1, t), X.E26).select("s1_id", "cand_id", "cand_rank", *X.E26))
    return M.match_lists(s1, M.top_matches(L.score(_fitted(spark, d, first, X.E26)[0], first, X.E26), SECOND_THRESHOLD))


def _fitted(spark: SparkSession, d: str, pairs: DataFrame, features: list[str], **kind) -> tuple:
    """(model, threshold) from the labelled records' pairs: fitted on four fifths, the threshold tuned on the rest."""
    true = E.truth(spark, d).withColumn("label", F.lit(1))
    known = pairs.join(E.labelled(spark, d), "s1_id", "left_semi").join(true, ["s1_id", "cand_id"], "left").na.fill(0, ["label"])
    split = cut(P.stratified_split(known, "label", ["s1_id", "cand_id"]))
    model = L.train(split.where(~F.col("is_validation")), features, **kind)
    return model, L.tune(L.score(model, split.where("is_validation"), features))


def candidate_stats(spark: SparkSession, d: str) -> DataFrame:
    s1 = E.source(spark, d, 1).select(F.col("entity_id").alias("s1_id"))
    return V.candidate_stats(_candidates(spark, d, 100), s1).withColumn("mean", F.round("mean", 6))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    out = V.threshold_sweep(_labelled_scores(spark, d), THRESHOLDS)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f05")})


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return V.best_threshold(threshold_sweep(spark, d)).select("threshold", "f05")


def entity_f05(spark: SparkSession, d: str) -> DataFrame:
    out = V.entity_f05(M.top_matches(_scored(spark, d), 0.5), E.truth(spark, d), E.labelled(spark, d))
    return out.withColumn("f05", F.round("f05", 6))


def macro_f05(spark: SparkSession, d: str) -> DataFrame:
    return V.macro_f05(M.top_matches(_scored(spark, d), 0.5), E.truth(spark, d), E.labelled(spark, d)).withColumn("f05", F.round("f05", 6))


def _output(spark: SparkSession, d: str) -> DataFrame:
    ids = F.filter(F.transform(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "train_matches").select(F.col("source1_entity_id").alias("s1_id"), ids.alias("ids"), F.lit(False).alias("broken"))


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    ids = E.targets(spark, d).select("entity_id")
    required = E.source(spark, d, 1).select(F.col("entity_id").alias("s1_id"))
    return Q.quality_report(_output(spark, d), required, ids, _candidates(spark, d, 100))


def output_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.row_counts(_output(spark, d)).withColumn("matched_percent", F.round("matched_percent", 6))


def exact_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.exact_sample(E.source(spark, d, 1), "entity_id", 500).select("entity_id")


def truth_preserving_sample(spark: SparkSession, d: str) -> DataFrame:
    return P.truth_preserving_sample(E.targets(spark, d), E.truth(spark, d), 2000).select("entity_id")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _labelled_scores(spark, d).select("s1_id", "cand_id", "label")
    return P.stratified_split(rows, "label", ["s1_id", "cand_id"])


def pair_inspection(spark: SparkSession, d: str) -> DataFrame:
    """True pairs side by side, with the keys they share."""
    s1, t = _keyed(spark, d)
    names = [k.column for k in B.KEYS]
    side = lambda df, n, key: df.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{c}_{n}") for c in ["norm_name", "norm_addr", *names]])
    pairs = E.truth(spark, d).join(side(s1, 1, "s1_id"), "s1_id").join(side(t, 2, "cand_id"), "cand_id")
    shared = F.array_join(F.array_compact(F.array(*[F.when((F.col(f"{c}_1") != "") & (F.col(f"{c}_1") == F.col(f"{c}_2")), F.lit(c)) for c in names])), ",")
    return pairs.select("s1_id", "cand_id", "norm_name_1", "norm_name_2", "norm_addr_1", "norm_addr_2", shared.alias("shared_keys"))


def diagnostic_recall(spark: SparkSession, d: str) -> DataFrame:
    out = _diagnostic_recall(E.truth(spark, d), E.source(spark, d, 1), E.targets(spark, d))
    return out.withColumn("recall", F.round("recall", 6))


def missed_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.missed(_candidates(spark, d, 100), E.truth(spark, d))


def train_and_score(spark: SparkSession, d: str) -> DataFrame:
    """Matches of every source 1 record, labelled or not; the model and its threshold come from the candidates of labelled ones."""
    pairs = cut(_candidate_features(spark, d, X.E11, guarded=False).select("s1_id", "cand_id", "cand_rank", *X.E11))
    model, threshold = _fitted(spark, d, pairs, X.E11)
    return M.top_matches(L.score(model, pairs, X.E11), threshold)


QUERIES = {
    f.__name__: f
    for f in (
        normalize_entities, normalizer_variants, block_keys, key_cardinality, block_sizes, block_members_capped, query_aware_index, candidates_cap20, candidates_cap100,
        candidates_v1, candidates_tiered_v2, candidate_lists, token_features, edit_features, feature_vectors_11, feature_vectors_13, feature_vectors_26, tiered_match,
        linear_score_topk, match_lists, bound_pruned_match, ground_truth_long, block_recall, entity_and_pair_recall, recall_at_caps, reserve_sweep, candidate_stats,
        threshold_sweep, best_threshold, entity_f05, macro_f05, quality_report, output_row_counts, exact_sample, truth_preserving_sample, stratified_split, pair_inspection,
        diagnostic_recall, missed_pairs, train_and_score, blocking_gate, prepared_recall, reserve_experiment, positive_rate, rescored_match,
    )
}


# --- the same in SQL -------------------------------------------------------------------------------------------------


def _map(t: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in t.items())}}}"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _text(c: str, fold: bool = True) -> str:
    x = f"lower({'strip_accents' if fold else ''}(coalesce({c}, '')))"
    return f"trim(regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _tokens(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


def _expand(c: str, table_: dict[str, str]) -> str:
    return f"array_to_string(list_transform({_tokens(_text(c))}, lambda x: coalesce({_map(table_)}[x], x)), ' ')"


_POSTAL = r"'\b(\d{5})(?:-?\d{4})?\b'"
_ONE = """
raw AS (SELECT 'S1' AS src, * FROM train_source1 UNION ALL SELECT 'S2', * FROM train_source2 UNION ALL SELECT 'S3', * FROM train_source3),
one AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY business_name NULLS FIRST, business_address NULLS FIRST, country NULLS FIRST) = 1)
"""
_POSTAL_OF = f"regexp_extract(coalesce(business_address, ''), {_POSTAL}, 1)"


def _entities(name: str, addr: str, postal: str = _POSTAL_OF, null: str = "nan") -> str:
    """ent: the normalised records."""
    return f"""{_ONE},
ent AS (SELECT src, entity_id, business_name, business_address, {name} AS norm_name, {addr} AS norm_addr, {postal} AS postal, coalesce(lower(regexp_replace(country, '^\\s+|\\s+$', '', 'g')), '{null}') AS country_l FROM one)
"""


def _keys(ent: str, house: str = "norm_addr") -> str:
    """K: the long key table over the entities; `house` is what the house-number key comes from."""
    return f"""{ent},
tok AS (SELECT *, {_tokens('norm_name')} AS nt, regexp_extract_all(lower({house}), '\\d+[a-zA-Z]?|[a-zA-Z]+') AS adt FROM ent),
num AS (SELECT *, list_position(list_transform(adt, lambda x: regexp_full_match(x, '\\d{{2,}}[a-zA-Z]?')), true) AS house FROM tok),
tel AS (SELECT *, list_filter(adt[house + 1:house + 4], lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains({_list(W.GENERIC)}, x)) AS telling FROM num),
keyed AS (SELECT *, substring(postal, 1, 3) AS postal3, coalesce(nt[1], '') AS first_token, substring(norm_name, 1, 3) AS first3, substring(norm_name, 1, 2) AS first2,
  array_to_string(list_sort(nt), ' ') AS sorted_tokens, array_to_string(list_sort(list_filter(nt, lambda x: NOT list_contains({_list(W.LEGAL)}, x))), ' ') AS core_tokens,
  regexp_extract(norm_addr, '(\\b\\d{{2,5}}\\b)', 1) AS street_num, CASE WHEN house > 0 AND len(telling) > 0 THEN adt[house] || '|' || substring(telling[1], 1, 4) ELSE '' END AS addr_num_token4 FROM tel),
K AS (SELECT src, entity_id, country_l, tag, value, prio FROM (
  SELECT src, entity_id, country_l, 'p' AS tag, postal3 AS value, 0 AS prio, 1 AS least FROM keyed UNION ALL SELECT src, entity_id, country_l, 's', sorted_tokens, 1, 1 FROM keyed
  UNION ALL SELECT src, entity_id, country_l, 'k', core_tokens, 2, 1 FROM keyed UNION ALL SELECT src, entity_id, country_l, 't', first_token, 3, 1 FROM keyed
  UNION ALL SELECT src, entity_id, country_l, 'f', first3, 4, 1 FROM keyed UNION ALL SELECT src, entity_id, country_l, 'n', street_num, 5, 3 FROM keyed
  UNION ALL SELECT src, entity_id, country_l, 'h', addr_num_token4, 6, 3 FROM keyed) WHERE length(value) >= least)
"""


_ENT = _entities(_expand("business_name", W.NAME_ABBREVIATIONS), _expand("business_address", W.ADDRESS_ABBREVIATIONS))
_LONG = _keys(_ENT)
_LONG_DIAGNOSTIC = _keys(_entities(_expand("business_name", W.DIAGNOSTIC_NAME_ABBREVIATIONS), _expand("business_address", W.DIAGNOSTIC_ADDRESS_ABBREVIATIONS), null=""))
_LONG_EXPERIMENT = _keys(_entities(_text("business_name", False), _text("business_address", False), "coalesce(regexp_extract_all(business_address, '\\b(\\d{5})\\b', 1)[-1], '')"), "coalesce(business_address, '')")
_TRUTH = "truth AS (SELECT DISTINCT source1_entity_id AS s1_id, unnest(regexp_extract_all(matched_entity_ids, 'S[23]-[0-9]{9}')) AS cand_id FROM train_matches), labelled AS (SELECT DISTINCT source1_entity_id AS s1_id FROM train_matches)"


def _blocked(long: str) -> str:
    """j: the blocking join over K."""
    return f"""{long}, {_TRUTH},
q AS (SELECT * FROM K WHERE src = 'S1'),
t AS (SELECT * FROM K SEMI JOIN q USING (country_l, tag, value) WHERE src <> 'S1'),
tc AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY src, country_l, tag, value ORDER BY entity_id) <= 100),
j AS (SELECT q.entity_id AS s1_id, tc.entity_id AS cand_id, tc.tag, tc.prio, tc.src FROM q JOIN tc USING (country_l, tag, value))
"""


_HITS, _HITS_EXPERIMENT = _blocked(_LONG), _blocked(_LONG_EXPERIMENT)


def _ranked(cap: int, reserve: int = 5, name: str = "c") -> str:
    base = max(0, cap - min(reserve, cap))
    return f"""
{name}b AS (SELECT s1_id, cand_id, min((prio, src, cand_id)) AS o FROM j WHERE tag <> 'h' GROUP BY ALL),
{name}r AS (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY o) AS rank FROM {name}b QUALIFY rank <= {base}),
{name}n AS (SELECT s1_id, count(*) AS n FROM {name}r GROUP BY 1),
{name}h AS (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY src, cand_id) + coalesce(n, 0) AS rank
  FROM (SELECT DISTINCT s1_id, cand_id, src FROM j WHERE tag = 'h') ANTI JOIN {name}r USING (s1_id, cand_id) LEFT JOIN {name}n USING (s1_id) QUALIFY rank <= {cap}),
{name} AS (SELECT s1_id, cand_id, CAST(rank AS INTEGER) AS rank FROM {name}r UNION ALL SELECT s1_id, cand_id, CAST(rank AS INTEGER) FROM {name}h)
"""


_PAIRS = f"""{_ENT}, {_TRUTH},
att AS (SELECT s1_id, cand_id, a.norm_name AS n1, b.norm_name AS n2, a.norm_addr AS a1, b.norm_addr AS a2, a.country_l AS c1, b.country_l AS c2, a.postal AS p1, b.postal AS p2
  FROM truth JOIN ent a ON a.entity_id = s1_id JOIN ent b ON b.entity_id = cand_id)"""


def _set(c: str) -> str:
    return f"list_distinct({_tokens(c)})"


def _jac(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({_set(a)}, {_set(b)})) / nullif(len(list_distinct(list_concat({_set(a)}, {_set(b)}))), 0), 0.0)"


def _eq(a: str, b: str) -> str:
    return f"CAST(coalesce({a} <> '' AND {b} <> '' AND {a} = {b}, false) AS DOUBLE)"


def _core(c: str) -> str:
    return f"array_to_string(list_filter({_tokens(c)}, lambda x: NOT list_contains({_list(W.LEGAL_SUFFIXES)}, x)), ' ')"


_LEN = "CASE WHEN length({0}) = 0 OR length({1}) = 0 THEN 0.0 ELSE least(length({0}), length({1})) / greatest(length({0}), length({1})) END"
_TOKEN_FEATURES = f"""
SELECT s1_id, cand_id, round({_jac('n1', 'n2')}, 6) AS name_jaccard, CAST(len(list_intersect({_set('n1')}, {_set('n2')})) AS DOUBLE) AS common_token_count,
  round(coalesce(len(list_intersect({_set('n1')}, {_set('n2')})) / nullif(least(len({_set('n1')}), len({_set('n2')})), 0), 0.0), 6) AS name_token_overlap,
  CAST(len(list_distinct(list_concat({_set('n1')}, {_set('n2')}))) - len(list_intersect({_set('n1')}, {_set('n2')})) AS DOUBLE) AS name_token_diff_count,
  CAST(abs(len({_set('n1')}) - len({_set('n2')})) AS DOUBLE) AS name_token_count_diff, {_eq(f"({_tokens('n1')})[1]", f"({_tokens('n2')})[1]")} AS first_token_match,
  {_eq(f"({_tokens('n1')})[-1]", f"({_tokens('n2')})[-1]")} AS last_token_match, round({_LEN.format('n1', 'n2')}, 6) AS name_len_ratio,
  round({_jac(_core('n1'), _core('n2'))}, 6) AS core_name_jaccard, round({_jac('a1', 'a2')}, 6) AS addr_jaccard, round({_LEN.format('a1', 'a2')}, 6) AS addr_len_ratio,
  {_eq('c1', 'c2')} AS country_match, {_eq('p1', 'p2')} AS postal_match, {_eq('substring(p1, 1, 3)', 'substring(p2, 1, 3)')} AS postal_prefix3_match FROM att
"""


def _lcs(pairs: str, name: str) -> str:
    """A relation (s1_id, cand_id, r) with the insert/delete ratio of a and b of `pairs`."""
    return f"""
{name}t AS (SELECT s1_id, cand_id, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS row FROM {pairs}
  UNION ALL SELECT w.s1_id, w.cand_id, w.i + 1, list_reduce(range(1, len(b) + 1), lambda cur, j: list_append(cur,
    CASE WHEN b[j] = a[w.i + 1] THEN w.row[j] + 1 ELSE greatest(w.row[j + 1], cur[-1]) END), [0::BIGINT])
  FROM {name}t w JOIN {pairs} p ON w.s1_id = p.s1_id AND w.cand_id = p.cand_id WHERE w.i < len(a)),
{name} AS (SELECT p.s1_id, p.cand_id, CASE WHEN a = '' OR b = '' THEN 0.0 ELSE 2 * w.row[-1] / (len(a) + len(b)) END AS r FROM {pairs} p JOIN {name}t w ON w.s1_id = p.s1_id AND w.cand_id = p.cand_id AND w.i = len(p.a))
"""


_EDITED = {
    "name_lev": ("n1", "n2"), "name_token_sort": tuple(f"array_to_string(list_sort({_tokens(c)}), ' ')" for c in ("n1", "n2")), "addr_lev": ("a1", "a2"),
    "addr_token_sort": tuple(f"array_to_string(list_sort({_tokens(c)}), ' ')" for c in ("a1", "a2")), "core_name_similarity": (_core("n1"), _core("n2")),
}
_SCORED = f"""{_HITS}, {_ranked(20)},
catt AS (SELECT s1_id, cand_id, rank AS cand_rank, a.norm_name AS n1, b.norm_name AS n2, a.norm_addr AS a1, b.norm_addr AS a2, a.country_l AS c1, b.country_l AS c2, a.postal AS p1, b.postal AS p2
  FROM c JOIN ent a ON a.entity_id = s1_id JOIN ent b ON b.entity_id = cand_id),
scored AS (SELECT s1_id, cand_id, cand_rank, round(1 / (1 + exp(-({CHEAP_BIAS} + {CHEAP_MODEL['name_jaccard']} * ({_jac('n1', 'n2')}) + {CHEAP_MODEL['addr_jaccard']} * ({_jac('a1', 'a2')})
  + {CHEAP_MODEL['country_match']} * {_eq('c1', 'c2')} + {CHEAP_MODEL['postal_match']} * {_eq('p1', 'p2')}))), 9) AS prob FROM catt),
top AS (SELECT s1_id, cand_id, prob, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY prob DESC, cand_rank, cand_id) AS INTEGER) AS rank FROM scored WHERE prob >= 0.5 QUALIFY rank <= 5),
ls AS (SELECT scored.*, CAST(tr.cand_id IS NOT NULL AS INTEGER) AS label FROM scored SEMI JOIN labelled USING (s1_id) LEFT JOIN truth tr USING (s1_id, cand_id))
"""
_PER = """
m AS (SELECT coalesce(p.s1_id, t.s1_id) AS s1_id, p.cand_id AS pc, t.cand_id AS tc2 FROM top p FULL JOIN truth t ON p.s1_id = t.s1_id AND p.cand_id = t.cand_id),
per AS (SELECT l.s1_id, count(pc) AS n_pred, count(tc2) AS n_true, count(CASE WHEN pc IS NOT NULL AND tc2 IS NOT NULL THEN 1 END) AS tp FROM labelled l LEFT JOIN m USING (s1_id) GROUP BY 1),
f AS (SELECT *, CASE WHEN n_true = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END AS f05 FROM per)
"""
_SWEEP = f"""{_SCORED},
g AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold),
s AS (SELECT threshold, sum(CASE WHEN prob >= threshold THEN label ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN prob >= threshold THEN 1 - label ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN prob < threshold THEN label ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN prob < threshold THEN 1 - label ELSE 0 END)::BIGINT AS tn FROM ls, g GROUP BY 1),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM s),
sw AS (SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(1.25 * precision * recall / nullif(0.25 * precision + recall, 0), 0.0), 6) AS f05 FROM pr)
"""


_RESERVE_ROW = "SELECT {reserve} AS reserve, count(DISTINCT CASE WHEN x.cand_id IS NOT NULL THEN s1_id END) AS entities_hit, count(x.cand_id)::BIGINT AS pairs_found FROM truth LEFT JOIN {name} x USING (s1_id, cand_id)"


def _recall_rows(caps: list[tuple[int, int]], what: str, hits: str = "") -> str:
    parts = [_ranked(c, r, f"c{c}x{r}x") for c, r in caps]
    rows = [what.format(name=f"c{c}x{r}x", cap=c, reserve=r) for c, r in caps]
    return f"WITH {hits or _HITS}, {', '.join(parts)} " + " UNION ALL ".join(rows)


_KEYNAME = _expand("business_name", W.KEY_ABBREVIATIONS)
SQL = {
    "normalize_entities": f"WITH {_ENT} SELECT entity_id, src, norm_name, norm_addr, postal, country_l FROM ent",
    "normalizer_variants": f"""WITH {_ONE} SELECT entity_id, {_expand('business_name', W.V1_ABBREVIATIONS)} AS v1_name, {_KEYNAME} AS key_name,
  trim(regexp_replace(lower(coalesce(business_name, '')), '\\s+', ' ', 'g')) AS plain_name, {_text('business_name', False)} AS experiment_name,
  regexp_extract(coalesce(business_address, ''), '\\b(\\d{{5,6}})(?:-\\d{{4}})?\\b', 1) AS postal_5_6, coalesce(regexp_extract_all(business_address, '\\b(\\d{{5}})\\b', 1)[-1], '') AS last_postal,
  coalesce(regexp_extract_all(business_address, '\\b(\\d{{4,6}})\\b', 1)[-1], '') AS last_4_6 FROM one WHERE src = 'S1'""",
    "block_keys": f"WITH {_LONG} SELECT src, entity_id, country_l, tag, value FROM K",
    "key_cardinality": f"WITH {_LONG} SELECT src, tag, count(DISTINCT (country_l, value)) AS n_keys, count(*) AS n_rows FROM K GROUP BY ALL",
    "block_sizes": f"WITH {_LONG} SELECT src, country_l, tag, value, count(*) AS n_ids FROM K GROUP BY ALL",
    "block_members_capped": f"WITH {_LONG} SELECT src, entity_id, country_l, tag, value FROM K WHERE src <> 'S1' QUALIFY row_number() OVER (PARTITION BY src, country_l, tag, value ORDER BY entity_id) <= 100",
    "query_aware_index": f"WITH {_LONG} SELECT src, entity_id, country_l, tag, value FROM K WHERE src <> 'S1' AND (country_l, tag, value) IN (SELECT (country_l, tag, value) FROM K WHERE src = 'S1')",
    "candidates_cap20": f"WITH {_HITS}, {_ranked(20)} SELECT * FROM c",
    "candidates_cap100": f"WITH {_HITS}, {_ranked(100)} SELECT * FROM c",
    "candidates_v1": f"""WITH {_LONG},
K1 AS (SELECT src, entity_id, country_l, 'p' AS tag, postal3 AS value FROM keyed WHERE postal3 <> '' UNION ALL SELECT src, entity_id, country_l, 't', first_token FROM keyed WHERE first_token <> ''
  UNION ALL SELECT src, entity_id, country_l, 'c', first2 FROM keyed WHERE first2 <> ''),
j1 AS (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS cand_id FROM K1 a JOIN K1 b USING (country_l, tag, value) WHERE a.src = 'S1' AND b.src <> 'S1')
SELECT s1_id, cand_id, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY cand_id) AS INTEGER) AS rank FROM j1 QUALIFY rank <= 200""",
    "candidates_tiered_v2": f"""WITH {_HITS},
jw AS (SELECT q.entity_id AS s1_id, t.entity_id AS cand_id, t.tag, t.src FROM q JOIN t USING (country_l, tag, value)),
v AS (SELECT s1_id, cand_id, min(CASE WHEN tag IN ('p', 's', 'k') THEN 0 WHEN tag IN ('t', 'f') THEN 1 ELSE 2 END) AS tier FROM jw WHERE tag <> 'h' GROUP BY ALL),
vr AS (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY tier, cand_id) AS rank FROM v QUALIFY rank <= 95),
vn AS (SELECT s1_id, count(*) AS n FROM vr GROUP BY 1),
vh AS (SELECT s1_id, cand_id, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY s1_id ORDER BY src, cand_id) AS h FROM (SELECT DISTINCT s1_id, cand_id, src FROM jw WHERE tag = 'h') ANTI JOIN vr USING (s1_id, cand_id) LEFT JOIN vn USING (s1_id) QUALIFY h <= 5)
SELECT s1_id, cand_id, CAST(rank AS INTEGER) AS rank FROM vr UNION ALL SELECT s1_id, cand_id, CAST(n + h AS INTEGER) FROM vh""",
    "candidate_lists": f"WITH {_HITS}, {_ranked(20)} SELECT e.entity_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS candidate_entity_ids FROM ent e LEFT JOIN c ON c.s1_id = e.entity_id WHERE e.src = 'S1' GROUP BY 1",
    "token_features": f"WITH {_PAIRS} {_TOKEN_FEATURES}",
    "edit_features": f"""WITH RECURSIVE {_PAIRS}, {', '.join(f"p{n} AS (SELECT s1_id, cand_id, {x} AS a, {y} AS b FROM att)" for n, (x, y) in _EDITED.items())}, {', '.join(_lcs(f'p{n}', f'l{n}') for n in _EDITED)}
SELECT s1_id, cand_id, {', '.join(f"round(l{n}.r, 6) AS {n}" for n in _EDITED)} FROM {' '.join(f"l{n}" if i == 0 else f"JOIN l{n} USING (s1_id, cand_id)" for i, n in enumerate(_EDITED))}""",
    "tiered_match": f"""WITH {_ENT},
kn AS (SELECT src, entity_id, country_l, {_KEYNAME} AS n FROM ent),
kk AS (SELECT * FROM (SELECT src, entity_id, country_l, 0 AS tier, n AS value FROM kn UNION ALL SELECT src, entity_id, country_l, 1, array_to_string(list_sort({_tokens('n')}), ' ') FROM kn
  UNION ALL SELECT src, entity_id, country_l, 2, array_to_string(list_sort(list_filter({_tokens('n')}, lambda x: NOT list_contains({_list(W.KEY_LEGAL)}, x))), ' ') FROM kn) WHERE value <> ''),
hh AS (SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, min(tier) AS tier, b.src FROM kk a JOIN kk b USING (country_l, tier, value) WHERE a.src = 'S1' AND b.src <> 'S1' GROUP BY ALL),
cc AS (SELECT *, count(*) FILTER (tier = 0) OVER (PARTITION BY s1_id) AS n0, count(*) FILTER (tier <= 1) OVER (PARTITION BY s1_id) AS n1 FROM hh)
SELECT s1_id, cand_id, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY tier, src, cand_id) AS INTEGER) AS rank FROM cc WHERE tier = 0 OR tier = 1 AND n0 < 3 OR tier = 2 AND n0 < 3 AND n1 < 3 QUALIFY rank <= 5""",
    "linear_score_topk": f"WITH {_SCORED} SELECT s1_id, cand_id, round(prob, 6) AS prob, rank FROM top",
    "match_lists": f"WITH {_SCORED} SELECT e.entity_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY top.rank), '') AS matched_entity_ids FROM ent e LEFT JOIN top ON s1_id = e.entity_id WHERE e.src = 'S1' GROUP BY 1",
    "ground_truth_long": f"WITH {_TRUTH} SELECT s1_id, cand_id, substring(cand_id, 1, 2) AS target FROM truth",
    "block_recall": f"""WITH {_LONG}, {_TRUTH}, sh AS (SELECT DISTINCT s1_id, cand_id, a.tag FROM truth JOIN K a ON a.entity_id = s1_id JOIN K b ON b.entity_id = cand_id AND a.country_l = b.country_l AND a.tag = b.tag AND a.value = b.value),
u AS (SELECT * FROM sh UNION ALL SELECT DISTINCT s1_id, cand_id, 'union' FROM sh) SELECT tag, count(*) AS pairs_found, (SELECT count(*) FROM truth) AS n_pairs, round(count(*) / (SELECT count(*) FROM truth), 6) AS recall FROM u GROUP BY 1""",
    "entity_and_pair_recall": f"""WITH {_HITS}, {_ranked(100)}, pe AS (SELECT s1_id, count(c.cand_id) AS found, count(*) AS pairs FROM truth LEFT JOIN c USING (s1_id, cand_id) GROUP BY 1)
SELECT count(*) AS n_entities, count(*) FILTER (found > 0) AS entities_hit, sum(pairs)::BIGINT AS n_pairs, sum(found)::BIGINT AS pairs_found, round(count(*) FILTER (found > 0) / count(*), 6) AS entity_recall, round(sum(found) / sum(pairs), 6) AS pair_recall FROM pe""",
    "recall_at_caps": _recall_rows([(c, 5) for c in CAPS], "SELECT {cap} AS cap, count(x.cand_id) AS pairs_found, count(*) AS n_pairs, round(count(x.cand_id) / count(*), 6) AS recall, count(DISTINCT CASE WHEN x.cand_id IS NOT NULL THEN s1_id END) AS entities_hit, count(DISTINCT s1_id) AS n_entities, round(count(DISTINCT CASE WHEN x.cand_id IS NOT NULL THEN s1_id END) / count(DISTINCT s1_id), 6) AS entity_recall, round((SELECT count(*) FROM {name}) / (SELECT count(*) FROM ent WHERE src = 'S1'), 6) AS mean_candidates FROM truth LEFT JOIN {name} x USING (s1_id, cand_id)"),
    "reserve_sweep": _recall_rows([(100, r) for r in RESERVES], _RESERVE_ROW),
    "reserve_experiment": _recall_rows([(100, r) for r in RESERVES], _RESERVE_ROW, _HITS_EXPERIMENT),
    "blocking_gate": f"""WITH {_HITS}, {_ranked(100)}, m AS (SELECT coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM c GROUP BY s1_id)), pe AS (SELECT s1_id, count(c.cand_id) AS found FROM truth LEFT JOIN c USING (s1_id, cand_id) GROUP BY 1)
SELECT any_value(most) AS most_candidates, any_value(most) <= 100 AS cap_kept, count(*) AS n_entities, count(*) FILTER (found > 0) AS entities_hit, round(count(*) FILTER (found > 0) / count(*), 6) AS entity_recall, count(*) FILTER (found > 0) / count(*) >= {GATE} AS passes FROM pe, m""",
    "prepared_recall": f"""WITH {_LONG_DIAGNOSTIC}, {_TRUTH}, sh AS (SELECT DISTINCT s1_id, cand_id, a.tag FROM truth JOIN K a ON a.entity_id = s1_id JOIN K b ON b.entity_id = cand_id AND a.country_l = b.country_l AND a.tag = b.tag AND a.value = b.value WHERE a.tag <> 'h'),
u AS (SELECT * FROM sh UNION ALL SELECT DISTINCT s1_id, cand_id, 'union' FROM sh) SELECT tag, count(*) AS pairs_found, (SELECT count(*) FROM truth) AS n_pairs, round(count(*) / (SELECT count(*) FROM truth), 6) AS recall FROM u GROUP BY 1""",
    "positive_rate": f"WITH {_HITS}, {_ranked(20)}, p AS (SELECT CAST(tr.cand_id IS NOT NULL AS INTEGER) AS label FROM c SEMI JOIN labelled USING (s1_id) LEFT JOIN truth tr USING (s1_id, cand_id)) SELECT count(*) AS n_pairs, sum(label)::BIGINT AS n_positive, round(avg(label), 6) AS positive_rate FROM p",
    "stratified_split": f"""WITH {_SCORED} SELECT s1_id, cand_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || s1_id || '|' || cand_id), s1_id, cand_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.2) AS is_validation FROM ls""",
    "candidate_stats": f"""WITH {_HITS}, {_ranked(100)}, n AS (SELECT e.entity_id, count(c.cand_id) AS n FROM ent e LEFT JOIN c ON c.s1_id = e.entity_id WHERE e.src = 'S1' GROUP BY 1)
SELECT min(n) AS least, CAST(floor(median(n)) AS BIGINT) AS median, max(n) AS most, round(avg(n), 6) AS mean, count(*) AS n_entities FROM n""",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM sw",
    "best_threshold": f"WITH {_SWEEP} SELECT threshold, f05 FROM sw ORDER BY f05 DESC, threshold LIMIT 1",
    "entity_f05": f"WITH {_SCORED}, {_PER} SELECT s1_id, n_pred, n_true, tp, round(f05, 6) AS f05 FROM f",
    "macro_f05": f"WITH {_SCORED}, {_PER} SELECT round(avg(f05), 6) AS f05, count(*) AS n_entities, count(*) FILTER (n_true = 0) AS n_singletons FROM f",
    "quality_report": f"""WITH {_HITS}, {_ranked(100)},
o AS (SELECT source1_entity_id AS s1_id, list_filter(list_transform(string_split(coalesce(matched_entity_ids, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS ids FROM train_matches),
ea AS (SELECT s1_id, unnest(ids) AS id FROM o),
z AS (SELECT 'duplicate row' AS rule, 'error' AS level, s1_id AS x FROM o GROUP BY s1_id HAVING count(*) > 1
UNION ALL SELECT 'repeated id', 'error', s1_id FROM o WHERE len(ids) > len(list_distinct(ids))
UNION ALL SELECT 'self match', 'error', s1_id FROM ea WHERE id LIKE 'S1-%'
UNION ALL SELECT 'wrong prefix', 'error', s1_id FROM ea WHERE NOT regexp_matches(id, '^S[123]-')
UNION ALL SELECT 'missing row', 'error', entity_id FROM ent WHERE src = 'S1' AND entity_id NOT IN (SELECT s1_id FROM o)
UNION ALL SELECT DISTINCT 'extra row', 'error', s1_id FROM o WHERE s1_id NOT IN (SELECT entity_id FROM ent WHERE src = 'S1')
UNION ALL SELECT DISTINCT 'unknown id', 'error', id FROM ea WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM ent WHERE src <> 'S1')
UNION ALL SELECT DISTINCT 'not among candidates', 'warning', s1_id FROM (SELECT s1_id, id AS cand_id FROM ea) ANTI JOIN c USING (s1_id, cand_id))
SELECT rule, level, count(*) AS n, array_to_string(list_sort(list_distinct(list(x)))[1:5], ',') AS examples FROM z GROUP BY ALL""",
    "output_row_counts": """WITH o AS (SELECT len(list_filter(list_transform(string_split(coalesce(matched_entity_ids, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '')) AS k FROM train_matches)
SELECT count(*) AS n_rows, count(*) FILTER (k = 0) AS n_empty, count(*) FILTER (k > 0) AS n_matched, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS matched_percent FROM o""",
    "exact_sample": f"WITH {_ENT} SELECT entity_id FROM ent WHERE src = 'S1' ORDER BY md5('42|' || entity_id), entity_id LIMIT 500",
    "truth_preserving_sample": f"""WITH {_ENT}, {_TRUTH}, kept AS (SELECT entity_id FROM ent WHERE src <> 'S1' AND entity_id IN (SELECT cand_id FROM truth))
SELECT entity_id FROM kept UNION ALL SELECT entity_id FROM (SELECT entity_id, row_number() OVER (ORDER BY md5('42|' || entity_id), entity_id) AS r FROM ent WHERE src <> 'S1' AND entity_id NOT IN (SELECT entity_id FROM kept)) WHERE r <= greatest(0, 2000 - (SELECT count(*) FROM kept))""",
    "pair_inspection": f"""WITH {_LONG}, {_TRUTH} SELECT s1_id, cand_id, a.norm_name AS norm_name_1, b.norm_name AS norm_name_2, a.norm_addr AS norm_addr_1, b.norm_addr AS norm_addr_2,
  concat_ws(',', {', '.join(f"CASE WHEN a.{k.column} <> '' AND a.{k.column} = b.{k.column} THEN '{k.column}' END" for k in B.KEYS)}) AS shared_keys
FROM truth JOIN keyed a ON a.entity_id = s1_id JOIN keyed b ON b.entity_id = cand_id""",
    "diagnostic_recall": f"""WITH {_ONE}, {_TRUTH},
dn AS (SELECT entity_id, trim(regexp_replace(lower(coalesce(business_name, '')), '\\s+', ' ', 'g')) AS n, trim(regexp_replace(lower(coalesce(business_address, '')), '\\s+', ' ', 'g')) AS a,
  coalesce(regexp_extract_all(business_address, '\\b(\\d{{4,6}})\\b', 1)[-1], '') AS postal FROM one),
dk AS (SELECT *, substring(postal, 1, 3) AS postal3, regexp_extract(a, '^\\s*(\\d+[A-Za-z]?(?:/\\d+)?)', 1) AS street_num, coalesce(({_tokens('n')})[1], '') AS first_token, substring(n, 1, 3) AS first3, substring(n, 1, 4) AS first4,
  array_to_string(list_sort({_tokens('n')}), ' ') AS sorted_tokens, array_to_string(list_sort(list_filter({_tokens('n')}, lambda x: NOT list_contains({_list(W.LEGAL)}, x))), ' ') AS core_tokens,
  array_to_string(list_sort(list_distinct({_tokens('a')})), ' ') AS addr_sorted_tokens FROM dn),
dp AS (SELECT *, CASE WHEN postal <> '' AND street_num <> '' THEN postal || '|' || street_num ELSE '' END AS postal_house FROM dk),
dh AS (SELECT s1_id, cand_id, list_filter([{', '.join(f"CASE WHEN x.{c} <> '' AND x.{c} = y.{c} THEN '{t}' END" for t, c in DIAGNOSTIC_KEYS.items())}], lambda z: z IS NOT NULL) AS tags FROM truth JOIN dp x ON x.entity_id = s1_id JOIN dp y ON y.entity_id = cand_id)
SELECT t.tag, count(*) FILTER (list_contains(tags, t.tag) OR t.tag = 'union' AND len(tags) > 0) AS pairs_found, count(*) AS n_pairs, round(count(*) FILTER (list_contains(tags, t.tag) OR t.tag = 'union' AND len(tags) > 0) / count(*), 6) AS recall
FROM dh, (SELECT unnest({_list([*DIAGNOSTIC_KEYS, 'union'])}) AS tag) t GROUP BY 1""",
    "missed_pairs": f"WITH {_HITS}, {_ranked(100)} SELECT s1_id, cand_id FROM truth ANTI JOIN c USING (s1_id, cand_id) ORDER BY 1, 2 LIMIT 20",
}
