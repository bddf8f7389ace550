"""Every query of the core runs over the small tables and, where it has SQL, gives what the SQL gives."""

import os

import duckdb
import pytest

from tarn.plans import resolution, training_data

QUERIES = resolution.QUERIES | training_data.QUERIES
SQL = resolution.SQL | training_data.SQL


def plain(rows):
    return sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


def same(spark, sf, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    got = query(spark, sf)
    names = sorted(got.columns)
    want = con.execute(sql)
    assert sorted(c[0] for c in want.description) == names
    want = con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert plain(got.select(*names).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["feature_vectors_11", "feature_vectors_13", "feature_vectors_26"])
def test_features_are_bounded(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows
    for r in rows:
        for k, v in r.asDict().items():
            if k.startswith(("name_lev", "addr_lev", "name_jac", "addr_jac", "name_part", "addr_part", "name_token_s", "addr_token_s", "core_name")):
                assert 0.0 <= v <= 1.0, (k, v)


@pytest.mark.parametrize("name", ["feature_vectors_11", "feature_vectors_13", "feature_vectors_26"])
def test_features_of_every_candidate(spark, sf, name):
    want = sorted((r["s1_id"], r["cand_id"]) for r in resolution.candidates_cap20(spark, sf).collect())
    assert sorted((r["s1_id"], r["cand_id"]) for r in QUERIES[name](spark, sf).select("s1_id", "cand_id").collect()) == want


def test_pruning_equals_full_scoring(spark, sf):
    from pyspark.sql import functions as F

    from tarn.operators import entities as E
    from tarn.operators import features as X
    from tarn.operators import matching as M

    pairs = resolution.candidates_cap20(spark, sf)
    attached = X.attach(pairs, E.source(spark, sf, 1), E.targets(spark, sf))
    full = X.with_features(attached, list(resolution.FULL_MODEL)).withColumn("prob", M.logistic(M.linear(resolution.FULL_MODEL, resolution.FULL_BIAS)))
    want = {(r[0], r[1]) for r in full.where("prob >= 0.5").select("s1_id", "cand_id").collect()}
    assert want and {(r[0], r[1]) for r in resolution.bound_pruned_match(spark, sf).collect()} == want
    negative = dict(resolution.FULL_MODEL, name_partial=-1.5)
    full = X.with_features(attached, list(negative)).withColumn("prob", M.logistic(M.linear(negative, -5.0)))
    want = {(r[0], r[1]) for r in full.where("prob >= 0.6").select("s1_id", "cand_id").collect()}
    got = M.pruned_scores(attached, negative, -5.0, 0.6, X.EXPENSIVE).where(F.col("passes"))
    assert {(r[0], r[1]) for r in got.select("s1_id", "cand_id").collect()} == want


def test_candidates_keep_the_cap(spark, sf):
    for cap in (0, 3, 20):
        rows = resolution._candidates(spark, sf, cap).collect()
        per = {}
        for r in rows:
            per.setdefault(r["s1_id"], []).append((r["rank"], r["cand_id"]))
        assert all(len(v) <= cap and len({c for _, c in v}) == len(v) and sorted(x for x, _ in v) == list(range(1, len(v) + 1)) for v in per.values())
        assert bool(rows) == (cap > 0)


def test_matches_are_candidates_and_every_record_has_a_row(spark, sf):
    cands = {(r[0], r[1]) for r in resolution.candidates_cap20(spark, sf).select("s1_id", "cand_id").collect()}
    lists = resolution.match_lists(spark, sf).collect()
    assert len(lists) == 100 == len({r[0] for r in lists})
    assert {(r[0], i) for r in lists for i in r[1].split(",") if i} <= cands


def test_stratified_split_is_exact(spark):
    from tarn.operators.sampling import stratified_split

    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1003)], "id int, label int")
    rows = stratified_split(df, "label", ["id"]).collect()
    for label in (0, 1):
        mine = [r["is_validation"] for r in rows if r["label"] == label]
        assert sum(mine) == -(-len(mine) // 5)
    grouped = stratified_split(df.selectExpr("*", "id % 40 AS g"), "label", ["id"], group="g").collect()
    assert all(len({r["is_validation"] for r in grouped if r["g"] == g}) == 1 for g in range(40))


def test_train_and_score(spark):
    rows = resolution.train_and_score(spark, "/root/testdata/sf0.01").collect()
    per = {}
    for r in rows:
        assert 0.3 <= r["prob"] <= 1
        per[r["s1_id"]] = per.get(r["s1_id"], 0) + 1
    assert rows and max(per.values()) <= 5


def test_train_and_score_covers_unlabelled_records(spark):
    from tarn.operators import entities as E

    d = "/root/testdata/sf0.01"
    known = {r[0] for r in E.labelled(spark, d).collect()}
    cands = {(r["s1_id"], r["cand_id"]) for r in resolution.candidates_cap20(spark, d).collect()}
    pairs = {(r["s1_id"], r["cand_id"]) for r in resolution.train_and_score(spark, d).collect()}
    assert pairs <= cands
    matched = {s for s, _ in pairs}
    assert matched & known and matched - known


def test_training_sees_the_features_that_are_registered(spark, sf):
    """Edit measures of empty strings are the kernels' own in training as in feature_vectors_11."""
    want = {(r["s1_id"], r["cand_id"]): r["name_lev"] for r in resolution.feature_vectors_11(spark, sf).collect()}
    got = {(r["s1_id"], r["cand_id"]): r["name_lev"] for r in resolution._candidate_features(spark, sf, ["name_lev"], guarded=False).collect()}
    assert got == want


def test_rescored_matches_come_from_the_first_places(spark):
    d = "/root/testdata/sf0.01"
    lists = {r[0]: r[1].split(",")[: resolution.FIRST] for r in resolution.candidate_lists(spark, d).collect()}
    rows = resolution.rescored_match(spark, d).collect()
    assert len(rows) == len(lists) and any(r[1] for r in rows)
    assert all(set(r[1].split(",")) - {""} <= set(lists[r[0]]) for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
