"""Operators on small hand-made tables: nulls, blanks, repeats, ties, empty tables, clashing extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import evaluate as V
from tarn.operators import matching as M
from tarn.operators import packed as K
from tarn.operators import quality as Q
from tarn.operators.blocking import Key, capped, key_table, rank_hits
from tarn.operators.heavy import heavy_keys, per_key
from tarn.operators.sampling import exact_sample, truth_preserving_sample
from tarn.sources import tsv


def test_per_key_with_a_hot_key(spark):
    rows = [("A ", None, i) for i in range(900)] + [("b", "x", 1), (" ", "X", 2), (None, "", 3), ("a", " x ", 4)]
    df = spark.createDataFrame(rows, "country string, name string, row_count int").repartition(7)
    got = {(r[0], r[1]): r[2] for r in per_key(df, ["country", "name"]).collect()}
    assert got == {("country", "a"): 901, ("country", "b"): 1, ("name", "x"): 3}
    assert {r[1] for r in heavy_keys(df, ["country", "name"], 0.5).collect()} == {"a"}
    assert heavy_keys(df, ["country"], 901 / 904).count() == 1
    assert per_key(df.limit(0), ["country"]).count() == 0 and heavy_keys(df.limit(0), ["country"]).count() == 0
    sums = per_key(df, ["name"], {"s": F.sum("row_count"), "m": F.max("row_count")}).collect()
    assert [tuple(r) for r in sums] == [("name", "x", 7, 4)]


def packed(spark, rows, known):
    df = spark.createDataFrame(rows, "k string, f string").withColumn("field", F.lit("z")).withColumn("value", F.lit(1))
    words = spark.createDataFrame([(x,) for x in known], "v string")
    out = K.split_packed(df, "k", "f", words, "v", known_only=True).collect()
    return sorted((r["key"], r["pos"], r["value"]) for r in out)


def test_packed_values(spark):
    known = ["Smith, John", "Smith", "Ann", "A;B", "x-1", "x-12"]
    rows = [
        ("1", "Smith, John;Ann"), ("2", '"Ann" | [\'A;B\']'), ("3", "x-12,x-1, x-12"), ("4", None), ("5", ""), ("6", "none"), (None, "Ann"), ("7", "Ann,Ann"), ("7", ' "Ann";"Ann" '),
        ("8", "Annabel, Ann"), ("9", "Smith John"),
    ]
    assert packed(spark, rows, known) == [
        ("1", 1, "Smith, John"), ("1", 2, "Ann"), ("2", 1, "Ann"), ("2", 2, "A;B"), ("3", 1, "x-12"), ("3", 2, "x-1"), ("3", 3, "x-12"), ("7", 1, "Ann"), ("7", 2, "Ann"), ("8", 1, "Ann"), ("9", 1, "Smith"),
    ]
    assert packed(spark, rows, []) == [] and packed(spark, [], known) == []
    long = ",".join(["Ann", "x-1"] * 3000)
    assert len(packed(spark, [("1", long)], known)) == 6000


def test_packed_unknown_pieces_and_random_round_trip(spark):
    df = spark.createDataFrame([("1", "Ann; 'foo' ,bar")], "k string, f string")
    words = spark.createDataFrame([("Ann",)], "v string")
    got = K.split_packed(df, "k", "f", words, "v").orderBy("pos").collect()
    assert [(r["pos"], r["value"], r["known"]) for r in got] == [(1, "Ann", True), (2, "foo", False), (3, "bar", False)]
    r = random.Random(5)
    known = [f"S2-{r.randrange(10**9):09d}" for _ in range(40)]
    rows, want = [], []
    for i in range(200):
        ids = [r.choice(known) for _ in range(r.randint(0, 5))]
        text = "".join(r.choice(["", "'", '"', " "]) + x + r.choice([",", ";", " | ", "\t", "||", " and ", "，"]) for x in ids)
        rows.append((str(i), r.choice(["[", "", "("]) + text))
        want += [(str(i), p, x) for p, x in enumerate(ids, 1)]
    assert packed(spark, rows, known) == sorted(want)


def test_best_cover_prefers_whole_values():
    assert K.best_cover("ab cd", [(0, 2, "ab"), (3, 5, "cd"), (0, 5, "ab cd")]) == [("ab cd", True)]
    assert K.best_cover("", []) == [] and K.best_cover(" , ", []) == []


def test_block_cap_and_ranking(spark):
    keyed = spark.createDataFrame([("S2", f"S2-{i:03d}", "us", "75") for i in range(250)] + [("S3", "S3-000", "us", "")], "src string, entity_id string, country_l string, postal3 string")
    index = key_table(keyed, (Key("p", "postal3", 1, 0),))
    assert index.count() == 250
    kept = sorted(r["entity_id"] for r in capped(index, 100).collect())
    assert kept == [f"S2-{i:03d}" for i in range(100)]
    hits = spark.createDataFrame([("a", f"c{i}", "p", 0, "S2") for i in range(9)] + [("a", "c8", "h", 6, "S2"), ("a", "c9", "h", 6, "S3"), ("a", "c1", "t", 3, "S2")], "s1_id string, cand_id string, tag string, prio int, src string")
    assert [r["cand_id"] for r in rank_hits(hits, 10).orderBy("rank").collect()] == ["c0", "c1", "c2", "c3", "c4", "c8", "c9"]
    assert rank_hits(hits, 0).count() == 0 and rank_hits(hits.limit(0), 10).count() == 0


def test_tiers_and_blank_names(spark):
    cols = "entity_id string, src string, business_name string, country_l string"
    s1 = spark.createDataFrame([("S1-1", "S1", "B A Ltd", "us"), ("S1-2", "S1", None, "us")], cols)
    t = spark.createDataFrame([("S2-1", "S2", "b a limited", "us"), ("S2-2", "S2", "A B ltd", "us"), ("S3-1", "S3", "A B", "us"), ("S3-2", "S3", None, "us"), ("S3-3", "S3", "a b", "fr")], cols)
    got = [(r["s1_id"], r["cand_id"]) for r in M.tiered_match(s1, t).orderBy("s1_id", "rank").collect()]
    assert got == [("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S3-1")]
    assert ("S1-2", "S3-2") in {(r["s1_id"], r["cand_id"]) for r in M.tiered_match(s1, t, allow_blank=True).collect()}


def test_f05(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "s1_id string, cand_id string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "s1_id string")
    pred, true = pairs([("b", "x"), ("d", "x"), ("d", "y"), ("e", "q")]), pairs([("c", "x"), ("d", "x"), ("e", "p")])
    got = {r["s1_id"]: r["f05"] for r in V.entity_f05(pred, true, ids).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.0, "d": pytest.approx(0.625 / 1.125), "e": 0.0}
    m = V.macro_f05(pred, true, ids).first()
    assert m["n_entities"] == 5 and m["n_singletons"] == 2
    assert tuple(V.macro_f05(pred, true, ids.limit(0)).first()) == (0.0, 0, 0)
    assert V.recall(pred, true).first()["pairs_found"] == 1


def test_sweep_takes_the_first_of_equal_thresholds(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0)], "prob double, label int")
    sweep = V.threshold_sweep(scored, [0.1, 0.3, 0.5, 0.85])
    assert {(r["threshold"], r["tp"], r["fp"], r["fn"], r["tn"]) for r in sweep.collect()} == {(0.1, 2, 1, 0, 0), (0.3, 2, 0, 0, 1), (0.5, 2, 0, 0, 1), (0.85, 1, 0, 1, 1)}
    assert V.best_threshold(sweep).first()["threshold"] == 0.3


def test_quality_rules(spark):
    lines = ["S1-1\tS2-1", "S1-2", "S1-3\tS2-1", "S1-3\tS2-2", "S1-4\tS2-1,S2-1", "S1-5\tS1-1", "S1-6\tX-1", "S1-7\tS2-9", "S1-9\t", "", "S1-8\tS3-1 , "]
    out = Q.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    required = spark.createDataFrame([(f"S1-{i}",) for i in (1, 3, 4, 5, 6, 7, 8, 10)], "s1_id string")
    known = spark.createDataFrame([("S2-1",), ("S2-2",), ("S3-1",)], "entity_id string")
    cands = spark.createDataFrame([("S1-1", "S2-1"), ("S1-3", "S2-1"), ("S1-3", "S2-2"), ("S1-4", "S2-1")], "s1_id string, cand_id string")
    got = {r["rule"]: r["n"] for r in Q.quality_report(out, required, known, cands).collect()}
    assert got == {"no tab": 1, "duplicate row": 1, "repeated id": 1, "self match": 1, "wrong prefix": 1, "unknown id": 1, "missing row": 1, "extra row": 1, "not among candidates": 4}
    assert Q.header_problem(None) == "empty file" and Q.header_problem("a,b") == "comma-separated" and Q.header_problem("x\ty") == "wrong header"
    assert Q.header_problem("Source1_entity_id\tmatched_entity_ids ") is None


def test_samples(spark):
    df = spark.createDataFrame([(f"S2-{i}",) for i in range(100)], "entity_id string")
    assert exact_sample(df, "entity_id", 7).count() == 7 and exact_sample(df, "entity_id", 1000).count() == 100
    assert sorted(exact_sample(df, "entity_id", 7).collect()) == sorted(exact_sample(df.repartition(9), "entity_id", 7).collect())
    need = spark.createDataFrame([("S2-5",), ("S2-7",), ("S9-1",)], "cand_id string")
    got = {r[0] for r in truth_preserving_sample(df, need, 10).collect()}
    assert len(got) == 10 and {"S2-5", "S2-7"} <= got
    assert truth_preserving_sample(df, need, 1).count() == 2


def test_files(spark, tmp_path):
    src = tmp_path / "train_source1.tsv"
    src.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tCafé \"X\"\tNA\t\nS1-2\tnull\t1 a\tUS\n", encoding="utf-8")
    rows = tsv.read_tsv(spark, str(src)).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'Café "X"', None, None), ("S1-2", None, "1 a", "US")]
    assert tsv.read_tsv(spark, str(src), columns=["country"]).columns == ["country"]
    out = spark.createDataFrame([("S1-1", "S2-1,S2-2,S2-3,S2-4"), ("S1-2", "")], "source1_entity_id string, candidate_entity_ids string")
    tsv.write_tsv(out, str(tmp_path / "out"), single=True)
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S2-2,S2-3,S2-4\nS1-2\t\n"
    got = tsv.read_candidates(spark, str(tmp_path / "out")).collect()
    assert sorted((r["cand_id"], r["rank"]) for r in got) == [("S2-1", 1), ("S2-2", 2), ("S2-3", 3)]
    assert tsv.read_lines(spark, str(tmp_path / "out")).count() == 3
    calls = []
    build = lambda: calls.append(1) or out
    for settings in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert tsv.cached(spark, str(tmp_path / "cache"), settings, build).count() == 2
    assert len(calls) == 2
    assert tsv.first_existing(spark, str(tmp_path / "nothing"), str(src)) == str(src)
    with pytest.raises(FileNotFoundError):
        tsv.first_existing(spark, str(tmp_path / "nothing"))
    df = spark.range(10).withColumnRenamed("id", "n")
    assert [r[0] for r in tsv.head(df, "n", 3, 4).collect()] == [4, 5, 6]


def test_model_round_trip(spark, tmp_path):
    from tarn.operators import model as L

    r = random.Random(2)
    rows = [(r.random(), r.random()) for _ in range(400)]
    df = spark.createDataFrame([(a, b, int(2 * a - b + 0.1 * r.random() > 0.6)) for a, b in rows], "a double, b double, label int")
    model = L.train(df, ["a", "b", "absent"])
    scored = L.score(model, df, ["a", "b", "absent"])
    coefficients, bias = L.folded(model, ["a", "b", "absent"])
    by_hand = scored.withColumn("p", M.logistic(M.linear({k: v for k, v in coefficients.items() if k != "absent"}, bias)))
    assert by_hand.where(F.abs(F.col("p") - F.col("prob")) > 1e-9).count() == 0
    thr = L.tune(scored)
    assert scored.where((F.col("prob") >= thr).cast("int") != F.col("label")).count() < 40
    L.save(model, str(tmp_path / "m"), ["a", "b", "absent"], thr, 20)
    back = L.load(spark, str(tmp_path / "m"))
    assert back["feats"] == ["a", "b", "absent"] and back["thr"] == thr and back["cap"] == 20
    with pytest.raises(ValueError):
        L.train(df.where("label = 1"), ["a"])


@pytest.mark.parametrize("n", [0, 7, 900, 5000])
def test_exact_sample_is_the_first_in_hash_order(spark, n):
    import hashlib

    from tarn.operators.sampling import exact_sample

    ids = [f"k{i}" for i in range(3000)]
    want = sorted(ids, key=lambda x: (hashlib.md5(f"42|{x}".encode()).hexdigest(), x))[:n]
    df = spark.createDataFrame([(x, "z", 1) for x in ids], "id string, n string, __b int")
    assert sorted(r["id"] for r in exact_sample(df.drop("__b"), "id", n).collect()) == sorted(want)
    assert exact_sample(df.limit(0).drop("__b"), "id", n).count() == 0


def test_kept_at_equals_ranking_for_each_setting(spark):
    from tarn.operators.blocking import kept_at, rank_hits

    r = random.Random(3)
    rows = list({(f"S1-{r.randrange(6)}", f"S2-{r.randrange(40):02d}", t, p, "S2") for _ in range(500) for t, p in [r.choice([("p", 0), ("t", 3), ("h", 6), ("h", 6)])]})
    hits = spark.createDataFrame(rows, "s1_id string, cand_id string, tag string, prio int, src string")
    settings = [(0, 5), (3, 5), (10, 5), (10, 0), (20, 30), (100, 10)]
    got = kept_at(hits, settings).collect()
    for i, (cap, reserve) in enumerate(settings):
        want = {(x["s1_id"], x["cand_id"]) for x in rank_hits(hits, cap, reserve).collect()}
        assert {(x["s1_id"], x["cand_id"]) for x in got if x["kept"][i]} == want, (cap, reserve)


def test_boosted_trees_and_positive_rate(spark):
    from tarn.operators import model as L
    from tarn.operators.evaluate import positive_rate

    r = random.Random(2)
    rows = [(f"a{i}", x, y, int((x > 0.5) != (y > 0.5))) for i, x, y in ((i, r.random(), r.random()) for i in range(400))]
    df = spark.createDataFrame(rows, "s1_id string, x double, y double, label int")
    scored = L.score(L.train(df, ["x", "y"], boosted=True, trees=20), df, ["x", "y"]).collect()
    assert sum((s["prob"] >= 0.5) == (s["label"] == 1) for s in scored) > 380  # no linear model can
    rate = positive_rate(df).first()
    assert (rate["n_pairs"], rate["n_positive"]) == (400, sum(x[3] for x in rows)) and positive_rate(df.limit(0)).first()["positive_rate"] == 0.0
    with pytest.raises(ValueError):
        L.train(df.where("label = 1"), ["x", "y"])
