"""Components, splits and segmentation: against brute force, with edge cases."""

import random
import time
from pathlib import Path

import pytest

from tarn.llm import splits as P
from tarn.llm.components import connected_components
from tarn.storage import cut, scratch


def groups(links, extra=()):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            parent[find(a)] = find(b)
    for x in extra:
        find(x)
    least = {}
    for x in parent:
        r = find(x)
        least[r] = min(least.get(r, x), x)
    return {x: least[find(x)] for x in parent}


def solved(spark, links, extra=None):
    df = spark.createDataFrame(links, "a string, b string").selectExpr("a", "b", "'z' AS u", "1 AS group_id")
    v = None if extra is None else spark.createDataFrame([(x,) for x in extra], "v string")
    rows = connected_components(df, "a", "b", v, "v").collect()
    assert len(rows) == len({r["entity_id"] for r in rows})
    return {r["entity_id"]: r["group_id"] for r in rows}


def test_shapes(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)]
    star = [("hub", f"s{i}") for i in range(300)]
    ring = [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)]
    links = chain + star + ring + [("x", "x"), ("p", None), (None, "q"), (None, None), *star[:5]]
    assert solved(spark, links, ["alone", "hub", None]) == groups(links, ["alone", "hub"])


def test_random_graphs_and_empty(spark):
    r = random.Random(4)
    links = [(f"n{r.randrange(400):03d}", f"n{r.randrange(400):03d}") for _ in range(330)]
    assert solved(spark, links) == groups(links)
    assert solved(spark, []) == {} and solved(spark, [], ["a"]) == {"a": "a"}


def test_largest_differencing_evens_bins():
    r = random.Random(1)
    weights = [int(r.paretovariate(1.2)) for _ in range(3000)]
    bins = P._balance_simple(weights, 10)
    sums = [sum(w for w, b in zip(weights, bins) if b == k) for k in range(10)]
    assert sum(sums) == sum(weights) and max(sums) <= max(max(weights), sum(weights) / 10 * 1.02 + 1)
    assert P._balance_simple([], 5) == [] and P._balance_simple([7], 5) in ([k] for k in range(5))


@pytest.mark.parametrize("shard", [40, 100_000])
def test_splits_keep_groups_and_proportions(spark, shard):
    r = random.Random(9)
    rows = [(f"e{i}", f"g{int(r.paretovariate(1.1)) if i % 3 else i}") for i in range(3000)] + [("none", None)]
    df = spark.createDataFrame(rows, "e string, g string").selectExpr("e", "g", "'x' AS bin", "2 AS weight", "3 AS shard")
    out = P.assign_splits(df, "g", {"train": 8, "validation": 1, "test": 1}, shard_groups=shard).collect()
    assert len(out) == len(rows)
    of, size = {}, {}
    for x in out:
        if x["g"] is None:
            assert x["split"] is None and x["bin"] is None
            continue
        assert of.setdefault(x["g"], x["split"]) == x["split"]
        size[x["split"]] = size.get(x["split"], 0) + 1
    assert abs(size["train"] / 3000 - 0.8) < 0.03 and abs(size["test"] / 3000 - 0.1) < 0.03
    again = P.assign_splits(df.repartition(5), "g", {"train": 8, "validation": 1, "test": 1}, shard_groups=shard).collect()
    assert {x["e"]: x["split"] for x in again} == {x["e"]: x["split"] for x in out}


def test_splits_of_nothing_and_of_one_huge_group(spark):
    df = spark.createDataFrame([("a", "g")] * 50 + [("b", "h"), ("c", "i")], "e string, g string")
    assert P.assign_splits(df.limit(0), "g", {"train": 1.0}).count() == 0
    out = P.assign_splits(df, "g", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()
    assert {x["split"] for x in out if x["g"] == "g"} == {"train"} and len({x["split"] for x in out}) > 1
    with pytest.raises(ValueError):
        P.assign_splits(df, "g", {})


def test_linked_records_share_a_split(spark):
    links = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z"), ("x", "q")], "r string, s string")
    out = {x["entity_id"]: (x["group_id"], x["split"]) for x in P.split_linked(links, "r", "s", {"train": 0.5, "test": 0.5}, spark.createDataFrame([("e",)], "r string")).collect()}
    assert set(out) == {"a", "b", "c", "d", "x", "e"}  # the record x is not the shared thing x
    assert out["a"] == out["b"] == out["c"] and out["x"][0] == "x" and out["e"][0] == "e"


def test_shuffles_and_tables_go_when_a_table_is_written(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: str(disk.getAllFiles().mkString(" ")).count("shuffle_")
    before, counted = shuffles(), spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    with scratch(spark) as keep:
        first = cut(counted)
        last = keep(cut(first.where("k > 2")))
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before
    assert last.count() == 4 and not Path(first._cut_path.removeprefix("file://")).exists()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
