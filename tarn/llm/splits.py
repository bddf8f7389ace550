"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.components import connected_components
from tarn.storage import cut

BINS = 100
SHARD_GROUPS = 50_000


def largest_differencing(weights: list[list[float]], bins: int) -> list[list[tuple[int, int]]]:
    """Where each local bin goes. weights[i] is a partial solution: the weights of its (at most `bins`) own bins.

    Karmarkar-Karp for many bins: a heap holds partial solutions by their spread (heaviest less lightest bin); the two with
    the largest spread are combined, the heaviest bin of one with the lightest of the other, until one is left. Returns
    `bins` lists of (i, local bin).
    """
    heap = []
    for i, own in enumerate(weights):
        cells = sorted(((w, ((i, k),)) for k, w in enumerate(own)), key=lambda c: -c[0])
        cells += [(0, ())] * (bins - len(cells))
        heap.append((cells[-1][0] - cells[0][0], i, cells))
    heapq.heapify(heap)
    n = len(weights)
    while len(heap) > 1:
        _, _, x = heapq.heappop(heap)
        _, _, y = heapq.heappop(heap)
        merged = sorted(((a[0] + b[0], (a[1], b[1]) if a[1] and b[1] else a[1] or b[1]) for a, b in zip(x, reversed(y))), key=lambda c: -c[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], n, merged))
        n += 1
    return [_leaves(tree) for _, tree in heap[0][2]] if heap else [[] for _ in range(bins)]


def _leaves(tree) -> list[tuple[int, int]]:
    """The (i, local bin) of a tree of pairs; a leaf is a one-element tuple."""
    out, stack = [], [tree]
    while stack:
        t = stack.pop()
        if len(t) == 1:
            out.append(t[0])
        else:
            stack.extend(t)
    return out


def _balance_simple(weights: list[int], bins: int) -> list[int]:
    """The bin of each weight, each being a partial solution of its own."""
    out = [0] * len(weights)
    for b, members in enumerate(largest_differencing([[w] for w in weights], bins)):
        for i, _ in members:
            out[i] = b
    return out


def _combine(groups: DataFrame, bins: int) -> DataFrame:
    """groups(group_id, weight, shard) -> (group_id, shard, bin)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "group_id"], ascending=[False, True], ignore_index=True)
        return pd.DataFrame({"group_id": pdf["group_id"], "weight": pdf["weight"], "shard": pdf["shard"], "bin": _balance_simple(pdf["weight"].tolist(), bins)})

    kind = groups.schema["group_id"].dataType.simpleString()
    return groups.groupBy("shard").applyInPandas(run, f"group_id {kind}, weight long, shard int, bin int")


def assign_splits(members: DataFrame, group: str, proportions: dict[str, float], bins: int = BINS, shard_groups: int = SHARD_GROUPS) -> DataFrame:
    """members + (bin, split): all rows of one group in one split, rows in the given proportions as near as whole bins allow.

    Largest-differencing balance: groups are dealt by hash to shards of about `shard_groups` groups; each shard combines its
    groups into `bins` bins; then whole shards, each by now a partial solution of `bins` weights, are combined in the same
    way, on the driver while bins x shards is under a million numbers (that is 500 million groups with the defaults), beyond
    by one more level of shards. Only bin weights reach the driver. Last, whole bins go, heaviest first, to the split that
    lacks most. A group larger than a bin makes its bin heavy and counts with its whole weight, so the others even it out.

    Rows with a null group get null bin and split. Empty input gives no rows. Equal weights are told apart by group id, so
    the result does not depend on the order of rows. Columns of members named bin or split are replaced.
    """
    total = sum(proportions.values())
    if not proportions or total <= 0 or min(proportions.values()) < 0:
        raise ValueError("proportions must be positive")
    members = members.drop("bin", "split")
    weights = members.where(F.col(f"`{group}`").isNotNull()).groupBy(F.col(f"`{group}`").alias("group_id")).agg(F.count(F.lit(1)).alias("weight"))
    weights = cut(weights)
    n = weights.count()
    shards = max(1, -(-n // shard_groups))
    local = cut(_combine(weights.withColumn("shard", F.pmod(F.xxhash64("group_id"), F.lit(shards)).cast("int")), bins))
    sums = local.groupBy("shard", "bin").agg(F.sum("weight").alias("weight"))
    spark = members.sparkSession
    if shards * bins > 1_000_000:
        wide = cut(sums.select(F.struct("shard", "bin").alias("group_id"), "weight", F.pmod(F.xxhash64("shard"), F.lit(max(1, shards // 1000))).cast("int").alias("shard")))
        second = cut(_combine(wide, bins).select(F.col("group_id.shard").alias("shard"), F.col("group_id.bin").alias("bin"), F.col("shard").alias("shard2"), F.col("bin").alias("bin2"), "weight"))
        local = local.join(second.select("shard", "bin", "shard2", "bin2"), ["shard", "bin"]).select("group_id", "weight", F.col("shard2").alias("shard"), F.col("bin2").alias("bin"))
        sums = local.groupBy("shard", "bin").agg(F.sum("weight").alias("weight"))
    partial: dict[int, dict[int, int]] = {}
    for r in sums.collect():  # at most a million bin weights
        partial.setdefault(r["shard"], {})[r["bin"]] = r["weight"]
    keys = sorted(partial)
    cells = [sorted(partial[s]) for s in keys]
    placed = largest_differencing([[partial[s][b] for b in bs] for s, bs in zip(keys, cells)], bins)
    heavy = sorted(((sum(partial[keys[i]][cells[i][k]] for i, k in m), b) for b, m in enumerate(placed)), key=lambda x: (-x[0], x[1]))
    rows_all = sum(w for w, _ in heavy)
    lack = {s: rows_all * p / total for s, p in proportions.items()}
    of: dict[int, str] = {}
    for w, b in heavy:
        s = max(lack, key=lambda x: (lack[x], x))
        of[b] = s
        lack[s] -= w
    where = [(keys[i], cells[i][k], b, of[b]) for b, m in enumerate(placed) for i, k in m]
    plan = spark.createDataFrame(where, "shard int, local int, bin int, split string")
    dealt = local.withColumnRenamed("bin", "local").join(F.broadcast(plan), ["shard", "local"]).select(F.col("group_id").alias("__group"), "bin", "split")
    return members.join(dealt, F.col(f"`{group}`") == F.col("__group"), "left").drop("__group")


def split_linked(links: DataFrame, record: str, shared: str, proportions: dict[str, float], records: DataFrame | None = None) -> DataFrame:
    """(entity_id, group_id, bin, split) for each id of links[record] (and records[record]).

    links: a record and one thing it shares (an author, a source, an entity). Records that share one, directly or through
    others, get one split. The shared ids are marked so that they never equal a record id.
    """
    own = links.select(F.concat(F.lit("r:"), F.col(f"`{record}`").cast("string")).alias("a"), F.concat(F.lit("s:"), F.col(f"`{shared}`").cast("string")).alias("b"))
    extra = None if records is None else records.select(F.concat(F.lit("r:"), F.col(f"`{record}`").cast("string")).alias("a"))
    groups = connected_components(own, "a", "b", extra, "a")
    named = groups.where(F.col("entity_id").startswith("r:")).select(F.substring("entity_id", 3, 1 << 30).alias("entity_id"), F.substring("group_id", 3, 1 << 30).alias("group_id"))
    return assign_splits(cut(named), "group_id", proportions)
