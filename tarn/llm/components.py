"""Groups of records that are linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.storage import cut, cut_counted, drop

MAX_ROUNDS = 200


def contract(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs -> (id, group_id): every id with an edge to another one; group_id is the least id of its group.

    Random contraction: in a round each vertex hooks to the one at most two steps away that comes first in a hash order drawn
    afresh, edges are relabelled and de-duplicated, and the next round works on what is left. A round shrinks the vertices
    with an edge by a constant factor in expectation, whatever the shape (a chain or a star too), so rounds grow with the
    logarithm of the graph. The mappings are expanded from the last to the first.

    A round's order is the 64-bit hash of a long under the round's seed, which is one-to-one; the hash itself becomes the
    vertex's label of the next round, so a vertex's choice is a min of longs in a hash table with map-side combining, and a
    hub with a third of all edges is one row per map task. What is left without an edge keeps (round, label) as its root.
    """
    spark = edges.sparkSession
    edges, n_edges = cut_counted(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    for n in range(MAX_ROUNDS):
        if not n_edges:
            break
        both = edges.union(edges.select("v", "u"))
        first = both.groupBy("u").agg(F.min(F.xxhash64(F.lit(n), "v")).alias("m")).select(F.col("u").alias("v"), F.least(F.xxhash64(F.lit(n), "u"), "m").alias("m"))
        hooks = cut(both.join(first, "v").groupBy("u").agg(F.min("m").alias("to")).withColumnRenamed("u", "x"))
        maps.append(hooks)
        moved = edges.join(hooks.toDF("u", "p"), "u").join(hooks.toDF("v", "q"), "v").where("p <> q")
        spent = edges
        edges, n_edges = cut_counted(moved.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
        drop(spent)
    else:
        raise RuntimeError(f"links did not contract in {MAX_ROUNDS} rounds")
    drop(edges)
    if not maps:
        return spark.createDataFrame([], "id bigint, group_id bigint")
    whole = maps[-1].withColumn("round", F.lit(len(maps)))
    for k in range(len(maps) - 2, -1, -1):
        step = maps[k].join(whole.select(F.col("x").alias("to"), F.col("to").alias("further"), "round"), "to", "left")
        whole = step.select("x", F.coalesce("further", "to").alias("to"), F.coalesce("round", F.lit(k + 1)).alias("round"))
        if k % 8 == 7:
            whole = cut(whole)
    whole = cut(whole)
    for m in maps:
        drop(m)
    least = whole.groupBy("round", "to").agg(F.min("x").alias("group_id"))
    return whole.join(least, ["round", "to"]).select(F.col("x").alias("id"), "group_id")


def numbered(ids: DataFrame, column: str) -> DataFrame:
    """(column, id): the distinct non-null values with longs in their order, written once (a range shuffle; no global counter)."""
    named = ids.select(F.col(f"`{column}`").alias(column)).where(F.col(column).isNotNull()).distinct()
    return cut(named.orderBy(column).withColumn("id", F.monotonically_increasing_id()))


def connected_components(links: DataFrame, a: str, b: str, vertices: DataFrame | None = None, vertex: str | None = None) -> DataFrame:
    """(entity_id, group_id): every id of links[a], links[b] and vertices[vertex]; group_id is the smallest id of its group.

    Ids get longs in their own order once; contract() works on these alone, and ids come back by a join at the end.

    Null ids make no vertex and no edge; self links and repeated links change nothing; a row with one null id still makes
    the other a vertex. Empty input gives no rows. Ties cannot occur. Other columns are ignored.
    """
    ends = cut(links.select(F.col(f"`{a}`").alias("u"), F.col(f"`{b}`").alias("v")).distinct())
    named = ends.select(F.explode(F.array("u", "v")).alias("entity_id"))
    if vertices is not None:
        named = named.union(vertices.select(F.col(f"`{vertex}`")))
    ids = numbered(named, "entity_id")
    edges = ends.where("u <> v").join(ids.toDF("u", "i"), "u").join(ids.toDF("v", "j"), "v").select(F.col("i").alias("u"), F.col("j").alias("v"))
    placed = cut(ids.join(contract(edges), "id", "left").select("entity_id", F.coalesce("group_id", "id").alias("group")))
    return placed.join(ids.select(F.col("id").alias("group"), F.col("entity_id").alias("group_id")), "group").select("entity_id", "group_id")


#: Members of a group from which its pairs are made in several tasks.
MEMBERS = 1000


def pairs_within(members: DataFrame, key: str, group: str) -> DataFrame:
    """(a, b), a < b: the distinct pairs of keys that share a group.

    A group of more than MEMBERS keys is cut by hash: each part of it, about MEMBERS keys, meets all of the group in a task
    of its own. Null keys and groups have no pairs.
    """
    ids = cut(members.select(F.col(f"`{key}`").alias("id"), F.col(f"`{group}`").alias("g")).where("id IS NOT NULL AND g IS NOT NULL").distinct())
    hot = ids.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEMBERS).select("g", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts"))
    held = ids.join(hot, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    one = held.select(F.col("id").alias("a"), "g", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    other = held.select(F.col("id").alias("b"), "g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = one.join(other, ["g", "part"]).where("a < b").select("a", "b")
    return pairs.distinct()
