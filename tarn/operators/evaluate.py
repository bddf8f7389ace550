"""Quality of candidates and matches against labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_entity(pred: DataFrame, true: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1_id, n_pred, n_true, tp) of every id of entities; pred and true are pair tables (s1_id, cand_id)."""
    marked = pred.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1)).join(true.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1)), ["s1_id", "cand_id"], "full")
    sums = marked.groupBy("s1_id").agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count(F.col("p") + F.col("t")).alias("tp"))
    return entities.select("s1_id").distinct().join(sums, "s1_id", "left").na.fill(0, ["n_pred", "n_true", "tp"])


def f05(n_pred: Column, n_true: Column, tp: Column) -> Column:
    """F0.5 of one entity; 1 when nothing is true and nothing predicted."""
    p, r = tp / F.greatest(n_pred, F.lit(1)), tp / F.greatest(n_true, F.lit(1))
    return F.when(n_true == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when(tp == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_f05(pred: DataFrame, true: DataFrame, entities: DataFrame) -> DataFrame:
    e = per_entity(pred, true, entities)
    return e.withColumn("f05", f05(F.col("n_pred"), F.col("n_true"), F.col("tp")))


def macro_f05(pred: DataFrame, true: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: f05, n_entities, n_singletons; 0.0 for no entities."""
    return entity_f05(pred, true, entities).agg(F.coalesce(F.avg("f05"), F.lit(0.0)).alias("f05"), F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("n_true") == 0).alias("n_singletons"))


def recall(pred: DataFrame, true: DataFrame) -> DataFrame:
    """One row: entity and pair recall over the entities with a true pair."""
    hit = true.join(pred.select("s1_id", "cand_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "cand_id"], "left")
    per = hit.groupBy("s1_id").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("pairs"))
    return per.agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("found") > 0).alias("entities_hit"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("found"), F.lit(0)).alias("pairs_found"),
    ).withColumns({"entity_recall": F.coalesce(F.try_divide(F.col("entities_hit"), F.col("n_entities")), F.lit(0.0)), "pair_recall": F.coalesce(F.try_divide(F.col("pairs_found"), F.col("n_pairs")), F.lit(0.0))})


def key_recall(true: DataFrame, s1_keys: DataFrame, target_keys: DataFrame) -> DataFrame:
    """(tag, pairs_found, n_pairs, recall): true pairs whose records share a key of the tag, and tag "union" for any key."""
    a = s1_keys.select(F.col("entity_id").alias("s1_id"), "country_l", "tag", "value")
    b = target_keys.select(F.col("entity_id").alias("cand_id"), "country_l", "tag", "value")
    shared = true.join(a, "s1_id").join(b, ["cand_id", "country_l", "tag", "value"]).select("s1_id", "cand_id", "tag").distinct()
    both = shared.union(shared.select("s1_id", "cand_id", F.lit("union")).distinct())
    n = true.agg(F.count(F.lit(1)).alias("n_pairs"))
    return both.groupBy("tag").agg(F.count(F.lit(1)).alias("pairs_found")).join(F.broadcast(n), how="cross").withColumn("recall", F.col("pairs_found") / F.col("n_pairs"))


def recall_at_settings(kept: DataFrame, true: DataFrame, entities: DataFrame, settings: int) -> DataFrame:
    """(setting, pairs_found, n_pairs, recall, entities_hit, n_entities, entity_recall, mean_candidates) for each place of the
    array in kept(s1_id, cand_id, kept array<boolean>). Recall is over the true pairs and the entities that have one; the mean
    over all of `entities`. One pass over kept and one join with the true pairs, whatever the number of settings."""
    spark = kept.sparkSession
    each = spark.range(settings).select(F.col("id").cast("int").alias("setting"))
    at = lambda i: F.try_element_at("kept", F.lit(i + 1))
    sizes = kept.agg(F.array(*[F.count_if(at(i)) for i in range(settings)]).alias("sizes"))
    n = entities.select("s1_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    hit = true.select("s1_id", "cand_id").distinct().join(kept, ["s1_id", "cand_id"], "left")
    per = hit.groupBy("s1_id").agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.coalesce(at(i), F.lit(False))).alias(f"f{i}") for i in range(settings)])
    total = per.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"), F.count(F.lit(1)).alias("n_entities"), F.array(*[F.coalesce(F.sum(f"f{i}"), F.lit(0)) for i in range(settings)]).alias("found"),
        F.array(*[F.count_if(F.col(f"f{i}") > 0) for i in range(settings)]).alias("hit"),
    )
    rows = each.join(F.broadcast(total), how="cross").join(F.broadcast(sizes), how="cross").join(F.broadcast(n), how="cross")
    pick = lambda c: F.element_at(c, F.col("setting") + 1)
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select(
        "setting", pick("found").alias("pairs_found"), "n_pairs", rate(pick("found"), F.col("n_pairs")).alias("recall"), pick("hit").alias("entities_hit"), "n_entities",
        rate(pick("hit"), F.col("n_entities")).alias("entity_recall"), rate(pick("sizes"), F.col("n")).alias("mean_candidates"),
    )


def candidate_stats(ranked: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: least, median (cut to a whole number), most and mean number of candidates per entity."""
    per = entities.select("s1_id").distinct().join(ranked.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")), "s1_id", "left").na.fill(0, ["n"])
    return per.agg(F.min("n").alias("least"), F.percentile("n", 0.5).cast("long").alias("median"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.count(F.lit(1)).alias("n_entities"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f05) of pairs (prob, label) at each threshold, in one pass.

    Every pair is counted once into the interval of thresholds that its probability reaches; running sums give the counts.
    """
    spark = scored.sparkSession
    grid = sorted(thresholds)
    reach = F.lit(0)
    for t in grid:
        reach = reach + (F.col("prob") >= F.lit(float(t))).cast("int")
    cells = scored.groupBy(reach.alias("reach")).agg(F.sum("label").cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    steps = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "i int, threshold double")
    sums = steps.join(F.broadcast(cells), how="cross").groupBy("i", "threshold").agg(
        F.sum(F.when(F.col("reach") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("reach") >= F.col("i"), F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("reach") < F.col("i"), F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(F.col("reach") < F.col("i"), F.col("n") - F.col("pos")).otherwise(0)).alias("tn"),
    )
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    out = sums.drop("i").withColumns({"precision": p, "recall": r})
    score = F.coalesce(F.try_divide(1.25 * F.col("precision") * F.col("recall"), 0.25 * F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f05", score)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the highest f05, the least threshold of equals."""
    return sweep.orderBy(F.desc("f05"), "threshold").limit(1)


def missed(pred: DataFrame, true: DataFrame, limit: int = 20) -> DataFrame:
    """Example report: the first true pairs, by id, that pred lacks."""
    return true.join(pred.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").orderBy("s1_id", "cand_id").limit(limit)


def positive_rate(pairs: DataFrame) -> DataFrame:
    """One row: n_pairs, n_positive and the share of pairs with label 1; 0.0 for none."""
    out = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("n_positive"))
    return out.withColumn("positive_rate", F.coalesce(F.try_divide("n_positive", "n_pairs"), F.lit(0.0)))
