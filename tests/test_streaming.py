"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from tarn.operators import blocking as B
from tarn.operators import entities as E
from tarn.streaming.arrivals import arrivals_per_window, serve_candidates


def test_streamed_candidates_equal_batch(spark, sf, tmp_path):
    targets = E.with_keys(E.targets(spark, sf))
    rows = E.one_per_id(spark.read.parquet(f"{sf}/train_source1.parquet"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    serve_candidates(stream, targets, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("s1_id", "cand_id", "rank").collect()}
    want = {tuple(r) for r in B.candidates(E.with_keys(E.source(spark, sf, 1)), targets, 20).collect()}
    assert got == want and want


def test_windows_count_repeats_once(spark, sf, tmp_path):
    loads = spark.read.parquet(f"{sf}/train_source1_loads.parquet")
    stream = spark.readStream.schema(loads.schema).parquet(f"{sf}/train_source1_loads.parquet".replace("train_source1_loads.parquet", "train_source1_loads.parque[t]"))
    query = arrivals_per_window(stream, "recorded_at", "3650 days").writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {tuple(r) for r in spark.table("arrivals").collect()}
    once = loads.where("recorded_at IS NOT NULL").dropDuplicates(["entity_id", "batch_no", "recorded_at"])
    want = {tuple(r) for r in once.groupBy(F.window("recorded_at", "1 day").alias("w"), "batch_no").count().select("w.start", "batch_no", "count").collect()}
    assert got == want and want
