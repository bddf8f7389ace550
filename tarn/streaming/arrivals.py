"""Records that arrive as a stream: candidates per micro-batch, and late arrivals by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.operators import blocking as B
from tarn.operators.entities import enrich, with_keys
from tarn.storage import cut


def serve_candidates(arriving: DataFrame, targets: DataFrame, path: str, checkpoint: str, cap: int = 20) -> StreamingQuery:
    """Ranked candidates of streamed source 1 rows (entity_id, business_name, business_address, country), appended to Parquet.

    The targets' capped block table is written once to the shared folder: each micro-batch is joined to it as in batch, so a record gets the candidates it
    would get there. A batch that is repeated after a failure overwrites its own folder.
    """
    index = cut(B.capped(B.key_table(targets)))

    def run(batch: DataFrame, number: int) -> None:
        s1 = with_keys(enrich(batch.dropDuplicates(["entity_id"]))).withColumn("src", F.substring("entity_id", 1, 2))
        hits = B.block_hits(B.key_table(s1), index)
        B.rank_hits(hits, cap).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_per_window(arriving: DataFrame, when: str, delay: str = "2 days", window: str = "1 day") -> DataFrame:
    """(start, batch_no, n) of arrivals in tumbling windows of their recorded time; a repeated arrival (same id, batch and time)
    counts once, rows later than `delay` behind the newest are dropped, rows without a time are left out."""
    timed = arriving.where(F.col(when).isNotNull()).withWatermark(when, delay).dropDuplicates(["entity_id", "batch_no", when])
    return timed.groupBy(F.window(when, window).alias("w"), "batch_no").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "batch_no", "n")
