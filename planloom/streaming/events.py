"""Flow series over a stream of events, the same values as in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.session import shared_dir


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n, total) by tumbling windows of a day; a watermark bounds the state."""
    t = events.withColumn("ts", F.col("ts").cast("timestamp"))
    by = t.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type") if events.isStreaming else t.groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    amount = F.sum(F.coalesce(F.col("value"), F.lit(0.0)).cast("decimal(18,4)"))
    return by.agg(F.count(F.lit(1)).alias("n"), amount.alias("total")).select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


def run_to_table(stream: DataFrame, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Run a streaming aggregation over what is there, in update mode, and give the last value of each key.

    Batches and the query's checkpoint lie in the shared folder, so a lost executor or driver resumes."""
    base = f"{shared_dir(spark)}/planloom/stream-{uuid.uuid4().hex[:12]}"

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(spark.read.parquet(f"{base}/out/*").drop("batch").schema).parquet(f"{base}/out/*")
    got = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/*")
    rest = [c for c in out.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col("batch"))
    return got.groupBy(*keys).agg(last.alias("l")).select(*keys, *[F.col(f"l.{c}").alias(c) for c in rest])
