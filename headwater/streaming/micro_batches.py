"""Structured Streaming forms of the state operators; each runs what is available and stops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.operators import state
from headwater.sources.tables import children, work_dir
from headwater.sources.versioned import BucketTable

NEWS = "id long, title string, image string, url string, first_seen timestamp, heat double"


def upsert_stream(spark: SparkSession, source: DataFrame, path: str | None = None, buckets: int = 64, keep: int = 3) -> BucketTable:
    """Merges each micro-batch into a versioned table of news and returns the table.

    A batch rewrites the buckets of its own keys alone; one that is delivered again changes nothing; ``keep`` versions
    stay. A start with nothing new returns the table as it is.
    """
    path = path or f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    news = BucketTable(spark, f"{path}/news", "id", NEWS, buckets, "first_seen")

    def merge(batch: DataFrame, number: int) -> None:
        if news.merge(batch, state.merge_news, "stream", number)["changed"]:
            news.collect(keep)

    query = source.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return news


def rate_limit_stream(source: DataFrame, limit: int, path: str | None = None, minutes: int = 60) -> DataFrame:
    """(user_id, start, n) of the tumbling windows over the limit.

    Each micro-batch writes the windows that changed to files; windows leave the state ten days behind the latest event.
    """
    spark = source.sparkSession
    path = path or f"{work_dir(spark)}/rates-{uuid.uuid4().hex}"
    counts = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 days").groupBy(F.window("ts", f"{minutes} minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    changed = counts.select("user_id", F.col("window.start").alias("start"), "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/number={number}")

    query = changed.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not children(spark, f"{path}/batches"):
        return spark.createDataFrame([], changed.schema)
    seen = spark.read.schema(changed.schema).parquet(f"{path}/batches/*")
    return seen.groupBy("user_id", "start").agg(F.max("n").alias("n")).where(F.col("n") > limit).select("user_id", "start", "n")
