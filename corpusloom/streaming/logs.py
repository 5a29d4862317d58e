"""Incremental versions of the append-log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a log folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key; state goes once the watermark has passed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def resume(stream: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key the sink doesn't hold yet."""
    return stream.join(done.select(key).distinct(), key, "left_anti")


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; late rows beyond the delay are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"))


def history(stream: DataFrame, key: str, passed: str) -> DataFrame:
    """Attempts and passes per problem, kept as state over all rounds."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col(passed)).alias("passes"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All new rows to a JSON log, once each, then stop."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
