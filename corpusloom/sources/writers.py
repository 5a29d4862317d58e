"""Writers: logs, content-addressed blobs, matrices, reports, rejects, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows added to a log folder; a failed job leaves what was there."""
    df.write.mode("append").json(path)


def overwrite_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_blobs(df: DataFrame, content: str, path: str) -> None:
    """One row per distinct content, under the first two digits of its SHA-256."""
    hashed = df.select(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.col(content).alias("content"))
    once = hashed.groupBy("sha256").agg(F.any_value("content").alias("content"))  # equal hash, equal content
    once.withColumn("prefix", F.substring("sha256", 1, 2)).repartition("prefix", F.substring("sha256", 3, 1)).write.mode("overwrite").partitionBy("prefix").parquet(path)


def write_paths(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_blocks(df: DataFrame, path: str) -> None:
    """Token blocks with their split as a partition column."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A one-row aggregate as one JSON document."""
    df.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def split_rejects(df: DataFrame, reason: str, kept_path: str, rejects_path: str, keep: str = "keep") -> None:
    """Kept rows and, apart, every rejected row with its reason."""
    df.where(F.col(reason) == keep).write.mode("overwrite").parquet(kept_path)
    df.where(F.coalesce(F.col(reason), F.lit("")) != keep).write.mode("append").json(rejects_path)


def rewrite_with_backup(df: DataFrame, path: str, backup: str) -> None:
    """Replace a Parquet folder; the old rows are backed up first. An existing backup is kept, never overwritten."""
    spark = df.sparkSession
    context = spark.sparkContext
    files = lambda p: (context._jvm.org.apache.hadoop.fs.Path(p), context._jsc.hadoopConfiguration())
    place, conf = files(backup)
    if not place.getFileSystem(conf).exists(place):
        spark.read.parquet(path).write.parquet(backup)
    staged = f"{path}.staged"
    df.write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").parquet(path)
    place, conf = files(staged)
    place.getFileSystem(conf).delete(place, True)
