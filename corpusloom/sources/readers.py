"""Readers: explicit schemas, optional inputs, tolerant JSON, raw files, and a paged source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """One JSON object a line; unreadable lines become nulls, or fail the read if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """``read_jsonl``, or an empty relation of that schema if the path is missing."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document that is an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_parquet_tree(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a folder, whatever the folders are called."""
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)


def read_text_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), skip_dirs: tuple[str, ...] = (), max_bytes: int = 2_000_000) -> DataFrame:
    """``(path, bytes, text)`` of each file: undecodable bytes go, blank and oversized files are skipped.

    Suffix, folder and size rules only see the listing, so skipped files are never opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where((F.col("length") > 0) & (F.col("length") <= max_bytes))
    if suffixes:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([s.lstrip(".").lower() for s in suffixes]))
    for d in skip_dirs:
        files = files.where(~F.col("path").contains(f"/{d}/"))
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "�", "")
    lossy = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�", "")
    out = files.select("path", F.col("length").alias("bytes"), F.coalesce(text, lossy).alias("text"))
    return out.where(F.trim("text", F.lit(" \t\r\n")) != "")


def read_listed(spark: SparkSession, list_path: str, files: DataFrame) -> DataFrame:
    """The files that a white-space separated list names by the end of their paths."""
    names = spark.read.text(list_path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("name")).where("name <> ''").distinct()
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    names = names.select("name", base("name").alias("__base"))
    ends = (F.col("path") == F.col("name")) | F.endswith("path", F.concat(F.lit("/"), "name"))
    return files.withColumn("__own", base("path")).join(names, (F.col("__own") == F.col("__base")) & ends, "left_semi").drop("__own")


def read_tolerant_json(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, item)`` JSON text of the items of a bare list or of the list under ``data``; strings stay as they are."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.data", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    rows = doc.select(F.posexplode(items).alias("ordinal", "i"))
    return rows.select("ordinal", F.when(F.schema_of_variant("i") == "STRING", F.try_variant_get("i", "$", "string")).otherwise(F.to_json("i")).alias("item"))


def scrape_log(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """``(line, name, value)``: the first group of every match of each pattern."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    found = [F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(1)), lambda v, n=name: F.struct(F.lit(n).alias("name"), v.alias("value"))) for name, p in patterns.items()]
    return lines.select("line", F.explode(F.concat(*found)).alias("m")).select("line", "m.name", "m.value")


class _Slice(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class PagedSource(DataSource):
    """A paged service as a Spark source: one partition a slice, pages read until a short one, waits after refusals.

    Options: ``slices`` ("0:10,10:100"), ``per_page``, ``attempts``, ``wait_s``. Subclasses give ``fetch``.
    """

    #: fetch(lo, hi, page, per_page) -> rows, or None if refused for now
    fetch: Callable[[int, int, int, int], list | None]

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "full_name string, license string, permissive boolean, size_kb long, stars long, fork boolean"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(type(self).fetch, self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, fetch, options):
        self.fetch, self.options = fetch, dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Slice(*map(int, s.split(":"))) for s in self.options["slices"].split(",")]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        import time

        per_page, attempts, wait = int(self.options.get("per_page", 100)), int(self.options.get("attempts", 6)), float(self.options.get("wait_s", 60))
        page = 1
        while True:
            for k in range(1, attempts + 1):
                rows = self.fetch(partition.lo, partition.hi, page, per_page)
                if rows is not None:
                    break
                time.sleep(wait * k)
            else:
                raise RuntimeError(f"slice {partition.lo}:{partition.hi}, page {page}: refused {attempts} times")
            yield from (tuple(r) for r in rows)
            if len(rows) < per_page:
                return
            page += 1
