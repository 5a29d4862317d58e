"""Contiguous shards of near equal bytes, from a global prefix sum. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import persist_table


def shard_by_bytes(df: DataFrame, size: Column, order: list[str], n_shards: int = 24, prefix: str = "") -> DataFrame:
    """All of ``df``'s columns plus ``size``, ``shard`` and ``slot`` (names take ``prefix``).

    Rows are put in order by ``order`` and cut where the running total of bytes passes an equal share, so
    shards are contiguous in that order and their sizes differ from the target by less than one row.

    1. One range shuffle sorts the rows; each range partition is stored with its number.
    2. Per-partition totals (one row a partition) give each partition's offset: the only global window
       sees as many rows as there are partitions.
    3. A window inside each partition adds the running total; the cut is arithmetic.

    Ties in ``order`` (repeated rows, null keys) are spread over partitions by a row number of the scan, so one
    key with a third of all rows is dealt out like any other. A null size counts as 0; an empty table gives an
    empty result. A clash between the three new names and ``df``'s columns is an error: choose a ``prefix``.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    names = {k: prefix + k for k in ("size", "shard", "slot")}
    if clash := set(names.values()) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are taken; pass a prefix")
    own = "__loom_"
    keys = [*order, f"{own}tie"]
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.withColumn(names["size"], F.coalesce(size.cast("long"), F.lit(0)))
        .withColumn(f"{own}tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *keys)
        .withColumn(f"{own}part", F.spark_partition_id())
    )
    ranged = persist_table(ranged, "shard-ranges")
    totals = ranged.groupBy(f"{own}part").agg(F.sum(names["size"]).alias(f"{own}b"), F.count(F.lit(1)).alias(f"{own}n"))
    before = Window.orderBy(f"{own}part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # one row a partition: safe to order in one task and to broadcast
    starts = totals.select(
        F.col(f"{own}part"),
        F.coalesce(F.sum(f"{own}b").over(before), F.lit(0)).alias(f"{own}b0"),
        F.coalesce(F.sum(f"{own}n").over(before), F.lit(0)).alias(f"{own}n0"),
        F.sum(f"{own}b").over(everything).alias(f"{own}all"),
    )
    inside = Window.partitionBy(f"{own}part").orderBy(*keys)
    placed = (
        ranged.withColumn(f"{own}end", F.sum(names["size"]).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(f"{own}row", F.row_number().over(inside).cast("long"))
        .join(F.broadcast(starts), f"{own}part")
        .withColumn(f"{own}from", F.col(f"{own}b0") + F.col(f"{own}end") - F.col(names["size"]))
        .withColumn(f"{own}index", F.col(f"{own}n0") + F.col(f"{own}row") - 1)
        .withColumn(
            names["shard"],
            F.when(F.col(f"{own}all") > 0, F.expr(f"least({n_shards - 1}, cast({own}from as decimal(38,0)) * {n_shards} div {own}all)"))
            .otherwise(F.lit(0))
            .cast("int"),
        )
    )
    # where each shard begins, from one row a (partition, shard)
    heads = placed.groupBy(names["shard"]).agg(F.min(f"{own}index").alias(f"{own}head"))
    return (
        placed.join(F.broadcast(heads), names["shard"])
        .withColumn(names["slot"], F.col(f"{own}index") - F.col(f"{own}head"))
        .select(*df.columns, *names.values())
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of near equal bytes, ordered by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("row_bytes"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = shard_by_bytes(docs, F.col("row_bytes"), ["doc_id", "text_crc32", "row_bytes"], 24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SQL = """
WITH s AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 8 AS BIGINT) AS size, encode(coalesce(text, '')) AS b FROM documents
), bits AS (
  SELECT CAST(i AS BIGINT) AS i, CAST(list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(x AS BIGINT) FOR x IN range(8)]),
    lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS BIGINT) AS v FROM range(256) t(i)
), tab AS (SELECT list(v ORDER BY i) AS t FROM bits
), crc AS (
  SELECT doc_id, size, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), [CAST(('0x' || substr(h, 2 * k + 1, 2)) AS BIGINT) FOR k IN range(length(h) // 2)]),
    lambda c, x: xor(tab.t[CAST(xor(c & 255, x) AS BIGINT) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM (SELECT doc_id, size, hex(b) AS h FROM s), tab
), run AS (
  SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total, row_number() OVER w AS rn
  FROM crc WINDOW w AS (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)
), cut AS (
  SELECT *, CAST(least(23, (before * 24) // total) AS INTEGER) AS shard FROM run
)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY rn) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""
