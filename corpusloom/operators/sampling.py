"""Reproducible sampling, splits, order-dependent picks and packing. Every order has a total tie rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import uniform

TWO32 = 4294967296.0


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given total order, by a grouped minimum with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in rest]).select(*df.columns)


def fixed_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in hash order."""
    return df.orderBy(uniform(seed, F.col(key)), key).limit(n)


def per_group_sample(df: DataFrame, group: str, key: str, n: Column | int, seed: str) -> DataFrame:
    """At most n rows of each group, in hash order."""
    w = Window.partitionBy(group).orderBy(uniform(seed, F.col(key)), key)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def weighted_sample(df: DataFrame, key: str, weight: Column, n: int, seed: str) -> DataFrame:
    """n rows without replacement, each draw in proportion to the weights left: the n least of -ln(u)/w."""
    u = (uniform(seed, F.col(key)) + 0.5) / TWO32
    return df.where(weight > 0).withColumn("draw_key", -F.log(u) / weight).orderBy("draw_key", key).limit(n)


def quota_groups(groups: DataFrame, stratum: list[str], key: str, size: str, fraction: float, seed: str) -> DataFrame:
    """Whole groups of each stratum, in hash order, until their sizes reach the (half-even) rounded quota."""
    w = Window.partitionBy(*stratum).orderBy(uniform(seed, F.col(key)), key).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*stratum)
    return (
        groups.withColumn("__before", F.coalesce(F.sum(size).over(w), F.lit(0)))
        .withColumn("__quota", F.bround(F.sum(size).over(total) * F.lit(fraction), 0))
        .where(F.col("__before") < F.col("__quota"))
        .drop("__before", "__quota")
    )


def ranked_split(keys: DataFrame, key: str, fraction: float, seed: str) -> DataFrame:
    """``keys`` plus ``split``: the first max(1, floor(n * fraction)) keys in hash order are ``val``."""
    n = keys.agg(F.count(F.lit(1)).alias("__n"))
    cut = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(fraction)))
    # the held-out head is a top-k: no global sort of all keys
    quota = n.select(cut.alias("c")).first()["c"]
    val = keys.orderBy(uniform(seed, F.col(key)), key).limit(quota).select(key, F.lit("val").alias("split"))
    return keys.join(val, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def running_offsets(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """``sizes`` plus ``start``: the total of ``size`` before each row in key order, without one task for all rows.

    Rows are dealt by range; per-partition totals give each partition's base, a window inside adds the rest.
    """
    from corpusloom.session import persist_table

    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = persist_table(sizes.repartitionByRange(n, key).withColumn("__p", F.spark_partition_id()), "offsets")
    totals = dealt.groupBy("__p").agg(F.sum(size).alias("__s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    inside = Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("__e", F.sum(size).over(inside)).join(F.broadcast(base), "__p").withColumn("start", F.col("__b") + F.col("__e") - F.col(size)).drop("__p", "__b", "__e")


def pack(docs: DataFrame, key: str, tokens: str, block: int, eos) -> DataFrame:
    """``(block, tokens)``: documents with an end mark each, in key order, cut into full blocks; the tail is dropped.

    A block is put together from one slice of each document in it.
    """
    ended = docs.select(key, F.concat(F.col(tokens), F.array(eos)).alias("t"))
    placed = running_offsets(ended.select(key, F.size("t").alias("n").cast("long")), key, "n").select(key, "start")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.size("t") - 1) / block)
    slices = ended.join(placed, key).select("start", "t", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("start"), F.size("t").cast("long"))
    slices = slices.select("block", F.struct("start", F.slice("t", (begin + 1).cast("int"), (end - begin).cast("int")).alias("s")).alias("p"))
    blocks = slices.groupBy("block").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["s"])).alias("tokens"))
    return blocks.where(F.size("tokens") == block)
