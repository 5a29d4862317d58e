"""pass@k, bootstrap intervals, paired comparisons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import uniform
from corpusloom.operators.draws import uniforms
from corpusloom.operators.similarity import sized
from corpusloom.session import ship_package

#: Bytes of a bootstrap's values up to which they are held as one array.
HELD_BYTES = 48 << 20
#: Draws of one resample that are summed in one go, and cells that a task takes.
PLACES, TASK_CELLS = 1 << 22, 1 << 26


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate from n samples with c right: 1 minus the chance that k drawn are all wrong."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - miss)


def bootstrap(values: DataFrame, value: str, resamples: int, seed: str, most: int = HELD_BYTES) -> DataFrame:
    """One row: n, mean, lo, hi. ``values`` has a dense ``idx`` from 0; the (resample, draw) cells are spread over the
    cluster and aggregated. Values that take at most ``most`` bytes are broadcast as one array and their cells drawn
    and summed as arrays, beyond that every cell is a row of a join.

    Draws are hashes of (seed, resample, place): the same on every run and engine.
    """
    n = values.count()
    means = (_held_means if 8 * n <= most else _joined_means)(values, value, n, resamples, seed)
    lo, hi = int(resamples * 0.025), int(resamples * 0.975)
    ci = means.agg(F.sort_array(F.collect_list("m")).alias("s")).select(F.get("s", F.lit(lo)).alias("lo"), F.get("s", F.lit(min(hi, resamples - 1))).alias("hi"))
    point = values.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return point.crossJoin(F.broadcast(ci))  # one row by one row


def _joined_means(values: DataFrame, value: str, n: int, resamples: int, seed: str) -> DataFrame:
    cells = values.sparkSession.range(resamples).withColumnRenamed("id", "b").select("b", F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("j"))
    drawn = cells.select("b", (uniform(seed, F.concat_ws(":", "b", "j")) % F.lit(max(n, 1))).alias("idx"))
    return drawn.join(sized(values.select("idx", value)), "idx").groupBy("b").agg(F.avg(value).alias("m"))


def _held_means(values: DataFrame, value: str, n: int, resamples: int, seed: str) -> DataFrame:
    spark = values.sparkSession
    rows = values.select("idx", F.col(value).cast("double").alias("x")).toArrow()
    held, there = np.zeros(n), np.zeros(n, bool)
    idx = rows["idx"].to_numpy()
    held[idx], there[idx] = rows["x"].fill_null(0.0).to_numpy(), rows["x"].is_valid().to_numpy()
    shared = spark.sparkContext.broadcast((held, None if there.all() else there))
    parts = max(1, -(-n // PLACES))

    def sums(batches):
        held, there = shared.value
        for batch in batches:
            ids = np.asarray(batch.column(0))
            total, count = dict.fromkeys(ids.tolist(), 0.0), dict.fromkeys(ids.tolist(), 0)
            for part in np.unique(ids // resamples).tolist():
                mine = (ids[ids // resamples == part] % resamples).tolist()
                for some, u in uniforms(seed, mine, part * PLACES, min(n, (part + 1) * PLACES)):
                    # a remainder by way of the quotient, which numpy divides many at once
                    at = (u - u // np.uint32(n) * np.uint32(n)).astype(np.intp)
                    got = held.take(at).sum(axis=1).tolist()
                    found = [at.shape[1]] * len(some) if there is None else there.take(at).sum(axis=1).tolist()
                    for b, x, k in zip(some, got, found, strict=True):
                        total[part * resamples + b] += x
                        count[part * resamples + b] += k
            yield pa.RecordBatch.from_pydict({"b": ids % resamples, "x": list(total.values()), "k": pa.array(count.values(), pa.int64())})

    ship_package(spark)
    # enough tasks that none is long, few enough that a task's arrays hold several resamples of few values
    tasks = min(parts * resamples, max(4 * spark.sparkContext.defaultParallelism, resamples * n // TASK_CELLS))
    sums_of = spark.range(0, parts * resamples, 1, max(1, tasks)).mapInArrow(sums, "b long, x double, k long")
    return sums_of.groupBy("b").agg((F.sum("x") / F.nullif(F.sum("k"), F.lit(0))).alias("m"))
