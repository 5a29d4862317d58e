"""Set similarity and contamination joins, through inverted indexes instead of cross products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import ship_package

#: Bytes of a side's values below which a join may broadcast it; they are measured first.
SMALL_SIDE_BYTES = 16 << 20


def side_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take in memory, by their lengths."""
    held = F.lit(16 * (len(df.columns) + 1))
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            held = held + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            held = held + 8 * F.coalesce(F.size(f.name), F.lit(0))
    return int(df.agg(F.coalesce(F.sum(held.cast("long")), F.lit(0))).first()[0])


def sized(df: DataFrame, most: int = SMALL_SIDE_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows were measured to take at most ``most`` bytes, else left to a shuffle join."""
    return F.broadcast(df) if side_bytes(df) <= most else df


def windows(t: Column, size: int, stride: int) -> Column:
    """Windows of ``size`` characters at every ``stride``; none from a text of at most ``size``, none at its very end."""
    at = F.sequence(F.lit(0), F.greatest(F.length(t) - size - 1, F.lit(0)), F.lit(stride))
    return F.when(F.length(t) > size, F.transform(at, lambda i: F.substring(t, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def window_hashes(text: str, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window that ``windows`` gives, in one pass over the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n, out = len(c), []
    with np.errstate(over="ignore"):
        c = (c + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        c ^= c >> np.uint64(29)
        for base in _BASES:
            power = np.cumprod(np.append(np.uint64(1), np.full(size, base, np.uint64)))
            inverse = np.cumprod(np.append(np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)))
            total = np.append(np.uint64(0), np.cumsum(c * inverse[:n]))
            at = np.arange(0, max(n - size, 0), stride)
            forward = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
            h = (total[at + size] - total[at]) * forward[at] * power[size - 1]
            out.append(h ^ h >> np.uint64(31))
    return out[0], out[1]


def shingle_hits(docs: DataFrame, tests: DataFrame, key: str, text: Column, test_text: Column, size: int = 60, test_stride: int = 30, full: bool = True, most: int = SMALL_SIDE_BYTES) -> DataFrame:
    """Distinct keys of documents that share a window with a test text.

    ``full`` takes every document window, so a passage is found at any offset; otherwise both sides step alike and
    only passages in phase are found. Windows are hashed in one pass over each text. The test windows are broadcast and
    hits compared with them, if they take at most ``most`` bytes; else both sides meet by two hashes of their windows.
    """
    ship_package(docs.sparkSession)
    stride = 1 if full else test_stride
    found = tests.select(F.explode(windows(test_text, size, test_stride)).alias("w")).distinct()
    own = docs.select(F.col(key).alias("k"), text.alias("t")).where(F.length("t") > size)
    kind = docs.select(key).schema[0].dataType
    if side_bytes(found) <= most:
        known: dict[int, set[str]] = {}
        for w in found.toArrow()["w"].to_pylist():
            known.setdefault(int(window_hashes(w + ".", size, 1)[0][0]), set()).add(w)
        shared = docs.sparkSession.sparkContext.broadcast((np.array(sorted(known), np.uint64), known))

        def hits(batches):
            names, windows_of = shared.value
            for batch in batches:
                out = []
                for k, t in enumerate(batch.column(1).to_pylist()):
                    h = window_hashes(t, size, stride)[0]
                    at = np.flatnonzero(names[np.minimum(np.searchsorted(names, h), len(names) - 1)] == h) if len(names) else ()
                    if any(t[i * stride : i * stride + size] in windows_of[int(h[i])] for i in at):
                        out.append(k)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out, pa.int64()))], names=["k"])

        return own.mapInArrow(hits, T.StructType([T.StructField("k", kind)])).select(F.col("k").alias(key)).distinct()

    def hashed(step):
        def run(batches):
            for batch in batches:
                both = [window_hashes(t, size, step) for t in batch.column(1).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(both)), [len(h) for h, _ in both]))
                columns = [pa.array(np.concatenate([b[i] for b in both]).view(np.int64)) for i in (0, 1)] if both else [pa.array([], pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *columns], names=["k", "h1", "h2"])

        return run

    schema = lambda k: T.StructType([T.StructField("k", k), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
    wanted = found.select(F.lit(0).alias("k"), F.concat("w", F.lit(".")).alias("t")).mapInArrow(hashed(1), schema(T.IntegerType())).select("h1", "h2").distinct()
    return own.mapInArrow(hashed(stride), schema(kind)).distinct().join(wanted, ["h1", "h2"], "left_semi").select(F.col("k").alias(key)).distinct()


def overlaps(left: DataFrame, right: DataFrame, lkey: str, rkey: str, lwords: str, rwords: str) -> DataFrame:
    """``(lkey, rkey, common, nl, nr)`` of all pairs that share a word: an equi-join on words, then a count.

    Both sides pre-count their set sizes. A word in very many rows is a skewed key that Spark splits.
    """
    a = left.select(F.col(lkey), F.size(lwords).alias("nl"), F.explode(lwords).alias("w"))
    b = right.select(F.col(rkey), F.size(rwords).alias("nr"), F.explode(rwords).alias("w"))
    return a.join(sized(b), "w").groupBy(lkey, rkey, "nl", "nr").agg(F.count(F.lit(1)).alias("common"))


def jaccard(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("jaccard", F.col("common") / (F.col("nl") + F.col("nr") - F.col("common")))


def nearest(pairs: DataFrame, lkey: str, rkey: str, score: str, k: int = 3) -> DataFrame:
    """The k best partners of each left row; ties by partner."""
    w = Window.partitionBy(lkey).orderBy(F.desc(score), rkey)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def greedy_accept(candidates: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Candidates accepted one by one in key order, each if no accepted neighbour precedes it.

    ``edges(a, b)`` with a < b links near variants. That is the lexicographically first independent set: in each
    round every undecided row whose smaller neighbours are all rejected is accepted, and its neighbours go.
    """
    from corpusloom.session import persist_table

    state = persist_table(candidates.select(F.col(key).alias("k")), "greedy")
    links = persist_table(edges.select("a", "b").distinct(), "greedy-edges")
    accepted = state.limit(0)
    while not links.isEmpty():
        blocked = links.select(F.col("b").alias("k")).distinct()
        now = state.join(blocked, "k", "left_anti")
        accepted = persist_table(accepted.union(now), "greedy-accepted")
        gone = links.join(now.withColumnRenamed("k", "a"), "a").select(F.col("b").alias("k")).distinct()
        state = persist_table(state.join(now, "k", "left_anti").join(gone, "k", "left_anti"), "greedy")
        alive = state.select("k")
        links = persist_table(links.join(alive.withColumnRenamed("k", "a"), "a", "left_semi").join(alive.withColumnRenamed("k", "b"), "b", "left_semi"), "greedy-edges")
    return accepted.union(state).select(F.col("k").alias(key))
