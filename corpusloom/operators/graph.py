"""Connected components by hooking labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import drop_table, persist_table


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that an edge names; component is its smallest node.

    In each round every label hooks onto the least label linked below it, hooks are followed one step further, and
    the edges are renamed; edges inside one label go. As hooks only go down, the smallest node of a component
    keeps its own label, and once no edge is left all labels are the smallest. Chains halve each round; stars take
    one. Every step is a grouped minimum with partial aggregation or a join that Spark may split, so a star of any
    size never meets in one task unaggregated. Only the hooks of each round are stored; nodes are renamed once, at
    the end. Edges with a null end and self-loops are ignored; repeated edges do no harm; no edges give an empty
    result.
    """
    a, b = F.col(src), F.col(dst)
    live = persist_table(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "cc-edges")
    first = live
    hooks = []
    while not live.isEmpty():
        hook = live.groupBy("hi").agg(F.min("lo").alias("to"))
        above = hook.select(F.col("hi").alias("to"), F.col("to").alias("top"))
        hook = persist_table(hook.join(above, "to", "left").select(F.col("hi").alias("label"), F.coalesce("top", "to").alias("to")), "cc-hooks")
        hooks.append(hook)
        ends = live
        for end in ("hi", "lo"):
            ends = _renamed(ends, hook, end)
        ends = ends.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()
        nxt = persist_table(ends, "cc-edges")
        if live is not first:
            drop_table(live)
        live = nxt
    nodes = first.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().withColumn("component", F.col("node"))
    for hook in hooks:
        nodes = _renamed(nodes, hook, "component")
    out = persist_table(nodes, "cc-labels")
    drop_table(*hooks, first, *([live] if live is not first else []))
    return out


def _renamed(df: DataFrame, hook: DataFrame, column: str) -> DataFrame:
    """``df`` with the labels in ``column`` replaced where they hook onto another."""
    out = df.join(hook.withColumnRenamed("label", column), column, "left")
    return out.select(*[F.coalesce("to", c).alias(c) if c == column else c for c in df.columns])
