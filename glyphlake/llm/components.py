"""Connected components of an edge table, by rounds of minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a, b) -> (id, root) for every id that has an edge; root is the smallest id reachable.

    Each round hooks the root of every edge's end to the smallest root next to
    it and then follows the roots' own hooks (pointer jumping), so the number of
    rounds grows with the logarithm of a component's length.  A round touches
    each edge once; edges whose ends already have one root are dropped.  Labels
    never come to the driver.
    """
    both = edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct()
    edges = scratch.table(both)
    labels = scratch.table(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("root")))
    while not edges.isEmpty():
        # Edges are always between current roots.
        hooks, made = edges.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("hook")), []
        while True:
            hooks = scratch.table(hooks)
            made.append(hooks)
            up = hooks.select(F.col("root").alias("hook"), F.col("hook").alias("next"))
            jumped = hooks.join(up, "hook", "left")
            if jumped.where("next is not null").isEmpty():
                break
            hooks = jumped.select("root", F.coalesce("next", "hook").alias("hook"))
        relabel = lambda df, key: df.join(hooks.withColumnRenamed("root", key), key, "left").withColumn(key, F.coalesce("hook", key)).drop("hook")
        labels, old = scratch.table(relabel(labels, "root").select("id", "root")), labels
        moved = relabel(relabel(edges, "a"), "b").where("a <> b")
        edges, used = scratch.table(moved.selectExpr("greatest(a, b) a", "least(a, b) b").distinct()), edges
        scratch.drop(old, used, *made)
    scratch.drop(edges)
    return labels
