"""Connected components of an edge table by hooking and contraction.

Each round, every vertex hooks to its smallest neighbour if that is smaller, hooks
are followed, and the edges are rewritten to what their ends hooked to; edges
inside a tree disappear.  Rounds end when no edge is left.  Everything stays in
tables; only the number of edges left comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

JUMPS = 2


def _follow(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, label) with each label replaced by its parent where it has one."""
    step = parents.select(F.col("id").alias("_id"), F.col("label").alias("_up"))
    return labels.join(step, F.col("label") == F.col("_id"), "left").select("id", F.coalesce("_up", "label").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every vertex of ``edges`` (a, b); label is the least id reachable."""
    edges = keep(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
        parents = keep(ends.groupBy("id").agg(F.least("id", F.min("other")).alias("label")), "hooks")
        for _ in range(JUMPS):
            parents = keep(_follow(parents, parents), "hooks")
        a = parents.select(F.col("id").alias("a"), F.col("label").alias("p"))
        b = parents.select(F.col("id").alias("b"), F.col("label").alias("q"))
        edges = keep(edges.join(a, "a").join(b, "b").filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        labels = parents if labels is None else keep(_follow(labels, parents), "labels")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels
