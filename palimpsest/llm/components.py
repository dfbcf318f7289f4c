"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is some node of its component, the same for all of them.

    In each round every node points to the least of its closed neighbourhood, and edges are mapped along; what is left
    has far fewer nodes. Minima are summed before shuffles and edges join pointers one to one, so a hub costs no
    more than its edges. Each round is written to the shared folder, and the one before is deleted; the driver sees counts only.
    """
    edges = common.materialize(edges.select("a", "b").filter("a <> b").distinct())
    pointers = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
        known = pointers
        pointers = least if known is None else common.materialize(_follow(known, least))
        mapped = edges.join(least.select(F.col("node").alias("a"), F.col("label").alias("a1")), "a").select("a1", "b")
        mapped = mapped.join(least.select(F.col("node").alias("b"), F.col("label").alias("b1")), "b")
        left = common.materialize(mapped.select(F.least("a1", "b1").alias("a"), F.greatest("a1", "b1").alias("b")).filter("a <> b").distinct())
        common.release(edges, known, least if known is not None else None)
        edges = left
    if pointers is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return pointers


def _follow(pointers: DataFrame, step: DataFrame) -> DataFrame:
    """Pointers, one step further where there is one."""
    step = step.select(F.col("node").alias("at"), F.col("label").alias("to"))
    return pointers.join(step, F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label"))
