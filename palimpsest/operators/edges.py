"""The association graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.vectors import cosine, minus, norm


def build_edges(memories: DataFrame, c: Config) -> DataFrame:
    """(store_id, src, dst, weight), both directions, of all pairs of a store that reach theta_edge (Eq 4, Eq 18).

    The decay in time bounds the lag of an edge, so this is a band join on buckets of time: each row meets its own bucket and the
    next one, by an equality. Cosines are computed behind the join, so that the time test comes first.
    memories: store_id, mem_id, ts, key, value, key_norm, value_norm.
    """
    width = c.max_lag + 1
    if c.displacement_edges_enabled:
        memories = memories.withColumn("shift", minus("value", "key")).withColumn("shift_norm", norm("shift"))
    names = [x for x in ("mem_id", "ts", "key", "value", "key_norm", "value_norm", "shift", "shift_norm") if x in memories.columns]
    left = memories.select("store_id", F.floor(F.col("ts") / width).alias("bucket"), *[F.col(x).alias(f"a_{x}") for x in names])
    right = memories.select("store_id", F.explode(F.array(F.floor(F.col("ts") / width), F.floor(F.col("ts") / width) - 1)).alias("bucket"), *[F.col(x).alias(f"b_{x}") for x in names])
    lag = F.col("b_ts") - F.col("a_ts")
    later = (lag > 0) | ((lag == 0) & (F.col("b_mem_id") > F.col("a_mem_id")))
    near = left.join(right, ["store_id", "bucket"]).filter((lag <= c.max_lag) & later)
    alike = c.alpha_k * cosine("a_key", "b_key", "a_key_norm", "b_key_norm") + c.alpha_v * cosine("a_value", "b_value", "a_value_norm", "b_value_norm")
    if c.displacement_edges_enabled:
        alike = (alike + c.alpha_d * cosine("a_shift", "b_shift", "a_shift_norm", "b_shift_norm")) / (c.alpha_k + c.alpha_v + c.alpha_d)
    weight = alike * F.exp(-lag.cast("double") / c.tau_temporal)
    # Both directions from one weight, which as an array's element is neither computed twice nor pushed into the join.
    edge = lambda src, dst, w: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), w.alias("weight"))
    both = F.flatten(F.transform(F.array(weight), lambda w: F.array(edge("a_mem_id", "b_mem_id", w), edge("b_mem_id", "a_mem_id", w))))
    return near.select("store_id", F.inline(F.filter(both, lambda e: e["weight"] >= c.theta_edge)))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("store_id", F.col("src").alias("mem_id")).agg(F.count("*").alias("degree"))


def neighbors(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges of each node, ranked."""
    order = Window.partitionBy("store_id", "src").orderBy(F.col("weight").desc(), "dst")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def graph_counts(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (isolated ones too) and undirected edges of each store."""
    n = memories.groupBy("store_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("store_id").agg(F.expr("count(*) div 2").alias("edges"))
    return n.join(e, "store_id", "left").select("store_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


def adjust_edges(edges: DataFrame, changes: DataFrame, c: Config) -> DataFrame:
    """Edges after feedback (Eq 16): factors of recalled endpoints, in order of query and rank, capped at 1, dropped below theta_edge.

    changes: store_id, mem_id, rank, factor, and query_id where several queries recalled. Cap and drop between two factors make
    their order count, so all factors of both endpoints meet in the edge's row and are applied in turn; an edge stays one row.
    """
    query = F.col("query_id").cast("long") if "query_id" in changes.columns else F.lit(0).cast("long")
    held = changes.groupBy("store_id", "mem_id").agg(F.collect_list(F.struct(query.alias("query_id"), F.col("rank"), F.col("factor"))).alias("steps"))
    one = held.select("store_id", F.col("mem_id").alias("src"), F.col("steps").alias("x"))
    two = held.select("store_id", F.col("mem_id").alias("dst"), F.col("steps").alias("y"))
    met = edges.join(one, ["store_id", "src"], "left").join(two, ["store_id", "dst"], "left")
    none = F.array().cast(held.schema["steps"].dataType)
    met = met.withColumn("steps", F.array_sort(F.concat(F.coalesce("x", none), F.coalesce("y", none))))
    after = F.aggregate("steps", F.col("weight"), lambda w, s: F.when(w * s["factor"] >= c.theta_edge, F.least(w * s["factor"], F.lit(1.0))))
    return met.select("store_id", "src", "dst", after.alias("weight")).filter("weight is not null")
