"""Spreading activation over the association graph (Eq 5, 5b, 5c, 20, 21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.vectors import total


def spread(activation: DataFrame, edges: DataFrame, c: Config) -> DataFrame:
    """(query_id, store_id, mem_id, activation) after the hops.

    activation: query_id, store_id, mem_id, a0, and, for query-aware messages, sim (cosine of query and key). Each hop is
    one join of edges with what their far ends hold and one sum by near end; the loop over hops is unrolled in the plan.
    """
    hops = c.multiscale_hops if c.multiscale_enabled else c.n_hops
    keys = ["query_id", "store_id", "mem_id"]
    state = activation.withColumn("s0", F.col("a0"))
    if c.spreading_debias_enabled:
        most = F.max(F.abs("a0")).over(Window.partitionBy("query_id", "store_id"))
        state = state.withColumn("cap", c.spread_residual_cap * F.greatest(most, F.lit(1e-12)))
        count = edges.groupBy("store_id", "src").agg(F.count("*").cast("double").alias("degree"))
        edges = edges.join(count, ["store_id", "src"]).join(count.select("store_id", F.col("src").alias("dst"), F.col("degree").alias("far_degree")), ["store_id", "dst"])
        edges = edges.withColumn("weight", F.col("weight") / (F.sqrt("degree") * F.sqrt("far_degree")))
    for h in range(hops):
        eta = c.eta_propagation * (c.multiscale_damping**h if c.multiscale_enabled else 1.0)
        held = F.col(f"s{h}") * F.greatest(F.lit(0.0), F.col("sim")) if c.query_aware_spread_enabled else F.col(f"s{h}")
        far = state.select("query_id", "store_id", F.col("mem_id").alias("dst"), held.alias("held"))
        message = far.join(edges.select("store_id", "src", "dst", "weight"), ["store_id", "dst"])
        combine = F.sum if c.spreading_debias_enabled else F.avg
        got = message.groupBy("query_id", "store_id", F.col("src").alias("mem_id")).agg(combine(F.col("weight") * F.col("held")).alias("got"))
        change = F.coalesce("got", F.lit(0.0))
        if c.spreading_debias_enabled:
            change = F.greatest(-F.col("cap"), F.least(F.col("cap"), change))
        state = state.join(got, keys, "left").withColumn(f"s{h + 1}", F.col(f"s{h}") + eta * change).drop("got")
    out = total(F.col(f"s{h}") for h in range(hops + 1)) / (hops + 1) if c.multiscale_enabled else F.col(f"s{hops}")
    return state.select(*keys, out.alias("activation"))


def collect(activated: DataFrame, c: Config) -> DataFrame:
    """Rows that reach the threshold, ranked; no limit on their number."""
    order = Window.partitionBy("query_id", "store_id").orderBy(F.col("activation").desc(), "mem_id")
    return activated.filter(F.col("activation") >= c.activation_threshold).withColumn("rank", F.row_number().over(order))
