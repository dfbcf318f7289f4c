"""What happens to an incoming pair: contradiction, drift, gate, soft decision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import cold_start, density_threshold, input_gate, prospect, sharpness
from ..functions.vectors import blend, cosine, minus, norm, normalized, sigmoid
from . import recall

_SIGNALS = "store_id long, mem_id long, ts long, m_mem_id long, best double, r_out double, r_val double, z double, zx double, m_ts long, n long, near long"


def signals(memories: DataFrame, c: Config) -> DataFrame:
    """Each memory taken as an incoming pair, and what the earlier memories of its store say to it; one without earlier ones has no row.

    store_id, mem_id, ts, n (earlier memories), m_mem_id and best (the one whose key is nearest to the input, the earlier of equals, and its
    cosine), r_out and r_val (the output's largest cosine with a key, a value), near (keys nearer to the input than the density's
    threshold) and entropy (of the softmax of the output's cosines with keys, Eq 10b, 0 for fewer than two).

    A pair of blocks is three matrix products, and gives one row for each incoming memory. The parts of the softmax carry their maximum, so that they add up.
    """

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        rows = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0)] * 5 + [np.zeros(0, np.int64)] * 3]
        if len(asked) and len(held):
            held = held.take(pa.array(np.lexsort((held.column("mem_id").to_numpy(), held.column("ts").to_numpy()))))
            new = {x: asked.column(x).to_numpy() for x in ("store_id", "query_id", "a_ts")}
            old = {x: held.column(x).to_numpy() for x in ("mem_id", "ts")}
            keys, values, e_in, e_out = (recall.units(t, x) for t, x in ((held, "key"), (held, "value"), (asked, "e_in"), (asked, "e_out")))
            for at in range(0, len(asked), 256):
                part = slice(at, at + 256)
                before = old["ts"][None, :] < new["a_ts"][part, None]
                some = before.any(axis=1)
                kk, ok, ov = (np.where(before, x, -np.inf)[some] for x in (e_in[part] @ keys.T, e_out[part] @ keys.T, e_out[part] @ values.T))
                if not len(kk):
                    continue
                nearest, top = kk.argmax(axis=1), ok.max(axis=1)
                x = (ok - top[:, None]) / c.entropy_temperature
                z = np.exp(x)
                rows.append([new["store_id"][part][some], new["query_id"][part][some], new["a_ts"][part][some], old["mem_id"][nearest], kk.max(axis=1), top, ov.max(axis=1), z.sum(axis=1), (z * np.where(z > 0, x, 0.0)).sum(axis=1), old["ts"][nearest], before[some].sum(axis=1), (kk > c.theta_density_neighbor).sum(axis=1)])
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in _SIGNALS.split(", ")])

    asked = memories.select("store_id", F.col("mem_id").alias("query_id"), F.col("ts").alias("a_ts"), F.col("key").alias("e_in"), F.col("value").alias("e_out"))
    parts = recall.dealt(asked, memories, ["a_ts", "e_in", "e_out"], ["ts", "key", "value"]).applyInArrow(run, _SIGNALS)
    best = F.max_by(F.struct("m_mem_id", "best"), F.struct("best", (-F.col("m_ts")).alias("turn")))
    block = F.struct(F.col("r_out").alias("top"), "z", "zx")
    whole = parts.groupBy("store_id", "mem_id").agg(F.first("ts").alias("ts"), F.sum("n").alias("n"), best.alias("m"), F.max("r_out").alias("r_out"), F.max("r_val").alias("r_val"), F.sum("near").alias("near"), F.collect_list(block).alias("blocks"))
    less = lambda x: (x["top"] - F.col("r_out")) / c.entropy_temperature  # noqa: E731  each block's sums, in terms of the whole's maximum
    z = F.aggregate("blocks", F.lit(0.0), lambda s, x: s + x["z"] * F.exp(less(x)))
    zx = F.aggregate("blocks", F.lit(0.0), lambda s, x: s + (x["zx"] + x["z"] * less(x)) * F.exp(less(x)))
    whole = whole.withColumns({"z": z, "zx": zx})
    entropy = F.when(F.col("n") < 2, F.lit(0.0)).otherwise((F.log("z") - F.col("zx") / F.col("z")) / F.log(F.col("n").cast("double")))
    return whole.select("store_id", "mem_id", "ts", "n", "m.m_mem_id", "m.best", "r_out", "r_val", "near", entropy.alias("entropy"))


def best_match(signals: DataFrame, memories: DataFrame) -> DataFrame:
    """The stored memory nearest to each incoming input, with the vectors of both: rows meet by id, once each.

    store_id, mem_id, ts, e_in, e_out; m_* of the stored memory; kk, ov: cosines of input and key, output and value.
    """
    new = memories.select("store_id", "mem_id", F.col("key").alias("e_in"), F.col("value").alias("e_out"), F.col("value_norm").alias("out_norm"))
    old = memories.select("store_id", *[F.col(x).alias(f"m_{x}") for x in ("mem_id", "key", "value", "strength", "value_norm")])
    met = signals.select("store_id", "mem_id", "ts", "m_mem_id", F.col("best").alias("kk")).join(new, ["store_id", "mem_id"]).join(old, ["store_id", "m_mem_id"])
    return met.withColumn("ov", cosine("e_out", "m_value", "out_norm", "m_value_norm")).drop("out_norm", "m_value_norm")


def contradictions(best: DataFrame, c: Config) -> DataFrame:
    """Adds contradiction (Eq 2): the same key with another value."""
    return best.withColumn("contradiction", (F.col("kk") >= c.theta_key) & (F.col("ov") < c.theta_value))


def drift(best: DataFrame, c: Config, soft: bool) -> DataFrame:
    """Adds drifted: the stored value moved towards the new output, by bias (Eq 2) or also by their unlikeness (Eq 2b)."""
    by = F.lit(c.initial_bias) * (1.0 - F.col("ov")) if soft else F.lit(c.initial_bias)
    return best.withColumn("by", by).withColumn("drifted", normalized(blend("m_value", "e_out", 1.0 - F.col("by"), F.col("by")))).drop("by")


def multichannel(best: DataFrame, c: Config) -> DataFrame:
    """Adds disp_sim and contradiction (Eq 24). context, m_context: context vectors now and at creation; 0.5 where either is null."""
    old, new = normalized(minus("m_value", "m_key")), normalized(minus("e_out", "e_in"))
    best = best.withColumns({"old": old, "new": new}).withColumn("disp_sim", cosine("old", "new"))
    ctx = F.when(F.col("context").isNull() | F.col("m_context").isNull(), F.lit(0.5)).otherwise(cosine("context", "m_context"))
    agree = c.w_channel_topic * F.col("kk") + c.w_channel_disp * F.col("disp_sim") + c.w_channel_ctx * ctx
    return best.withColumn("ctx_sim", ctx).withColumn("contradiction", (F.col("kk") >= c.theta_key) & (agree < c.theta_multichannel)).drop("old", "new")


def gated(signals: DataFrame, c: Config) -> DataFrame:
    """Adds gate and action (Eq 10). signals: best, r_out, r_val, d_ctx, entropy."""
    gate = input_gate(F.col("r_out"), F.col("r_val"), F.col("d_ctx"), F.col("best"), F.col("entropy"), c)
    action = F.when(F.col("best") >= c.theta_create, "strengthened").when(F.col("r_out") >= c.theta_out_filter, "filtered").when(F.col("gate") < c.theta_min_gate, "filtered").otherwise("created")
    return signals.withColumn("gate", gate).withColumn("action", action)


def soft_decisions(signals: DataFrame, c: Config) -> DataFrame:
    """Sharpness, threshold, probability and decision to strengthen (Eq 25 to 27), with the cold-start factor (Eq 28)."""
    s = signals.withColumns({"n": F.col("n").cast("double"), "near": F.col("near").cast("double")})
    s = s.withColumns({"sharpness": sharpness(F.col("n"), c), "threshold": density_threshold(F.col("near"), F.col("n"), c), "cold": cold_start(F.col("n"), c)})
    s = s.withColumn("p_strengthen", sigmoid(F.col("sharpness") * (F.col("best") - F.col("threshold"))))
    return s.withColumn("strengthen", F.col("p_strengthen") >= 0.5)


def decayed(memories: DataFrame, now: str, c: Config) -> DataFrame:
    """Strength after the turns since ts, in closed form (Eq 1)."""
    return memories.withColumn("strength", F.col("strength") * F.pow(F.lit(c.gamma), (F.col(now) - F.col("ts")).cast("double")))


def strengthened(best: DataFrame, c: Config) -> DataFrame:
    """Adds gain: what a match adds to strength (Eq 1), by the prospect transform if so configured (Eq 12)."""
    gain = c.alpha * F.col("kk")
    return best.withColumn("gain", prospect(gain, c) if c.prospect_enabled else gain)


def feedback(recalled: DataFrame, responses: DataFrame, memories: DataFrame, c: Config) -> DataFrame:
    """Per recalled row: alignment of the response with its value, effect, new strength and edge factor (Eq 16).

    recalled: query_id, store_id, mem_id, rank; responses: query_id, response. Rows are found by mem_id, whichever their rank.
    """
    met = recalled.join(responses, "query_id").join(memories.select("store_id", "mem_id", "value", "value_norm", "strength"), ["store_id", "mem_id"])
    met = met.withColumn("response_norm", norm("response")).withColumn("alignment", cosine("response", "value", "response_norm", "value_norm"))
    up, down = F.col("alignment") > c.theta_align, F.col("alignment") < c.theta_misalign
    after = F.when(up, F.col("strength") + c.alpha_feedback * F.col("alignment")).when(down, F.col("strength") * F.greatest(F.lit(0.01), 1.0 - c.alpha_feedback * (c.theta_misalign - F.col("alignment")))).otherwise(F.col("strength"))
    factor = F.when(up, F.lit(1.0 + c.eta_feedback)).when(down, F.lit(1.0 - c.eta_feedback)).otherwise(F.lit(1.0))
    effect = F.when(up, "strengthened").when(down, "weakened").otherwise("neutral")
    return met.select("query_id", "store_id", "mem_id", "rank", "alignment", effect.alias("effect"), after.alias("strength"), factor.alias("factor"))

