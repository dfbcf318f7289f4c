"""Scalar rules of the memory model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from .vectors import clamp, sigmoid


def prospect(delta: Column, c: Config) -> Column:
    """Gains are concave, losses steeper (Eq 12)."""
    loss = -c.prospect_lambda_loss * F.pow(F.abs(delta), F.lit(c.prospect_rho))
    return F.when(delta > 0, F.pow(delta, F.lit(c.prospect_rho))).when(delta < 0, loss).otherwise(F.lit(0.0))


def compressed(strength: Column, c: Config) -> Column:
    return F.pow(F.greatest(strength, F.lit(1e-10)), F.lit(c.recall_strength_exp))


def recency(now: Column, at: Column, c: Config) -> Column:
    return F.exp(-F.greatest(now - at, F.lit(0)).cast("double") / c.tau_recall)


def base_level(now: Column, history: Column, at: Column, c: Config) -> Column:
    """Log of the sum of decayed accesses (Eq 17); a row without history counts its own time as one."""
    known = F.when(F.size(history) > 0, history).otherwise(F.array(at))
    return F.log(F.greatest(F.aggregate(known, F.lit(0.0), lambda s, t: s + F.pow(F.greatest(now - t, F.lit(1)).cast("double"), F.lit(-c.actr_decay))), F.lit(1e-10)))


def cold_start(n: Column, c: Config) -> Column:
    return 1.0 + c.cold_start_kappa * F.exp(-n.cast("double") / max(c.cold_start_tau, 1.0))


def sharpness(n: Column, c: Config) -> Column:
    return c.beta_soft_min + (c.beta_soft_max - c.beta_soft_min) * F.least(n / float(c.n_mature), F.lit(1.0))


def density_threshold(near: Column, n: Column, c: Config) -> Column:
    return c.theta_soft_base + c.beta_theta_density * near / n


def input_gate(r_out: Column, r_val: Column, d_ctx: Column, best: Column | None, entropy: Column, c: Config) -> Column:
    """Eq 10; without a best match, Eq 6: the output's overlap is the primary signal."""
    if c.transcript_ingest:
        along = F.lit(0.0)
    else:
        share = F.least((d_ctx - c.theta_ctx_gate) / (1.0 - c.theta_ctx_gate + 1e-8), F.lit(1.0))
        along = F.when(d_ctx > c.theta_ctx_gate, F.pow(F.greatest(share, F.lit(0.0)), F.lit(c.ctx_power))).otherwise(F.lit(0.0))
    primary = 1.0 - (r_out if best is None else best)
    penalty = c.gate_w_val * r_val + c.gate_w_ctx * along + c.gate_w_entropy * entropy
    if best is not None:
        penalty = c.gate_w_out * r_out + penalty
    return sigmoid(c.beta_gate * (clamp(primary - penalty, 0.0, 1.0) - c.theta_gate))


def effective_k(max_sim: Column, c: Config) -> Column:
    """Harder queries get more rows (Eq 15)."""
    return F.least(F.ceil(c.top_k * (1.0 + c.beta_difficulty * (1.0 - F.greatest(F.lit(0.0), max_sim)))), F.lit(c.top_k_max)).cast("int")
