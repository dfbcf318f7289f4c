"""Parameters of the memory engine.

Flags are read while a plan is built, so a branch that is off is not in the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # The published defaults.
    embedding_dim: int = 1024
    alpha: float = 0.1
    gamma: float = 0.995
    initial_strength: float = 1.0
    initial_bias: float = 0.5
    theta_key: float = 0.7
    theta_value: float = 0.5
    delta: float = 0.5
    theta_create: float = 0.75
    top_k: int = 5
    min_relevance: float = 0.01
    alpha_k: float = 0.5
    alpha_v: float = 0.5
    tau_temporal: float = 5.0
    theta_edge: float = 0.1
    eta_propagation: float = 0.5
    n_hops: int = 2
    activation_threshold: float = 0.01
    beta_gate: float = 6.0
    theta_gate: float = 0.4
    theta_min_gate: float = 0.12
    delta_graph: float = 0.7
    lambda_context: float = 0.7
    beta_context: float = 8.0
    theta_context: float = 0.3
    recall_w_semantic: float = 0.45
    recall_w_answer: float = 0.2
    recall_w_context: float = 0.2
    recall_w_recency: float = 0.15
    tau_recall: float = 10.0
    recall_strength_exp: float = 0.3
    gate_w_out: float = 0.15
    gate_w_val: float = 0.05
    gate_w_ctx: float = 0.5
    ctx_power: float = 1.5
    gate_w_entropy: float = 0.0
    entropy_temperature: float = 0.5
    theta_ctx_gate: float = 0.5
    theta_out_filter: float = 0.9
    adaptive_heads: bool = False
    head_temperature: float = 0.5
    transcript_ingest: bool = False
    prospect_enabled: bool = False
    prospect_rho: float = 0.88
    prospect_lambda_loss: float = 2.25
    tension_enabled: bool = False
    theta_tension_key: float = 0.5
    theta_tension_val: float = 0.4
    channels_enabled: bool = False
    adaptive_k_enabled: bool = False
    beta_difficulty: float = 1.0
    top_k_max: int = 15
    feedback_enabled: bool = False
    theta_align: float = 0.6
    theta_misalign: float = 0.3
    alpha_feedback: float = 0.05
    eta_feedback: float = 0.1
    actr_enabled: bool = False
    actr_decay: float = 0.5
    actr_max_history: int = 20
    displacement_edges_enabled: bool = False
    alpha_d: float = 0.3
    sparse_recall_enabled: bool = False
    recall_w_sparse: float = 0.15
    multiscale_enabled: bool = False
    multiscale_hops: int = 4
    multiscale_damping: float = 0.7
    query_aware_spread_enabled: bool = False
    spreading_debias_enabled: bool = False
    spread_residual_cap: float = 0.5
    hierarchy_enabled: bool = False
    theta_cluster: float = 0.7
    min_cluster_size: int = 3
    theta_identity: float = 0.6
    min_identity_size: int = 2
    recall_w1: float = 0.5
    recall_w2: float = 0.3
    recall_w3: float = 0.2
    consolidate_every: int = 20
    multichannel_enabled: bool = False
    w_channel_topic: float = 0.5
    w_channel_disp: float = 0.3
    w_channel_ctx: float = 0.2
    theta_multichannel: float = 0.55
    soft_decisions_enabled: bool = False
    beta_soft_min: float = 5.0
    beta_soft_max: float = 20.0
    n_mature: int = 100
    theta_soft_base: float = 0.55
    beta_theta_density: float = 0.3
    theta_density_neighbor: float = 0.5
    cold_start_enabled: bool = False
    cold_start_kappa: float = 3.0
    cold_start_tau: float = 10.0
    shared_memory_weight: float = 0.3
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    hybrid_weight: float = 0.15
    channel_anchors: dict[str, str] = field(
        default_factory=lambda: {
            "fact": "This is a factual statement about the world or about me",
            "preference": "I like this, I prefer this, my favorite is",
            "instruction": "Please always do this, remember to do this",
            "event": "Something happened, I went to, yesterday I did",
        }
    )

    @classmethod
    def full(cls, **changes) -> Config:
        """The preset of an evaluation: every part of the model on, but for the two that evaluations vary (transcript_ingest, spreading_debias_enabled)."""
        on = ("prospect", "tension", "channels", "adaptive_k", "feedback", "actr", "displacement_edges", "sparse_recall", "multiscale", "query_aware_spread", "hierarchy", "multichannel", "soft_decisions", "cold_start")
        return cls(**{f"{name}_enabled": True for name in on} | changes)

    @property
    def max_lag(self) -> int:
        """Largest time difference that an edge can span: exp(-lag / tau) times the largest similarity reaches theta_edge."""
        most = 1.0 if self.displacement_edges_enabled else self.alpha_k + self.alpha_v
        return max(0, math.floor(self.tau_temporal * math.log(most / self.theta_edge) + 1e-9))
