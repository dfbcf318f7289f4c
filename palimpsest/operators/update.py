"""The update cycle: an ordered fold over the turns of a store.

Every step depends on all before it (decay, best match, context, contradiction, edges), so a store is folded in order by one
task, and stores run in parallel. The same kernel serves batch, streaming and a running memory, which goes on from where a store was left.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..config import Config
from .hierarchy import leaders

ACTIONS = "store_id long, turn long, action string, mem_id long, best_sim double, gate double"
MEMORIES = "store_id long, mem_id long, key array<double>, value array<double>, strength double, bias double, ts long, access_count long, input_text string, output_text string, access_history array<long>, category string, context_at_creation array<double>"
STATES = "store_id long, due long, layer binary"
GROUPS = "store_id long, {0}_id long, key array<double>, value array<double>, strength double, children array<long>"
#: Tables that a state is laid out as, with their schemas.
TABLES = {
    "memories": MEMORIES,
    "edges": "store_id long, src long, dst long, weight double",
    "l2": GROUPS.format("l2"),
    "l3": GROUPS.format("l3"),
    "layer_state": "store_id long, timestep long, context_vector array<double>",
}


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return 0.0 if na < 1e-8 or nb < 1e-8 else float(a @ b / (na * nb))


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(q)
    return np.zeros(len(rows)) if n < 1e-8 else rows @ q / (np.maximum(np.linalg.norm(rows, axis=1), 1e-8) * n)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 1e-8 else v


@dataclass
class Layer:
    """One store while it is folded: numbers in arrays that grow by doubling, the rest in lists."""

    c: Config
    anchors: dict[str, np.ndarray] = field(default_factory=dict)
    edges: dict[int, dict[int, float]] = field(default_factory=dict)
    step: int = 0
    context: np.ndarray | None = None
    n: int = 0
    held: dict[str, np.ndarray] = field(default_factory=dict)
    told: list[dict] = field(default_factory=list)
    l2: list[list[int]] = field(default_factory=list)
    l3: list[list[int]] = field(default_factory=list)

    def col(self, name: str) -> np.ndarray:
        return self.held[name][: self.n]

    @property
    def rows(self) -> list[dict]:
        """The memories as they are."""
        numbers = {k: self.col(k) for k in self.held}
        return [{k: x[i].copy() if x.ndim > 1 else x[i].item() for k, x in numbers.items()} | self.told[i] for i in range(self.n)]

    def _append(self, told: dict, **numbers) -> int:
        if not self.n:
            self.held = {k: np.zeros((16, *np.shape(v)), dtype=np.int64 if isinstance(v, int) else np.float64) for k, v in numbers.items()}
        elif self.n == len(self.held["ts"]):
            self.held = {k: np.concatenate([x, np.zeros_like(x)]) for k, x in self.held.items()}
        for k, v in numbers.items():
            self.held[k][self.n] = v
        self.told.append(told)
        self.n += 1
        return self.n - 1

    def cold(self) -> float:
        return 1.0 + self.c.cold_start_kappa * math.exp(-self.n / max(self.c.cold_start_tau, 1.0)) if self.c.cold_start_enabled else 1.0

    def prospect(self, d: float) -> float:
        if not self.c.prospect_enabled or d == 0:
            return d
        return d**self.c.prospect_rho if d > 0 else -self.c.prospect_lambda_loss * abs(d) ** self.c.prospect_rho

    def weight(self, a: dict, b: dict) -> float:
        c = self.c
        alike = c.alpha_k * cosine(a["key"], b["key"]) + c.alpha_v * cosine(a["value"], b["value"])
        if c.displacement_edges_enabled:
            shift = lambda r: unit(r["value"] - r["key"])
            alike = (alike + c.alpha_d * cosine(shift(a), shift(b))) / (c.alpha_k + c.alpha_v + c.alpha_d)
        return alike * math.exp(-abs(a["ts"] - b["ts"]) / c.tau_temporal)

    def create(self, e_in: np.ndarray, e_out: np.ndarray, said: str, replied: str, strength: float) -> int:
        c = self.c
        category, best = "", -1.0
        if c.channels_enabled:
            for name, anchor in self.anchors.items():
                if (sim := cosine(e_in, anchor)) > best:
                    category, best = name, sim
        near = np.flatnonzero(self.col("ts") >= self.step - c.max_lag).tolist() if self.n else []  # no edge spans more
        told = {"input_text": said, "output_text": replied, "access_history": [self.step] if c.actr_enabled else [], "category": category, "context_at_creation": self.context}
        i = self._append(told, key=e_in, value=e_out, strength=float(strength), bias=float(c.initial_bias), ts=self.step, access_count=0)
        at = lambda j: {k: self.held[k][j] for k in ("key", "value", "ts")}
        own = at(i)
        self.edges[i] = {}
        for j in near:
            if (w := self.weight(own, at(j))) >= c.theta_edge:
                self.edges[i][j] = self.edges[j][i] = w
        for j in self.edges[i]:  # a contradicted neighbour gives way, and is not normalised anew (Eq 7)
            value = self.held["value"][j]
            if cosine(e_out, value) < c.theta_value:
                self.held["value"][j] = value + self.held["bias"][j] * (e_out - value)
                self.held["strength"][j] *= c.delta_graph
        return i

    def contradicts(self, at: int, e_in: np.ndarray, e_out: np.ndarray, sim: float) -> bool:
        c, key, value, known = self.c, self.held["key"][at], self.held["value"][at], self.told[at]["context_at_creation"]
        if sim < c.theta_key:
            return False
        if not c.multichannel_enabled:
            return cosine(value, e_out) < c.theta_value
        ctx = 0.5 if known is None or self.context is None else cosine(self.context, known)
        disp = cosine(unit(value - key), unit(e_out - e_in))
        return c.w_channel_topic * sim + c.w_channel_disp * disp + c.w_channel_ctx * ctx < c.theta_multichannel

    def gate(self, r_out: float, r_val: float, d_ctx: float, best: float, entropy: float) -> float:
        c = self.c
        along = 0.0
        if d_ctx > c.theta_ctx_gate:
            along = min((d_ctx - c.theta_ctx_gate) / (1.0 - c.theta_ctx_gate + 1e-8), 1.0) ** c.ctx_power
        novelty = 1.0 - best - (c.gate_w_out * r_out + c.gate_w_val * r_val + c.gate_w_ctx * along + c.gate_w_entropy * entropy)
        return 1.0 / (1.0 + math.exp(-c.beta_gate * (max(0.0, min(1.0, novelty)) - c.theta_gate)))

    def entropy(self, to_keys: np.ndarray) -> float:
        if self.n < 2 or not self.c.gate_w_entropy:
            return 0.0
        x = to_keys / self.c.entropy_temperature
        p = np.exp(x - x.max())
        p = np.clip(p / p.sum(), 1e-10, 1.0)
        return float(-(p * np.log(p)).sum() / math.log(len(p)))

    def update(self, e_in: np.ndarray, e_out: np.ndarray, said: str, replied: str) -> tuple[str, int | None, float | None, float | None]:
        """(action, mem_id, best_sim, gate)."""
        c = self.c
        self.step += 1
        if c.transcript_ingest:
            return "created", self.create(e_in, e_out, said, replied, c.initial_strength), None, None
        if self.n:
            self.held["strength"][: self.n] *= c.gamma
        d_ctx = 0.0 if self.context is None else cosine(e_in, self.context)
        self.context = e_in if self.context is None else unit(c.lambda_context * self.context + (1.0 - c.lambda_context) * e_in)
        cold = self.cold()
        if not self.n:
            return "created", self.create(e_in, e_out, said, replied, c.initial_strength * cold), None, None
        sims = cosines(e_in, self.col("key"))
        at = int(sims.argmax())
        best = float(sims[at])
        if c.soft_decisions_enabled:
            beta = c.beta_soft_min + (c.beta_soft_max - c.beta_soft_min) * min(self.n / c.n_mature, 1.0)
            theta = c.theta_soft_base + c.beta_theta_density * float((sims > c.theta_density_neighbor).mean())
            p = 1.0 / (1.0 + math.exp(-beta * (best - theta)))
        else:
            p = float(best >= c.theta_create)
        if p >= 0.5:
            held, told = self.held, self.told[at]
            held["strength"][at] += self.prospect(c.alpha * best * cold * (p if c.soft_decisions_enabled else 1.0))
            held["ts"][at] = self.step
            held["access_count"][at] += 1
            if c.actr_enabled:
                told["access_history"] = [*told["access_history"], self.step][-c.actr_max_history :]
            value, bias = held["value"][at].copy(), float(held["bias"][at])
            if self.contradicts(at, e_in, e_out, best):
                held["value"][at] = unit(value + bias * (e_out - value))
                held["strength"][at] *= c.delta
                self.create(e_in, e_out, said, replied, c.initial_strength)
                self._maybe_consolidate()
                return "contradiction", at, best, None
            held["value"][at] = unit(value + bias * (1.0 - cosine(value, e_out)) * (e_out - value))
            return "strengthened", at, best, None
        to_keys = cosines(e_out, self.col("key"))
        r_out, r_val = float(to_keys.max()), float(cosines(e_out, self.col("value")).max())
        if r_out >= c.theta_out_filter:
            return "filtered", None, best, 0.0
        gate = self.gate(r_out, r_val, d_ctx, best, self.entropy(to_keys))
        if gate < c.theta_min_gate:
            return "filtered", None, best, gate
        made = self.create(e_in, e_out, said, replied, gate * c.initial_strength * cold * ((1.0 - p) if c.soft_decisions_enabled else 1.0))
        self._maybe_consolidate()
        return "created", made, best, gate

    def feedback(self, e_out: np.ndarray, recalled: list[int]) -> None:
        """Strengths and edges of what was recalled, in its order, after the response (Eq 16)."""
        c = self.c
        for i in [int(x) for x in recalled if 0 <= x < self.n]:
            alignment = cosine(e_out, self.held["value"][i])
            if alignment > c.theta_align:
                self.held["strength"][i] += c.alpha_feedback * alignment
                factor = 1.0 + c.eta_feedback
            elif alignment < c.theta_misalign:
                self.held["strength"][i] *= max(0.01, 1.0 - c.alpha_feedback * (c.theta_misalign - alignment))
                factor = 1.0 - c.eta_feedback
            else:
                continue
            for j, w in list(self.edges[i].items()):
                if w * factor < c.theta_edge:
                    del self.edges[i][j], self.edges[j][i]
                else:
                    self.edges[i][j] = self.edges[j][i] = min(w * factor, 1.0)

    def _maybe_consolidate(self) -> None:
        c = self.c
        if c.hierarchy_enabled and self.n >= c.min_cluster_size and self.step % c.consolidate_every == 0:
            self.consolidate()

    def consolidate(self) -> None:
        """Forms patterns of memories that none has yet, then identities of patterns likewise (Eq 22)."""
        c = self.c
        if self.n < c.min_cluster_size:
            return
        spent = {i for group in self.l2 for i in group}
        free = [i for i in range(self.n) if i not in spent]
        if free:
            self.l2 += [[free[i] for i in found] for found in leaders(self.col("key")[free], c.theta_cluster, c.min_cluster_size, True)]
        if len(self.l2) < c.min_identity_size:
            return
        spent = {i for group in self.l3 for i in group}
        free = [i for i in range(len(self.l2)) if i not in spent]
        keys = self.centres("key", self.col("key"), self.col("strength"), self.l2)
        if free:
            self.l3 += [[free[i] for i in found] for found in leaders(keys[free], c.theta_identity, c.min_identity_size, False)]

    @staticmethod
    def centres(name: str, rows: np.ndarray, strength: np.ndarray, groups: list[list[int]]) -> np.ndarray:
        """Unit means of the groups' rows, weighted by strength."""
        whole = [s if (s := strength[g].sum()) >= 1e-10 else 1.0 for g in groups]
        return np.stack([unit((strength[g, None] * rows[g]).sum(axis=0) / w) for g, w in zip(groups, whole, strict=True)])

    def tables(self, store_id: int) -> dict[str, list[tuple]]:
        """Rows of TABLES."""
        out: dict[str, list[tuple]] = {name: [] for name in TABLES}
        names = [x.split()[0] for x in MEMORIES.split(", ")][2:]
        out["memories"] = [(store_id, i, *(r[x] for x in names)) for i, r in enumerate(self.rows)]
        out["edges"] = [(store_id, i, j, w) for i, near in self.edges.items() for j, w in near.items()]
        out["layer_state"] = [(store_id, self.step, self.context)]
        key, value, strength = (self.col(x) for x in ("key", "value", "strength")) if self.n else (None, None, None)
        for name, groups in (("l2", self.l2), ("l3", self.l3)):
            if groups:
                key, value = self.centres("key", key, strength, groups), self.centres("value", value, strength, groups)
                strength = np.array([strength[g].sum() for g in groups])
                out[name] = [(store_id, k, key[k], value[k], float(strength[k]), g) for k, g in enumerate(groups)]
        return out


def fold(layer: Layer, turns: pd.DataFrame) -> list[tuple]:
    """Actions of turns (turn, e_in, e_out, input_text, output_text, and recalled: ids of what the turn's prompt held), in order."""
    out, known = [], "recalled" in turns.columns
    for r in turns.sort_values("turn", kind="stable").itertuples(index=False):
        e_out = np.asarray(r.e_out, dtype=float)
        out.append((r.store_id, r.turn, *layer.update(np.asarray(r.e_in, dtype=float), e_out, r.input_text, r.output_text)))
        if known and layer.c.feedback_enabled and r.recalled is not None:
            layer.feedback(e_out, list(r.recalled))
    return out


def _anchors(anchors: dict[str, list[float]] | None) -> dict[str, np.ndarray]:
    return {k: np.asarray(v) for k, v in (anchors or {}).items()}


def actions(turns: DataFrame, c: Config, anchors: dict[str, list[float]] | None = None) -> DataFrame:
    """What the cycle does with each turn. turns: store_id, turn, e_in, e_out, input_text, output_text."""
    known = _anchors(anchors)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold(Layer(c, known), rows), columns=["store_id", "turn", "action", "mem_id", "best_sim", "gate"])

    return turns.groupBy("store_id").applyInPandas(run, ACTIONS)


def memories(turns: DataFrame, c: Config, anchors: dict[str, list[float]] | None = None) -> DataFrame:
    """What the store holds after all turns."""
    known = _anchors(anchors)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        layer = Layer(c, known)
        fold(layer, rows)
        return pd.DataFrame(layer.tables(rows["store_id"].iloc[0])["memories"], columns=_names(MEMORIES))

    return turns.groupBy("store_id").applyInPandas(run, MEMORIES)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def advance(states: DataFrame | None, turns: DataFrame, c: Config, anchors: dict[str, list[float]] | None = None) -> DataFrame:
    """(store_id, due, layer): each store's state after the given turns, which come behind those that ``states`` has folded.

    A store without new turns keeps its state, and none is folded again. layer: pickled by this module, for the memory's own folder.
    """
    known = _anchors(anchors)

    def one(store: int, before: pd.DataFrame | None, rows: pd.DataFrame) -> pd.DataFrame:
        layer, due = (pickle.loads(before["layer"].iloc[0]), int(before["due"].iloc[0])) if before is not None and len(before) else (Layer(c, known), 0)
        layer.c, layer.anchors = c, known
        rows = rows[rows["turn"] >= due]
        fold(layer, rows)
        return pd.DataFrame([(store, max(due, int(rows["turn"].max()) + 1) if len(rows) else due, pickle.dumps(layer))], columns=["store_id", "due", "layer"])

    if states is None:
        return turns.groupBy("store_id").applyInPandas(lambda rows: one(rows["store_id"].iloc[0], None, rows), STATES)

    def both(key: tuple, before: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return one(key[0], before, rows)

    return states.groupBy("store_id").cogroup(turns.groupBy("store_id")).applyInPandas(both, STATES)


def table_of(states: DataFrame, name: str) -> DataFrame:
    """One of TABLES, of all stores' states."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for store, layer in zip(batch["store_id"], batch["layer"], strict=True):
                yield pd.DataFrame(pickle.loads(layer).tables(store)[name], columns=_names(TABLES[name]))

    return states.mapInPandas(run, TABLES[name])
