"""Retrieval over a store's memories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import base_level, compressed, effective_k, recency
from ..functions.vectors import blend, cosine, norm, normalized, sigmoid, sum_vectors, total

QUERY = ("query_id", "store_id")
#: Rows of a block, of queries and of memories, on average.
BLOCK = 4096
PAIRS = "query_id long, mem_id long, score double"


def meet(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """Each query with all memories of its store. queries: query_id, store_id, q; an equality join on the store."""
    return queries.withColumn("q_norm", norm("q")).join(memories, "store_id")


def ranked(df: DataFrame, score: str, k: int | Column, by: list[str] | None = None) -> DataFrame:
    """The k best rows of each query by score, ties to the smaller mem_id."""
    order = Window.partitionBy(*(by or ["query_id"])).orderBy(F.col(score).desc(), "mem_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return np.asarray(rows.flatten(), dtype=np.float64).reshape(len(rows), -1)


def units(table: pa.Table, name: str) -> np.ndarray:
    """A column of vectors as unit rows."""
    return _units(_matrix(table.column(name)))


def _units(x: np.ndarray) -> np.ndarray:
    """Unit rows; (nearly) zero ones are zero, so that their cosines are."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n < 1e-8, 0.0, x / np.maximum(n, 1e-300))


def dealt(queries: DataFrame, memories: DataFrame, asked: list[str], held: list[str]):
    """Both sides, grouped by pairs of blocks of a store: the columns ``asked`` of queries meet the columns ``held`` of memories.

    A store of n memories and m queries is n / BLOCK times m / BLOCK pairs of blocks, so a large store is many tasks.
    """
    blocks = lambda df, name: df.groupBy("store_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(queries, "q_blocks").join(blocks(memories, "m_blocks"), "store_id")  # a row a store
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda row, n: F.pmod(F.xxhash64(row), F.col(n)).cast("int")
    again = lambda c: (F.col(c) + F.lit(0)).alias(c)  # noqa: E731  a column of its own, where both sides come from one table
    left = queries.join(sizes, "store_id").select(again("store_id"), own("query_id", "q_blocks").alias("qb"), every("m_blocks").alias("mb"), again("query_id"), *asked)
    right = memories.join(sizes, "store_id").select("store_id", every("q_blocks").alias("qb"), own("mem_id", "m_blocks").alias("mb"), "mem_id", *held)
    keys = ("store_id", "qb", "mb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def _ordered(held: pa.Table) -> pa.Table:
    return held.take(pa.array(np.argsort(held.column("mem_id").to_numpy(), kind="stable")))


def _best(score: np.ndarray, k: int | None) -> np.ndarray:
    """Whether a score is among its row's best k; ties of the k-th go along, and are settled by mem_id later."""
    if k is None or k >= score.shape[1]:
        return np.ones(score.shape, dtype=bool)
    return score >= np.partition(score, -k, axis=1)[:, -k, None]


def in_blocks(queries: DataFrame, memories: DataFrame, k: int | None) -> DataFrame:
    """query_id, mem_id, score: cosines of queries (query_id, store_id, q) and all memories (store_id, mem_id, key) of their store.

    Each pair of blocks is one matrix product, and no pair is a row before it is known to matter: of each block, a query's best ``k`` leave (None: all).
    """

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(asked) and len(held):
            held = _ordered(held)
            names, ids = asked.column("query_id").to_numpy(), held.column("mem_id").to_numpy()
            q, keys = _units(_matrix(asked.column("q"))), _units(_matrix(held.column("key")))
            for at in range(0, len(names), 256):
                score = q[at : at + 256] @ keys.T
                i, j = np.nonzero(_best(score, k))
                out.append((names[at + i], ids[j], score[i, j]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "mem_id", "score"])

    return dealt(queries, memories, ["q"], ["key"]).applyInArrow(run, PAIRS)


def dense_topk(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """query_id, rank, mem_id, score: exact top-k by cosine."""
    return ranked(in_blocks(queries.select("query_id", "store_id", "q"), memories.select("store_id", "mem_id", "key"), k), "score", k)


def weighted_value(queries: DataFrame, memories: DataFrame, dim: int) -> DataFrame:
    """Mean value of a store's memories, weighted by strength and similarity (Eq 3); null where the weights add up to nothing.

    A block's weighted sum is two matrix products, and one row a query; the blocks' sums are added up.
    """

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names, sums, weights = [np.zeros(0, np.int64)], [np.zeros((0, dim))], [np.zeros(0)]
        if len(asked) and len(held):
            keys, values, strength = _units(_matrix(held.column("key"))), _matrix(held.column("value")), held.column("strength").to_numpy()
            names.append(asked.column("query_id").to_numpy())
            q = _units(_matrix(asked.column("q")))
            for at in range(0, len(q), 256):
                w = (q[at : at + 256] @ keys.T) * strength[None, :]
                sums.append(w @ values)
                weights.append(w.sum(axis=1))
        return pa.table({"query_id": np.concatenate(names), "v": pa.array(list(np.concatenate(sums)), pa.list_(pa.float64())), "w": np.concatenate(weights)})

    found = dealt(queries.select("query_id", "store_id", "q"), memories.select("store_id", "mem_id", "key", "value", "strength"), ["q"], ["key", "value", "strength"])
    found = found.applyInArrow(run, "query_id long, v array<double>, w double")
    sums = found.groupBy("query_id").agg(sum_vectors("v", F.lit(1.0), dim).alias("v"), F.sum("w").alias("w"))
    return sums.select("query_id", F.when(F.col("w") >= 1e-8, F.transform("v", lambda x: x / F.col("w"))).alias("value"))


def effective_query(queries: DataFrame, memories: DataFrame, state: DataFrame, c: Config) -> DataFrame:
    """Query mixed with the context (Eq 8): the surer the best match, the more of the query stays.

    state: store_id, context (null: none). Adds alpha and q_eff. Without memories the query counts as sure.
    """
    best = meet(queries, memories).groupBy("query_id").agg(F.max(cosine("q", "key", "q_norm", "key_norm")).alias("best"))
    met = queries.join(best, "query_id", "left").join(state, "store_id", "left")
    alpha = F.when(F.col("best").isNull(), F.lit(1.0)).otherwise(sigmoid(c.beta_context * (F.col("best") - c.theta_context)))
    met = met.withColumn("alpha", alpha)
    mixed = normalized(blend("q", "context", F.col("alpha"), 1.0 - F.col("alpha")))
    return met.withColumn("q_eff", F.when(F.col("context").isNull(), F.col("q")).otherwise(mixed))


def _softmax(most: list[Column], c: Config) -> list[Column]:
    """Weights of heads by the largest value of each (Eq 11)."""
    top = F.greatest(*most)
    lifted = [F.exp((x - top) / c.head_temperature) for x in most]
    return [x / total(lifted) for x in lifted]


def _head_weights(c: Config, lexical: bool) -> list[float]:
    weights = [c.recall_w_semantic, c.recall_w_answer, c.recall_w_context, 0.0 if c.spreading_debias_enabled and c.transcript_ingest else c.recall_w_recency, c.recall_w_sparse if lexical else 0.0]
    return [w / sum(weights) for w in weights]


def _held(memories: DataFrame, state: DataFrame, c: Config) -> DataFrame:
    """Memories with the heads that don't depend on the query: h3 and h4."""
    held = memories.join(state.withColumn("c_norm", norm("context")), "store_id")
    held = held.withColumn("h3", F.when(F.col("context").isNull(), F.lit(0.0)).otherwise(F.greatest(cosine("context", "key", "c_norm", "key_norm"), F.lit(0.0))))
    if not c.actr_enabled:
        return held.withColumn("h4", recency(F.col("now"), F.col("ts"), c))
    held = held.withColumn("level", base_level(F.col("now"), F.col("access_history"), F.col("ts"), c))
    low, high = F.min("level").over(Window.partitionBy("store_id")), F.max("level").over(Window.partitionBy("store_id"))
    held = held.withColumns({"low": low, "high": high})
    return held.withColumn("h4", F.when(F.col("high") - F.col("low") > 1e-8, (F.col("level") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.5)))


def multi_head_best(queries: DataFrame, memories: DataFrame, state: DataFrame, c: Config, k: int) -> DataFrame:
    """As ``multi_head`` without a sparse head, but in blocks: of each block a query's best ``k`` rows by score, and its most similar one.

    Those hold the best k of the whole store and its largest h1. Adaptive heads need the largest value of each head first, which is
    a pass of its own that gives one row a query and block.
    """
    held = _held(memories, state, c).select("store_id", "mem_id", "key", "value", "h3", "h4", compressed(F.col("strength"), c).alias("by"))
    columns, asked = ["key", "value", "h3", "h4", "by"], queries.select("query_id", "store_id", "q")

    def heads(q: np.ndarray, held: pa.Table) -> Iterator[tuple[int, list[np.ndarray]]]:
        keys, values = (_units(_matrix(held.column(x))) for x in ("key", "value"))
        h3, h4 = (held.column(x).to_numpy()[None, :] for x in ("h3", "h4"))
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            yield at, [np.maximum(part @ keys.T, 0.0), np.maximum(part @ values.T, 0.0), h3, h4]

    if c.adaptive_heads:

        def largest(asked: pa.Table, held: pa.Table) -> pa.Table:
            out = [np.zeros((0, 4))]
            if len(asked) and len(held):
                out += [np.stack([np.broadcast_to(h.max(axis=1), len(x[0])) for h in x], axis=1) for _, x in heads(_units(_matrix(asked.column("q"))), held)]
            most = np.concatenate(out)
            return pa.table([asked.column("query_id").slice(0, len(most)), *(pa.array(most[:, i]) for i in range(4))], names=["query_id", "m1", "m2", "m3", "m4"])

        found = dealt(asked, held, ["q"], columns).applyInArrow(largest, "query_id long, m1 double, m2 double, m3 double, m4 double")
        most = found.groupBy("query_id").agg(*[F.max(f"m{i}").alias(f"m{i}") for i in range(1, 5)])
        weights = _softmax([*(F.col(f"m{i}") for i in range(1, 5)), F.lit(0.0)], c)
        asked = asked.join(most.select("query_id", F.array(*weights[:4]).alias("w")), "query_id")
    else:
        asked = asked.withColumn("w", F.array(*[F.lit(float(w)) for w in _head_weights(c, False)[:4]]))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if len(asked) and len(held):
            held = _ordered(held)
            names, stores, ids, by = (t.column(x).to_numpy() for t, x in ((asked, "query_id"), (asked, "store_id"), (held, "mem_id"), (held, "by")))
            weight = _matrix(asked.column("w"))
            for at, x in heads(_units(_matrix(asked.column("q"))), held):
                score = by[None, :] * sum(weight[at : at + len(x[0]), i, None] * x[i] for i in range(4))
                taken = _best(score, k)
                taken[np.arange(len(taken)), x[0].argmax(axis=1)] = True
                i, j = np.nonzero(taken)
                out.append((names[at + i], stores[at + i], ids[j], x[0][i, j], score[i, j]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "store_id", "mem_id", "h1", "score"])

    return dealt(asked, held, ["q", "w"], columns).applyInArrow(run, "query_id long, store_id long, mem_id long, h1 double, score double")


def multi_head(queries: DataFrame, memories: DataFrame, state: DataFrame, c: Config, sparse: DataFrame | None = None) -> DataFrame:
    """query_id, store_id, mem_id, h1, score of every pair (Eq 9, 9b, 11, 17, 19).

    Heads: query and key, query and value, context and key, recency (or base level), sparse. state: store_id, now, context.
    sparse: query_id, mem_id, sparse; with store_id where memories of two stores share an id. Where only the best rows are wanted and
    there is no sparse head, ``multi_head_best`` gives them without a row for every pair.
    """
    held = _held(memories, state, c)
    met = meet(queries, held.select("store_id", "mem_id", "key", "key_norm", "value", "value_norm", "strength", "h3", "h4"))
    met = met.select("query_id", "store_id", "mem_id", "strength", F.greatest(cosine("q", "key", "q_norm", "key_norm"), F.lit(0.0)).alias("h1"), F.greatest(cosine("q", "value", "q_norm", "value_norm"), F.lit(0.0)).alias("h2"), "h3", "h4")
    if sparse is None:
        met = met.withColumn("h5", F.lit(0.0))
    else:
        met = met.join(sparse, [x for x in ("query_id", "store_id", "mem_id") if x in sparse.columns], "left").withColumn("h5", F.coalesce("sparse", F.lit(0.0)))
    heads = [F.col(f"h{i}") for i in range(1, 6)]
    if c.adaptive_heads:
        most = met.groupBy("query_id").agg(*[F.max(f"h{i}").alias(f"m{i}") for i in range(1, 6)])
        weights = _softmax([F.col(f"m{i}") for i in range(1, 6)], c)
        met = met.join(most.select("query_id", *[w.alias(f"w{i}") for i, w in enumerate(weights, 1)]), "query_id")
        score = total(F.col(f"w{i}") * h for i, h in enumerate(heads, 1))
    else:
        score = total(w * h for w, h in zip(_head_weights(c, sparse is not None), heads, strict=True))
    return met.select("query_id", "store_id", "mem_id", "h1", (compressed(F.col("strength"), c) * score).alias("score"))


def recall(scored: DataFrame, c: Config) -> DataFrame:
    """Top rows of each query that are relevant; the depth adapts to the best similarity if so configured (Eq 15). scored: with h1."""
    if c.adaptive_k_enabled:
        scored = scored.withColumn("k", effective_k(F.max("h1").over(Window.partitionBy("query_id")), c))
        out = ranked(scored, "score", F.col("k"))
    else:
        out = ranked(scored, "score", c.top_k)
    return out.filter(F.col("score") >= c.min_relevance)


def access_delta(recalled: DataFrame) -> DataFrame:
    """What recall adds to access counts; recall itself changes nothing."""
    return recalled.groupBy("store_id", "mem_id").agg(F.count("*").alias("accesses"))


def tension(recalled: DataFrame, memories: DataFrame, c: Config) -> DataFrame:
    """Role of each recalled row against the first one (Eq 13): conflicting if alike in key and unlike in value."""
    held = recalled.join(memories.select("store_id", "mem_id", "key", "key_norm", "value", "value_norm"), ["store_id", "mem_id"])
    first = held.filter("rank = 1").select("query_id", *[F.col(x).alias(f"top_{x}") for x in ("key", "key_norm", "value", "value_norm")])
    met = held.join(first, "query_id")
    against = (F.col("rank") > 1) & (cosine("top_key", "key", "top_key_norm", "key_norm") > c.theta_tension_key) & (cosine("top_value", "value", "top_value_norm", "value_norm") < c.theta_tension_val)
    return met.select(*recalled.columns, F.when(against, "conflicting").otherwise("supporting").alias("role"))


def classify(rows: DataFrame, anchors: list[tuple[str, list[float]]], vector: str) -> Column:
    """Name of the nearest anchor, the first of equals to nine digits (Eq 14)."""
    sims = F.array(*[F.struct(F.round(cosine(vector, F.lit(a)), 9).alias("sim"), F.lit(-i).alias("turn"), F.lit(name).alias("name")) for i, (name, a) in enumerate(anchors)])
    return F.array_max(sims)["name"]
