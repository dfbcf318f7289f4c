"""The registered queries: each operator over whole tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import base_level, cold_start, prospect
from ..functions.text import hash_embed, is_refusal
from ..functions.vectors import cosine, dot, norm, normalized
from ..operators import decisions, edges, evaluation, hierarchy, ingest, recall, reports, sparse, spread, update
from . import tables as t

C = t.CONFIG
BUDGETS = [1, 2, 3, 5, 8, 12, 20, 30]
SAMPLE = 200


def r6(c, name: str):
    """Rounded; adding zero makes -0 and 0 one."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def _vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).select(*keys, "pos", r6("x", "x"))


# Retrieval


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    mem = t.memories(spark, d)
    return recall.dense_topk(t.as_queries(mem), mem, C.top_k).select("query_id", "rank", "mem_id", r6("score", "score"))


def weighted_recall_value(spark, d):
    mem = t.memories(spark, d)
    return _vectors(recall.weighted_value(t.as_queries(mem), mem, t.DIM), ["query_id"], "value")


def effective_query(spark, d):
    mem = t.memories(spark, d)
    out = recall.effective_query(t.centres(mem), mem, t.state(mem), C)
    return out.select("query_id", r6("alpha", "alpha"), r6(cosine("q_eff", "q"), "to_query"), r6(cosine("q_eff", "context"), "to_context"), r6(norm("q_eff"), "length"))


def _multi(spark, d, c, best, context=True):
    mem = t.memories(spark, d)
    state = t.state(mem)
    if not context:
        state = state.withColumn("context", F.lit(None).cast("array<double>"))
    return recall.multi_head_best(t.as_queries(mem), mem, state, c, best)


def _recalled(spark, d, c, context=True):
    return recall.recall(_multi(spark, d, c, c.top_k, context), c)


def _shown(df):
    return df.select("query_id", "rank", "mem_id", r6("score", "score"))


def multi_head_recall(spark, d):
    return _shown(_recalled(spark, d, C))


def multi_head_recall_transcript(spark, d):
    return _shown(_recalled(spark, d, replace(C, transcript_ingest=True, spreading_debias_enabled=True), context=False))


def adaptive_heads(spark, d):
    return _shown(_recalled(spark, d, replace(C, adaptive_heads=True)))


def adaptive_k_recall(spark, d):
    mem = t.memories(spark, d)
    c = replace(C, adaptive_k_enabled=True)
    return _shown(recall.recall(recall.multi_head_best(t.centres(mem), mem, t.state(mem), c, c.top_k_max), c))


def actr_recall(spark, d):
    return _shown(_recalled(spark, d, replace(C, actr_enabled=True)))


def access_delta(spark, d):
    return recall.access_delta(_recalled(spark, d, C))


def actr_base_level(spark, d):
    """Users' base levels from their last accesses in minutes, scaled over all users."""
    e = t.table(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 60).alias("minute"))
    order = Window.partitionBy("user_id").orderBy(F.col("minute").desc())
    last = e.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= C.actr_max_history)
    held = last.groupBy("user_id").agg(F.sort_array(F.collect_list("minute")).alias("history"), F.max("minute").alias("at"))
    level = held.withColumn("now", e.agg(F.max("minute") + 1).scalar()).select("user_id", base_level(F.col("now"), F.col("history"), F.col("at"), C).alias("level"))
    low, high = level.agg(F.min("level")).scalar(), level.agg(F.max("level")).scalar()
    return level.select("user_id", r6("level", "level"), r6(F.when(high - low > 1e-8, (F.col("level") - low) / (high - low)).otherwise(0.5), "head"))


def tension_split(spark, d):
    return recall.tension(_recalled(spark, d, C), t.memories(spark, d), C).select("query_id", "rank", "mem_id", "role")


def _talk(spark, d):
    """Memories of a talk's turns, and as queries the talk's last words."""
    c = replace(C, sparse_recall_enabled=True)
    rows = t.pairs(spark, d)
    held = ingest.with_norms(ingest.direct_ingest(rows.select("store_id", "turn", "input_text", "output_text"), c, t.DIM))
    state = held.groupBy("store_id").agg((F.max("ts") + 1).alias("now"), F.max_by("key", "ts").alias("context"))
    asked = rows.groupBy("store_id").agg(F.max_by("output_text", "turn").alias("said"), F.min_by("input_text", "turn").alias("first"))
    asked = asked.select(F.col("store_id").alias("query_id"), "store_id", F.concat_ws(" ", "first", "said").alias("text"))
    return c, held, state, asked


def sparse_head_recall(spark, d):
    """All five heads: the words of a query are matched with its store's own index (Eq 19)."""
    c, held, state, asked = _talk(spark, d)
    found = sparse.tfidf_by_store(asked, held)
    scored = recall.multi_head(asked.select("query_id", "store_id", normalized(hash_embed("text")).alias("q")), held, state, c, found)
    return recall.recall(scored, c).select("query_id", "rank", "mem_id", r6("score", "score"))


# Graph


def _edges(spark, d, c=C):
    return edges.build_edges(t.memories(spark, d), c)


def edge_band_join(spark, d):
    return _edges(spark, d).select("store_id", "src", "dst", r6("weight", "weight"))


def edge_displacement(spark, d):
    return _edges(spark, d, replace(C, displacement_edges_enabled=True)).select("store_id", "src", "dst", r6("weight", "weight"))


def edge_degrees(spark, d):
    return edges.degrees(_edges(spark, d))


def neighbors_top3(spark, d):
    return edges.neighbors(_edges(spark, d), 3).select("store_id", "src", "dst", "rank", r6("weight", "weight"))


def graph_counts(spark, d):
    return edges.graph_counts(t.memories(spark, d), _edges(spark, d))


def _activation(mem):
    met = recall.meet(t.centres(mem), mem).select("query_id", "store_id", "mem_id", "strength", cosine("q", "key", "q_norm", "key_norm").alias("sim"))
    return met.select("query_id", "store_id", "mem_id", (F.col("strength") * F.greatest(F.lit(0.0), F.col("sim"))).alias("a0"), "sim")


def _spread(spark, d, c):
    mem = t.memories(spark, d)
    return spread.spread(_activation(mem), edges.build_edges(mem, c), c)


def _spread_shown(spark, d, c):
    return _spread(spark, d, c).select("query_id", "mem_id", r6("activation", "activation"))


def spread_mean_2hop(spark, d):
    return _spread_shown(spark, d, C)


def spread_gcn_sym(spark, d):
    return _spread_shown(spark, d, replace(C, spreading_debias_enabled=True))


def spread_multiscale(spark, d):
    return _spread_shown(spark, d, replace(C, multiscale_enabled=True))


def spread_query_aware(spark, d):
    return _spread_shown(spark, d, replace(C, query_aware_spread_enabled=True))


def spread_and_collect(spark, d):
    return spread.collect(_spread(spark, d, C), C).select("query_id", "rank", "mem_id", r6("activation", "activation"))


def graph_recall(spark, d):
    """Effective query, heads, spreading, threshold: the whole serving path."""
    mem = t.memories(spark, d)
    state = t.state(mem)
    q = recall.effective_query(t.centres(mem), mem, state, C).select("query_id", "store_id", F.col("q_eff").alias("q"))
    scored = recall.multi_head(q, mem, state, C).select("query_id", "store_id", "mem_id", F.col("score").alias("a0"), F.lit(1.0).alias("sim"))
    return spread.collect(spread.spread(scored, edges.build_edges(mem, C), C), C).select("query_id", "rank", "mem_id", r6("activation", "activation"))


def graph_recall_reranked(spark, d):
    """The whole serving path with query-aware spreading, ranked anew by patterns and identities (Eq 20, 23)."""
    c = replace(C, query_aware_spread_enabled=True)
    mem = t.memories(spark, d)
    state, l2 = t.state(mem), _l2(mem)
    q = recall.effective_query(t.centres(mem), mem, state, c).select("query_id", "store_id", F.col("q_eff").alias("q"))
    scored = recall.multi_head(q, mem, state, c).select("query_id", "store_id", "mem_id", F.col("score").alias("a0"), F.col("h1").alias("sim"))
    found = spread.collect(spread.spread(scored, edges.build_edges(mem, c), c), c).withColumnRenamed("activation", "score")
    return _shown(hierarchy.rerank(found, q, l2, _l3(l2), c))


def classic_graph_recall(spark, d):
    """Spreading from strength times similarity, which may be negative."""
    mem = t.memories(spark, d)
    start = recall.meet(t.centres(mem), mem).select("query_id", "store_id", "mem_id", (F.col("strength") * cosine("q", "key", "q_norm", "key_norm")).alias("a0"), F.lit(1.0).alias("sim"))
    return spread.collect(spread.spread(start, edges.build_edges(mem, C), C), C).select("query_id", "rank", "mem_id", r6("activation", "activation"))


def search_report(spark, d):
    mem = t.memories(spark, d)
    net = edges.build_edges(mem, C)
    found = spread.collect(spread.spread(_activation(mem), net, C), C)
    texts = mem.select("store_id", "mem_id", "strength", F.concat(F.lit("said "), F.col("mem_id").cast("string")).alias("input_text"), F.concat(F.lit("replied "), F.col("ts").cast("string")).alias("output_text"))
    return reports.search_report(found.join(texts, ["store_id", "mem_id"]), net)


def feedback_delta(spark, d):
    """Feedback on what each store's centre recalls, the context taken as the response."""
    mem = t.memories(spark, d)
    got = recall.dense_topk(t.centres(mem), mem, 15).withColumn("store_id", F.col("query_id"))
    response = t.state(mem).select(F.col("store_id").alias("query_id"), F.col("context").alias("response"))
    out = decisions.feedback(got, response, mem, C)
    return out.select("store_id", "mem_id", "rank", r6("alignment", "alignment"), "effect", r6("strength", "strength"))


def feedback_edges(spark, d):
    mem = t.memories(spark, d)
    got = recall.dense_topk(t.centres(mem), mem, 15).withColumn("store_id", F.col("query_id"))
    response = t.state(mem).select(F.col("store_id").alias("query_id"), F.col("context").alias("response"))
    changes = decisions.feedback(got, response, mem, C).select("store_id", "mem_id", "rank", "factor")
    return edges.adjust_edges(edges.build_edges(mem, C), changes, C).select("store_id", "src", "dst", r6("weight", "weight"))


# Decisions


def _best(spark, d):
    mem = t.memories(spark, d)
    return decisions.best_match(decisions.signals(mem, C), mem)


def contradiction_flags(spark, d):
    return decisions.contradictions(_best(spark, d), C).select("mem_id", "m_mem_id", r6("kk", "key_sim"), r6("ov", "value_sim"), "contradiction")


def hard_value_drift(spark, d):
    return decisions.drift(_best(spark, d), C, soft=False).select("mem_id", r6(norm("drifted"), "length"), r6(dot("drifted", "e_out"), "to_output"), r6(dot("drifted", "m_value"), "to_value"))


def soft_value_drift(spark, d):
    return decisions.drift(_best(spark, d), C, soft=True).select("mem_id", r6(norm("drifted"), "length"), r6(dot("drifted", "e_out"), "to_output"), r6(dot("drifted", "m_value"), "to_value"))


def multichannel_flags(spark, d):
    mem = t.memories(spark, d)
    best = decisions.best_match(decisions.signals(mem, C), mem).join(t.state(mem).select("store_id", "context"), "store_id").withColumn("m_context", F.when(F.col("m_mem_id") % 3 > 0, F.col("m_key")))
    return decisions.multichannel(best, C).select("mem_id", "m_mem_id", r6("disp_sim", "disp_sim"), r6("ctx_sim", "ctx_sim"), "contradiction")


def attention_entropy(spark, d):
    return decisions.signals(t.memories(spark, d), C).select("mem_id", r6("entropy", "entropy"))


def gate_chain(spark, d):
    mem = t.memories(spark, d)
    c = replace(C, gate_w_entropy=0.1, theta_create=0.45, theta_out_filter=0.5)
    # What comes is compared with the context vector as the turns before have left it (Eq 8).
    states = ingest.context_states(mem.select("store_id", F.col("ts").alias("turn"), F.col("key").alias("e")), c)
    before = states.select("store_id", (F.col("turn") + 1).alias("ts"), "context", norm("context").alias("c_norm"))
    along = mem.join(before, ["store_id", "ts"]).select("store_id", "mem_id", cosine("key", "context", "key_norm", "c_norm").alias("d_ctx"))
    signals = decisions.signals(mem, c).join(along, ["store_id", "mem_id"])
    return decisions.gated(signals, c).select("mem_id", r6("best", "best"), r6("r_out", "r_out"), r6("r_val", "r_val"), r6("d_ctx", "d_ctx"), r6("gate", "gate"), "action")


def soft_decision(spark, d):
    out = decisions.soft_decisions(decisions.signals(t.memories(spark, d), C), C)
    return out.select("mem_id", r6("sharpness", "sharpness"), r6("threshold", "threshold"), r6("cold", "cold"), r6("p_strengthen", "p_strengthen"), "strengthen")


def cold_start_curve(spark, d):
    return t.memories(spark, d).select("store_id", "mem_id", r6(cold_start(F.col("ts") - 1, C), "factor"))


def prospect_delta(spark, d):
    e = t.table(spark, d, "events").select("event_id", (F.col("value") - 50.0).alias("delta"))
    return e.select("event_id", r6(prospect(F.col("delta"), C), "felt"))


def strength_decay(spark, d):
    mem = t.memories(spark, d).join(t.state(t.memories(spark, d)).select("store_id", "now"), "store_id")
    return decisions.decayed(mem, "now", C).select("store_id", "mem_id", r6("strength", "strength"))


def strength_gain(spark, d):
    c = replace(C, prospect_enabled=True)
    return decisions.strengthened(_best(spark, d), c).select("mem_id", r6("gain", "gain"))


# Dialogue


def window_pairs(spark, d):
    return t.pairs(spark, d).select("store_id", "turn", "input_text", "output_text")


def direct_ingest(spark, d):
    out = ingest.direct_ingest(t.pairs(spark, d).select("store_id", "turn", "input_text", "output_text"), C, t.DIM)
    return out.select("store_id", "mem_id", "ts", "strength", r6(dot("key", "value"), "key_value"), r6(norm("key"), "key_length"), "input_text")


def hash_embedding(spark, d):
    rows = t.turns(spark, d).select("store_id", "turn", normalized(hash_embed("text")).alias("e"))
    return _vectors(rows, ["store_id", "turn"], "e")


def context_ema(spark, d):
    states = ingest.context_states(t.pairs(spark, d).select("store_id", "turn", F.col("e_in").alias("e")), C)
    return _vectors(states, ["store_id", "turn"], "context")


def _anchors(spark):
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(C.channel_anchors.items())], "i int, name string, text string")
    return [(r["name"], r["e"]) for r in rows.select("i", "name", normalized(hash_embed("text")).alias("e")).orderBy("i").collect()]


def channel_classify(spark, d):
    rows = t.pairs(spark, d)
    return rows.select("store_id", "turn", recall.classify(rows, _anchors(spark), "e_in").alias("channel"))


def refusal_rate(spark, d):
    rows = t.turns(spark, d).filter("role = 'assistant'")
    return rows.agg(F.count("*").alias("n"), r6(F.avg(is_refusal("text").cast("double")), "refusal_rate"))


def flatten_turns(spark, d):
    """Conversations nested as dialogue samples of two sessions, and unnested again."""
    rows = t.turns(spark, d).withColumn("session", F.when(F.col("turn") < 4, "session_1").otherwise("session_2"))
    lists = rows.groupBy("store_id", "session").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("turns"))
    texts = lists.select("store_id", "session", F.to_json(F.transform("turns", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text"), F.concat(F.lit("D"), x["turn"].cast("string")).alias("dia_id"), F.when(x["turn"] == 1, "a chart").alias("blip_caption")))).alias("json"))
    nested = texts.groupBy(F.col("store_id").alias("sample_id")).agg(F.map_from_entries(F.collect_list(F.struct("session", "json"))).alias("m"))
    part = lambda s: F.concat(F.lit(f'"{s}":'), F.coalesce(F.col("m")[s], F.lit("[]")))
    samples = nested.select("sample_id", F.concat(F.lit('{"session_1_date_time":"day one",'), part("session_1"), F.lit(","), part("session_2"), F.lit("}")).alias("conversation"))
    return ingest.flatten_turns(samples)


def update_fold(spark, d):
    return update.actions(t.pairs(spark, d), replace(C, theta_create=0.75, theta_key=0.7, theta_value=0.5, theta_ctx_gate=0.5, theta_out_filter=0.9)).select("store_id", "turn", "action", "mem_id", r6("best_sim", "best_sim"), r6("gate", "gate"))


def update_actions(spark, d):
    out = update_fold(spark, d).groupBy("action").count()
    return out.select("action", F.col("count").alias("n"))


def updated_memories(spark, d):
    c = replace(C, theta_create=0.75, theta_key=0.7, theta_value=0.5, theta_ctx_gate=0.5, theta_out_filter=0.9, actr_enabled=True)
    return update.memories(t.pairs(spark, d), c).select("store_id", "mem_id", "ts", "access_count", r6("strength", "strength"))


# Lexical


def tfidf_cosine(spark, d):
    out = sparse.tfidf_cosine(t.benchmark(spark, d), t.documents(spark, d))
    return out.select("query_id", "mem_id", r6("sparse", "sparse"))


def bm25_topk(spark, d):
    scored = sparse.bm25(t.benchmark(spark, d), t.documents(spark, d), C).withColumn("score", F.round("bm25", 6))
    return recall.ranked(scored, "score", C.top_k).select("query_id", "rank", "mem_id", "score")


def hybrid_topk(spark, d):
    docs, asked = t.documents(spark, d), t.benchmark(spark, d)
    scored = sparse.bm25(asked, docs, C)
    one = F.lit(0).cast("long").alias("store_id")
    left = asked.select("query_id", one, normalized(hash_embed("text")).alias("q"))
    right = docs.select("mem_id", one, normalized(hash_embed("text")).alias("key"))
    # Every document is a candidate of every query, in blocks; without a common term bm25 is zero.
    every = recall.in_blocks(left, right, None).withColumnRenamed("score", "dense")
    met = every.join(scored, ["query_id", "mem_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    both = met.withColumns({"d": sparse.minmax(met, "dense"), "b": sparse.minmax(met, "bm25")})
    both = both.withColumn("score", F.round(F.col("d") + C.hybrid_weight * F.col("b"), 6))
    return recall.ranked(both, "score", C.top_k).select("query_id", "rank", "mem_id", "score")


def document_frequency(spark, d):
    return sparse.document_frequency(sparse.postings(t.documents(spark, d)))


# Hierarchy


def _l2(mem):
    grouped = mem.withColumn("part", F.col("ts") % 4)
    out = hierarchy.centroids(grouped, ["store_id", "part"], t.DIM)
    return out.withColumn("l2_id", F.col("store_id") * 4 + F.col("part")).drop("part")


def _l3(l2):
    out = hierarchy.centroids(l2.withColumn("mem_id", F.col("l2_id")).withColumn("part", F.col("l2_id") % 2).drop("children"), ["store_id", "part"], t.DIM)
    return out.withColumn("l3_id", F.col("store_id") * 2 + F.col("part")).drop("part")


def l2_centroids(spark, d):
    return _vectors(_l2(t.memories(spark, d)), ["store_id", "l2_id"], "key")


def l3_centroids(spark, d):
    return _vectors(_l3(_l2(t.memories(spark, d))), ["store_id", "l3_id"], "value")


def hierarchical_rerank(spark, d):
    mem = t.memories(spark, d)
    l2 = _l2(mem)
    got = _recalled(spark, d, C).drop("h1")
    return _shown(hierarchy.rerank(got, t.as_queries(mem), l2, _l3(l2), C))


def l2_summary(spark, d):
    mem = t.memories(spark, d)
    named = mem.withColumn("input_text", F.concat(F.lit("memory "), F.col("mem_id").cast("string")))
    return hierarchy.l2_summary(_l2(mem), named).select("l2_id", r6("strength", "strength"), "n", "texts")


def greedy_clusters(spark, d):
    return hierarchy.greedy_clusters(t.memories(spark, d), replace(C, theta_cluster=0.15, min_cluster_size=2))


def consolidate(spark, d):
    """Patterns and identities that form by themselves, with their members' number."""
    l2, l3 = hierarchy.consolidate(t.memories(spark, d), replace(C, theta_cluster=0.15, min_cluster_size=2, theta_identity=0.05), t.DIM)
    shown = lambda df, name, level: df.select("store_id", F.lit(level).alias("level"), F.col(name).alias("group_id"), F.size("children").alias("n"), r6("strength", "strength"))
    return shown(l2, "l2_id", 2).unionByName(shown(l3, "l3_id", 3))


def merged_children(spark, d):
    """Runs of five memories, absorbed by the patterns that hold enough of them."""
    mem = t.memories(spark, d)
    runs = mem.groupBy("store_id", F.floor(F.col("ts") / 5).alias("cluster")).agg(F.sort_array(F.collect_list("mem_id")).alias("children"))
    out = hierarchy.absorb(_l2(mem).select("store_id", F.col("l2_id"), "children"), runs)
    return out.select("store_id", "l2_id", "cluster", F.size("children").alias("n"), F.array_min("children").alias("least"), F.array_max("children").alias("most"))


def shared_merge(spark, d):
    mem = t.memories(spark, d)
    own = recall.dense_topk(t.centres(mem), mem, C.top_k)
    other = t.centres(mem).withColumn("store_id", (F.col("store_id") + 1) % 10)
    return hierarchy.shared_merge(own, recall.dense_topk(other, mem, C.top_k), C).select("query_id", "rank", "mem_id", "origin", r6("score", "score"))


# Evaluation


def _gold(mem):
    """Evidence of a query: the memory that follows it."""
    return mem.select("store_id", F.col("ts"), F.col("mem_id")).join(mem.select("store_id", (F.col("ts") + 1).alias("ts"), F.col("mem_id").alias("query_id")), ["store_id", "ts"]).select("query_id", "mem_id")


def _asked(mem):
    return mem.select(F.col("mem_id").alias("query_id"), (F.col("mem_id") % 5).alias("category"))


def _hits(spark, d):
    mem = t.memories(spark, d)
    got = recall.ranked(_multi(spark, d, C, 12), "score", 12)
    return evaluation.hits(got, _gold(mem), _asked(mem))


def recall_at_k(spark, d):
    return _hits(spark, d).agg(F.count("*").alias("n"), r6(F.avg("hit"), "recall"))


def recall_by_category(spark, d):
    return evaluation.by_category(_hits(spark, d), "hit").select("category", "n", r6("mean", "recall"))


def budget_sweep(spark, d):
    mem = t.memories(spark, d)
    return evaluation.budget_sweep(recall.ranked(_multi(spark, d, C, max(BUDGETS)), "score", max(BUDGETS)), _gold(mem), _asked(mem), BUDGETS).select("k", "n", r6("gold_share", "gold_share"))


def mcnemar_exact(spark, d):
    rows = t.table(spark, d, "labels")
    return evaluation.mcnemar(rows, "quality", "toxic").select("n01", "n10", r6("p", "p"))


def mcnemar_recall(spark, d):
    mem = t.memories(spark, d)
    dense = evaluation.hits(recall.dense_topk(t.as_queries(mem), mem, 12), _gold(mem), _asked(mem)).select("query_id", F.col("hit").alias("dense"))
    both = _hits(spark, d).join(dense, "query_id")
    return evaluation.mcnemar(both, "dense", "hit").select("n01", "n10", r6("p", "p"))


def token_f1(spark, d):
    return evaluation.token_f1(t.pairs(spark, d), "output_text", "input_text", "f1").select("store_id", "turn", r6("f1", "f1"))


def stemmed_f1(spark, d):
    return evaluation.stemmed_f1(t.pairs(spark, d), "output_text", "input_text", "f1").select("store_id", "turn", r6("f1", "f1"))


def score_answers(spark, d):
    rows = t.pairs(spark, d).select((F.col("store_id") * 100 + F.col("turn")).alias("q_id"), F.col("output_text").alias("prediction"), F.col("input_text").alias("answer"), (F.col("turn") % 5 + 1).cast("int").alias("category"))
    return evaluation.score_answers(rows, "q_id", stems=False).select("q_id", "category", r6("score", "score"))


def score_stemmed_answers(spark, d):
    """As score_answers, on stems, which SQL has no function for."""
    rows = t.pairs(spark, d).select((F.col("store_id") * 100 + F.col("turn")).alias("q_id"), F.col("output_text").alias("prediction"), F.col("input_text").alias("answer"), (F.col("turn") % 5 + 1).cast("int").alias("category"))
    return evaluation.score_answers(rows, "q_id").select("q_id", "category", r6("score", "score"))


def _results(spark, d):
    """Scored answers of an evaluation: each turn's reply as the prediction of what was said."""
    rows = evaluation.token_f1(t.pairs(spark, d), "output_text", "input_text", "f1")
    return rows.select("store_id", (F.col("turn") % 5 + 1).cast("int").alias("category"), "f1", (F.col("f1") >= 0.1).cast("int").alias("judge"), (F.col("turn") % 4).alias("num_recalled"), (F.col("turn") % 2 == 0).alias("gold_present"))


def evaluation_summary(spark, d):
    return evaluation.summary(_results(spark, d))


def evaluation_report(spark, d):
    return reports.evaluation_report(evaluation.summary(_results(spark, d)), evaluation.ingest_stats(gate_chain(spark, d).select((F.col("mem_id") % 10).alias("store_id"), "action")))


def ingest_stats(spark, d):
    out = evaluation.ingest_stats(gate_chain(spark, d).select((F.col("mem_id") % 10).alias("store_id"), "action"))
    return out.select("stores", r6("avg_memories", "avg_memories"), r6("filtered_pct", "filtered_pct"))


def operating_curve(spark, d):
    """Means by budget: a question is judged right where its gold evidence is in the budget, an adversarial one where it is refused."""
    mem = t.memories(spark, d)
    got = recall.dense_topk(t.as_queries(mem), mem, max(BUDGETS))
    first = got.join(_gold(mem), ["query_id", "mem_id"], "left_semi").groupBy(F.col("query_id").alias("q_id")).agg(F.min("rank").alias("first"))
    asked = mem.select(F.col("mem_id").alias("q_id"), (F.col("mem_id") % 5 + 1).cast("int").alias("category"), F.explode(F.array(*map(F.lit, [0, *BUDGETS]))).alias("k"))
    asked = asked.join(first, "q_id", "left").withColumn("found", F.coalesce(F.col("first") <= F.col("k"), F.lit(False)))
    refused = ~F.col("found") & ((F.col("q_id") + F.col("k")) % 3 == 0)
    judge = F.when(F.col("q_id") % 89 != 0, F.when(F.col("category") == 5, refused).otherwise(F.col("found")).cast("int"))
    return evaluation.operating_curve(asked.select("q_id", "k", "category", judge.alias("judge"), refused.alias("refused")), first)


def joined_categories(spark, d):
    """Samples of two kinds of questions as one."""
    rows = t.turns(spark, d).filter("role = 'user'").select("store_id", "turn", "text")
    first, second = rows.filter("turn % 4 = 0").withColumn("kind", F.lit("opening")), rows.filter("turn % 4 <> 0").drop("text").withColumn("kind", F.lit("follow-up"))
    return evaluation.joined_categories(first, second).select("store_id", "turn", "kind", F.length("text").alias("n"))


def stratified_sample(spark, d):
    rows = t.documents(spark, d)
    return evaluation.stratified_sample(rows, "lang", F.md5(F.concat(F.col("mem_id").cast("string"), F.lit(":0"))), SAMPLE).select("lang", "mem_id")


def evidence_ids(spark, d):
    """Turns found again by their text; copies find the last one."""
    rows = t.turns(spark, d)
    known = rows.withColumn("dia_id", F.concat(F.lit("D"), F.col("turn").cast("string")))
    return evaluation.evidence_ids(rows.select("store_id", F.col("turn").alias("asked"), "text"), known).select("store_id", "asked", "dia_id")


def capped_questions(spark, d):
    rows = t.turns(spark, d).filter("role = 'user'")
    return evaluation.capped(rows, 2, "store_id", "turn").select("store_id", "turn")


def matched_results(spark, d):
    """Dense and multi-head hits side by side, the second run lacking one category."""
    mem = t.memories(spark, d)
    dense = evaluation.hits(recall.dense_topk(t.as_queries(mem), mem, 12), _gold(mem), _asked(mem))
    both = evaluation.matched(dense, _hits(spark, d).filter("category <> 4"), ["query_id"], "hit")
    return both.agg(F.count("*").alias("n"), F.sum(F.col("b").isNull().cast("long")).alias("unmatched"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("same"))


# Reports


def strength_summary(spark, d):
    return reports.strength_summary(t.memories(spark, d)).select("store_id", "n", r6("mean", "mean"), "most", "least", r6("median", "median"))


def strength_histogram(spark, d):
    return reports.strength_histogram(t.memories(spark, d))


def top_bottom_strength(spark, d):
    return reports.top_and_bottom(t.memories(spark, d)).select("store_id", "part", "place", "mem_id", "strength")


def _texts(spark, d):
    got = _recalled(spark, d, C)
    mem = t.memories(spark, d).select("store_id", "mem_id", "strength", F.concat(F.lit("said "), F.col("mem_id").cast("string")).alias("input_text"), F.concat(F.lit("replied "), F.col("ts").cast("string")).alias("output_text"), F.when(F.col("mem_id") % 3 == 0, "fact").when(F.col("mem_id") % 3 == 1, "hobby").otherwise("").alias("category"))
    return got.join(mem, ["store_id", "mem_id"])


def prompt_format(spark, d):
    return reports.prompt(_texts(spark, d))


def channel_format(spark, d):
    return reports.channel_prompt(_texts(spark, d))


def tension_format(spark, d):
    roles = recall.tension(_recalled(spark, d, C), t.memories(spark, d), C).select("query_id", "mem_id", "role")
    return reports.tension_prompt(_texts(spark, d).join(roles, ["query_id", "mem_id"]))


def memory_list(spark, d):
    mem = t.memories(spark, d).withColumns({"input_text": F.concat(F.lit("said "), F.col("mem_id").cast("string")), "access_count": F.col("ts") % 3})
    return reports.memory_list(mem)


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_") and f.__name__ != "r6"}
