"""The update cycle, clustering, serving and caches against plain Python."""

import math
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.operators import edges, evaluation, hierarchy, ingest, update
from palimpsest.plans import queries, tables
from palimpsest.session import MemorySession, enable_memory
from palimpsest.sources import dialogues, snapshots

C = Config()


def cos(a, b):
    na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
    return 0.0 if na < 1e-8 or nb < 1e-8 else sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb)


def one(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 1e-8 else list(v)


def brute_fold(c, turns):
    """Actions and memories of turns (e_in, e_out, said) by lists and loops, without any of the engine's code."""
    mem, context, out = [], None, []
    for step, (e_in, e_out, said) in enumerate(turns, 1):

        def make(strength):
            for m in mem:
                span = math.exp(-abs(step - m["ts"]) / c.tau_temporal)
                alike = c.alpha_k * cos(e_in, m["key"]) + c.alpha_v * cos(e_out, m["value"])
                if c.displacement_edges_enabled:
                    a, b = (one([y - x for x, y in zip(k, v, strict=True)]) for k, v in ((e_in, e_out), (m["key"], m["value"])))
                    alike = (alike + c.alpha_d * cos(a, b)) / (c.alpha_k + c.alpha_v + c.alpha_d)
                m["near"] = alike * span >= c.theta_edge
            for m in mem:
                if m["near"] and cos(e_out, m["value"]) < c.theta_value:
                    m["value"] = [x + c.initial_bias * (y - x) for x, y in zip(m["value"], e_out, strict=True)]
                    m["strength"] *= c.delta_graph
            mem.append({"key": e_in, "value": e_out, "strength": strength, "ts": step, "uses": 0, "said": said, "context": context})
            return len(mem) - 1

        for m in mem:
            m["strength"] *= c.gamma
        along = 0.0 if context is None else cos(e_in, context)
        context = e_in if context is None else one([c.lambda_context * x + (1 - c.lambda_context) * y for x, y in zip(context, e_in, strict=True)])
        cold = 1 + c.cold_start_kappa * math.exp(-len(mem) / c.cold_start_tau) if c.cold_start_enabled else 1.0
        if not mem:
            out.append(("created", make(cold), None, None))
            continue
        sims = [cos(e_in, m["key"]) for m in mem]
        best = max(sims)
        at = sims.index(best)
        p = 1.0 if best >= c.theta_create else 0.0
        if c.soft_decisions_enabled:
            sharp = c.beta_soft_min + (c.beta_soft_max - c.beta_soft_min) * min(len(mem) / c.n_mature, 1)
            threshold = c.theta_soft_base + c.beta_theta_density * sum(s > c.theta_density_neighbor for s in sims) / len(sims)
            p = 1 / (1 + math.exp(-sharp * (best - threshold)))
        if p >= 0.5:
            m = mem[at]
            gain = c.alpha * best * cold * (p if c.soft_decisions_enabled else 1)
            if c.prospect_enabled and gain:
                gain = gain**c.prospect_rho if gain > 0 else -c.prospect_lambda_loss * (-gain) ** c.prospect_rho
            m["strength"] += gain
            m["ts"], m["uses"] = step, m["uses"] + 1
            against = False
            if best >= c.theta_key:
                if c.multichannel_enabled:
                    a, b = (one([y - x for x, y in zip(k, v, strict=True)]) for k, v in ((m["key"], m["value"]), (e_in, e_out)))
                    ctx = 0.5 if m["context"] is None else cos(context, m["context"])
                    against = c.w_channel_topic * best + c.w_channel_disp * cos(a, b) + c.w_channel_ctx * ctx < c.theta_multichannel
                else:
                    against = cos(m["value"], e_out) < c.theta_value
            by = c.initial_bias if against else c.initial_bias * (1 - cos(m["value"], e_out))
            m["value"] = one([x + by * (y - x) for x, y in zip(m["value"], e_out, strict=True)])
            if against:
                m["strength"] *= c.delta
                make(1.0)
            out.append(("contradiction" if against else "strengthened", at, best, None))
            continue
        echo, same = [cos(e_out, m["key"]) for m in mem], max(cos(e_out, m["value"]) for m in mem)
        if max(echo) >= c.theta_out_filter:
            out.append(("filtered", None, best, 0.0))
            continue
        run = min((along - c.theta_ctx_gate) / (1 - c.theta_ctx_gate + 1e-8), 1) ** c.ctx_power if along > c.theta_ctx_gate else 0.0
        h = 0.0
        if len(mem) > 1 and c.gate_w_entropy:
            e = [math.exp(x / c.entropy_temperature) for x in echo]
            h = -sum(x / sum(e) * math.log(x / sum(e)) for x in e) / math.log(len(e))
        news = max(0.0, min(1.0, 1 - best - c.gate_w_out * max(echo) - c.gate_w_val * same - c.gate_w_ctx * run - c.gate_w_entropy * h))
        gate = 1 / (1 + math.exp(-c.beta_gate * (news - c.theta_gate)))
        if gate < c.theta_min_gate:
            out.append(("filtered", None, best, gate))
        else:
            out.append(("created", make(gate * cold * ((1 - p) if c.soft_decisions_enabled else 1)), best, gate))
    return out, mem


def close(a, b):
    return all((x is None) == (y is None) and (x == y if isinstance(x, str) or x is None else abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True))


def test_update_queries_by_brute_force(spark, sf_dir):
    """update_fold, update_actions and updated_memories over all conversations."""
    d = sf_dir.replace("sf0.001", "sf0.01")
    c = replace(tables.CONFIG, theta_create=0.75, theta_key=0.7, theta_value=0.5, theta_ctx_gate=0.5, theta_out_filter=0.9)
    stores = {}
    for r in tables.pairs(spark, d).orderBy("store_id", "turn").collect():
        stores.setdefault(r.store_id, []).append(r)
    want = {s: brute_fold(c, [(r.e_in, r.e_out, r.input_text) for r in rows]) for s, rows in stores.items()}
    acts = {(s, r.turn): a for s, rows in stores.items() for r, a in zip(rows, want[s][0], strict=True)}
    got = queries.update_fold(spark, d).collect()
    assert len(got) == len(acts) and all(close((r.action, r.mem_id, r.best_sim, r.gate), acts[r.store_id, r.turn]) for r in got)
    names = [a[0] for a in acts.values()]
    assert {r.action: r.n for r in queries.update_actions(spark, d).collect()} == {x: names.count(x) for x in set(names)}
    held = queries.updated_memories(spark, d).collect()
    assert len(held) == sum(len(m) for _, m in want.values())
    for r in held:
        m = want[r.store_id][1][r.mem_id]
        assert close((r.ts, r.access_count, r.strength), (m["ts"], m["uses"], m["strength"]))


@pytest.mark.parametrize("flags", [{}, {"soft_decisions_enabled": True, "cold_start_enabled": True}, {"multichannel_enabled": True, "prospect_enabled": True, "displacement_edges_enabled": True}, {"gate_w_entropy": 0.2, "theta_value": -0.2}])
def test_fold_with_flags_by_brute_force(flags):
    rng = np.random.default_rng(4)
    topics = rng.normal(size=(6, 16))
    turns = []
    for k in range(120):
        e = [one((topics[rng.integers(6)] + 0.5 * rng.normal(size=16)).tolist()) for _ in range(2)]
        turns.append((*e, f"said {k}"))
    c = replace(C, theta_create=0.8, theta_key=0.75, theta_edge=0.05, theta_min_gate=0.3) if not flags.get("theta_value") else replace(C, theta_create=0.8)
    c = replace(c, **flags)
    want, held = brute_fold(c, turns)
    layer = update.Layer(c)
    got = [layer.update(np.array(a), np.array(b), said, "") for a, b, said in turns]
    assert all(close(x, y) for x, y in zip(got, want, strict=True))
    assert len({x[0] for x in want}) >= 3
    for row, m in zip(layer.rows, held, strict=True):
        assert row["input_text"] == m["said"] and row["strength"] == pytest.approx(m["strength"]) and row["value"] == pytest.approx(m["value"]) and row["ts"] == m["ts"]


def brute_clusters(keys, theta, least, checked):
    spent, out = set(), []
    for i in range(len(keys)):
        if i in spent:
            continue
        group = [i] + [j for j in range(len(keys)) if j != i and j not in spent and sum(x * y for x, y in zip(keys[i], keys[j], strict=True)) > theta]
        if len(group) < least:
            spent |= set() if checked else set(group)
            continue
        spent |= set(group)
        pairs = [sum(x * y for x, y in zip(keys[a], keys[b], strict=True)) for n, a in enumerate(group) for b in group[n + 1 :]]
        if not checked or not pairs or sum(pairs) / len(pairs) >= theta:
            out.append(group)
    return out


def test_cluster_queries_by_brute_force(spark, sf_dir):
    """greedy_clusters and consolidate over all stores."""
    stores = {}
    for r in tables.memories(spark, sf_dir).orderBy("mem_id").collect():
        stores.setdefault(r.store_id, []).append(r)
    want, groups = set(), set()
    for s, rows in stores.items():
        found = brute_clusters([r.key for r in rows], 0.15, 2, True)
        want |= {(s, k, rows[i].mem_id) for k, g in enumerate(found) for i in g}
        mean = lambda g, rows=rows: one([sum(rows[i].strength * rows[i].key[d] for i in g) for d in range(64)])
        upper = brute_clusters([mean(g) for g in found], 0.05, 2, False)
        weight = [sum(rows[i].strength for i in g) for g in found]
        groups |= {(s, 2, k, len(g), round(weight[k], 6)) for k, g in enumerate(found)} | {(s, 3, k, len(g), round(sum(weight[i] for i in g), 6)) for k, g in enumerate(upper)}
    assert {(r.store_id, r.cluster, r.mem_id) for r in queries.greedy_clusters(spark, sf_dir).collect()} == want and want
    assert {(r.store_id, r.level, r.group_id, r.n, r.strength) for r in queries.consolidate(spark, sf_dir).collect()} == groups
    assert {x[1] for x in groups} == {2, 3}


def test_stemmed_queries_by_a_table_of_stems(spark):
    """Answers that share words only by their stems; the stems are those of the algorithm's published examples."""
    rows = [(1, "relational hoping", "relate hope", 2), (2, "the conditional, feudalism", "conditions, feudal", 1), (3, "hopping", "hop; else", 3), (4, "goodness", "good", 4), (5, "formality", "form", 4)]
    df = spark.createDataFrame(rows, "q_id int, prediction string, answer string, category int")
    got = {r.q_id: r.score for r in evaluation.score_answers(df, "q_id").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 0.0}
    plain = {r.q_id: r.score for r in evaluation.score_answers(df, "q_id", stems=False).collect()}
    assert plain == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_feedback_of_two_queries_on_one_memory(spark):
    net = spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 0, 0.5), (1, 2, 3, 0.11), (1, 3, 2, 0.11)], "store_id long, src long, dst long, weight double")
    changes = spark.createDataFrame([(9, 1, 0, 1, 1.1), (4, 1, 0, 3, 0.9), (4, 1, 1, 1, 0.9), (4, 1, 2, 2, 0.9), (9, 1, 3, 2, 1.1)], "query_id long, store_id long, mem_id long, rank int, factor double")
    got = {(r.src, r.dst): r.weight for r in edges.adjust_edges(net, changes, C).collect()}
    assert got == {(0, 1): pytest.approx(0.5 * 0.9 * 0.9 * 1.1), (1, 0): pytest.approx(0.5 * 0.9 * 0.9 * 1.1)}


def test_mcnemar_of_many_pairs(spark):
    from math import comb

    for a, b in ((1400, 1500), (1001, 1001), (5, 4000), (0, 40)):
        df = spark.range(a + b).select((F.col("id") < a).cast("int").alias("x"), (F.col("id") >= a).cast("int").alias("y"))
        r = evaluation.mcnemar(df, "x", "y").first()
        n, m = a + b, min(a, b)
        exact = min(1.0, float(2 * sum(comb(n, i) for i in range(m + 1)) / 2**n)) if n < 1000 or m < 10 else min(1.0, 2 * sum(comb(n, i) for i in range(m + 1)) / 2**n)
        assert r.p == pytest.approx(exact, rel=1e-8, abs=1e-300)


def test_category_union_and_preset(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, text string"), spark.createDataFrame([(2,), (2,)], "id int")
    got = [(r.id, r.text) for r in evaluation.joined_categories(a, b).collect()]
    assert sorted(got, key=str) == [(1, "x"), (2, None), (2, None)]
    c = Config.full(top_k=7)
    assert c.top_k == 7 and c.feedback_enabled and c.hierarchy_enabled and not c.transcript_ingest and not c.spreading_debias_enabled


def test_embedding_cache(spark, tmp_path):
    path, log = str(tmp_path / "cache"), str(tmp_path / "log")

    def model(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    first = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, "b")], "i int, text string")
    assert {r.i: r.e for r in dialogues.embedded(first, path, model, "e").collect()} == {1: [2.0, 1.0], 2: [2.0, 1.0], 3: None, 4: [1.0, 1.0]}
    again = spark.createDataFrame([(1, "b"), (2, "ccc")], "i int, text string")
    assert {r.i: r.e for r in dialogues.embedded(again, path, model, "e").collect()} == {1: [1.0, 1.0], 2: [3.0, 1.0]}
    assert sorted(open(log).read().split()) == ["aa", "b", "ccc"]


# The running memory

TALK = ["the ferry to the island leaves at nine", "our ferry ticket has the number 40417", "a ferry sails past the island at nine", "my sister keeps bees behind the barn", "the bees behind the barn make dark honey", "honey from my sister is dark this year", "the island ferry was late again today", "we planted beans beside the barn wall"]
ANSWERS = ["so it leaves the island at nine", "the number 40417 is noted", "past the island then", "bees behind a barn", "dark honey it is", "a dark year of honey", "late ferry again", "beans beside the wall"]


def talked(spark, path, config, parts=1, recalled=None):
    """A session that has observed the talk in some parts, each followed by a snapshot."""
    session = MemorySession(spark, str(path), config)
    rows = [(1, k, said, replied, (recalled or {}).get(k)) for k, (said, replied) in enumerate(zip(TALK, ANSWERS, strict=True))]
    rows += [(2, k, r[3], r[2], None) for k, r in enumerate(rows[:4])]
    for part in np.array_split(np.arange(len(rows)), parts):
        session.observe(spark.createDataFrame([rows[k] for k in part], "store_id long, turn long, input_text string, output_text string, recalled array<long>"))
        session.snapshot()
    return session


def strengths(session):
    held, _ = snapshots.load(session.spark, f"{session.path}/snapshots")
    return {(r.store_id, r.mem_id): r.strength for r in held["memories"].collect()}, held


BASE = Config(theta_min_gate=0.0, theta_out_filter=1.1, theta_create=0.95, theta_cluster=0.3, min_cluster_size=2, theta_identity=0.1, consolidate_every=4)


def test_snapshots_go_on_where_the_last_one_ended(spark, tmp_path):
    config = replace(BASE, hierarchy_enabled=True, feedback_enabled=True)
    whole, held = strengths(talked(spark, tmp_path / "a", config, recalled={5: [0, 3]}))
    parts, also = strengths(talked(spark, tmp_path / "b", config, parts=3, recalled={5: [0, 3]}))
    assert whole == parts and len(whole) == 12
    for name in ("edges", "l2", "l3", "layer_state"):
        key = [c for c in held[name].columns if c not in ("key", "value", "context_vector")]
        assert sorted(map(tuple, held[name].select(*key).collect())) == sorted(map(tuple, also[name].select(*key).collect()))
    kept = [p.name for p in (tmp_path / "b" / "snapshots").iterdir() if p.is_dir()]
    assert len(kept) == 2  # the last version and the one before


def test_each_flag_of_serving_changes_the_result(spark, tmp_path):
    plain, _ = strengths(talked(spark, tmp_path / "plain", BASE, recalled={7: [0, 3]}))
    told, _ = strengths(talked(spark, tmp_path / "told", replace(BASE, feedback_enabled=True, theta_align=0.4, theta_misalign=0.39), recalled={7: [0, 3]}))
    assert {k for k in plain if plain[k] != told[k]} == {(1, 0), (1, 3)}
    session = talked(spark, tmp_path / "tree", replace(BASE, hierarchy_enabled=True))
    _, held = strengths(session)
    assert held["l2"].filter("store_id = 1").count() >= 1
    rare = talked(spark, tmp_path / "rare", replace(BASE, hierarchy_enabled=True, consolidate_every=100))
    assert strengths(rare)[1]["l2"].count() == 0
    asked = spark.createDataFrame([(0, 1, "which number has the ferry ticket 40417")], "query_id long, store_id long, text string")

    def scores(config):
        session.config = config
        return {r.mem_id: round(r.score, 9) for r in session.recall(asked, 1).collect()}

    base, lexical, tree = scores(BASE), scores(replace(BASE, sparse_recall_enabled=True)), scores(replace(BASE, hierarchy_enabled=True))
    assert base and set(base) == set(lexical) == set(tree) and base != tree
    share = lambda x: x[1] / sum(x.values())  # noqa: E731  the one memory that has the query's rare words
    assert share(lexical) > share(base)


def test_recall_of_one_store_reads_one_bucket(spark, tmp_path):
    session = talked(spark, tmp_path / "m", BASE)
    held = session._tables(1)["memories"]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(store_id), EqualTo(store_id,1)]" in plan
    assert {r.store_id for r in held.collect()} == {1}
    folders = {f.split("/bucket=")[1].split("/")[0] for f in held.inputFiles()} if held.inputFiles() else set()
    assert len(folders) <= 2


def test_client_gives_feedback_and_recalls_new_turns(spark, tmp_path):
    session = MemorySession(spark, str(tmp_path / "c"), replace(BASE, feedback_enabled=True), snapshot_every=2)
    seen = []
    client = SimpleNamespace(responses=SimpleNamespace(create=lambda **kw: seen.append(kw) or SimpleNamespace(output_text=ANSWERS[(len(seen) - 1) % 8])))
    enable_memory(client, session, 3)
    for said in TALK[:4]:
        client.responses.create(input=said)
    assert "instructions" not in seen[1] and TALK[0] in seen[2]["instructions"]
    noted = {r.turn: r.recalled for r in spark.read.parquet(f"{session.path}/turns").collect()}
    assert not noted[0] and not noted[1] and set(noted[2]) <= {0, 1} and noted[2]


def test_derived_tables_are_made_again_from_memories(spark, tmp_path):
    session = talked(spark, tmp_path / "r", replace(BASE, hierarchy_enabled=True))
    held = strengths(session)[1]
    again = snapshots.rebuild({"memories": held["memories"]}, session.config, 64)
    want = edges.build_edges(ingest.with_norms(held["memories"]), session.config)
    assert again["edges"].count() == want.count() and again["l2"].count() >= held["l2"].count() > 0
    assert hierarchy.consolidate(ingest.with_norms(held["memories"]), session.config, 64)[1].count() == again["l3"].count()
