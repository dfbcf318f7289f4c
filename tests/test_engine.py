"""Properties of the engine's operators, and exact values on hand-made inputs."""

import json
import math
import os
import warnings
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.functions import scoring, text
from palimpsest.functions.vectors import cosine, normalized
from palimpsest.operators import decisions, edges, evaluation, hierarchy, ingest, recall, reports, sparse, spread, update
from palimpsest.sources import dialogues, snapshots
from palimpsest.streaming.updates import update_stream, windowed_counts

C = Config()


def unit(rng, d=64):
    v = rng.normal(size=d)
    return v / np.linalg.norm(v)


def stored(spark, rows):
    """memories of (mem_id, ts, key, value, strength) in store 1."""
    data = [(1, i, t, [float(x) for x in k], [float(x) for x in v], float(s)) for i, t, k, v, s in rows]
    return ingest.with_norms(spark.createDataFrame(data, "store_id long, mem_id long, ts long, key array<double>, value array<double>, strength double"))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Expressions


def test_cosine_and_normalisation_of_zero(spark):
    rows = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert rows.select(cosine("a", "b")).first()[0] == 0.0
    assert rows.select(normalized("a")).first()[0] == [0.0, 0.0]


def test_prospect(spark):
    gain, loss, zero = (value(spark, scoring.prospect(F.lit(x), C)) for x in (0.5, -0.5, 0.0))
    assert gain == pytest.approx(0.5**0.88) and loss == pytest.approx(-2.25 * 0.5**0.88) and zero == 0 and -loss > gain


def test_gate_opens_for_news_and_closes_for_echoes(spark):
    gate = lambda *x, c=C: value(spark, scoring.input_gate(*[None if v is None else F.lit(v) for v in x], c))
    assert gate(0.1, 0.0, 0.0, 0.1, 0.0) > 0.5 > gate(0.9, 0.9, 0.9, 0.9, 0.0)
    assert gate(0.2, 0.0, 0.9, 0.2, 0.0) < gate(0.2, 0.0, 0.0, 0.2, 0.0)
    assert gate(0.2, 0.0, 0.9, 0.2, 0.0, c=replace(C, transcript_ingest=True)) == pytest.approx(gate(0.2, 0.0, 0.0, 0.2, 0.0))
    assert gate(0.3, 0.0, 0.0, None, 0.0) == pytest.approx(1 / (1 + math.exp(-6 * (0.7 - 0.4))))


def test_adaptive_curves(spark):
    assert value(spark, scoring.cold_start(F.lit(0), C)) == pytest.approx(4.0)
    assert value(spark, scoring.sharpness(F.lit(1000.0), C)) == 20.0
    assert value(spark, scoring.effective_k(F.lit(1.0), C)) == 5 and value(spark, scoring.effective_k(F.lit(-1.0), C)) == 10
    assert value(spark, scoring.base_level(F.lit(10), F.array(F.lit(6), F.lit(9)), F.lit(9), C)) == pytest.approx(math.log(4**-0.5 + 1))


def test_text(spark):
    assert value(spark, text.normalize_answer(F.lit("The  cat, and a Dog's (tail)!"))) == "cat dogs tail"
    assert value(spark, text.tokens(F.lit("Été 2a-b"))) == ["t", "2a", "b"]
    assert sum(value(spark, text.hash_embed(F.lit("a b a")))) == 3.0
    assert [text.porter_stem(w) for w in ("caresses", "ponies", "cats", "agreed", "plastered", "motoring", "hopping", "filing", "happy", "relational", "triplicate", "hopeful", "adjustable", "adoption", "rate", "controll", "sky")] == ["caress", "poni", "cat", "agre", "plaster", "motor", "hop", "file", "happi", "relat", "triplic", "hope", "adjust", "adopt", "rate", "control", "sky"]


# Graph


def test_edges_of_alike_and_of_distant_memories(spark):
    k = np.eye(64)
    rows = [(0, 1, k[0], k[1], 1.0), (1, 1, k[0], k[1], 1.0), (2, 6, k[0], k[1], 1.0), (3, 100, k[0], k[1], 1.0), (4, 2, k[32], k[33], 1.0)]
    got = {(r.src, r.dst): r.weight for r in edges.build_edges(stored(spark, rows), C).collect()}
    assert got == {(a, b): pytest.approx(w) for (a, b), w in {(0, 1): 1.0, (1, 0): 1.0, (0, 2): math.exp(-1), (2, 0): math.exp(-1), (1, 2): math.exp(-1), (2, 1): math.exp(-1)}.items()}


def test_band_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = unit(rng)
    rows = [(i, int(rng.integers(1, 60)), base + 0.1 * rng.normal(size=64), base + 0.1 * rng.normal(size=64), 1.0) for i in range(80)]
    for c in (C, replace(C, displacement_edges_enabled=True), replace(C, theta_edge=0.4)):
        layer = update.Layer(c)
        want = set()
        for a in rows:
            for b in rows:
                if a[0] != b[0] and layer.weight({"key": a[2], "value": a[3], "ts": a[1]}, {"key": b[2], "value": b[3], "ts": b[1]}) >= c.theta_edge:
                    want.add((a[0], b[0]))
        assert {(r.src, r.dst) for r in edges.build_edges(stored(spark, rows), c).collect()} == want


def graph(spark, pairs):
    return spark.createDataFrame([(1, a, b, w) for a, b, w in pairs] + [(1, b, a, w) for a, b, w in pairs], "store_id long, src long, dst long, weight double")


def activated(spark, a0, net, c, sim=None):
    rows = spark.createDataFrame([(1, 1, i, float(a), float(1 if sim is None else sim[i])) for i, a in enumerate(a0)], "query_id long, store_id long, mem_id long, a0 double, sim double")
    return [r.activation for r in spread.spread(rows, net, c).orderBy("mem_id").collect()]


def test_spreading_by_hand(spark):
    chain = graph(spark, [(0, 1, 0.9), (1, 2, 0.9)])
    assert activated(spark, [1, 0, 0], chain, replace(C, n_hops=1)) == pytest.approx([1, 0.225, 0])
    assert activated(spark, [1, 0, 0], chain, C) == pytest.approx([1 + 0.45 * 0.225, 0.225 + 0.5 * (0.9 * 1 + 0) / 2, 0.45 * 0.225])
    assert activated(spark, [1, 0, 0], chain, replace(C, eta_propagation=0.0)) == [1, 0, 0]
    assert activated(spark, [1, 0.5], graph(spark, [(7, 8, 0.5)]), C) == [1, 0.5]
    star = graph(spark, [(0, 1, 0.8), (0, 2, 0.5)])
    assert activated(spark, [1, 0, 0], star, replace(C, n_hops=1)) == pytest.approx([1, 0.4, 0.25])
    assert activated(spark, [1, 0, 0], star, replace(C, n_hops=1, spreading_debias_enabled=True)) == pytest.approx([1, 0.5 * 0.5, 0.5 * 0.5 / math.sqrt(2)])
    assert activated(spark, [1, 0, 0], star, replace(C, n_hops=1, query_aware_spread_enabled=True), [0.5, 1, 1]) == pytest.approx([1, 0.2, 0.125])
    far = activated(spark, [1, 0, 0, 0, 0], graph(spark, [(i, i + 1, 0.8) for i in range(4)]), replace(C, multiscale_enabled=True))
    assert far[4] > 0 and activated(spark, [1, 0, 0, 0, 0], graph(spark, [(i, i + 1, 0.8) for i in range(4)]), C)[4] == 0


def test_feedback_reaches_every_memory_and_edges_in_order(spark):
    k = np.eye(8)
    mem = stored(spark, [(i, i + 1, k[i], k[i % 2], 1.0) for i in range(4)])
    got = recall.dense_topk(spark.createDataFrame([(1, 1, [1.0] * 8)], "query_id long, store_id long, q array<double>"), mem, 10).withColumn("store_id", F.lit(1).cast("long"))
    response = spark.createDataFrame([(1, [float(x) for x in k[1]])], "query_id long, response array<double>")
    out = {r.mem_id: r for r in decisions.feedback(got, response, mem, C).collect()}
    assert {i: r.effect for i, r in out.items()} == {0: "weakened", 1: "strengthened", 2: "weakened", 3: "strengthened"}
    assert out[3].strength == pytest.approx(1.05) and out[2].strength == pytest.approx(1 - 0.05 * 0.3)
    changes = spark.createDataFrame([(1, 0, 1, 1.1), (1, 1, 2, 0.9)], "store_id long, mem_id long, rank int, factor double")
    after = {(r.src, r.dst): r.weight for r in edges.adjust_edges(graph(spark, [(0, 1, 0.95), (1, 2, 0.105), (2, 3, 0.5)]), changes, C).collect()}
    assert after == {(0, 1): 0.9, (1, 0): 0.9, (2, 3): 0.5, (3, 2): 0.5}


# Retrieval


def test_weighted_value_is_the_formula(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i + 1, unit(rng), unit(rng), 1.0 + i) for i in range(4)]
    q = rows[0][2] + rows[1][2]
    w = np.array([s * (q @ k) / np.linalg.norm(q) for _, _, k, _, s in rows])
    got = recall.weighted_value(spark.createDataFrame([(1, 1, q.tolist())], "query_id long, store_id long, q array<double>"), stored(spark, rows), 64).first()
    assert got.value == pytest.approx((w @ np.stack([r[3] for r in rows]) / w.sum()).tolist())


def test_head_weights_are_convex(spark):
    k = np.eye(8)
    mem = stored(spark, [(0, 1, k[0], k[0], 1.0)])
    state = spark.createDataFrame([(1, 1, k[0].tolist())], "store_id long, now long, context array<double>")
    q = spark.createDataFrame([(9, 1, k[0].tolist())], "query_id long, store_id long, q array<double>")
    ones = spark.createDataFrame([(9, 0, 1.0)], "query_id long, mem_id long, sparse double")
    for c, s in ((C, None), (C, ones), (replace(C, adaptive_heads=True), ones)):
        assert recall.multi_head(q, mem, state, c, s).first().score == pytest.approx(1.0)


def test_tfidf_finds_the_exact_word(spark):
    docs = spark.createDataFrame([(0, "the locker code is 55120187"), (1, "our flat in Porto"), (2, "a heron stood in the reeds"), (3, "")], "mem_id long, text string")
    asked = spark.createDataFrame([(1, "55120187"), (2, "heron reeds"), (3, ""), (4, "unknown")], "query_id long, text string")
    got = {(r.query_id, r.mem_id): r.sparse for r in sparse.tfidf_cosine(asked, docs).collect()}
    assert set(got) == {(1, 0), (2, 2)} and all(0 < x <= 1 for x in got.values())


# The update cycle


def turns_of(rng, n, base=None):
    rows = []
    for i in range(n):
        e = unit(rng) if base is None or i % 3 else base + 0.02 * rng.normal(size=64)
        rows.append((1, i, e / np.linalg.norm(e), unit(rng), f"in {i}", f"out {i}"))
    return pd.DataFrame(rows, columns=["store_id", "turn", "e_in", "e_out", "input_text", "output_text"])


def test_fold_decays_never_forgets_and_keeps_context_unit():
    rng = np.random.default_rng(8)
    layer, sizes = update.Layer(C), []
    base = unit(rng)
    for r in turns_of(rng, 40, base).itertuples(index=False):
        before = [m["strength"] for m in layer.rows]
        action = layer.update(r.e_in, r.e_out, r.input_text, r.output_text)
        if action[0] == "filtered":
            assert [m["strength"] for m in layer.rows] == pytest.approx([0.995 * s for s in before])
        sizes.append(len(layer.rows))
        assert np.linalg.norm(layer.context) == pytest.approx(1)
    assert sizes == sorted(sizes)
    assert {a for a in ("contradiction",)} <= {x[2] for x in update.fold(update.Layer(C), turns_of(np.random.default_rng(8), 40, base))}


def test_fold_flags():
    rng = np.random.default_rng(9)
    data = turns_of(rng, 30, unit(rng))
    plain = update.fold(update.Layer(C), data)
    assert update.fold(update.Layer(replace(C, theta_multichannel=0.1, n_mature=7)), data) == plain
    assert {x[2] for x in update.fold(update.Layer(replace(C, transcript_ingest=True)), data)} == {"created"}
    layer = update.Layer(replace(C, actr_enabled=True, actr_max_history=3, theta_value=-1.0))
    update.fold(layer, data)
    assert max(len(m["access_history"]) for m in layer.rows) == 3
    strong = update.Layer(replace(C, cold_start_enabled=True))
    update.fold(strong, data[:1])
    assert strong.rows[0]["strength"] == pytest.approx(4.0)


def test_fold_edges_equal_the_band_join_when_nothing_changes(spark):
    rng = np.random.default_rng(10)
    base = unit(rng)
    data = turns_of(rng, 30, base)
    c = replace(C, transcript_ingest=True, theta_value=-2.0)
    layer = update.Layer(c)
    update.fold(layer, data)
    mem = stored(spark, [(i, m["ts"], m["key"], m["value"], 1.0) for i, m in enumerate(layer.rows)])
    assert {(r.src, r.dst): pytest.approx(r.weight) for r in edges.build_edges(mem, c).collect()} == {(i, j): w for i, n in layer.edges.items() for j, w in n.items()}


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(11)
    data = pd.concat([turns_of(rng, 12, unit(rng)).assign(store_id=s) for s in range(3)])
    data["e_in"], data["e_out"] = data["e_in"].map(np.ndarray.tolist), data["e_out"].map(np.ndarray.tolist)
    kind = "store_id long, turn long, e_in array<double>, e_out array<double>, input_text string, output_text string"
    batch = spark.createDataFrame(data, kind)
    want = sorted(tuple(r) for r in update.actions(batch, C).select("store_id", "turn", "action", "mem_id").collect())
    parts = np.array_split(data.sample(frac=1, random_state=1), 3)
    for i, part in enumerate([*parts, parts[0]]):  # the last part is a repetition
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = update_stream(stream, C).writeStream.format("memory").queryName("acts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    assert sorted(tuple(r) for r in spark.table("acts").select("store_id", "turn", "action", "mem_id").collect()) == want


def test_windows(spark, sf_dir):
    rows = windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour", "1 day").collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{sf_dir}/events.parquet").count()


# Hierarchy


def test_leaders():
    rng = np.random.default_rng(12)
    near = lambda b, n: [(v := b + 0.03 * rng.normal(size=8)) / np.linalg.norm(v) for _ in range(n)]
    a, b = np.eye(8)[0], np.eye(8)[4]
    keys = np.stack([*near(a, 3), *near(b, 2), *near(a, 1)])
    assert hierarchy.leaders(keys, 0.7, 3, True) == [[0, 1, 2, 5]]
    assert hierarchy.leaders(keys, 0.7, 2, False) == [[0, 1, 2, 5], [3, 4]]
    assert hierarchy.leaders(np.eye(8), 0.7, 3, True) == []


def test_centroids_pull_towards_strength(spark):
    k = np.eye(4)
    mem = stored(spark, [(0, 1, k[0], k[0], 3.0), (1, 2, k[1], k[1], 1.0)])
    got = hierarchy.centroids(mem, ["store_id"], 4).first()
    assert got.strength == 4 and got.children == [0, 1] and np.linalg.norm(got.key) == pytest.approx(1) and got.key[0] == pytest.approx(3 * got.key[1])


def test_rerank_looks_at_recalled_rows_only(spark):
    """Groups that overlap, rows without a group, ids that two stores share; and no query meets the members of its store."""
    rng = np.random.default_rng(13)
    vec = lambda: rng.normal(size=4).tolist()
    l2 = [(s, g, vec(), [int(x) for x in rng.choice(12, 5, replace=False)]) for s in (0, 1) for g in range(4)]
    l3 = [(s, g, vec(), [int(x) for x in rng.choice(4, 2, replace=False)]) for s in (0, 1) for g in range(2)]
    queries = [(q, q % 2, vec()) for q in range(6)] + [(6, 0, [0.0] * 4)]
    recalled = [(q, s, m, float(rng.uniform(0.1, 1)), r + 1) for q, s, _ in queries for r, m in enumerate(rng.choice(14, 6, replace=False).tolist())]
    found = spark.createDataFrame(recalled, "query_id long, store_id long, mem_id long, score double, rank int")
    asked = spark.createDataFrame(queries, "query_id long, store_id long, q array<double>")
    groups = [spark.createDataFrame(x, f"store_id long, {name} long, key array<double>, children array<long>") for x, name in ((l2, "l2_id"), (l3, "l3_id"))]
    c = Config(recall_w1=0.5, recall_w2=0.3, recall_w3=0.2)
    df = hierarchy.rerank(found, asked, *groups, c)

    def best(q, keys):
        return max([0.0, *(float(np.dot(q, k) / (np.linalg.norm(q) * np.linalg.norm(k))) if np.any(q) else 0.0 for k in keys)])

    want = {}
    for q, s, m, score, _ in recalled:
        v = queries[q][2]
        own = [x for x in l2 if x[0] == s and m in x[3]]
        above = [x[2] for x in l3 if x[0] == s and any(g[1] in x[3] for g in own)]
        want[q, s, m] = score * (0.5 + 0.3 * best(v, [x[2] for x in own]) + 0.2 * best(v, above))
    rows = df.collect()
    assert set(df.columns) == set(found.columns) and {(r.query_id, r.store_id, r.mem_id): r.score for r in rows} == pytest.approx(want)
    for q, _, _ in queries:
        order = [r.mem_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)]
        assert order == [k[2] for k in sorted((k for k in want if k[0] == q), key=lambda k: (-want[k], k[2]))]
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i in (i for i, x in enumerate(lines) if "Generate explode" in x):
        under = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert not any("Join" in x for x in lines[i:under])


# Evaluation and reports


def test_mcnemar(spark):
    rows = spark.createDataFrame([(0, 1)] * 8 + [(1, 0)] * 2 + [(1, 1)] * 5, "a int, b int")
    got = evaluation.mcnemar(rows, "a", "b").first()
    assert (got.n01, got.n10) == (8, 2) and got.p == pytest.approx(2 * (1 + 10 + 45) / 1024)
    assert evaluation.mcnemar(rows.filter("a = b"), "a", "b").first().p == 1.0


def test_answers(spark):
    rows = spark.createDataFrame([(1, "red, green", "green, blue", 1), (2, "in May", "In May", 2), (3, "x", "x; or y", 3), (4, "cats", "dog", 4), (5, "That was not mentioned.", "z", 5), (6, "yes", "z", 5)], "q_id int, prediction string, answer string, category int")
    assert {r.q_id: r.score for r in evaluation.score_answers(rows, "q_id").collect()} == {1: 0.5, 2: 1.0, 3: 1.0, 4: 0.0, 5: 1.0, 6: 0.0}
    stems = evaluation.stemmed_f1(spark.createDataFrame([("running cats", "run cat"), ("", "x")], "p string, t string"), "p", "t", "f").collect()
    assert [r.f for r in stems] == [1.0, 0.0]


def test_prompts(spark):
    rows = spark.createDataFrame([(1, 1, 1.2, "i" * 130, "o", 1.5, "", "supporting"), (1, 2, 0.4, "b", "c", 0.5, "fact", "conflicting")], "query_id long, rank int, score double, input_text string, output_text string, strength double, category string, role string")
    plain = reports.prompt(rows).first().prompt.split("\n")
    assert plain[0] == reports.HEADER and plain[2] == f'[HIGH] User said: "{"i" * 120}" → You replied: "o" (strength: 1.50)' and plain[-1] == reports.FOOTER
    assert reports.CONFLICTS in reports.tension_prompt(rows).first().prompt
    assert reports.channel_prompt(rows).first().prompt.index("[FACT]") < reports.channel_prompt(rows).first().prompt.index("[UNCATEGORIZED]")


# Sources


def test_dialogues(spark, tmp_path):
    sample = {"sample_id": "s1", "conversation": {"speaker_a": "A", "session_2_date_time": "d2", "session_2": [{"speaker": "B", "text": "later", "dia_id": "D2:1"}], "session_10": [], "session_1_date_time": "d1", "session_1": [{"speaker": "A", "text": "hi", "dia_id": "D1:1", "blip_caption": "a cat"}]}, "qa": [{"question": "q", "answer": 2022, "category": 2, "evidence": ["D1:1"]}, {"question": "p", "adversarial_answer": "n", "category": 5, "evidence": []}]}
    path = str(tmp_path / "d.json")
    with open(path, "w") as f:
        json.dump([sample], f)
    samples = dialogues.read_samples(spark, path)
    got = [(r.session_no, r.text) for r in ingest.flatten_turns(samples).orderBy("session_no").collect()]
    assert got == [(1, "[d1] A: hi [shared image: a cat]"), (2, "[d2] B: later")]
    assert [(r.answer, r.category, r.evidence) for r in dialogues.questions(samples).orderBy("q_id").collect()] == [("2022", 2, ["D1:1"]), ("n", 5, [])]
    assert dialogues.select_samples(samples, ["s1"]).count() == 1
    with pytest.raises(ValueError, match="s2"):
        dialogues.select_samples(samples, ["s1", "s2"])
    cache = spark.createDataFrame([("0", [1.0])], "hash string, vector array<double>")
    assert dialogues.embedding_cache_misses(spark.createDataFrame([("a",), ("a",)], "text string"), cache).count() == 1


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "store")
    assert snapshots.load(spark, path)[1] is False
    rows = [(s, 0, s, 0.5) for s in (1, 2)]
    edges_ = spark.createDataFrame([(s, a, b, w) for s, a, b, w in rows], snapshots.TABLES["edges"])
    snapshots.save({"edges": edges_}, path)
    version = snapshots.save({"edges": edges_.union(edges_)}, path)
    tables, found = snapshots.load(spark, path, store_id=1)
    assert found and tables["edges"].count() == 2 and tables["memories"].count() == 0
    assert not [x for x in os.listdir(path) if x.startswith(".") and not x.endswith(".crc")]
    for root, _, names in os.walk(f"{path}/{version}/edges"):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(root, name), "wb") as f:
                    f.write(b"damaged")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        tables, found = snapshots.load(spark, path)
    assert not found and caught and tables["edges"].count() == 0


def test_hybrid_scores_all_documents(spark, sf_dir):
    import numpy as np

    from palimpsest.functions.text import hash_embed
    from palimpsest.functions.vectors import normalized
    from palimpsest.operators import sparse
    from palimpsest.plans import queries, tables

    docs, asked = tables.documents(spark, sf_dir), tables.benchmark(spark, sf_dir)
    v, q = ({r[0]: np.array(r[1]) for r in df.select(i, normalized(hash_embed("text"))).collect()} for df, i in ((docs, "mem_id"), (asked, "query_id")))
    ids, bm25 = sorted(v), {(r.query_id, r.mem_id): r.bm25 for r in sparse.bm25(asked, docs, queries.C).collect()}
    scale = lambda x: (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else x * 0
    got = {}
    for r in queries.hybrid_topk(spark, sf_dir).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.score
    assert set(got) == set(q)
    for i, e in q.items():
        score = scale(np.array([v[k] @ e for k in ids])) + queries.C.hybrid_weight * scale(np.array([bm25.get((i, k), 0.0) for k in ids]))
        top = np.sort(score)[::-1][: queries.C.top_k]
        assert np.allclose([got[i][k] for k in sorted(got[i])], top, atol=2e-6)
