"""op3, op8 and op10 against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import common, simhash, substring, topk
from palimpsest.llm.components import components


def fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Smallest id reachable, for ids with a fingerprint, by brute force."""
    names = {}
    for i, f in prints:
        names.setdefault(f, []).append(i)
    prints_ = list(names)
    label = list(range(len(prints_)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, f in enumerate(prints_):
        for j in range(i):
            if (f ^ prints_[j]).bit_count() <= 2:
                label[root(i)] = root(j)
    label = [root(k) for k in range(len(prints_))]
    least = {}
    for k, f in enumerate(names):
        known = [i for i in names[f] if i is not None]
        least[label[k]] = min([least.get(label[k]), *known], key=lambda v: (v is None, v))
    return {(i, f): least[label[k]] for k, f in enumerate(names) for i in names[f]}


def test_simhash_query(spark, sf_dir):
    table = [(r.doc_id, r.text or "") for r in common.read(spark, sf_dir, "documents").collect()]
    prints = [(i, fingerprint(t)) for i, t in table]
    want = classes(prints)
    got = simhash.query(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", want[i, f]) for i, f in prints)


def test_simhash_links_with_and_without_crowds(spark, monkeypatch):
    rng = random.Random(2)
    x = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            x.add(f)
            for _ in range(rng.choice([1, 2, 2, 3])):
                f ^= 1 << rng.randrange(64)
    x |= {0, 1, 2, 4, 2**64 - 1, 2**64 - 2, 2**63, 2**63 + 1}
    order = np.array(sorted(x), dtype=np.uint64)
    want = simhash._classes(order, 2)
    nodes = spark.createDataFrame([(int(v),) for v in order.view(np.int64)], "fp long")
    for crowd in (512, 2):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        found = {r.node: r.label for r in components(simhash.links(nodes)).collect()}
        own = [found.get(int(v), int(v)) for v in order.view(np.int64)]
        seen = {}
        assert all(seen.setdefault(a, b) == b for a, b in zip(own, want.tolist(), strict=True)) and len(set(own)) == len(set(want.tolist()))


def test_exploded_rows_are_never_broadcast(spark):
    """The planner takes them for as small as the fingerprints, so their joins must not be left to it."""
    nodes = common.materialize(spark.range(1000).select(F.xxhash64("id").alias("fp")))
    rows = nodes.select("fp", F.explode(simhash.cells(simhash.segment_counts(F.col("fp")), 32)).alias("cell"))
    for df in (simhash._met(rows), simhash.links(nodes)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_odd_rows(spark):
    rows = [(5, None, 1), (4, "", 1), (7, " \t", 1), (None, "only here", 1), (2, "ABC é", 1), (3, "abc é", 1), (3, "abc é", 1), (9, "a " * 60_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.groups(docs).collect()}
    prints = [(i, fingerprint(t or "")) for i, t, _ in rows]
    assert {(i, f & 2**64 - 1): c for (i, f), c in got.items()} == classes(prints)
    assert simhash.groups(docs).count() == len(rows) and simhash.groups(docs.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, want = [], {}
    for g in range(60):
        base = [word() for _ in range(300)]
        first = len(rows)
        for c in range(1 + g % 4):
            copy = list(base)
            for _ in range(c * 2):
                copy[rng.randrange(300)] = word()
            rows.append((len(rows), " ".join(copy), 1))
            want[rows[-1][0]] = first
    n = len(rows)
    rows += [(n, rows[0][1], 1), (n + 1, "", 1), (n + 2, None, 1), (None, "x", 1), (n + 3, "lone", 1)]
    want |= {n: 0, n + 1: n + 1, n + 2: n + 1, n + 3: n + 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_meet_in_the_grid(spark, monkeypatch):
    """Where no two texts share a band, those with fingerprints within two bits meet all the same."""
    rng = random.Random(14)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(10**9)}" for _ in range(1500)]
        copy = list(base)
        copy[rng.randrange(1500)] = "x"
        texts += [" ".join(base), " ".join(copy)]
    prints = [int(simhash.majority(simhash._mixed(simhash._set(t), simhash.SIGNATURE))[0]) for t in texts]
    close = [k for k in range(0, 60, 2) if (prints[k] ^ prints[k + 1]).bit_count() <= 2]
    assert 10 < len(close) and any(prints[k] != prints[k + 1] for k in close)
    whole = simhash.signatures
    monkeypatch.setattr(simhash, "signatures", lambda *a: whole(*a).withColumn("bands", F.array(F.xxhash64("node", F.lit("lone")))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs).collect()}
    assert all(got[k + 1] == k for k in close) and all(got[k] == k and got[k + 1] in (k, k + 1) for k in range(0, 60, 2))


def block_edits(rng, likeness, way, n=300):
    """A text and a copy with another end, more at the end or a piece cut off, as alike as asked for or just above."""
    base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    m = n - 4  # shingles
    if way == "replaced":  # (m - k) / (m + k)
        k = int(m * (1 - likeness) / (1 + likeness))
        return base, base[: n - k] + [f"x{rng.randrange(10**9)}" for _ in range(k)]
    k = int(m * (1 - likeness)) if way == "truncated" else int(m / likeness) - m
    return base, base[: n - k] if way == "truncated" else base + [f"x{rng.randrange(10**9)}" for _ in range(k)]


def test_bands_meet_after_block_edits():
    rng = random.Random(6)
    for likeness in (0.8, 0.82, 0.85, 0.9):
        for way in ("replaced", "appended", "truncated"):
            for _ in range(50):
                a, b = (np.unique(simhash.shingle_hashes([w.encode() for w in x], simhash.SHINGLE)) for x in block_edits(rng, likeness, way))
                assert likeness <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < likeness + 0.01
                assert (simhash.least_hashes(a) == simhash.least_hashes(b)).any()


def brute_classes(texts, likeness):
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    near = np.array([[len(a & b) / len(a | b) >= likeness for b in sets] for a in sets])
    label = np.arange(len(sets))
    while True:
        least = np.where(near, label[None, :], len(sets)).min(axis=1)
        if (least == label).all():
            return {i: int(x) for i, x in enumerate(label)}
        label = least


def test_near_duplicates_decides_by_the_sets(spark):
    """Pairs just above and just under 0.8 after scattered and block edits."""
    rng = random.Random(7)
    texts = []
    for likeness in (0.7, 0.75, 0.78, 0.8, 0.85, 0.9):
        for way in ("replaced", "appended", "truncated"):
            for _ in range(8):
                texts += [" ".join(x) for x in block_edits(rng, likeness, way)]
        for n in (5, 8, 12, 30):
            texts += [" ".join(x) for x in block_edits(rng, likeness, "appended", n)]
    for _ in range(60):
        a = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        b = list(a)
        for i in rng.sample(range(300), 7):
            b[i] = "x"
        texts += [" ".join(a), " ".join(b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in simhash.near_duplicates(docs).collect()} == brute_classes(texts, 0.8)


def test_near_duplicates_in_crowds(spark, monkeypatch):
    """Near copies that are alike to a base in mid-order only, and chains of copies, in one block and in several."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"

    def changed(words, k, step=13):
        out = list(words)
        for i in rng.sample(range(5, len(words) - 5, step), k):
            out[i] = word()
        return out

    base = [word() for _ in range(300)]
    copies = [changed(base, 6) for _ in range(150)]
    texts = copies[:75] + [base] + copies[75:]
    for _ in range(3):  # a chain of texts, each alike to the next
        text = [word() for _ in range(300)]
        for _ in range(25):
            text = changed(text, 5)
            texts.append(text)
    shared = [word() for _ in range(240)]  # boilerplate, not alike
    texts += [shared + [word() for _ in range(50)] for _ in range(60)]
    texts = [" ".join(x) for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes(texts, 0.8)
    assert all(want[i] == 0 for i in range(151))
    for block in (simhash.BLOCK, 16):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs).collect()}
        assert got == want


def test_blocks_decide_as_pairs_do():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, k).astype(np.uint64)) for k in rng.integers(0, 90, 80)] + [np.zeros(0, np.uint64)]
    for likeness in (0.3, 0.5, 0.8):
        assert (simhash.alike_matrix(sets, likeness) == [[simhash.alike(a, b, likeness) for b in sets] for a in sets]).all()


def limit(v):
    return max(-(2**63), min(2**63 - 1, v))


def brute_top(rows, k):
    def scaled(v):
        return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [max(-(2**62), min(2**62, int(np.floor(np.float64(x) * 64)))) for x in v]

    table = [(i, s) for i, v in rows if (s := scaled(v)) is not None]
    out = []
    for i, v in table:
        if i % 20 == 0:
            scores = sorted((-limit(sum(a * b for a, b in zip(v, w, strict=False))), j) for j, w in table if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def test_topk_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in common.read(spark, sf_dir, "embeddings").collect()]
    got = sorted(tuple(r) for r in topk.query(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 20)


def clustered(rng, n, spread=0.05):
    centres = rng.normal(size=(30, 8)) * 5
    return centres[rng.integers(30, size=n)] + rng.normal(size=(n, 8)) * spread


def test_topk_skips_what_bounds_exclude(spark):
    """Through the operator: clustered vectors need a small part of all products, and give what brute force gives."""
    vectors = clustered(np.random.default_rng(1), 3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = df.select("vec_id", topk.quantised(df.embedding).alias("v"))
    asked = rows.filter("vec_id % 20 = 0")
    assert topk.evaluated(rows, asked, 5) < 0.25
    table = np.floor(64 * vectors)
    got = {}
    for r in topk.top_k(rows, asked, 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for i in range(0, 3000, 20):
        scores = table @ table[i]
        scores[i] = -np.inf
        best = np.lexsort((np.arange(3000), -scores))[:5]
        assert [got[i][k] for k in range(1, 6)] == [(j, scores[j]) for j in best.tolist()]


def test_topk_splits_a_crowd_and_takes_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.25]) for i in range(400)] + [(i, rng.normal(size=2).tolist()) for i in range(400, 600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "crowd" / "embeddings.parquet"))
    got = sorted(tuple(r) for r in topk.query(spark, str(tmp_path / "crowd")).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 20)
    rows = [(0, [1.0, 0.5]), (20, [1.0]), (40, None), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, []), (1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [float("inf"), 0.0]), (4, [-0.01, 0.0])]
    for extra in ([], [(120, [1e17, -1e17])]):
        df = spark.createDataFrame([(i, v, 1) for i, v in rows + extra], "vec_id long, embedding array<double>, score int")
        df.write.parquet(str(tmp_path / f"{len(extra)}" / "embeddings.parquet"))
        got = sorted(tuple(r) for r in topk.query(spark, str(tmp_path / f"{len(extra)}")).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute_top(rows + extra, 20)
    df.limit(0).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert topk.query(spark, str(tmp_path / "none")).count() == 0


def brute_dedup(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_query(spark, sf_dir):
    for d in (sf_dir, sf_dir.replace("sf0.001", "sf0.01")):
        rows = [(r.doc_id, r.text) for r in common.read(spark, d, "documents").collect()]
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.query(spark, d).collect()}
        assert got == brute_dedup(rows)


def test_substring_odd_rows_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 2000)
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij")
    shared = [[word() for _ in range(n)] for n in (19, 20, 21, 35, 60)]
    rows = [(1, None), (2, ""), (3, " ".join(["x"] * 50)), (4, "é 　 " * 40)]
    for i in range(5, 90):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += rng.choice(shared) if rng.random() < 0.6 else [word() + str(i) for _ in range(rng.randrange(40))]
        rows.append((i, " \n".join(parts)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, kept int, n_words string").repartition(7)
    want = brute_dedup(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.dedup(docs).collect()}
    assert got == want and sum(n for _, n, _ in want.values()) > 500
    whole = substring.dedup(docs, in_place=True).collect()
    text = dict(rows)
    assert len(whole) == len(rows) and all((r.text == text[r.doc_id]) if not want[r.doc_id][1] else hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2] for r in whole)
    twice = substring.dedup(docs.filter("doc_id = 3").union(docs.filter("doc_id = 3"))).collect()
    assert sorted(r.n_removed for r in twice) == [49, 50]
    assert substring.dedup(docs.limit(0)).count() == 0
