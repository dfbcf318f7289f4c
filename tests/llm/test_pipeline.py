"""The pipeline's stages, each against brute force on its own input."""

import hashlib

import corpus_pipeline
from palimpsest.llm import common, toxicity
from tests.llm.test_second import check_packing
from tests.llm.test_third import brute_dedup


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stages(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    docs = common.read(spark, sf_dir, "documents")
    columns = docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]
    given = {r.doc_id: r for r in docs.collect()}

    clean = common.materialize(stages[0](spark, docs, sf_dir))
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels"))
    kept = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns
    assert set(kept) == {i for i, r in given.items() if model.score(model.sentence_scores(r.text or "")[1]) < 0.5}
    assert all(kept[i] == given[i] for i in kept)

    single = common.materialize(stages[1](spark, clean, sf_dir))
    left = {r.doc_id: r for r in single.collect()}
    assert single.columns == columns and all(left[i] == given[i] for i in left)
    sets = {i: shingles(r.text or "") for i, r in kept.items()}
    order = sorted(sets)
    gone = set(order) - set(left)
    for i in order:
        likeness = [(alike(sets[i], sets[j]), j) for j in order if j != i and (sets[i] & sets[j] or sets[i] == sets[j])]
        if i in gone:  # something is about as alike as asked for
            assert max(likeness)[0] >= 0.65
        else:  # nothing that stays is a clear near copy of it
            assert not [j for x, j in likeness if x >= 0.9 and j in left]

    cut = common.materialize(stages[2](spark, single, sf_dir))
    after = {r.doc_id: r for r in cut.collect()}
    want = brute_dedup([(i, r.text) for i, r in left.items()])
    assert cut.columns == columns and set(after) == set(left)
    for i, r in after.items():
        if want[i][1]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[i][2] and r.n_chars == len(r.text)
        else:
            assert r == left[i]

    packed = stages[3](spark, cut, sf_dir).collect()
    n, total = check_packing([(i, r.text) for i, r in after.items()], packed)
    assert n <= -(-total // 4096) + 2


def test_run_on_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15), (None, "no id", "en", "s", 5)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 3, 3]  # a null and an empty text are copies of each other
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_run_with_clashing_columns_and_a_very_long_text(spark, tmp_path):
    """Columns named as those that the operators make stay as they are; a text of a million words is deduplicated and packed whole."""
    words = [f"w{k}" for k in range(1_000_000)]
    rows = [(1, " ".join(words), "a", 7, "x", "n", [1], "c", 5), (2, "a short text of six words", "b", 8, "y", "m", [2], "d", 6), (3, " ".join(["new"] * 19 + words[500:600]), "c", 9, "z", None, None, None, None)]
    names = "doc_id long, text string, gone string, row int, chunk string, node string, bands array<int>, class_id string, first int"
    docs = spark.createDataFrame(rows, names)
    single = common.materialize(corpus_pipeline.drop_near_duplicates(spark, docs, ""))
    key = lambda r: r[0]
    assert single.columns == docs.columns and sorted(map(tuple, single.collect()), key=key) == rows
    cut = sorted(corpus_pipeline.cut_repeats(spark, single, "").collect(), key=key)
    assert [tuple(r)[2:9] for r in cut] == [r[2:] for r in rows] and cut[0].text == rows[0][1] and cut[2].text == " ".join(["new"] * 19)
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert sum(r.length for r in packed if r.doc_id == 1) > 1_000_000 and {r.doc_id for r in packed} == {1, 2, 3}


def test_an_id_with_two_texts(spark):
    """Only the text that repeats another goes; of two near copies with one id, one stays."""
    words = [f"w{k}" for k in range(300)]
    near, other = " ".join(words[:-3]), " ".join(f"v{k}" for k in range(300))
    rows = [(1, " ".join(words)), (2, near), (2, other), (3, "a b c d e f g h"), (4, " ".join(f"u{k}" for k in range(300))), (4, " ".join(f"u{k}" for k in range(298)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(left)[:3] == [rows[0], rows[2], rows[3]] and len(left) == 4 and left.count(rows[4]) + left.count(rows[5]) == 1
