"""Shared helpers: batches, materialised tables and chunk files."""

import os

import pyarrow as pa
import pytest

from palimpsest.llm import chunks, common, packing, substring


def test_slices_are_bounded_and_whole():
    texts = ["a" * n for n in (0, 5, 3000, 10, 100_000, 1, 1, 900, 900, 900)] + [None] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), most=2000, rows=20))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows <= 20 and (p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 2000) for p in parts)


def test_the_session_stays_as_it_was(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, rows = spark.conf.get(key), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(1, "a b c " * 20), (2, "a b c " * 20)], "doc_id long, text string")
    assert substring.dedup(docs).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        common.materialize(docs.selectExpr("raise_error('no')"))
    assert (spark.conf.get(key), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == (before, rows)


def test_released_tables_are_gone(spark):
    df = common.materialize(spark.range(5))
    path = df._palimpsest_path
    assert df.count() == 5 and os.path.isdir(path)
    common.release(df, None, spark.range(1))
    assert not os.path.exists(path)


def test_chunks_keep_rows_in_order_and_drop_places(spark):
    rows = [(k % 7 if k % 5 else None, f"text {k} " * (k % 50), k) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int").repartition(5)
    folder = common.shared_dir(spark)
    made = chunks.write(docs, folder, "doc_id", "text", 4000)
    assert made.count() > 5 and made.agg({"docs": "sum"}).first()[0] == 300
    seen, gone = [], []
    for r in made.collect():
        table = chunks.load(folder, r.chunk)
        ids = chunks.ids_of(table, "doc_id")
        assert (ids[1:] >= ids[:-1]).all()
        seen += [tuple(x.values()) for x in table.to_pylist()]
        gone.append((r.chunk, 0, tuple(table.slice(0, 1).to_pylist()[0].values())))
    assert sorted(seen, key=str) == sorted(rows, key=str)
    drop = spark.createDataFrame([g[:2] for g in gone], "chunk long, row int")
    left = sorted((tuple(r) for r in chunks.kept(made, folder, drop, docs.schema).collect()), key=str)
    assert left == sorted(set(rows) - {g[2] for g in gone}, key=str)


def test_rounds_pass_on_only_what_can_merge(spark):
    """Of bins with one fill as many as there are small ones go on, whole tasks of them; none where no two fit."""
    schema = "sequence_id long, fill int"
    bins = [(t << 28 | k, 70) for t in range(10) for k in range(20)] + [(11 << 28, 20), (12 << 28, 10)] + [(13 << 28, 99)]
    made = spark.createDataFrame(bins, schema)
    left = [tuple(r) for r in made.filter(packing.unfinished(made, 100)).collect()]
    assert sorted(left) == sorted([(k, 70) for k in range(20)] + bins[200:202])
    assert packing.unfinished(made.filter("fill > 50"), 100) is None
    assert packing.unfinished(made.filter("fill in (10, 99)"), 100) is None
    two = made.filter("fill < 50")
    assert two.filter(packing.unfinished(two, 100)).count() == 2


def test_packing_in_rounds_loses_no_merge(spark, monkeypatch):
    """Many tasks with few pieces each: hardly more sequences than best fit makes of all pieces at once."""
    import random

    import public_tokenizers

    monkeypatch.setattr(packing, "TASK_ITEMS", 8)
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, "word " * rng.choice([3, 5, 30, 45, 55, 60])) for k in range(600)], "doc_id long, text string").repartition(40)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=100).collect()
    sizes = [m.length for r in got for m in r.members]
    assert len(sizes) == 600 and all(sum(m.length for m in r.members) == r.fill <= 100 for r in got)
    best = len(packing.best_fit(sizes, 100))
    assert best <= len(got) <= best * 1.1 + 2
