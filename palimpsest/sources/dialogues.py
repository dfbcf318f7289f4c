"""Nested dialogue files: a JSON list of samples with sessions of turns, and questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = "hash string, vector array<double>"
#: Texts that a model is given at once.
MODEL_BATCH = 64


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, conversation and qa, the latter two as JSON text: sessions are named by number, so their columns aren't known."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("s"))
    return rows.select(F.col("s")["sample_id"].alias("sample_id"), F.col("s")["conversation"].alias("conversation"), F.col("s")["qa"].alias("qa"))


def questions(samples: DataFrame) -> DataFrame:
    """sample_id, q_id, question, answer, category, evidence."""
    kind = "array<struct<question:string,answer:string,adversarial_answer:string,category:int,evidence:array<string>>>"
    rows = samples.select("sample_id", F.posexplode(F.from_json("qa", kind)).alias("q_id", "q"))
    return rows.select("sample_id", "q_id", "q.question", F.coalesce("q.answer", "q.adversarial_answer").alias("answer"), "q.category", "q.evidence")


def select_samples(samples: DataFrame, wanted: list[str]) -> DataFrame:
    """The named samples; a name that there isn't is an error."""
    known = {r[0] for r in samples.select("sample_id").filter(F.col("sample_id").isin(wanted)).distinct().collect()}
    if missing := sorted(set(wanted) - known):
        raise ValueError(f"no such samples: {', '.join(missing)}")
    return samples.filter(F.col("sample_id").isin(wanted))


def embedding_cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts whose hash the cache (hash, vector) lacks."""
    return texts.select("text").distinct().withColumn("hash", F.sha1("text")).join(cache, "hash", "left_anti")


def embedded(texts: DataFrame, path: str, model: Callable[[list[str]], list[list[float]]], name: str = "vector") -> DataFrame:
    """``texts`` (text, ...) with vectors of a model, each distinct text once: those that the cache at ``path`` lacks are embedded and added.

    model: takes a list of texts and gives their vectors; it is called with batches of a worker's texts and may load what it needs on the first.
    A null text has no vector. Batches are appended as new files, so a cache that is read meanwhile stays whole.
    """
    spark = texts.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MODEL_BATCH):
                part = batch.slice(at, MODEL_BATCH)
                vectors = model(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))], names=["hash", "vector"])

    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    cache = lambda: spark.read.schema(CACHE).parquet(path)
    missing = embedding_cache_misses(texts.filter("text is not null"), cache()).select("hash", "text")
    missing.mapInArrow(run, CACHE).write.mode("append").parquet(path)
    held = cache().groupBy("hash").agg(F.first("vector").alias(name))  # two runs at once may both have added a text
    return texts.withColumn("__hash", F.sha1("text")).join(held.withColumnRenamed("hash", "__hash"), "__hash", "left").drop("__hash")


def write_results(results: DataFrame, path: str, by: str = "sample_id") -> None:
    """Results as JSON, a folder for each sample; those of samples that are written again are replaced, others stay."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)
