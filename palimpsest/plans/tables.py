"""The engine's tables, from the driver's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import hash_embed
from ..functions.vectors import normalized, sum_vectors
from ..operators.ingest import window_pairs, with_norms

DIM = 64
#: Thresholds that these tables' similarities reach on both sides; random vectors are never as alike as sentences of one talk.
CONFIG = Config(embedding_dim=DIM, theta_edge=0.02, theta_cluster=0.2, theta_identity=0.1, theta_create=0.25, theta_key=0.25, theta_value=0.0, theta_tension_key=0.2, theta_tension_val=0.0, theta_align=0.2, theta_misalign=0.0, theta_density_neighbor=0.15, theta_soft_base=0.25, theta_ctx_gate=0.05, theta_out_filter=0.99)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as memories: a store for each label, in order of ids; the value is the next one's key."""
    order = Window.partitionBy("store_id").orderBy("mem_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("store_id"), F.col("vec_id").cast("long").alias("mem_id"), F.col("embedding").cast("array<double>").alias("key"))
    rows = rows.withColumns({"value": F.coalesce(F.lead("key").over(order), F.first("key").over(whole)), "ts": F.row_number().over(order).cast("long")})
    return with_norms(rows.withColumns({"strength": 1.0 + (F.col("mem_id") % 7) * F.lit(0.25), "access_history": F.filter(F.array(F.col("ts") - 3, F.col("ts")), lambda t: t > 0)}))


def as_queries(mem: DataFrame) -> DataFrame:
    """Every memory as a query of its own store."""
    return mem.select(F.col("mem_id").alias("query_id"), "store_id", F.col("key").alias("q"))


def centres(mem: DataFrame) -> DataFrame:
    """A query for each store: its mean key."""
    return mem.groupBy("store_id").agg(sum_vectors("key", F.lit(1.0), DIM).alias("q")).select(F.col("store_id").alias("query_id"), "store_id", normalized("q").alias("q"))


def state(mem: DataFrame) -> DataFrame:
    """Layer state: the step after the last, and the last key as context."""
    return mem.groupBy("store_id").agg((F.max("ts") + 1).alias("now"), F.max_by("key", "ts").alias("context"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("store_id"), F.col("turn").cast("long").alias("turn"), "role", "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their replies and embeddings of both."""
    out = window_pairs(turns(spark, sf_dir), F.concat(F.lit("[End of conversation on "), F.col("store_id").cast("string"), F.lit("]")))
    return out.withColumns({"e_in": normalized(hash_embed("input_text")), "e_out": normalized(hash_embed("output_text"))})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("mem_id"), "text", "lang")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


__all__ = ["CONFIG", "DIM", "as_queries", "benchmark", "centres", "documents", "memories", "pairs", "state", "table", "turns"]
