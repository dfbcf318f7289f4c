"""Lexical retrieval over an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import tokens


def postings(docs: DataFrame, id_col: str = "mem_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf): summed before the shuffle."""
    return docs.select(F.col(id_col), F.explode(tokens(text_col)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def tfidf_cosine(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, mem_id, sparse): cosine of tf * ln(1 + N / (1 + df)) vectors (Eq 19); pairs without a common term are left out.

    Only documents that have a query term are touched; norms come from the index alone. queries: query_id, text; docs: mem_id, text.
    """
    index = postings(docs)
    n = docs.agg(F.count("*").cast("double")).scalar()
    idf = document_frequency(index).select("term", F.log(1.0 + n / (1.0 + F.col("df"))).alias("idf"))
    weighed = index.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("mem_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("d_norm"))
    asked = postings(queries, "query_id").join(idf, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("qw"))
    q_norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    dots = asked.join(weighed.select("mem_id", "term", "w"), "term").groupBy("query_id", "mem_id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dots.join(norms, "mem_id").join(q_norms, "query_id").select("query_id", "mem_id", (F.col("dot") / (F.col("d_norm") * F.col("q_norm"))).alias("sparse"))


def bm25(queries: DataFrame, docs: DataFrame, c: Config) -> DataFrame:
    """(query_id, mem_id, bm25); a query term counts as often as it occurs; pairs without a common term are left out."""
    index = postings(docs)
    size = docs.select("mem_id", F.size(tokens("text")).cast("double").alias("size"))
    n, mean = docs.agg(F.count("*").cast("double")).scalar(), size.agg(F.avg("size")).scalar()
    df = document_frequency(index).select("term", F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = postings(queries, "query_id").join(df, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("qw"))
    sized = size.select("mem_id", (c.bm25_k1 * (1.0 - c.bm25_b + c.bm25_b * F.col("size") / mean)).alias("room"))
    met = asked.join(index, "term").join(sized, "mem_id")
    gain = F.col("qw") * F.col("tf") * (c.bm25_k1 + 1.0) / (F.col("tf") + F.col("room"))
    return met.groupBy("query_id", "mem_id").agg(F.sum(gain).alias("bm25"))


def tfidf_by_store(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, mem_id, sparse): as ``tfidf_cosine``, each store being a collection of its own, as recall's sparse head needs (Eq 19).

    queries: query_id, store_id, text; memories: store_id, mem_id, input_text. Everything is keyed by the store and a term, so no
    term is a key of all stores.
    """
    index = memories.select("store_id", "mem_id", F.explode(tokens("input_text")).alias("term")).groupBy("store_id", "mem_id", "term").agg(F.count("*").alias("tf"))
    n = memories.groupBy("store_id").agg(F.count("*").cast("double").alias("n"))
    idf = index.groupBy("store_id", "term").agg(F.count("*").alias("df")).join(n, "store_id").select("store_id", "term", F.log(1.0 + F.col("n") / (1.0 + F.col("df"))).alias("idf"))
    weighed = index.join(idf, ["store_id", "term"]).select("store_id", "mem_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighed.groupBy("store_id", "mem_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("d_norm"))
    asked = queries.select("query_id", "store_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "store_id", "term").agg(F.count("*").alias("tf"))
    asked = asked.join(idf, ["store_id", "term"]).select("query_id", "store_id", "term", (F.col("tf") * F.col("idf")).alias("qw"))
    q_norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    dots = asked.join(weighed, ["store_id", "term"]).groupBy("query_id", "store_id", "mem_id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dots.join(norms, ["store_id", "mem_id"]).join(q_norms, "query_id").select("query_id", "store_id", "mem_id", (F.col("dot") / (F.col("d_norm") * F.col("q_norm"))).alias("sparse"))


def minmax(df: DataFrame, score: str, by: str = "query_id"):
    """Score scaled to 0..1 within each query; 0 where all are equal."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(0.0))
