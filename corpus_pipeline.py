"""Corpus pipeline: toxic documents go, one of each group of near duplicates stays, repeated passages are cut, and what is left is packed.

Each stage reads what its predecessor has written, as Parquet, and all but the last return the columns of documents.

Null texts count as empty and stay null; a null id is never a label, a query or a duplicate. Equal rows are judged alike, so that they
go or stay together. Very long texts are worked on whole, one at a time. An empty table passes through as an empty one. Extra columns,
whatever their names, stay as they are in all stages but the last, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, packing, simhash, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half by a model of the labels of this stage's own input; without labels of both kinds, all stay."""
    return toxicity.keep_clean(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; documents without an id stay. Where an id has several texts, each is judged by itself."""
    return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; a text that repeats an earlier passage of 20 words or more is what is left of it, and n_chars is set to the length of each text (null: null)."""
    return substring.dedup(docs, in_place=True).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its sequence and its offset there; an empty text is a piece of one id."""
    import public_tokenizers

    return packing.places(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats), ("best_fit_packing", pack)]

#: A trained model, signatures and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else common.materialize(out)
    return docs
