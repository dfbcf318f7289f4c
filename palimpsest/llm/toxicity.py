"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in the words it has and in their first four letters,
a document's is the noisy-or of its sentences: 1 - prod(1 - p). Only documents have labels; the gradient through the noisy-or shares a document's blame
among its sentences, so the trained model also locates the offending ones.

The model is fitted on the driver on a bounded sample: at most ``PER_CLASS`` labelled documents of each class, by hash of
their ids, but for texts of over ``LONGEST`` bytes, weighted back to the classes' true shares. Every word that tells the classes of the sample apart by ``TOLD`` standard errors
has a weight, however many those are. Scoring covers whole texts of all rows, very long ones sentence by sentence.

Null and empty texts have no sentence and score as one without known words. Labels that are null, of unknown ids or of a null id
teach nothing; several labels of one id count as their maximum; without a toxic example every score is
the smoothed base rate. Repeated rows score alike. Columns other than id and text are left out.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: documents of a class, and bytes of a document (longer ones are not in the sample).
PER_CLASS, LONGEST = 2000, 100_000
#: Standard errors by which a word's shares of toxic and of clean documents differ at least, for it to have a weight.
TOLD = 2.5
#: Documents of the sample in which a word must occur, passes of the optimiser, its step, and the decay of weights, shared by all documents.
LEAST_DOCS, PASSES, STEP, DECAY = 4, 120, 0.1, 0.1
_SENTENCE = re.compile(r"[^.!?\n。！？]+")
_WORD = re.compile(r"[^\W\d_]+")
STEM = 4
SCORES = "doc_id long, score double, offending array<struct<begin:int,end:int,score:double>>"


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) in code points."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def features(text: str, begin: int, end: int) -> set[str]:
    """Words of a lower-cased sentence, and the beginnings of the longer ones."""
    found = set(_WORD.findall(text, begin, end))
    return found | {"^" + w[:STEM] for w in found if len(w) > STEM}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def sentence_scores(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        low = text.lower()
        if len(low) != len(text):  # some letters have longer lower cases; spans stay those of the given text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        get, spans, sums = self.weights.get, sentences(low) or [(0, 0)], []
        for a, b in spans:
            sums.append(sum([x for w in features(low, a, b) if (x := get(w)) is not None]))
        return spans, 1 / (1 + np.exp(-np.clip(np.array(sums) + self.bias, -40, 40)))

    def score(self, p: np.ndarray) -> float:
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def fit(texts: list[str], toxic: list[int], weight: list[float]) -> Model:
    """Minimises the weighted negative log-likelihood of the document labels by Adam."""
    y, weight = np.array(toxic, dtype=float), np.array(weight, dtype=float)
    base = (weight @ y + 0.5) / (weight.sum() + 1) if len(y) else 0.01
    if not len(y) or not y.any() or y.all():
        return Model({}, float(np.log(base / (1 - base))))
    # Features are made twice and never kept but as numbers: the driver holds counts, then the chosen columns.
    seen, lengths = [Counter(), Counter()], []
    for text, label in zip(texts, toxic, strict=True):
        low = text.lower()
        spans = sentences(low) or [(0, 0)]
        lengths.append(len(spans))
        seen[label].update(set().union(*[features(low, a, b) for a, b in spans]))
    n = [max(1, int((y == k).sum())) for k in (0, 1)]

    def told(w: str) -> float:  # how unlike the shares of toxic and of clean documents are that have the word, in standard errors
        a, b = seen[1][w], seen[0][w]
        share = (a + b) / sum(n)
        return abs(a / n[1] - b / n[0]) / np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-9)

    common_ = [w for k in (0, 1) for w, count in seen[k].items() if (k == 0 or w not in seen[0]) and count + seen[1 - k][w] >= LEAST_DOCS]
    words = sorted(w for w in common_ if told(w) >= TOLD)
    del seen
    at = {w: k for k, w in enumerate(words)}
    flat, sizes = array("i"), []
    for text in texts:
        low = text.lower()
        for a, b in sentences(low) or [(0, 0)]:
            found = [at[w] for w in features(low, a, b) if w in at]
            flat.extend(found)
            sizes.append(len(found))
    column = np.array(flat, dtype=np.int32)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    doc = np.repeat(np.arange(len(texts)), lengths)
    weight = weight / weight.sum()
    w, b = np.zeros(len(words)), float(np.log(base / (1 - base)) - np.log(len(sizes) / len(texts)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, PASSES + 1):
        s = np.clip(np.bincount(row, w[column], len(sizes)) + b, -30, 30)
        p = 1 / (1 + np.exp(-s))
        clean = np.bincount(doc, np.logaddexp(0, s), len(texts))  # - log of the chance that no sentence is toxic
        toxic_ = np.maximum(-np.expm1(-clean), 1e-9)
        g = (weight * np.where(y == 1, -np.exp(-clean) / toxic_, 1.0))[doc] * p
        gw, gb = np.bincount(column, g[row], len(words)) + DECAY / len(texts) * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= STEP * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model({x: float(w[k]) for x, k in at.items() if abs(w[k]) > 1e-3}, float(b))


def fold(doc_id: Column) -> Column:
    """True for rows held out from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Model of the labelled rows that are not held out. labels: doc_id, toxic (0 or 1)."""
    labels = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    labels = labels.filter("label_id is not null and toxic in (0, 1)").filter(~fold(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    labels = common.materialize(labels)
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    by_hash = lambda k: labels.filter(F.col("toxic") == k).orderBy(F.xxhash64("label_id"), "label_id").limit(per_class)
    sample = by_hash(0).unionByName(by_hash(1))  # at most 2 * per_class rows
    rows = common.texts(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).filter(F.octet_length("text") <= LONGEST).groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    taken = Counter(r["toxic"] for r in rows)
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], [counts[r["toxic"]] / taken[r["toxic"]] for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, score, offending: sentences of at least ``least``, with their spans in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            scores, bad = [], []
            for text in batch.column(1).to_pylist():
                spans, p = model.sentence_scores(text)
                scores.append(model.score(p))
                bad.append([{"begin": spans[k][0], "end": spans[k][1], "score": float(p[k])} for k in np.flatnonzero(p >= least)])
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(bad, kind)], names=["doc_id", "score", "offending"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, SCORES)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, as they are, whose text scores under ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(model.sentence_scores(t or "")[1]) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: score of every document by a model of the labels outside the held-out fold."""
    docs = common.read(spark, sf_dir, "documents")
    out = score(docs, train(docs, common.read(spark, sf_dir, "labels")))
    return out.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
