"""Exact top-k by inner product, with a pivot table.

Vectors are lifted by one coordinate to one norm, which makes the largest inner product the least Euclidean distance. Distances to
pivots are computed once for every row, and by the triangle inequality the largest difference of two rows' distances to
a pivot bounds their own distance from below. A block has pivots of its own besides: a product with a row is at most the one with the row's
nearest local pivot plus the query's length times the row's distance to it, which is a bound of the distance again. The larger bound counts.

1. A bounded sample gives the pivots, and each query its k-th best score there: no later one need be under it.
2. Candidates are dealt to blocks by their nearest pivot (a pivot with many rows has many blocks). A block knows the least and largest
   distance of its rows to each pivot, so a query for which even those exclude its rows skips the whole block.
3. In a block, a query takes candidates in the order of their bounds, in growing portions, until the next bound exceeds the
   distance of its k-th best: nothing behind it can enter. Only rows that reach the k-th best of the sample leave the block.

Queries are written to the shared folder in files of bounded size. A task holds one block of candidates and one
file of queries at a time, so nothing is broadcast and no pair is shuffled; a block's best k of each query are merged. How much is
excluded depends on the vectors alone: where they have no structure, nearly nothing, and time grows with queries times rows.

Components become floor(64 * x), as doubles and saturated at +-2^62; where products could exceed 2^53, scores are summed by
Python's integers, and a score beyond a long saturates. Vectors that are null or hold a null or a non-finite component take no part; shorter
vectors are padded with zeros. Candidates with the query's id are its own rows and left out. Several vectors of one
query id: the least is the query; repeated rows of other ids are candidates each. An empty table gives no rows.
Columns other than id and vector are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Pivots, rows of the sample, candidates of a block on average, queries of a file, queries at a time, and the first portion.
PIVOTS, SAMPLE, BLOCK, FILE, AT_ONCE, FIRST = 32, 2048, 8192, 4096, 128, 64
#: Rows of a block for each pivot of its own.
LOCAL = 64
EXACT = 2**53
_MOST, _LEAST = 2**63 - 1, -(2**63)
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """floor(64 * x) of every component; null for a vector that takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = 2**62
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * 64, F.lit(float(limit))), F.lit(-float(limit)))).cast("long"))
    return F.when(vector.isNotNull() & sound, scaled)


def choose_pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next one maximises the distance to those chosen."""
    if not len(rows):
        return rows
    chosen = [int(np.argmax((rows**2).sum(axis=1)))]
    far = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


@dataclass
class Space:
    """What all tasks share: arithmetic, radius and pivots."""

    dims: int
    exact: bool  # whether sums of products are exact as doubles
    radius2: float
    pivots: np.ndarray | None = None

    def matrix(self, column) -> np.ndarray:
        rows = column.to_pylist()
        out = np.zeros((len(rows), self.dims), dtype=np.float64 if self.exact else object)
        for i, row in enumerate(rows):
            out[i, : len(row)] = row[: self.dims]
        return out

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(self.radius2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)

    def apart(self, lifted: np.ndarray) -> np.ndarray:
        """Distances to the pivots."""
        return np.sqrt(np.maximum((lifted**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * lifted @ self.pivots.T, 0)).astype(np.float32)

    def query_apart(self, queries: np.ndarray) -> np.ndarray:
        return self.apart(np.concatenate([queries.astype(np.float64), np.zeros((len(queries), 1))], axis=1))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.exact:
            return rows @ query
        return np.array([max(_LEAST, min(_MOST, int(x))) for x in rows @ query], dtype=np.int64).astype(object)

    def reach(self, norm2: float, score) -> float:
        """Distance, and a little more for rounding, within which every row lies that scores at least as much."""
        if score is None or score <= _LEAST:
            return np.inf
        return float(np.sqrt(max(norm2 + self.radius2 - 2 * float(score), 0.0)) + 1e-4 * np.sqrt(self.radius2) + 1e-3)


def best_of_block(space: Space, queries: np.ndarray, query_ids: np.ndarray, least: list, table: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query number, id, score) of each query's best k in the block that score at least ``least`` (None: any), and how many products were evaluated."""
    rows, asked = table.astype(np.float64), queries.astype(np.float64)
    bounds, near = space.apart(space.lifted(table)), space.query_apart(queries)
    local = choose_pivots(rows, -(-len(rows) // LOCAL))
    apart = np.sqrt(np.maximum((rows**2).sum(axis=1)[:, None] + (local**2).sum(axis=1)[None, :] - 2 * rows @ local.T, 0))
    own = apart.argmin(axis=1)
    radius = apart[np.arange(len(rows)), own]
    widest = np.zeros(len(local))
    np.maximum.at(widest, own, radius)
    low_edge, high_edge = bounds.min(axis=0), bounds.max(axis=0)
    norms = [float(x) for x in (asked**2).sum(axis=1)]
    length, reach2 = np.sqrt(norms), np.array(norms) + space.radius2
    far = lambda q, most: np.sqrt(np.maximum(reach2[q, None] - 2 * most, 0)).astype(np.float32)  # noqa: E731  at least this far, if the product is at most that
    limits = np.array([space.reach(n, s) for n, s in zip(norms, least, strict=True)])
    whole = np.maximum(low_edge[None, :] - near, near - high_edge[None, :]).max(axis=1)
    asking = np.flatnonzero(whole <= limits)
    asking = asking[far(asking, asked[asking] @ local.T + length[asking, None] * widest[None, :]).min(axis=1) <= limits[asking]] if len(asking) else asking
    out, done = [], 0
    for at in range(0, len(asking), AT_ONCE):
        part = asking[at : at + AT_ONCE]
        low = np.zeros((len(part), len(table)), dtype=np.float32)
        for p in range(bounds.shape[1]):
            np.maximum(low, np.abs(near[part, p, None] - bounds[None, :, p]), out=low)
        np.maximum(low, far(part, (asked[part] @ local.T)[:, own] + length[part, None] * radius[None, :]), out=low)
        for j, i in enumerate(part.tolist()):
            c = np.flatnonzero((low[j] <= limits[i]) & (ids != query_ids[i]))
            c = c[np.argsort(low[j, c], kind="stable")]
            scores, n, step = None, 0, FIRST
            while n < len(c):  # in the order of the bound, until the next one exceeds the k-th best's distance
                if scores is not None and len(scores) >= k and low[j, c[n]] > space.reach(norms[i], np.sort(scores)[-k]):
                    break
                more = space.scores(table[c[n : n + step]], queries[i])
                scores = more if scores is None else np.concatenate([scores, more])
                n, step = n + step, 2 * step
            if scores is None:
                continue
            done += len(scores)
            held = sorted((-int(s), int(ids[x])) for s, x in zip(scores.tolist(), c.tolist(), strict=False)) if len(scores) <= 4 * k else _first(scores, ids[c[: len(scores)]], k)
            out += [(i, x, -s) for s, x in held[:k] if least[i] is None or -s >= least[i]]
    return out, done


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(- score, id) of the best k, ties to the smaller id."""
    kth = np.sort(scores)[-k]
    near = np.flatnonzero(scores >= kth)
    return sorted((-int(scores[x]), int(ids[x])) for x in near.tolist())[:k]


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score. candidates and queries: (vec_id long, v array<long>), v not null."""
    found = _search(candidates, queries, k, False)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluated(candidates: DataFrame, queries: DataFrame, k: int) -> float:
    """The share of all pairs of a query and a candidate whose product ``top_k`` computes in blocks."""
    row = _search(candidates, queries, k, True).agg(F.sum("query_id"), F.sum("vec_id")).head()
    return row[1] / row[0] if row[0] else 0.0


def _search(candidates: DataFrame, queries: DataFrame, k: int, count: bool) -> DataFrame:
    """(query_id, vec_id, score) of each block's best k; with ``count``, (pairs, products, 0) of each block instead."""
    spark = candidates.sparkSession
    candidates = common.materialize(candidates)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = candidates.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d"), F.max(square).alias("r2"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).head()
    if not whole["n"]:
        return spark.createDataFrame([], FOUND)
    dims = max(whole["d"], 1)
    space = Space(dims, float(whole["most"] or 0) ** 2 * dims < EXACT, float(whole["r2"]))
    sample = candidates.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow()  # bounded
    sample_ids, sample_rows = sample.column("vec_id").to_numpy(), space.matrix(sample.column("v"))
    space.pivots = choose_pivots(space.lifted(sample_rows), PIVOTS)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their k-th best score in the sample."""
        for batch in batches:
            q, kth = space.matrix(batch.column(1)), []
            for i, own in enumerate(batch.column(0).to_pylist()):
                s = space.scores(sample_rows, q[i])[sample_ids != own]
                kth.append(int(np.sort(s)[-k]) if len(s) >= k else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kth, pa.int64())], names=["vec_id", "v", "kth"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = space.apart(space.lifted(space.matrix(batch.column(1)))).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest, pa.int32())], names=["vec_id", "v", "pivot"])

    asked = common.materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    folder = common.shared_dir(spark)
    asked.mapInArrow(bounded, "vec_id long, v array<long>, kth long").write.option("maxRecordsPerFile", FILE).parquet(folder)
    files = [f"{folder}/{x.rsplit('/', 1)[-1]}" for x in spark.read.schema("vec_id long, v array<long>, kth long").parquet(folder).inputFiles()]
    placed = common.materialize(candidates.mapInArrow(dealt, "vec_id long, v array<long>, pivot int"))
    common.release(candidates, asked)
    sizes = placed.groupBy("pivot").agg(F.count("*").alias("n"))  # a row a pivot
    blocks = placed.join(F.broadcast(sizes), "pivot").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("n") / BLOCK)))

    def run(block: pa.Table) -> pa.Table:
        import pyarrow.parquet as pq

        fs, _ = common.file_system(folder)
        ids, table = block.column("vec_id").to_numpy(), space.matrix(block.column("v"))
        rows, pairs, products = [], 0, 0
        for path in files:
            got = pq.read_table(common.file_system(path)[1], filesystem=fs)
            if got.num_rows:
                names = got.column("vec_id").to_numpy()
                found, done = best_of_block(space, space.matrix(got.column("v")), names, got.column("kth").to_pylist(), table, ids, k)
                pairs, products = pairs + len(names) * len(ids), products + done
                rows += [(int(names[i]), x, s) for i, x, s in found]
        rows = [(pairs, products, 0)] if count else rows
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], names=["query_id", "vec_id", "score"])

    return blocks.select("pivot", "part", "vec_id", "v").groupBy("pivot", "part").applyInArrow(run, FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the 20 nearest by integer inner product of every row whose id is divisible by 20."""
    vectors = common.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).filter("v is not null and vec_id is not null")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)
