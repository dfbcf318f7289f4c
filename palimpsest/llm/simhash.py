"""Near duplicates by SimHash, with a range join in segment-popcount space.

A fingerprint is mapped to the bit counts of its two-bit segments. The Manhattan distance of two count vectors is at
most the Hamming distance of the fingerprints, so fingerprints within two bits are within distance two on that integer
grid, and then some grid point is within one of both: each emits its own cell and the neighbours at distance one, links share a
cell, and every meeting is verified on the fingerprints themselves. Equal fingerprints are one node.

Where over ``CROWD`` fingerprints meet in a cell, pairs are not tried. There, fingerprints link through hubs: those within two
bits share a word within one bit of each, and each links to the least fingerprint around that word. That is exact
too, and linear.

``groups`` is the contract's operator. ``near_duplicates`` finds texts with a likeness (Jaccard) of 0.8 or more of their sets of
five-word shingles. Texts meet in the same grid, by a fingerprint of these shingles, which brings together all that are within two bits;
texts at 0.8 can be further apart than that, so those that share a band of least shingle hashes meet as well, wherever the edits are.
Both are cells of one table. A signature of 512 bits, of which the fingerprint is the first word, tells which meetings are
worth a look, and the sets themselves decide. In a cell of over ``PAIRED`` texts each is tried with the nearest by signature first;
then the texts of its blocks that might link to another class are compared with each other, all pairs at once in the worker,
so that no pair of a cell goes undecided.

Null and empty texts, and texts without words, have fingerprint zero and link like any other. Repeated rows share a
class. A null doc_id is in a class but never names one. An empty table gives no rows. Columns other than id and text
are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as files
from . import common
from .components import components

#: Fingerprints in one cell up to which they are compared with each other.
CROWD = 512
SEED = 42
#: Of near_duplicates: words of a shingle, 64-bit words of a signature, and likeness.
SHINGLE, SIGNATURE, LIKENESS = 5, 8, 0.8
#: Least shingle hashes that make a band, and bands: of pairs at 0.8, all but 1 in 300,000 share one (1 - (1 - 0.8 ** 4) ** 24).
LEAST, BANDS = 4, 24
#: Standard errors of the signature by which a pair may miss LIKENESS before its sets are compared; sets of under SMALL shingles always are.
LOOSE, SMALL = 5.0, 64
#: Texts in one cell up to which all pairs are rows, and about how many make a block of a larger one, whose blocks meet two by two.
PAIRED, BLOCK = 8, 1024
_BLOCK = 1 << 15
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, joined by blanks; of the whole sequence, if shorter."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Words of the bits that over half the rows have; hashes: rows of uint64 words."""
    n, k = hashes.shape
    counts = np.zeros(64 * k, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + _BLOCK].astype(">u8")).view(np.uint8).reshape(-1, 8 * k), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64) if len(bits) > 255 else bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > n).view(">u8").astype(np.uint64)


def _split(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes, both know ASCII only


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: 64-bit SimHash of the shingles of ``size`` words, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = [majority(shingle_hashes(_split(t), size)[:, None])[0] for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _shifted(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by)


def cells(counts: Column, segments: int) -> Column:
    """Array of a count vector's own grid cell and those at distance one. counts: two-bit counts, packed."""
    at = F.sequence(F.lit(0), F.lit(2 * segments - 2), F.lit(2))
    count = lambda i: F.call_function("shiftrightunsigned", counts, i).bitwiseAND(F.lit(3))
    # 0 and 1 differ by the bits 01, 1 and 2 by the bits 11.
    change = lambda i, small: counts.bitwiseXOR(_shifted(F.when(small, F.lit(1)).otherwise(F.lit(3)).cast("long"), i))
    up = F.transform(F.filter(at, lambda i: count(i) < 2), lambda i: change(i, count(i) == 0))
    down = F.transform(F.filter(at, lambda i: count(i) > 0), lambda i: change(i, count(i) == 1))
    return F.concat(F.array(counts), up, down)


def flips(fp: Column, bits: int) -> Column:
    """Array of a word and all that differ from it in one bit: the cells of one-bit segments."""
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: fp.bitwiseXOR(_shifted(F.lit(1).cast("long"), i))))


def segment_counts(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each in its segment's place."""
    even = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(even), F.call_function("shiftrightunsigned", fp, F.lit(1)).bitwiseAND(even)
    return low.bitwiseXOR(high).bitwiseOR(_shifted(low.bitwiseAND(high), F.lit(1)))


def _met(rows: DataFrame) -> DataFrame:
    """Those of the rows (cell, ...) whose cell has company, with its number of rows.

    The planner takes exploded rows to be as few as what they come from and would collect them all on the driver to broadcast them, hence the hint.
    """
    company = rows.groupBy("cell").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    return rows.hint("merge").join(company, "cell")


def _classes(x: np.ndarray, most: int) -> np.ndarray:
    """For each word the place of the first one in its class, linked within ``most`` bits."""
    return _linked(np.bitwise_count(x[:, None] ^ x[None, :]) <= most)


def _linked(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric, reflexive relation the first one in its class."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect just what chains of fingerprints (fp) within two bits connect."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for row in batch.column(0):
                x = np.unique(np.asarray(row.values).view(np.uint64))
                label = _classes(x, 2)
                odd = np.flatnonzero(label != np.arange(len(x)))
                a.append(x[label[odd]])
                b.append(x[odd])
            out = [np.concatenate([np.zeros(0, np.uint64), *c]).view(np.int64) for c in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b"])

    dealt = nodes.select("fp", segment_counts(F.col("fp")).alias("counts")).select("fp", F.explode(cells(F.col("counts"), 32)).alias("cell"))
    met = common.materialize(_met(dealt))
    few = met.filter(F.col("crowd") <= CROWD).groupBy("cell").agg(F.collect_list("fp").alias("fps")).select("fps")
    near = few.mapInArrow(verify, "a long, b long")
    crowded = met.filter(F.col("crowd") > CROWD).select("fp").distinct()
    around = crowded.select("fp", F.explode(flips(F.col("fp"), 64)).alias("hub"))
    least = around.groupBy("hub").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1")
    hubs = around.hint("merge").join(least, "hub").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(hubs).filter("a <> b").distinct()


def groups(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: smallest doc_id that links within two bits reach."""
    prints = common.materialize(fingerprints(docs, size, id_col, text_col))
    nodes = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes)).select(F.col("node").alias("fp"), "label")
    classes = common.materialize(nodes.join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    named = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = common.materialize(classes.join(named, "label").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: fingerprint and class of every document."""
    out = groups(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit hashes of each hash."""
    x = h[:, None] + (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(_GOLDEN))[None, :]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def bits_apart(likeness: float, bits: int, allowed: float) -> int:
    """Bits in which signatures of sets of that likeness differ, and ``allowed`` standard errors more."""
    share = math.acos(2 * likeness / (1 + likeness)) / math.pi
    return math.floor(bits * share + allowed * math.sqrt(bits * share * (1 - share)))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS words, each of the least of the set under LEAST orders: sets share one with probability likeness ** LEAST."""
    orders = _mixed(np.arange(1, 2, dtype=np.uint64), LEAST * BANDS)[0] | np.uint64(1)
    least = np.full(LEAST * BANDS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (orders[:, None] * hashes[None, at : at + _BLOCK]).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, LEAST).T:
        out = _mixed(out ^ part, 1)[:, 0]
    return out


def signatures(chunks: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """chunk, row, doc_id, node (64-bit hash of the text), n (shingles), s0.. (signature words), bands."""
    names = ["n", *(f"s{k}" for k in range(SIGNATURE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                table = files.load(folder, chunk).select([id_col, text_col])
                at = 0
                for part in common.slices(iter(table.to_batches())):
                    rows, bands, nodes = [], [], []
                    for text in part.column(1).cast(pa.binary()).to_pylist():
                        own = np.unique(shingle_hashes(_split(text or b""), SHINGLE))
                        nodes.append(xxh64_intdigest(text or b"", SEED))
                        rows.append(np.concatenate([np.array([len(own)], dtype=np.uint64), majority(_mixed(own, SIGNATURE))]))
                        bands.append(least_hashes(own).view(np.int64))
                    numbers = np.array(rows, dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
                    columns = [pa.array(np.full(part.num_rows, chunk)), pa.array(np.arange(at, at + part.num_rows, dtype=np.int32)), part.column(0).cast(pa.int64()), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64))]
                    columns += [pa.array(np.ascontiguousarray(numbers[:, k])) for k in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(bands, pa.list_(pa.int64()))], names=["chunk", "row", "doc_id", "node", *names, "bands"])
                    at += part.num_rows

    kind = "chunk long, row int, doc_id long, node long, " + ", ".join(f"{n} long" for n in names) + ", bands array<long>"
    return chunks.select("chunk").repartition(files.tasks_of(chunks), "chunk").mapInArrow(run, kind)


def bodies(places: DataFrame, folder: str, text_col: str) -> DataFrame:
    """(node, text) of places (chunk, row, node): only these texts are shuffled, read from the chunks that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts = files.load(folder, chunk).column(text_col).take(pa.array([w["row"] for w in wanted])).cast(pa.string())
                found = pa.table({"node": pa.array([w["node"] for w in wanted], pa.int64()), "text": texts.fill_null("")})
                yield from common.slices(iter(found.to_batches()))

    listed = places.groupBy("chunk").agg(F.collect_list(F.struct("row", "node")).alias("wanted"))  # at most a chunk's rows
    return listed.mapInArrow(run, "node long, text string")


def alike(a: np.ndarray, b: np.ndarray, likeness: float) -> bool:
    """Whether two sets, sorted, are as alike as asked for (Jaccard); two empty ones are."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return union == 0 or both / union >= likeness


def _set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(_split(text.encode()), SHINGLE))


def verified(pairs: DataFrame, bodies: DataFrame, likeness: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets of shingles are as alike as asked for. bodies: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = np.zeros(0, np.uint64), None  # rows of one b often follow each other
        for batch in common.slices(batches):
            keep = []
            for b, ta, tb in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if b != at:
                    known, at = _set(tb), b
                keep.append(alike(_set(ta), known, likeness))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: bodies.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of crowded cells (cell, node, crowd, ...), dealt to all pairs (i, j) of blocks of their cell."""
    of = F.ceil(F.col("crowd") / BLOCK).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64("node"), of).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), of - 1)))
    return own.select(*rows.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _apart(t: pa.Table, likeness: float) -> np.ndarray:
    """Bits apart of all rows (n, label, s0..), and far more where a pair is of one label or can't be alike."""
    n, label = t["n"].to_numpy(), t["label"].to_numpy()
    apart = np.zeros((len(n), len(n)), dtype=np.uint16)
    for k in range(SIGNATURE):
        x = t[f"s{k}"].to_numpy().view(np.uint64)
        apart += np.bitwise_count(x[:, None] ^ x[None, :])
    small, large = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    loose = (apart <= bits_apart(likeness, 64 * SIGNATURE, LOOSE)) | (small < SMALL)
    return np.where(loose & (small >= likeness * large - 1e-6) & (label[:, None] != label[None, :]), apart, 2**16 - 1)


def nearest(rows: DataFrame, likeness: float) -> DataFrame:
    """(a, b): each row of crowded cells (cell, node, crowd, n, label, s0..) and the nearest of another label in each block it meets."""

    def run(t: pa.Table) -> pa.Table:
        apart, node = _apart(t, likeness), t["node"].to_numpy()
        at = apart.argmin(axis=1)
        some = apart[np.arange(len(at)), at] < 2**16 - 1
        a, b = node[some], node[at[some]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return _blocks(rows).groupBy("cell", "i", "j").applyInArrow(run, "a long, b long")


def open_rows(rows: DataFrame, likeness: float) -> DataFrame:
    """(cell, i, j, node): those of the rows, as above, that could be alike to one of another label."""

    def run(t: pa.Table) -> pa.Table:
        return t.filter(pa.array((_apart(t, likeness) < 2**16 - 1).any(axis=1))).select(["cell", "i", "j", "node"])

    return _blocks(rows).groupBy("cell", "i", "j").applyInArrow(run, "cell long, i int, j int, node long")


def alike_matrix(sets: list[np.ndarray], likeness: float) -> np.ndarray:
    """``alike`` of all pairs of sets, by products of incidence matrices."""
    n = np.array([len(x) for x in sets])
    every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [first, first + 4096])
        has = np.zeros((len(sets), 4096), dtype=np.float32)
        has[row[lo:hi], column[lo:hi] - first] = 1
        both += has @ has.T
    np.fill_diagonal(both, n)
    union = n[:, None] + n[None, :] - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0) >= likeness


def verified_blocks(rows: DataFrame, bodies: DataFrame, likeness: float) -> DataFrame:
    """Edges (a, b) that connect what pairs alike connect in each pair of blocks. rows: as of ``open_rows``."""

    def run(t: pa.Table) -> pa.Table:
        node = t["node"].to_numpy()
        label = _linked(alike_matrix([_set(x) for x in t["text"].to_pylist()], likeness))
        odd = label != np.arange(len(label))
        return pa.table({"a": node[label[odd]], "b": node[odd]})

    return rows.join(bodies, "node").groupBy("cell", "i", "j").applyInArrow(run, "a long, b long")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of a short list."""
    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row in batch.column(0):
            x = np.sort(np.asarray(row.values))
            i, j = np.triu_indices(len(x), 1)
            a.append(x[i])
            b.append(x[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])


def meetings(texts: DataFrame) -> DataFrame:
    """(node, cell): grid cells of each text's fingerprint, and its bands. texts: node, s0 (the fingerprint), bands.

    Counts of two-bit segments are no words that a band, which is a hash, has but by chance; such a meeting would be verified like any other.
    """
    grid = cells(segment_counts(F.col("s0")), 32)
    return texts.select("node", F.explode(F.concat(grid, F.col("bands"))).alias("cell"))


def near_classes(chunks: DataFrame, folder: str, likeness: float = LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk, row, doc_id, node (64-bit hash of the text), class_id, first (a node of the class that has class_id) of all rows whose doc_id is not null.

    Texts stay in their chunks; only those that some signature finds alike are shuffled. Each table is deleted once its readers are written.
    """
    own = common.materialize(signatures(chunks, folder, id_col, text_col).filter("doc_id is not null"))
    # Of copies, one row stands for all.
    rest = [F.first(c).alias(c) for c in own.columns if c not in ("chunk", "row", "doc_id", "node")]
    texts = common.materialize(own.groupBy("node").agg(F.min(F.struct("doc_id", "chunk", "row")).alias("place"), *rest))
    met = common.materialize(_met(meetings(texts)))
    few = met.filter(F.col("crowd") <= PAIRED).groupBy("cell").agg(F.collect_list("node").alias("nodes")).select("nodes")
    tried = few.mapInArrow(_pairs, "a long, b long")
    # In a crowd, nearest ones first, which links most of a large group; what could still link is compared in blocks.
    many = common.materialize(met.filter(F.col("crowd") > PAIRED).join(texts.drop("place", "bands"), "node"))
    near = nearest(many.withColumn("label", F.col("node")), likeness)
    met_pairs = common.materialize(tried.unionByName(near).distinct())
    common.release(met)
    side = lambda c: texts.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), *[F.col(f"s{k}").alias(f"{c}{k}") for k in range(SIGNATURE)])
    both = met_pairs.join(side("a"), "a").join(side("b"), "b")
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(SIGNATURE)), F.lit(0))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    loose = (small >= likeness * large - 1e-6) & ((apart <= bits_apart(likeness, 64 * SIGNATURE, LOOSE)) | (small < SMALL))
    asked = common.materialize(both.filter(loose).select("a", "b"))
    common.release(met_pairs)
    placed = lambda nodes: texts.join(nodes.distinct(), "node", "left_semi").select("node", "place.chunk", "place.row")
    held = common.materialize(bodies(placed(asked.select(F.explode(F.array("a", "b")).alias("node"))), folder, text_col))
    edges = common.materialize(verified(asked, held, likeness))
    common.release(asked, held)
    found = components(edges)
    labelled = many.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("cell")
    left = common.materialize(open_rows(labelled.join(mixed, "cell", "left_semi"), likeness))
    common.release(many)
    if not left.isEmpty():
        held = common.materialize(bodies(placed(left.select("node")), folder, text_col))
        more = common.materialize(verified_blocks(left, held, likeness))
        common.release(held, found)
        found = components(edges.unionByName(more))
        common.release(more)
    common.release(left, edges)
    classes = common.materialize(texts.select("node", F.col("place.doc_id").alias("id")).join(found, "node", "left").withColumn("label", F.coalesce("label", "node")))
    common.release(texts, found)
    named = classes.groupBy("label").agg(F.min(F.struct("id", "node")).alias("least"))
    named = common.materialize(classes.join(named, "label").select("node", F.col("least.id").alias("class_id"), F.col("least.node").alias("first")))
    common.release(classes)
    return own.select("chunk", "row", "doc_id", "node").join(named, "node").select("chunk", "row", "doc_id", "node", "class_id", "first")


def near_duplicates(docs: DataFrame, likeness: float = LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) of all rows whose doc_id is not null."""
    folder = common.shared_dir(docs.sparkSession)
    chunks = files.write(common.texts(docs, id_col, text_col), folder, "doc_id", "text")
    out = common.materialize(near_classes(chunks, folder, likeness).select("doc_id", "class_id"))
    common.remove(docs.sparkSession, folder)
    return out


def drop_near_duplicates(docs: DataFrame, likeness: float = LIKENESS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each class those with its smallest id and, of that id's texts, one; rows without an id.

    Equal rows with that id all stay. Wide rows are written once, in chunks, and never shuffled.
    """
    folder = common.shared_dir(docs.sparkSession)
    chunks = files.write(docs, folder, id_col, text_col)
    classes = near_classes(chunks, folder, likeness, id_col, text_col)
    gone = common.materialize(classes.filter("doc_id <> class_id or node <> first").select("chunk", "row"))
    return files.kept(chunks, folder, gone, docs.schema)
