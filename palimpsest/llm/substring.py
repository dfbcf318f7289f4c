"""Exact substring deduplication with fixed-block anchors.

A word is removed if a window of ``WINDOW`` consecutive words that covers it has the same words as a window that starts
earlier (in a document of a smaller id, or earlier in its own). Any such window holds a whole aligned
block of WINDOW / 2 words of its own document, whatever its start. So the aligned blocks of all documents are the index and every rolling block of
that length is a probe:

1. Documents are written in chunks to the shared folder. Each chunk deals the distinct hashes of its rolling blocks, told apart as
   aligned or not, to buckets.
2. A bucket finds the blocks that are aligned somewhere and occur twice or more, and tells the chunks that have them.
3. Around these hits a chunk extends: every window that holds a hit is a candidate, and neighbouring windows make
   up the maximal repeats. The distinct candidates of a chunk, each with its first document, are dealt to buckets again.
4. A bucket finds the first document of each window and tells the other chunks.
5. A chunk covers the windows that it lost, and those that it has had before, and writes what is left.

Only packed hashes are shuffled, at most one for each distinct block or window of a chunk: a passage that a third of all
documents share is as many entries as there are chunks. No pairs are made. Blocks are told apart by 48 bits (only candidates
depend on it), windows by 64.

Null texts are empty and repeats of one document are judged by their start. Rows of one id count as one document's copies: of
equal rows one keeps its words, of an id's different texts likewise: the first in a chunk, and of chunks the one with the
smaller number, which is drawn at random. A null id comes first. A very long text is one chunk. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks as files
from . import common

WINDOW = 20
BLOCK = WINDOW // 2
#: Text bytes of a chunk, and hashes of a bucket, on average.
CHUNK_BYTES, BUCKET_HASHES = 4 << 20, 1 << 20
_ID, _TEXT = "doc_id", "text"
_M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
PACKED = "bucket int, chunk long, packed binary"


def pack(values: np.ndarray) -> bytes:
    """Ascending uint64 values: differences, by byte planes, compressed."""
    import zstandard

    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def rolling(words: np.ndarray, size: int, by: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes."""
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(by) + words[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(_M1)
    return out ^ (out >> np.uint64(29))


class Chunk:
    """Documents in order of their ids, as one sequence of word hashes."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, keep: bool = False):
        """keep: the words themselves as well."""
        from xxhash import xxh64_intdigest

        self.table, self.words, parts = table, [], [np.zeros(0, np.uint64)]
        for piece in table.column(text_col).cast(pa.binary()).iterchunks():
            for text in piece:
                words = (text.as_py() or b"").split()
                parts.append(np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
                if keep:
                    self.words.append(words)
        self.ids = files.ids_of(table, id_col)
        sizes = np.array([len(x) for x in parts[1:]], dtype=np.int64)
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        flat = np.concatenate(parts)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.room = self.stops[self.doc] - np.arange(len(flat)) if len(flat) else np.zeros(0, np.int64)
        self.hashes = flat

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """48-bit hashes of rolling blocks of documents with a window, their positions, and whether they are aligned."""
        g = rolling(self.hashes, BLOCK, _M2) >> np.uint64(16)
        long_ = (self.stops - self.starts >= WINDOW)[self.doc[: len(g)]]
        at = np.flatnonzero((self.room[: len(g)] >= BLOCK) & long_)
        return g[at], at, (at - self.starts[self.doc[at]]) % BLOCK == 0

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of windows, and their positions."""
        g = rolling(self.hashes, WINDOW, _M1)
        at = np.flatnonzero(self.room[: len(g)] >= WINDOW)
        return g[at], at


def _by_bucket(values: np.ndarray, bits: int, top: int) -> Iterator[tuple[int, slice]]:
    """Bucket, its place in the ascending values of ``top`` bits."""
    bucket = (values >> np.uint64(top - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def dedup(docs: DataFrame, id_col: str = _ID, text_col: str = _TEXT, in_place: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that are left, joined by one blank.

    in_place: the rows of ``docs`` instead, all columns, with kept words for the text where anything was removed.
    """
    spark = docs.sparkSession
    folder = common.shared_dir(spark)
    if not in_place:
        docs = docs.select(F.col(id_col).cast("long").alias(_ID), F.col(text_col).cast("string").alias(_TEXT))
        id_col, text_col = _ID, _TEXT
    chunks = files.write(docs, folder, id_col, text_col, CHUNK_BYTES)
    n, total = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).head()
    bits = max(4, (total // BUCKET_HASHES).bit_length())  # a bucket stays as small, however much there is
    tasks = max(1, min(n, 10_000))
    load = lambda chunk, keep=False: Chunk(files.load(folder, chunk), id_col, text_col, keep)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                g, _, aligned = load(chunk).blocks()
                order = np.argsort(g, kind="stable")
                g, aligned = g[order], aligned[order]
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
                twice = np.diff(first, append=len(g)) > 1
                anchored = np.logical_or.reduceat(aligned, first) if len(g) else aligned
                g = g[first]
                told = g << np.uint64(2) | anchored.astype(np.uint64) << np.uint64(1) | twice.astype(np.uint64)
                yield _batch([(b, chunk, pack(told[s])) for b, s in _by_bucket(g, bits, 48)], PACKED)

    def anchors(table: pa.Table) -> pa.Table:
        names, told = table.column("chunk").to_pylist(), [unpack(x) for x in table.column("packed").to_pylist()]
        flat = np.concatenate(told)
        flat.sort()
        keys = flat >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        flags = np.bitwise_or.reduceat(flat & np.uint64(3), first)
        often = (np.diff(first, append=len(keys)) > 1) | (flags & np.uint64(1) > 0)
        hits = keys[first][often & (flags & np.uint64(2) > 0)]
        out = []
        for chunk, x in zip(names, told, strict=True):
            own = x >> np.uint64(2)
            own = own[np.isin(own, hits, assume_unique=True)]
            if len(own):
                out.append((int(table.column("bucket")[0].as_py()), chunk, pack(own)))
        return pa.Table.from_batches([_batch(out, PACKED)])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row, chunk in enumerate(batch.column(0).to_pylist()):
                own, hits = load(chunk), np.sort(np.concatenate([unpack(x) for x in batch.column(1)[at_row].as_py()]))
                g, at, _ = own.blocks()
                hit = np.zeros(len(own.hashes) + WINDOW, dtype=np.int64)
                hit[at[np.isin(g, hits)]] = 1
                before = np.concatenate([[0], np.cumsum(hit)])
                w, at = own.windows()
                held = before[at + WINDOW - BLOCK + 1] > before[at]
                w, first = np.unique(w[held], return_index=True)
                ids = own.ids[own.doc[at[held][first]]]
                yield _batch([(b, chunk, len(w[s]).to_bytes(4, "little") + _pair(w[s], ids[s])) for b, s in _by_bucket(w, bits, 64)], PACKED)

    def firsts(table: pa.Table) -> pa.Table:
        names = table.column("chunk").to_pylist()
        parts = [_unpair(x[4:], int.from_bytes(x[:4], "little")) for x in table.column("packed").to_pylist()]
        of = np.repeat(np.arange(len(parts)), [len(w) for w, _ in parts])
        w, ids = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.argsort(names)] = np.arange(len(names))
        order = np.lexsort((rank[of], ids, w))
        lost = np.concatenate([[False], w[order][1:] == w[order][:-1]])
        lost = order[lost]
        out = []
        for k in np.unique(of[lost]).tolist():
            out.append((int(table.column("bucket")[0].as_py()), names[k], pack(np.sort(w[lost[of[lost] == k]]))))
        return pa.Table.from_batches([_batch(out, PACKED)])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row, chunk in enumerate(batch.column(0).to_pylist()):
                own = load(chunk, keep=True)
                w, at = own.windows()
                lost = np.isin(w, np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for x in batch.column(1)[at_row].as_py() or [])]))
                lost |= _again(w)
                edge = np.zeros(len(own.hashes) + WINDOW + 1, dtype=np.int64)
                np.add.at(edge, at[lost], 1)
                np.add.at(edge, at[lost] + WINDOW, -1)
                gone = np.cumsum(edge)[: len(own.hashes)] > 0
                yield from _left(own, gone, text_col, in_place)
                del own, gone, edge, w, at, lost
                pa.default_memory_pool().release_unused()

    paths = common.materialize(chunks.select("chunk").repartition(tasks))
    dealt = lambda df: df.groupBy("bucket")
    gathered = lambda df: df.groupBy("chunk").agg(F.collect_list("packed").alias("packed"))  # noqa: E731  one for each bucket at most
    spread = lambda df: df.repartition(tasks, "chunk")
    hits = common.materialize(dealt(spread(paths).mapInArrow(probe, PACKED)).applyInArrow(anchors, PACKED))
    lost = common.materialize(dealt(spread(gathered(hits)).mapInArrow(extend, PACKED)).applyInArrow(firsts, PACKED))
    common.release(hits)
    last = spread(paths.join(gathered(lost), "chunk", "left"))
    return last.mapInArrow(cover, docs.schema if in_place else "doc_id long, n_words long, n_removed long, kept string")


def _again(w: np.ndarray) -> np.ndarray:
    """Whether a hash has occurred before."""
    out = np.ones(len(w), dtype=bool)
    out[np.unique(w, return_index=True)[1]] = False
    return out


def _pair(w: np.ndarray, ids: np.ndarray) -> bytes:
    import zstandard

    steps = np.diff(w, prepend=np.uint64(0))
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 8), np.ascontiguousarray(ids).view(np.uint8).reshape(-1, 8)], axis=1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpair(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    rows = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(16, n).T)
    return np.cumsum(np.ascontiguousarray(rows[:, :8]).view(np.uint64).ravel(), dtype=np.uint64), np.ascontiguousarray(rows[:, 8:]).view(np.int64).ravel()


def _left(own: Chunk, gone: np.ndarray, text_col: str, in_place: bool) -> Iterator[pa.RecordBatch]:
    """What is left of a chunk's documents, in batches of bounded size."""
    removed = np.concatenate([[0], np.cumsum(gone)])
    n_removed = removed[own.stops] - removed[own.starts]
    at = 0
    while at < len(own.words):
        stop, size = at, 0
        while stop < len(own.words) and size < 200_000:
            size += len(own.words[stop]) + 10
            stop += 1
        kept = [None if not n_removed[i] else b" ".join([w for w, g in zip(own.words[i], gone[own.starts[i] : own.stops[i]].tolist(), strict=True) if not g]).decode() for i in range(at, stop)]
        rows = own.table.slice(at, stop - at)
        if in_place:
            old = rows.column(text_col).to_pylist()
            place = rows.schema.get_field_index(text_col)
            rows = rows.set_column(place, rows.schema.field(place), pa.array([o if k is None else k for o, k in zip(old, kept, strict=True)], pa.string()))
            yield from rows.combine_chunks().to_batches()
        else:
            texts = [k if k is not None else b" ".join(own.words[i]).decode() for i, k in zip(range(at, stop), kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).combine_chunks(), pa.array([len(w) for w in own.words[at:stop]], pa.int64()), pa.array(n_removed[at:stop].astype(np.int64)), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )
        at = stop


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: what is left of every document."""
    return dedup(common.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
