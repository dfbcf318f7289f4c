"""Best-fit packing of token sequences, by hierarchical residual packing.

Texts are tokenised and cut only where they exceed a sequence. Each task packs its own pieces by best fit, largest first. Bins that
no other bin can usefully join are emitted; the rest are items of the next round: they are dealt to fewer tasks, each of
which packs its items by best fit again, up to one task.

Which bins are emitted loses no merge. Two bins over half full never fit each other, so each merge uses up a bin at most half full;
best fit leaves at most one of those in a packing, so there are as many as there were packings. Of the fuller bins, that number
of those with most room is enough, as any others that a merge might use can be replaced by them. All others are done. So
a round passes on about two bins for each packing, whatever the lengths are.

A text's ids are those of its stretches between ASCII blanks, as the tokenizer's own pattern never spans white space. A stretch of
letters and the punctuation behind it are encoded apart. A batch's stretches are made distinct by Arrow, each distinct part is
encoded once per worker by the library, and ids are laid out for all texts of a batch at once.

Null and empty texts are one end id. Repeated rows (also with one id) are pieces of their own. Very long texts are cut into
pieces like any other; one text must fit in a task's memory. An empty table gives no rows. Columns other than id and text are left out.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pieces that a task packs at a time, and bins dealt to a task of a later round.
LOCAL_ITEMS, TASK_ITEMS = 50_000, 20_000
#: Distinct parts of stretches that a worker keeps, and their bytes on average at most.
CACHE_PARTS, LONG = 600_000, 32
#: Words and other parts that are encoded by one call.
JOINED, AT_ONCE = 1000, 20_000
#: A stretch that is encoded as two: plain Latin letters (whose lower case is one letter), and ASCII punctuation but for
#: the apostrophe, which may begin a token of its own with the letters behind it.
PARTS = "^(?P<core>[A-Za-zªµºÀ-ÖØ-öø-įĲ-ſ]+)(?P<tail>[!-&(-/:-@\\[-`{-~]*)$"

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BINS = "sequence_id long, fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


class WordIds:
    """Ids of texts, by the parts of their stretches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        suffix, vocabulary = getattr(self.lib.model, "end_of_word_suffix", None), self.lib.get_vocab()
        self.final = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids that end a word
        self.final[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        """Part 0 is the empty one."""
        self.number: dict[str, int] = {"": 0}
        self.size, self.at, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.held = 0  # bytes of parts

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts, where each part's begin, and how many it has. Lower-case words are joined by blanks, as each ends with an id that only ends have."""
        ids, size, rest = [], np.zeros(len(parts), dtype=np.int64), list(range(len(parts)))
        words = [i for i in rest if (x := parts[i]).isalpha() and x.islower() and max(x) < "\u0180"]
        order = []
        for at in range(0, len(words), JOINED):
            own = words[at : at + JOINED]
            found = np.array(self.lib.encode(" ".join([parts[i] for i in own]), add_special_tokens=False).ids, dtype=np.uint32)
            ends = np.flatnonzero(self.final[found])
            if len(ends) == len(own) and ends[-1] == len(found) - 1:
                ids.append(found)
                size[own] = np.diff(ends, prepend=-1)
                order += own
        done = set(order)
        rest = [i for i in rest if i not in done]
        for at in range(0, len(rest), AT_ONCE):
            own = rest[at : at + AT_ONCE]
            for i, x in zip(own, self.lib.encode_batch_fast([parts[i] for i in own], add_special_tokens=False), strict=True):
                ids.append(np.array(x.ids, dtype=np.uint32))
                size[i] = len(x.ids)
            order += own
        at = np.zeros(len(parts), dtype=np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), at, size

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """Numbers of distinct parts; new ones are encoded."""
        number = self.number
        new = [x for x in parts if x not in number]
        if len(number) + len(new) > CACHE_PARTS or self.held > LONG * CACHE_PARTS:
            self.clear()
            number = self.number
            new = [x for x in parts if x]
        if new:
            ids, at, size = self._encoded(new)
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            self.at, self.size, self.ids = np.concatenate([self.at, len(self.ids) + at]), np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
            self.held += sum(map(len, new))
        return np.fromiter(map(number.__getitem__, parts), dtype=np.int64, count=len(parts))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, where each text's begin, and at last where they end). An end id goes behind each text."""
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy()
        coded = words.values.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).dictionary_encode()
        bounds = bounds - bounds[0]
        parts = pc.extract_regex(coded.dictionary, PARTS)
        core = pc.if_else(parts.is_valid(), pc.utf8_lower(pc.struct_field(parts, "core")), coded.dictionary)
        tail = pc.if_else(parts.is_valid(), pc.struct_field(parts, "tail"), "")
        pairs = pa.concat_arrays([core, tail]).dictionary_encode()
        numbers = self._numbers(pairs.dictionary.to_pylist())[pairs.indices.to_numpy()].reshape(2, -1).T  # core and tail of each stretch
        flat = numbers[coded.indices.to_numpy()].ravel()
        bounds = 2 * bounds
        size = self.size[flat]
        begin = np.concatenate([[0], np.cumsum(size)])
        total = int(begin[-1])
        ids = self.ids[np.repeat(self.at[flat] - begin[:-1], size) + np.arange(total)]
        begin = begin[bounds]
        if end_id is not None:
            ids = np.insert(ids, begin[1:], end_id)
            begin = begin + np.arange(len(begin))
        return ids, begin


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that it fits; a bit set finds that bin."""
    open_bins: dict[int, list[int]] = {}  # by room left
    rooms, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = open_bins[room]
            bin_ = stack.pop()
            if not stack:
                rooms ^= 1 << room
            bins[bin_].append(i)
        else:
            room, bin_ = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            open_bins.setdefault(room, []).append(bin_)
            rooms |= 1 << room
    return bins


def _bins(bins: list[list[int]], items: list[list[dict]], sizes: list[int], first: int) -> pa.RecordBatch:
    fills = [sum(sizes[i] for i in b) for b in bins]
    members = pa.array([[m for i in b for m in items[i]] for b in bins], type=pa.list_(MEMBER))
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(bins)), pa.int64()), pa.array(fills, pa.int32()), members], names=["sequence_id", "fill", "members"])


def _first_id(level: int) -> int:
    """Bins of a round and task are numbered from here."""
    return level << 56 | TaskContext.get().partitionId() << 28


def unfinished(made: DataFrame, capacity: int):
    """Condition on the bins that the next round needs, or None if no two can be merged.

    Those are the S bins at most half full, and of the fuller ones that the least bin still fits the S with most room. Where some of
    one fill are enough, whole tasks of the round are taken, by the number that a bin's id begins with.
    """
    half = capacity // 2
    fills = {r["fill"]: r["n"] for r in made.groupBy("fill").agg(F.count("*").alias("n")).collect()}  # one row a fill at most
    small = sum(n for f, n in fills.items() if f <= half)
    if not small:
        return None
    least, wanted, needed = min(fills), small, F.col("fill") <= half
    if small == 1 and not any(half < f <= capacity - least for f in fills):
        return None
    for fill in sorted(f for f in fills if half < f <= capacity - least):
        if fills[fill] <= wanted:
            needed |= F.col("fill") == fill
            wanted -= fills[fill]
            if wanted:
                continue
            break
        task = F.call_function("shiftright", "sequence_id", F.lit(28))
        tasks = made.filter(F.col("fill") == fill).groupBy(task.alias("task")).agg(F.count("*").alias("n"))
        last = tasks.withColumn("so_far", F.sum("n").over(common.running("task"))).filter(F.col("so_far") >= wanted).agg(F.min("task")).head()[0]
        needed |= (F.col("fill") == fill) & (task <= last)
        break
    return needed


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a sequence: sequence_id, fill, members (doc_id, piece, start, length, ids_crc32) in order."""

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(tokenizer_path)
        items: list[list[dict]] = []
        number = _first_id(0)

        def packed():
            sizes = [x[0]["length"] for x in items]
            return _bins(best_fit(sizes, capacity), items, sizes, number)

        for batch in common.slices(batches, rows=10_000):
            ids, begin = own.encode(batch.column(1), end_id)
            raw, begin = memoryview(ids.astype("<u4", copy=False)).cast("B"), begin.tolist()
            for name, first, last in zip(batch.column(0).to_pylist(), begin, begin[1:], strict=False):
                for piece, start in enumerate(range(first, last, capacity)):
                    stop = min(last, start + capacity)
                    items.append([{"doc_id": name, "piece": piece, "start": start - first, "length": stop - start, "ids_crc32": zlib.crc32(raw[4 * start : 4 * stop])}])
            if len(items) >= LOCAL_ITEMS:
                out = packed()
                number += out.num_rows
                yield out
                items = []
        if items:
            yield packed()
        pa.default_memory_pool().release_unused()

    def later_round(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, items, sizes = _first_id(level), [], []

            def packed():
                return _bins(best_fit(sizes, capacity), items, sizes, number)

            for batch in batches:
                sizes += batch.column(0).to_pylist()
                items += batch.column(1).to_pylist()
                if len(items) >= 4 * TASK_ITEMS:
                    out = packed()
                    number += out.num_rows
                    yield out
                    items, sizes = [], []
            if items:
                yield packed()

        return run

    level, made, tasks, closed = 0, common.materialize(common.texts(docs, id_col, text_col).mapInArrow(first_round, BINS)), None, []
    while tasks != 1 and (needed := unfinished(made, capacity)) is not None:
        level += 1
        closed.append(made.filter(~needed))
        rest = made.filter(needed).select("fill", "members")
        fewer = -(-rest.count() // TASK_ITEMS)
        tasks = fewer if tasks is None else min(fewer, max(1, tasks // 2))
        made = common.materialize(rest.repartition(tasks).mapInArrow(later_round(level), BINS))
    out = made
    for part in closed:
        out = out.unionByName(part)
    return out


def places(sequences: DataFrame) -> DataFrame:
    """One row a piece, with its sequence and its offset there."""
    lengths = F.transform("members", lambda m: m["length"])
    total = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    rows = sequences.select("sequence_id", F.inline(F.arrays_zip(F.col("members").alias("m"), F.slice(total, 1, F.size("members")).alias("offset"))))
    return rows.select("m.*", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in sequences of 4096 tokens."""
    import public_tokenizers

    out = places(pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
