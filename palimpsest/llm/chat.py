"""Chat formatting by assembly of tokens.

A conversation is one sequence of ids. Role marks and the end mark are reserved ids above the vocabulary, spliced
between segments that are encoded apart, so text can never make one. The loss mask is the running sum of +1 where an
assistant's text begins and -1 where it ends. In the formatted string the marks are control strings; where a text holds
one, or an escaped one, a backslash is put (one more) behind its first character, which undoes exactly.

Turns are ordered by (turn, role, text), nulls first. A null text is empty and a null role is ``user``; roles other than system, user and
assistant are named in the mark. Repeated rows are turns of their own. A null conv_id is a conversation. An empty
table gives no rows. Columns other than the four are left out. A conversation is a row, so it must fit a worker's memory; its
turns are gathered in blocks, by partial aggregation first.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Control strings of the template: the marks before each role's text, behind a mark's other role, and at a turn's end.
MARKS = {"system": "<<SYS>>", "user": "[INST]", "assistant": "[/INST]"}
OTHER, OTHER_END, END, BEGIN = "<|role:", "|>", "</s>", "<s>"
CONTROL = [*MARKS.values(), OTHER, OTHER_END, END, BEGIN]
_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    """``text`` with no control string in it."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


class Chat:
    """Reserved ids follow the vocabulary: begin, end, one for each known role, other role, other role's end."""

    def __init__(self, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.begin, self.end, self.other, self.other_end = first, first + 1, first + 2, first + 3
        self.roles = {r: first + 4 + k for k, r in enumerate(MARKS)}
        self.strings = {self.begin: BEGIN, self.end: END, self.other: OTHER, self.other_end: OTHER_END} | {i: MARKS[r] for r, i in self.roles.items()}
        self.first = first

    def encode(self, turns: list[tuple[str, str]]) -> tuple[list[int], np.ndarray, str]:
        """ids, loss mask and formatted string of (role, text) turns."""
        ids, steps, shown = [self.begin], [], [BEGIN]
        for role, text in turns:
            if role in MARKS:
                ids.append(self.roles[role])
                shown.append(MARKS[role])
            else:
                ids += [self.other, *self.lib.encode_ordinary(escape(role)), self.other_end]
                shown += [OTHER, escape(role), OTHER_END]
            start = len(ids)
            ids += self.lib.encode_ordinary(escape(text))
            if role == "assistant":
                steps += [(start, 1), (len(ids), -1)]
            ids.append(self.end)
            shown += [escape(text), END]
        change = np.zeros(len(ids) + 1, dtype=np.int8)
        for at, by in steps:
            change[at] += by
        return ids, np.cumsum(change)[:-1].astype(np.int8), "".join(shown)

    def decode(self, ids: list[int], mask: list[int]) -> tuple[list[tuple[str, str]], list[str], str]:
        """Turns, texts under the loss mask, and the formatted string, from ids and mask alone."""
        turns, shown, at, role = [], [], 0, None
        known = {i: r for r, i in self.roles.items()}
        loss = [unescape(self.lib.decode(run)) for run in self._runs(ids, mask)]
        while at < len(ids):
            if ids[at] >= self.first:
                i = ids[at]
                shown.append(self.strings[i])
                if i in known:
                    role = known[i]
                if i == self.end or i == self.begin:
                    role = None
                at += 1
                stop = self._next(ids, at)
                text = self.lib.decode(ids[at:stop])
                shown.append(text)
                if i == self.other:
                    role = unescape(text)
                elif role is not None:
                    turns.append((role, unescape(text)))
                at = stop
        return turns, loss, "".join(shown)

    def _next(self, ids: list[int], at: int) -> int:
        while at < len(ids) and ids[at] < self.first:
            at += 1
        return at

    @staticmethod
    def _runs(ids: list[int], mask: list[int]) -> Iterator[list[int]]:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(mask, dtype=np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            yield ids[a:b]


_CHATS: dict[str, Chat] = {}


def chat(path: str) -> Chat:
    if path not in _CHATS:
        _CHATS[path] = Chat(path)
    return _CHATS[path]


#: Conversations that a worker holds as Python lists at once.
AT_ONCE = 100
FORMATTED = "conv_id long, ids array<int>, loss_mask array<tinyint>, formatted string"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(rows: DataFrame, ranks_path: str) -> DataFrame:
    """conv_id, ids, loss_mask, formatted: one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chat(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                done = [own.encode([(t["role"], t["text"]) for t in turns]) for turns in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([d[0] for d in done], pa.list_(pa.int32())), pa.array([d[1] for d in done], pa.list_(pa.int8())), pa.array([d[2] for d in done], pa.string())],
                    names=["conv_id", "ids", "loss_mask", "formatted"],
                )

    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return gathered.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, ranks_path: str) -> DataFrame:
    """Digests of what ids and mask hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chat(ranks_path)
        for batch in common.slices(batches, rows=AT_ONCE):
            out = []
            for name, ids, mask, shown in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                turns, loss, again = own.decode(ids, mask)
                if again != shown:
                    raise ValueError(f"conversation {name}: ids and formatted string differ")
                text = "".join(loss)
                out.append((name, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(text), hashlib.sha256(text.encode()).hexdigest(), len(shown)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: digests read back from all formatted conversations, and from one made of control strings."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    mean = "</s>[INST] ok [/INST]"
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", mean), (-1, 1, "assistant", mean)], "conv_id long, turn long, role string, text string"))
    return read_back(format_conversations(rows, path), path)
