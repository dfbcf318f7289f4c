"""Whole rows in files of bounded size, for operators that come back to texts without shuffling them.

A task writes its rows, with all columns and in order of their ids, to files under names of its own attempt. The list of files is
materialised, so what a task that is run again left before is not in it. A place is a file and a row's number in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a chunk's rows.
CHUNK_BYTES = 4 << 20
CHUNKS = "chunk long, docs long, words long"


def _path(root: str, chunk: int) -> str:
    return f"{root}/{chunk:016x}"


def ids_of(table: pa.Table, id_col: str) -> np.ndarray:
    """Ids of a chunk's rows; a null one as the smallest."""
    return table.column(id_col).cast(pa.int64()).fill_null(-(2**63)).to_numpy()


def write(docs: DataFrame, folder: str, id_col: str, text_col: str, most: int = CHUNK_BYTES) -> DataFrame:
    """Writes the rows; one row (chunk, docs, words) for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.file_system(folder)
        fs.create_dir(root, recursive=True)

        def write_one(held):
            table = pa.Table.from_batches(held)
            table = table.take(pa.array(np.lexsort((np.arange(table.num_rows), ids_of(table, id_col)))))
            chunk = uuid.uuid4().int >> 65
            with fs.open_output_stream(_path(root, chunk)) as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table, max_chunksize=4096)
            words = sum(len((t or b"").split()) for t in table.column(text_col).cast(pa.binary()).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (chunk, table.num_rows, words)], names=["chunk", "docs", "words"])

        held, size = [], 0
        for batch in common.slices(batches, most // 8):
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield write_one(held)
                held, size = [], 0
        if held:
            yield write_one(held)

    return common.materialize(docs.mapInArrow(run, CHUNKS))


def load(folder: str, chunk: int) -> pa.Table:
    """A chunk's rows."""
    fs, root = common.file_system(folder)
    with fs.open_input_file(_path(root, chunk)) as f:
        return pa.ipc.open_file(f).read_all()


def tasks_of(chunks: DataFrame) -> int:
    """Tasks for one pass over the chunks."""
    return max(1, min(chunks.count(), 10_000))


def kept(chunks: DataFrame, folder: str, gone: DataFrame, schema) -> DataFrame:
    """The rows of all chunks, as they were written, but for the places ``gone`` (chunk, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table = load(folder, chunk)
                stays = np.ones(table.num_rows, dtype=bool)
                stays[rows or []] = False
                yield from common.slices(iter(table.filter(pa.array(stays)).to_batches()))

    listed = gone.groupBy("chunk").agg(F.collect_list("row").alias("rows"))  # at most a chunk's rows
    return chunks.select("chunk").join(listed, "chunk", "left").repartition(tasks_of(chunks), "chunk").mapInArrow(run, schema)
