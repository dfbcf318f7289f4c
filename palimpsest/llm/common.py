"""Helpers of the text operators: shared storage, materialising, column selection."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Characters that separate words, as everywhere in this package: blank and 0x09 to 0x0D. ``bytes.split()`` splits on just these.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Rows and bytes of texts that a Python worker works on at once; Spark hands it up to 10000 rows and 64 MB.
ROWS, BYTES = 1000, 8 << 20
#: Bytes of a batch of what is materialised: small ones leave little behind in the JVM's pools.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a folder in the warehouse is taken, which is shared as well; on a single machine, a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if app not in _OWN:
            single = master == "local" or master.startswith("local[")
            _OWN[app] = tempfile.mkdtemp(prefix="checkpoint-") if single else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints-{app}"
        base = _OWN[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most BATCH_BYTES go to the workers of what is run meanwhile; then the session is as it was."""
    before = None
    with suppress(Exception):  # a session that forbids changes keeps its own bound
        before = spark.conf.get(_BATCH)
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(_BATCH, before)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again: it is computed once, and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with _small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes materialised tables whose readers are all written."""
    for df in tables:
        if df is not None and (path := getattr(df, "_palimpsest_path", None)):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder of the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; unlike ``materialize`` it keeps partitions and the order of rows within them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, for code on executors that streams files in the shared folder."""
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], most: int = BYTES, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and ``most`` bytes of text; a longer text is a part of its own."""
    for batch in batches:
        size = np.full(batch.num_rows, 64, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            room = most + (int(ends[start - 1]) if start else 0)
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, room, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): null texts are empty; other columns, whatever their names, are left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text, natively."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(*order: str) -> WindowSpec:
    """All rows up to this one; for tables of one row a partition or task at most."""
    return Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
