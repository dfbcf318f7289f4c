"""Versioned snapshots of a memory: several tables that change together.

Each save writes all tables to a new version, then moves one pointer file over the old one, so a reader sees a whole
version or the one before, which stays; older ones are deleted. Stores are dealt to a fixed number of buckets, sorted within, so that
reading one store lists one folder a table and skips the row groups of others, however many stores there are.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import update

#: Folders of a table.
BUCKETS = 64
#: Schemas of the tables of a snapshot.
TABLES = update.TABLES | {"layers": update.STATES}
_POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _bucket(store):
    return F.pmod(F.xxhash64(store), F.lit(BUCKETS)).cast("int")


def save(tables: dict[str, DataFrame], path: str) -> str:
    """Writes a version with the given tables, those not given being empty; returns its name."""
    spark = next(iter(tables.values())).sparkSession
    version, before = uuid.uuid4().hex, current(spark, path)
    for name, schema in TABLES.items():
        df = tables.get(name, spark.createDataFrame([], schema))
        df = df.withColumn("bucket", _bucket(F.col("store_id").cast("long"))).repartition("bucket").sortWithinPartitions("bucket", "store_id")
        df.write.mode("error").partitionBy("bucket").parquet(f"{path}/{version}/{name}")
    fs, where = _files(spark, path)
    draft = where(f"{path}/.{version}")
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    target = where(f"{path}/{_POINTER}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    array[0] = overwrite
    context.rename(draft, target, array)
    for found in fs.listStatus(where(path)):
        if found.isDirectory() and found.getPath().getName() not in (version, before):
            fs.delete(found.getPath(), True)
    return version


def current(spark: SparkSession, path: str) -> str | None:
    """Name of the version that readers see."""
    fs, where = _files(spark, path)
    return spark.read.text(f"{path}/{_POINTER}").head()[0] if fs.exists(where(f"{path}/{_POINTER}")) else None


def load(spark: SparkSession, path: str, store_id: int | None = None, names: Iterable[str] = tuple(TABLES), verify: bool = True) -> tuple[dict[str, DataFrame], bool]:
    """(tables, whether a snapshot was read), of one store or all. A missing snapshot gives empty tables; a broken one as well, with a warning.

    verify: reads every file first, so that a damaged one shows here and not in a later query.
    """
    try:
        version = current(spark, path)
        if version is None:
            return {n: spark.createDataFrame([], TABLES[n]) for n in names}, False
        out = {}
        for name in names:
            df = spark.read.schema(TABLES[name] + ", bucket int").parquet(f"{path}/{version}/{name}")
            if store_id is not None:  # the bucket's number is a constant, by which folders are left out
                df = df.filter((F.col("bucket") == _bucket(F.lit(store_id).cast("long"))) & (F.col("store_id") == store_id))
            out[name] = df.drop("bucket")
            if verify:
                out[name].write.format("noop").mode("overwrite").save()
        return out, True
    except Exception as e:  # the store starts empty rather than not at all
        warnings.warn(f"snapshot at {path} can't be read: {e}", stacklevel=2)
        return {n: spark.createDataFrame([], TABLES[n]) for n in names}, False


def rebuild(tables: dict[str, DataFrame], c, dim: int) -> dict[str, DataFrame]:
    """Edges, patterns and identities made anew from the memories alone, as after a load of memories that came from elsewhere."""
    from ..operators import edges, hierarchy, ingest

    held = ingest.with_norms(tables["memories"])
    out = tables | {"edges": edges.build_edges(held, c)}
    if c.hierarchy_enabled:
        out["l2"], out["l3"] = hierarchy.consolidate(held, c, dim)
    return out
