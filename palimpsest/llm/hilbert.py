"""Sharding along a Hilbert curve, natively.

Several metadata columns are quantised by their own quantiles to levels of equal mass, the levels are turned into
an index on a Hilbert curve, rows are ordered by it, and runs are cut from that order: files cover compact boxes of all
columns at once, so filters on any of them skip files.

Law ``rows``: the counts of any two shards differ by at most one. Law ``bytes``: a row belongs to the shard in whose
equal share of all bytes its middle lies, so a shard differs from an equal share by at most the largest row.

Whole values are quantised: numbers by approximate quantiles, columns of any other type (text, dates) by the exact ones of their
counted distinct values.

Equal curve indexes are ordered by (doc_id, checksum, size); nulls of a metadata column are its lowest level; a null
text has no bytes, size 1 and checksum 0. Very long texts are only measured. Repeated rows each have a slot. An empty table gives
no rows. Columns that are not named are left out of ``shards``; ``write_shards`` keeps all, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Levels of a metadata column: 2 ** BITS.
BITS = 5


def curve_table(dims: int) -> list[list[int]]:
    """For each state (entry corner, direction) and cell corner: the cell's rank on the curve, and the next state.

    Entry corners and directions of sub-cells follow from the Gray code: state = entry * dims + direction.
    """
    size = 1 << dims
    gray = lambda i: i ^ i >> 1
    rank = {gray(i): i for i in range(size)}
    turn = lambda x, k: (x << k % dims | x >> (dims - k % dims)) & size - 1
    ones = lambda i: ((i ^ i + 1).bit_length() - 1) % dims
    ranks, after = [], []
    for entry in range(size):
        for way in range(dims):
            for cell in range(size):
                w = rank[turn(cell ^ entry, dims - (way + 1) % dims)]
                corner = gray(2 * ((w - 1) // 2)) if w else 0
                shift = 0 if w == 0 else ones(w - 1) if w % 2 == 0 else ones(w)
                ranks.append(w)
                after.append((entry ^ turn(corner, way + 1)) * dims + (way + shift + 1) % dims)
    return [ranks, after]


def with_curve(df: DataFrame, levels: list[str], out: str = "curve", bits: int = BITS) -> DataFrame:
    """Adds ``out``: index on the Hilbert curve of columns of levels from 0 to 2 ** bits - 1.

    One step a bit, from the highest: two look-ups in the curve's table, each a column of its own, so that none is computed twice.
    """
    dims = len(levels)
    ranks, after = ([F.lit(x) for x in table] for table in curve_table(dims))
    df = df.withColumns({"__at": F.lit(0), out: F.lit(0).cast("long")})
    for bit in range(bits - 1, -1, -1):
        cell = reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.call_function("shiftright", F.col(x), F.lit(bit)).bitwiseAND(F.lit(1)), F.lit(d)) for d, x in enumerate(levels)])
        df = df.withColumn("__cell", F.col("__at") * (1 << dims) + cell)
        df = df.withColumns({"__at": F.get(F.array(*after), F.col("__cell")), out: F.col(out) * (1 << dims) + F.get(F.array(*ranks), F.col("__cell"))})
    return df.drop("__at", "__cell")


def numeric(kind: str) -> bool:
    return kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint", "float", "double")


def exact_cuts(df: DataFrame, name: str, n: int) -> list:
    """The n - 1 quantiles of a column's values, of any type that can be ordered: its counted distinct values in order, and their running sums."""
    counts = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    laid = common.checkpoint(counts.repartitionByRange(common.shuffle_partitions(df.sparkSession), "value").sortWithinPartitions("value")).withColumn("part", F.spark_partition_id())
    sums = laid.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each partition
    sums = sums.select("part", (F.sum("n").over(common.running("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    along = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = laid.join(F.broadcast(sums), "part").withColumn("upto", F.col("before") + F.sum("n").over(along))
    # A value is the k-th quantile if it is the first one that k / n of all rows do not exceed.
    first, last = F.expr(f"(upto - n) * {n} div all + 1"), F.expr(f"upto * {n} div all")
    found = ranked.select("value", F.explode(F.when(first <= last, F.sequence(first, last))).alias("k")).filter(F.col("k") < n)
    return [r["value"] for r in found.orderBy("k").collect()]  # n - 1 values


def cuts(df: DataFrame, names: list[str], bits: int = BITS) -> list[list]:
    """The 2 ** bits - 1 quantiles of each column."""
    n, kinds = 1 << bits, dict(df.dtypes)
    numbers = [c for c in names if numeric(kinds[c])]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [k / n for k in range(1, n)], 10_000).alias(f"q{i}") for i, c in enumerate(numbers)]).head() if numbers else []
    known = {c: sorted(found[i] or []) for i, c in enumerate(numbers)}
    return [known[c] if c in known else exact_cuts(df, c, n) for c in names]


def level(value: Column, at: list) -> Column:
    """How many of the ascending cuts a value reaches, by halving; 0 for null."""

    def halved(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= F.lit(at[middle]), halved(middle + 1, high)).otherwise(halved(low, middle))

    return F.when(value.isNull(), F.lit(0)).otherwise(halved(0, len(at)))


def _laid(df: DataFrame, dims: list[str], count: int, law: str, bits: int, id_col: str, text_col: str, carried: list[Column]) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot, and what is carried.

    The range partitions are checkpointed, so that their counts and the rows' places in them, which give every row its
    rank, come from one and the same layout.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keys = [f"__d{i}" for i in range(len(dims))]
    # The texts are read once: quantiles and the ranges' samples come from what is written here.
    narrow = common.materialize(df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[F.col(c).alias(k) for c, k in zip(dims, keys, strict=True)], *carried))
    kinds = dict(narrow.dtypes)
    whole = lambda k: F.col(k).cast("double") if numeric(kinds[k]) else F.col(k)
    levels = {f"__l{i}": level(whole(k), at) for i, (k, at) in enumerate(zip(keys, cuts(narrow, keys, bits), strict=True))}
    curved = with_curve(narrow.withColumns(levels), list(levels), "curve", bits).drop(*keys, *levels)
    order = ["curve", "doc_id", "text_crc32", "size"]
    laid = common.checkpoint(curved.repartitionByRange(common.shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order))
    common.release(narrow)
    laid = laid.withColumn("place", F.monotonically_increasing_id())
    laid = laid.withColumns({"part": F.call_function("shiftrightunsigned", "place", F.lit(33)), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    before, whole_ = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    parts = laid.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))  # one row for each partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b_before"), F.sum("n").over(whole_).alias("n_all"), F.sum("b").over(whole_).alias("b_all"))
    ranked = laid.join(F.broadcast(parts), "part").withColumn("rank", F.col("n_before") + F.col("place"))
    shown = ["doc_id", "size", "text_crc32", "curve", "shard"] + [c for c in laid.columns if c == "__row"]
    if law == "rows":
        shard = F.expr(f"rank * {count} div n_all")
        first = F.expr(f"(shard * n_all + {count} - 1) div {count}")
        return ranked.withColumn("shard", shard.cast("int")).select(*shown, (F.col("rank") - first).cast("long").alias("slot"))
    along = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("b_before") + F.coalesce(F.sum("size").over(along), F.lit(0)) + F.expr("size div 2")
    cut = common.checkpoint(ranked.withColumn("middle", middle).withColumn("shard", F.expr(f"least({count - 1}, middle * {count} div b_all)").cast("int")).drop("middle"))
    starts = cut.groupBy("shard").agg(F.min("rank").alias("first"))
    return cut.join(F.broadcast(starts), "shard").select(*shown, (F.col("rank") - F.col("first")).alias("slot"))


def shards(df: DataFrame, dims: list[str], count: int, law: str = "rows", bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, curve, shard (from 0), slot (place in the shard along the curve, gapless from 0); the texts are not shuffled."""
    return _laid(df, dims, count, law, bits, id_col, text_col, [])


def write_shards(df: DataFrame, path: str, dims: list[str], count: int, law: str = "rows", bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """All rows of ``df``, with all columns, as Parquet: one folder a shard (``hilbert_shard=k``), files in slot order.

    Whole rows go along with their keys through one shuffle, so nothing is joined back. Each range partition
    writes its own run of a shard as a file, which is as compact a box of all dimensions.
    """
    laid = _laid(df, dims, count, law, bits, id_col, text_col, [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row")])
    rows = laid.sortWithinPartitions("shard", "slot").select("__row.*", F.col("shard").alias("hilbert_shard"))
    rows.write.partitionBy("hilbert_shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents in 16 runs of the curve over language, source and length."""
    laid = shards(common.read(spark, sf_dir, "documents"), ["lang", "source", "n_chars"], 16)
    return laid.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
