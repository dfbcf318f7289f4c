"""Threshold-scaled document sketches, natively.

A sketch holds every distinct hash of a text's shingles of five words that lies below a threshold, a fixed fraction of the hash
range, 2 ** -LEVELS. A text that has few is kept in more detail by one law for all: the threshold is the largest of 1, 1/2, ...,
2 ** -LEVELS of the range below which at most KEEP distinct hashes lie, or the last one. So texts of up to KEEP distinct shingles keep all of
them, and long ones their fixed fraction. The threshold is part of the sketch, and two sketches are compared at the smaller of theirs,
where both are samples by the same rule, however unequal the texts are. Sketches merge by union at the smallest threshold, and by the
law again: the merged sketch is that of the texts' shingles together, exactly.

A text of one to four words has one shingle, the whole sequence; a text without words has none. Two texts without shingles are alike
(1), and one without is unlike any that has some (0). Containment is null where a text's hashes all lie above the other's threshold: with
LEVELS = 2 that happens to a text of s shingles with probability (3/4) ** s.

Null texts are empty. ``neighbours`` orders rows by (doc_id, xxhash64 of the text, text), a null id as the smallest one; the
row after the last is the first, so a lone row follows itself. Repeated rows stay apart. Very long texts are one row's arrays in memory.
An empty table gives no rows. Columns other than id and text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
#: Halvings of the hash range down to the fixed fraction, and distinct hashes up to which a text is kept in more detail.
LEVELS, KEEP = 2, 256
_NO_ID = -(2**63)


def _most(level: int) -> int:
    """The largest signed hash in the lowest 2 ** -level of the range."""
    return 2 ** (64 - level) - 2**63 - 1


def _within(hashes: Column, level: int) -> Column:
    return F.filter(hashes, lambda x: x <= _most(level)) if level else hashes


def _under(hashes: Column, level: Column, levels: int) -> Column:
    """Hashes within the threshold of ``level``; each branch compares with a constant."""
    out = hashes
    for k in range(1, levels + 1):
        out = F.when(level == k, _within(hashes, k)).otherwise(out)
    return out


def _scaled(df: DataFrame, hashes: str, least: Column, out: str, levels: int, keep: int) -> DataFrame:
    """Adds ``out``: struct(level, kept: sorted hashes) by the law, of distinct hashes of which all below level ``least`` are there."""
    level = F.lit(levels)
    for k in reversed(range(levels)):
        level = F.when((least <= k) & (F.size(_within(F.col(hashes), k)) <= keep), k).otherwise(level)
    df = df.withColumn(f"__level_{out}", level)
    kept = F.array_sort(_under(F.col(hashes), F.col(f"__level_{out}"), levels))
    return df.withColumn(out, F.struct(F.col(f"__level_{out}").alias("level"), kept.alias("kept"))).drop(f"__level_{out}")


def with_sketch(df: DataFrame, text: str, out: str, levels: int = LEVELS, keep: int = KEEP) -> DataFrame:
    """Adds ``out``: struct(level: halvings of the hash range, kept: sorted distinct hashes in what is left of it)."""
    w, h = f"__words_{out}", f"__hashes_{out}"
    # Each array is a column of its own: inside a lambda, an expression would be computed anew for every element.
    df = df.withColumn(w, common.words(F.col(text)))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    rolled = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + k) for k in range(1, SHINGLE)]))
    df = df.withColumn(h, F.array_distinct(F.when(F.size(h) >= SHINGLE, rolled).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))))
    return _scaled(df, h, F.lit(0), out, levels, keep).drop(w, h)


def _common(a: Column, b: Column, levels: int) -> tuple[Column, Column]:
    """Both sketches' hashes at the smaller threshold."""
    level = F.greatest(a["level"], b["level"])
    cut = lambda x: F.when(x["level"] == level, x["kept"]).otherwise(_under(x["kept"], level, levels))
    return cut(a), cut(b)


def likeness(a: Column, b: Column, levels: int = LEVELS) -> Column:
    """Estimated share of common shingles among all; equal sketches give 1."""
    x, y = _common(a, b, levels)
    both = F.size(F.array_intersect(x, y)).cast("double")
    either = F.size(x) + F.size(y) - both
    return F.when(a == b, F.lit(1.0)).when(either > 0, both / either).otherwise(F.lit(0.0))


def containment(a: Column, b: Column, levels: int = LEVELS) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 for equal sketches, null where none is left to compare."""
    x, y = _common(a, b, levels)
    return F.when(a == b, F.lit(1.0)).when(F.size(x) > 0, F.size(F.array_intersect(x, y)).cast("double") / F.size(x))


def merge(df: DataFrame, by: list[str], sketch: str, levels: int = LEVELS, keep: int = KEEP) -> DataFrame:
    """by, sketch: of the shingles of all texts of a group together.

    Hashes are grouped as rows, distinct before they are shuffled, so that only a merged sketch itself must fit in one row.
    """
    level = df.groupBy(*by).agg(F.max(F.col(sketch)["level"]).alias("__least"))
    # Of explode, Spark infers a filter that it pushes into the sketch's lambdas, to be computed anew for each word.
    hashes = df.select(*by, F.explode_outer(F.col(sketch)["kept"]).alias("__hash")).distinct()
    most = F.lit(_most(0))
    for k in range(1, levels + 1):
        most = F.when(F.col("__least") == k, _most(k)).otherwise(most)
    held = hashes.join(level, by).filter(F.col("__hash") <= most).groupBy(*by).agg(F.collect_list("__hash").alias("__all"))
    merged = level.join(held, by, "left").withColumn("__all", F.coalesce("__all", F.array().cast("array<bigint>")))
    return _scaled(merged, "__all", F.col("__least"), sketch, levels, keep).select(*by, sketch)


def as_string(sketch: Column) -> Column:
    """Hexadecimal digits of the kept hashes, after one of the threshold."""
    return F.concat(sketch["level"].cast("string"), F.array_join(F.transform(sketch["kept"], lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ""))


def _held(values: list, kind: str) -> Column:
    """A constant array, told as one text, however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def count_of(key: Column, splits: list[int], reached: bool) -> Column:
    """How many of the sorted ``splits`` are at most ``key`` (reached) or less, by binary search."""
    if not splits:
        return F.lit(0)
    top, held = 1 << (len(splits).bit_length() - 1), _held(splits, "bigint")
    steps = [top >> k for k in range(top.bit_length())]
    ahead = (lambda x: x <= key) if reached else (lambda x: x < key)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(ahead(F.get(held, at + step - 1)), at + step).otherwise(at))


def id_splits(df: DataFrame, key: str, ranges: int) -> list[int]:
    """``ranges`` - 1 sorted split points of ranges of ``key`` with near equal numbers of rows; a frequent key is there more than once."""
    share = _held([k / ranges for k in range(1, ranges)], "double") if ranges > 1 else F.array(F.lit(0.5))
    at = F.percentile_approx(key, share, max(10_000, 20 * ranges))
    return sorted(df.agg(at.alias("at")).head()["at"] or [])


def range_of(key: Column, hashed: Column, splits: list[int]) -> Column:
    """Number of a row's range in the order of (key, hashed): a key that is several splits is dealt to that many ranges by its hash."""
    low, high = count_of(key, splits, False), count_of(key, splits, True)
    share = hashed.cast("double") / 2.0**64 + 0.5
    return F.when(high - low < 2, high).otherwise(low + 1 + F.least(F.floor(share * (high - low)), high - low - 1)).cast("int")


def neighbours(docs: DataFrame, levels: int = LEVELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: of the following row by (doc_id, hash of the text, text).

    Texts are shuffled once, by ranges of that order, four for each shuffle partition. What follows the last row of a range is the
    first one of the next: those first rows, one for each range, are found apart.
    """
    spark = docs.sparkSession
    docs = common.texts(docs, id_col, text_col).withColumns({"key": F.coalesce("doc_id", F.lit(_NO_ID)), "hashed": F.xxhash64("text")})
    partitions = common.shuffle_partitions(spark)
    splits = id_splits(docs, "key", 4 * partitions)
    docs = docs.withColumn("range", range_of(F.col("key"), F.col("hashed"), splits))
    heads = docs.groupBy("range").agg(F.min(F.struct("key", "hashed")).alias("least")).select("range", "least.*").orderBy("range").collect()  # one row a range
    follows = [(mine["range"], *heads[(k + 1) % len(heads)]) for k, mine in enumerate(heads)]
    follows = spark.createDataFrame(follows, "range int, head_range int, head_key long, head_hashed long")
    first = (
        docs.join(F.broadcast(follows.select("head_range", "head_key", "head_hashed").distinct()), (F.col("range") == F.col("head_range")) & (F.col("key") == F.col("head_key")) & (F.col("hashed") == F.col("head_hashed")))
        .groupBy("head_range")
        .agg(F.min("text").alias("head_text"))
    )
    first = with_sketch(first, "head_text", "head_sketch", levels).join(F.broadcast(follows), "head_range").select("range", "head_text", "head_sketch")
    dealt = with_sketch(docs.repartition(partitions, "range"), "text", "sketch", levels)
    order = Window.partitionBy("range").orderBy("key", "hashed", "text")
    dealt = dealt.withColumn("after", F.lead(F.struct("text", "sketch")).over(order))
    ends = F.col("after").isNull()
    dealt = dealt.join(first.withColumn("ends", F.lit(True)).withColumnRenamed("range", "of"), (F.col("range") == F.col("of")) & (ends == F.col("ends")), "left")
    return dealt.select("doc_id", "text", "sketch", F.coalesce("after.text", "head_text").alias("next_text"), F.coalesce("after.sketch", "head_sketch").alias("next_sketch"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: sketches of every document and of its edited text, and their likeness to each other and to the next document's."""
    df = neighbours(common.read(spark, sf_dir, "documents"))
    n = F.length("text")
    swapped = F.floor(n / 4).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - swapped), F.substring("next_text", F.lit(1), swapped)))
    df = with_sketch(df.drop("next_text", "text"), "edited", "edited_sketch")
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(own).alias("fingerprint"),
        as_string(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, after).alias("near_next"),
        containment(own, edited).alias("contained_edited"),
        containment(own, after).alias("contained_next"),
    )
