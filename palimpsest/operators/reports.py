"""Statistics and formatted reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import confidence
from .evaluation import CATEGORIES

#: The order in which an evaluation's categories are shown.
CATEGORY_ORDER = [4, 1, 2, 3, 5]
#: The reports' lines and the order of channels.
HEADER = "=== MEMORY CONTEXT ==="
ADVICE = "Use these memories to answer accurately. Distinguish between different relationship types (friends vs partners vs colleagues)."
SHORT_ADVICE = "Use these memories to answer accurately."
CONFLICTS = "=== CONFLICTING MEMORIES (consider both sides) ==="
FOOTER = "=== END MEMORY ==="
CHANNELS = ["fact", "event", "instruction", "preference", "uncategorized"]
BUCKETS = [(0.0, 0.1, "0.0-0.1"), (0.1, 0.5, "0.1-0.5"), (0.5, 1.0, "0.5-1.0"), (1.0, 2.0, "1.0-2.0"), (2.0, None, "2.0+")]


def strength_summary(memories: DataFrame) -> DataFrame:
    return memories.groupBy("store_id").agg(F.count("*").alias("n"), F.avg("strength").alias("mean"), F.max("strength").alias("most"), F.min("strength").alias("least"), F.median("strength").alias("median"))


def strength_histogram(memories: DataFrame) -> DataFrame:
    """(store_id, bucket, n), empty buckets too: one conditional count for each bucket, in one pass."""
    inside = lambda lo, hi: (F.col("strength") >= lo) & (F.lit(True) if hi is None else F.col("strength") < hi)
    counts = memories.groupBy("store_id").agg(*[F.sum(inside(lo, hi).cast("long")).alias(f"b{i}") for i, (lo, hi, _) in enumerate(BUCKETS)])
    return counts.select("store_id", F.inline(F.array(*[F.struct(F.lit(name).alias("bucket"), F.col(f"b{i}").alias("n")) for i, (_, _, name) in enumerate(BUCKETS)])))


def top_and_bottom(memories: DataFrame, k: int = 5) -> DataFrame:
    """The k strongest and the k weakest of each store, with their place at that end."""
    strong = Window.partitionBy("store_id").orderBy(F.col("strength").desc(), "mem_id")
    weak = Window.partitionBy("store_id").orderBy("strength", F.col("mem_id").desc())
    top = memories.withColumn("place", F.row_number().over(strong)).filter(F.col("place") <= k).withColumn("part", F.lit("top"))
    bottom = memories.withColumn("place", F.row_number().over(weak)).filter(F.col("place") <= k).withColumn("part", F.lit("bottom"))
    return top.unionByName(bottom)


def _line(category: bool) -> Column:
    tag = F.when(F.length("category") > 0, F.concat(F.lit(" ["), "category", F.lit("]"))).otherwise("") if category else F.lit("")
    return F.concat(F.lit("["), confidence(F.col("score")), F.lit("]"), tag, F.lit(' User said: "'), F.substring("input_text", 1, 120), F.lit('" → You replied: "'), F.substring("output_text", 1, 100), F.lit('" (strength: '), F.format_string("%.2f", "strength"), F.lit(")"))


def _joined(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"))


def prompt(recalled: DataFrame) -> DataFrame:
    """(query_id, prompt). recalled: query_id, rank, score, input_text, output_text, strength."""
    return _joined(recalled.withColumn("line", _line(False)), ["query_id"]).select("query_id", F.concat_ws("\n", F.lit(HEADER), F.lit(ADVICE), "body", F.lit(FOOTER)).alias("prompt"))


def tension_prompt(recalled: DataFrame) -> DataFrame:
    """Conflicting rows under a heading of their own. recalled: also role and category."""
    rows = recalled.withColumn("line", _line(True))
    lines = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("rank", "line")))), lambda x: x["line"]), "\n")
    both = rows.groupBy("query_id").agg(lines("supporting").alias("yes"), lines("conflicting").alias("no"))
    some = lambda c, x: F.when(F.length(c) > 0, x)
    return both.select("query_id", F.concat_ws("\n", F.lit(HEADER), F.lit(SHORT_ADVICE), some("yes", F.col("yes")), some("no", F.concat_ws("\n", F.lit(""), F.lit(CONFLICTS), "no")), F.lit(FOOTER)).alias("prompt"))


def channel_prompt(recalled: DataFrame) -> DataFrame:
    """Rows by category: known channels in their order, then others by first rank."""
    name = F.when(F.length("category") > 0, F.col("category")).otherwise("uncategorized")
    rows = recalled.withColumn("line", _line(True)).withColumn("channel", name)
    place = F.coalesce(*[F.when(F.col("channel") == x, F.lit(i)) for i, x in enumerate(CHANNELS)], F.lit(len(CHANNELS)))
    groups = rows.groupBy("query_id", "channel").agg(F.min("rank").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"))
    block = F.struct(place.alias("place"), F.col("first"), F.concat(F.lit("\n["), F.upper("channel"), F.lit("]\n"), "body").alias("text"))
    return groups.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("blocks")).select("query_id", F.concat_ws("\n", F.lit(HEADER), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n"), F.lit("\n" + FOOTER)).alias("prompt"))


def memory_list(memories: DataFrame) -> DataFrame:
    """A line for each memory of a store, strongest first."""
    order = Window.partitionBy("store_id").orderBy(F.col("strength").desc(), "mem_id")
    placed = memories.withColumn("place", F.row_number().over(order))
    line = F.concat(F.rpad(F.col("place").cast("string"), 4, " "), F.lit(" "), F.lpad(F.format_string("%.4f", "strength"), 10, " "), F.lit(" "), F.lpad(F.col("access_count").cast("string"), 10, " "), F.lit(" "), F.rpad(F.substring("input_text", 1, 58), 60, " "))
    return placed.select("store_id", "place", line.alias("line"))


def search_report(found: DataFrame, edges: DataFrame) -> DataFrame:
    """A text for each recalled row: activation, strength, number of edges, shortened texts. found: query_id, store_id, mem_id, rank, activation, strength, input_text, output_text."""
    count = edges.groupBy("store_id", F.col("src").alias("mem_id")).agg(F.count("*").alias("edges"))
    rows = found.join(count, ["store_id", "mem_id"], "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    text = F.concat(F.lit("  #"), F.col("rank").cast("string"), F.lit(" activation="), F.format_string("%.4f", "activation"), F.lit(" strength="), F.format_string("%.4f", "strength"), F.lit(" edges="), F.col("edges").cast("string"), F.lit("\n      Input:  "), F.substring("input_text", 1, 80), F.lit("\n      Output: "), F.substring("output_text", 1, 80))
    return rows.select("query_id", "rank", text.alias("line"))


def evaluation_report(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """(place, line) of an evaluation as text: a line for each category, overall, the answerable ones, and what the memory did.

    summary: of ``evaluation.summary``; stats: of ``evaluation.ingest_stats``. A category without questions shows zeros.
    """
    spark = summary.sparkSession
    names = [(k, f"category {c}", CATEGORIES[c]) for k, c in enumerate(CATEGORY_ORDER)] + [(5, "overall", "overall"), (6, "answerable", "answerable"), (7, "answerable, gold present", "gold present"), (8, "answerable, gold absent", "gold absent")]
    shown = spark.createDataFrame(names, "place int, section string, name string").join(summary, "section", "left")
    number = lambda c: F.lpad(F.format_string("%.4f", F.coalesce(c, F.lit(0.0))), 8, " ")
    rows = shown.select("place", F.concat(F.rpad("name", 18, " "), F.lpad(F.coalesce("n", F.lit(0)).cast("string"), 6, " "), number("f1"), number("judge"), F.lpad(F.format_string("%.1f", F.coalesce("gold_pct", F.lit(0.0))), 7, " ")).alias("line"))
    recalled = summary.filter("section = 'overall'").select(F.lit(10).alias("place"), F.concat(F.lit("memories recalled a question: "), F.format_string("%.2f", "recalled")).alias("line"))
    held = stats.select(F.inline(F.array(F.struct(F.lit(9).alias("place"), F.concat(F.lit("memories a conversation: "), F.format_string("%.3f", "avg_memories")).alias("line")), F.struct(F.lit(11).alias("place"), F.concat(F.lit("turns filtered: "), F.format_string("%.3f", "filtered_pct"), F.lit("%")).alias("line")))))
    return rows.unionByName(recalled).unionByName(held)
