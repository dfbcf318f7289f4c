"""Evaluation of retrieval and answers."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_words, is_refusal, normalize_answer, porter_stem

#: Names of the question categories, in the order of their numbers.
CATEGORIES = {1: "multi_hop", 2: "temporal", 3: "open_domain", 4: "single_hop", 5: "adversarial"}


def token_f1(df: DataFrame, prediction: str, truth: str, out: str) -> DataFrame:
    """Adds the F1 of the multisets of words of two normalised answers (not stemmed); 0 without a common word."""
    df = df.withColumns({"__p": answer_words(F.col(prediction)), "__t": answer_words(F.col(truth))})
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    same = F.aggregate(F.array_distinct("__p"), F.lit(0), lambda s, w: s + F.least(count(F.col("__p"), w), count(F.col("__t"), w)))
    df = df.withColumn("__s", same.cast("double"))
    return df.withColumn(out, F.when(F.col("__s") > 0, 2.0 * F.col("__s") / (F.size("__p") + F.size("__t"))).otherwise(F.lit(0.0))).drop("__p", "__t", "__s")


def stemmed_f1(df: DataFrame, prediction: str, truth: str, out: str) -> DataFrame:
    """As token_f1, on Porter stems: Arrow batches, as no built-in function stems."""

    @F.pandas_udf("double")
    def f1(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}

        def stems(s):
            return Counter(known.setdefault(w, porter_stem(w)) for w in (s or "").split())

        for p, t in batches:
            yield pd.Series([2.0 * n / (a.total() + b.total()) if (n := ((a := stems(x)) & (b := stems(y))).total()) else 0.0 for x, y in zip(p, t, strict=True)])

    return df.withColumn(out, f1(normalize_answer(F.col(prediction)), normalize_answer(F.col(truth))))


def multi_f1(df: DataFrame, prediction: str, truth: str, out: str, key: str, f1=token_f1) -> DataFrame:
    """Mean over comma-separated truths of the best F1 of the comma-separated predictions; key identifies a row."""
    parts = df.select(key, F.posexplode(F.split(F.col(truth), ",")).alias("part", "t"), F.split(F.col(prediction), ",").alias("ps")).select(key, "part", F.trim("t").alias("t"), F.explode("ps").alias("p")).withColumn("p", F.trim("p"))
    best = f1(parts, "p", "t", "f1").groupBy(key, "part").agg(F.max("f1").alias("f1")).groupBy(key).agg(F.avg("f1").alias(out))
    return df.join(best, key, "left")


def score_answers(df: DataFrame, key: str, stems: bool = True) -> DataFrame:
    """Adds score by category: 1 multi-answer F1, 2 to 4 F1 (3: of what stands before a semicolon), 5 refusal. prediction, answer, category.

    Words are compared by their Porter stems, or as they are if ``stems`` is off, which keeps the plan free of Python.
    """
    f1 = stemmed_f1 if stems else token_f1
    df = df.withColumn("__a", F.when(F.col("category") == 3, F.trim(F.split("answer", ";")[0])).otherwise(F.col("answer")))
    df = multi_f1(f1(df, "prediction", "__a", "__f1"), "prediction", "answer", "__multi", key, f1)
    score = F.when(F.col("category") == 1, F.col("__multi")).when(F.col("category").isin(2, 3, 4), F.col("__f1")).when((F.col("category") == 5) & is_refusal("prediction"), F.lit(1.0)).otherwise(F.lit(0.0))
    return df.withColumn("score", score).drop("__a", "__f1", "__multi")


def hits(recalled: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, hit): whether any recalled row is gold evidence; of queries that have some."""
    found = recalled.join(gold, ["query_id", "mem_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    asked = queries.join(gold, "query_id", "left_semi")
    return asked.join(found, "query_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def by_category(df: DataFrame, value: str, category: str = "category") -> DataFrame:
    """Mean and count by category and overall, in one pass."""
    return df.rollup(category).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def _log_factorial(n: Column) -> Column:
    """Stirling's series, to twelve digits from 10 on; 0 and 1 as they are."""
    return F.when(n < 2, F.lit(0.0)).otherwise(n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + 1.0 / (12.0 * n) - 1.0 / (360.0 * n * n * n))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n01, n10, p): exact two-sided test of paired 0/1 outcomes.

    The tail is summed from logarithms of binomial terms, from the largest one down: below ``fewer`` by 10 * sqrt(n) they are under
    exp(-200) of it, so that many terms are enough, however many pairs there are.
    """
    n = df.agg(F.coalesce(F.sum(((F.col(a) == 0) & (F.col(b) == 1)).cast("long")), F.lit(0)).alias("n01"), F.coalesce(F.sum(((F.col(a) == 1) & (F.col(b) == 0)).cast("long")), F.lit(0)).alias("n10"))
    n = n.withColumns({"all": (F.col("n01") + F.col("n10")).cast("double"), "fewer": F.least("n01", "n10")})

    def counted(acc: Column, i: Column) -> Column:  # C(all, fewer), term by term, where there are few
        return acc + F.log((F.col("all") - i + 1.0) / i)

    few = F.aggregate(F.when((F.col("fewer") > 0) & (F.col("fewer") <= 1000), F.sequence(F.lit(1).cast("long"), F.col("fewer"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), counted)
    many = _log_factorial(F.col("all")) - _log_factorial(F.col("fewer").cast("double")) - _log_factorial(F.col("all") - F.col("fewer"))
    n = n.withColumn("log", F.when(F.col("fewer") <= 1000, few).otherwise(many) + F.col("all") * math.log(0.5))
    n = n.withColumn("last", F.greatest(F.lit(1).cast("long"), F.col("fewer") - F.ceil(10.0 * F.sqrt("all"))))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log(i / (F.col("all") - i + 1.0))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(F.col("fewer") > 0, F.sequence(F.col("fewer"), F.col("last"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.col("log").alias("log"), F.exp(F.col("log")).alias("sum"))
    return n.select("n01", "n10", F.least(F.lit(1.0), 2.0 * F.aggregate(steps, start, add, lambda acc: acc["sum"])).alias("p"))


def budget_sweep(ranked: DataFrame, gold: DataFrame, queries: DataFrame, budgets: list[int]) -> DataFrame:
    """(k, n, gold_share) for each budget: ranked once, then cut at each."""
    best = ranked.join(gold, ["query_id", "mem_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    asked = queries.join(gold, "query_id", "left_semi").join(best, "query_id", "left").select(F.explode(F.array(*map(F.lit, budgets))).alias("k"), "first")
    return asked.groupBy("k").agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("first") <= F.col("k")).cast("double"), F.lit(0.0))).alias("gold_share"))


def operating_curve(answers: DataFrame, gold_rank: DataFrame) -> DataFrame:
    """One row for each budget k, 0 (nothing recalled) included, of the means that an operating point is chosen by.

    answers: q_id, k, category, judge (0 or 1; null: the question failed), refused (boolean). gold_rank: q_id, first (rank of the first gold
    evidence; questions without are left out). Categories 1 to 4 are answerable, 5 is adversarial. A mean over nothing is null.
    """
    rows = answers.join(gold_rank.select("q_id", "first"), "q_id", "left").withColumn("gold", F.coalesce(F.col("first") <= F.col("k"), F.lit(False)))
    ok, open_ = F.col("judge").isNotNull(), F.col("category").between(1, 4)
    mean = lambda where, x: F.round(F.avg(F.when(ok & where, x.cast("double"))), 4)
    names = [mean(F.col("category") == c, F.col("judge")).alias(f"judge_{CATEGORIES[c]}") for c in (1, 2, 3, 4)]
    return rows.groupBy("k").agg(
        F.count(F.when(ok & open_, 1)).alias("n_answerable"),
        F.count(F.when(ok & ~open_, 1)).alias("n_adversarial"),
        mean(open_, F.col("judge")).alias("answerable_judge"),
        mean(~open_, F.col("judge")).alias("adversarial_judge"),
        mean(open_, F.col("refused")).alias("answerable_refusal_rate"),
        mean(open_, F.col("gold")).alias("answerable_gold_present"),
        *names,
        F.count(F.when(~ok, 1)).alias("errors"),
    )


def summary(results: DataFrame) -> DataFrame:
    """(section, n, f1, judge, recalled, gold_pct): by category, overall, and of the answerable ones, also apart by gold evidence.

    results: category, f1, judge, num_recalled, gold_present (boolean). A row belongs to up to three sections, in one pass.
    """
    open_ = F.col("category") != 5
    sections = F.array_compact(F.array(F.concat(F.lit("category "), F.col("category").cast("string")), F.lit("overall"), F.when(open_, "answerable"), F.when(open_ & F.col("gold_present"), "answerable, gold present"), F.when(open_ & ~F.col("gold_present"), "answerable, gold absent")))
    rows = results.withColumn("section", F.explode(sections))
    mean = lambda x, places: F.round(F.avg(x), places)
    return rows.groupBy("section").agg(F.count("*").alias("n"), mean(F.col("f1"), 4).alias("f1"), mean(F.col("judge"), 4).alias("judge"), mean(F.col("num_recalled"), 2).alias("recalled"), mean(100.0 * F.col("gold_present").cast("double"), 1).alias("gold_pct"))


def ingest_stats(actions: DataFrame) -> DataFrame:
    """(stores, avg_memories, filtered_pct): memories made by the update cycle, and turns it filtered, of all. actions: store_id, action.

    The percentage is a ratio of sums, not a mean of stores' ratios.
    """
    stores = actions.groupBy("store_id").agg(F.count("*").alias("turns"), F.sum((F.col("action") == "filtered").cast("long")).alias("filtered"), F.sum(F.col("action").isin("created", "contradiction").cast("long")).alias("memories"))
    whole = stores.agg(F.count("*").alias("stores"), F.avg("memories").alias("avg_memories"), F.sum("filtered").alias("f"), F.sum("turns").alias("t"))
    return whole.select("stores", F.coalesce("avg_memories", F.lit(0.0)).alias("avg_memories"), F.when(F.col("t") > 0, 100.0 * F.col("f") / F.col("t")).otherwise(F.lit(0.0)).alias("filtered_pct"))


def joined_categories(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Samples of several categories as one, with all their rows; columns that a sample lacks are null."""
    out = first
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def stratified_sample(df: DataFrame, by: str, order: Column, size: int) -> DataFrame:
    """A proportional share of each stratum, at least one row, by a seeded hash order."""
    rows = df.withColumn("__o", order)
    n = rows.groupBy(by).agg(F.count("*").alias("__n"))
    whole = df.agg(F.count("*")).scalar()
    share = n.select(by, F.greatest(F.lit(1), F.round(size * F.col("__n") / whole).cast("long")).alias("__share"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("__o"))
    return rows.withColumn("__r", place).join(share, by).filter(F.col("__r") <= F.col("__share")).drop("__o", "__r", "__share")


def evidence_ids(recalled: DataFrame, turns: DataFrame) -> DataFrame:
    """Recalled rows with the id of the turn that has their text; of several such turns the last. recalled: text; turns: store_id, turn, text, dia_id."""
    last = turns.groupBy("store_id", "text").agg(F.max_by("dia_id", "turn").alias("dia_id"))
    return recalled.join(last, ["store_id", "text"], "left")


def capped(questions: DataFrame, most: int, by: str = "sample_id", order: str = "q_id") -> DataFrame:
    """At most the first ``most`` questions of each sample."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return questions.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")


def matched(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Results of two runs side by side: keys, a, b; b is null where the second run lacks the row."""
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "left")
