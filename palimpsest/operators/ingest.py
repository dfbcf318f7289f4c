"""From turns to memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import hash_embed
from ..functions.vectors import norm, normalized


def with_norms(memories: DataFrame) -> DataFrame:
    """Adds key_norm and value_norm, which every cosine uses again."""
    return memories.withColumns({"key_norm": norm("key"), "value_norm": norm("value")})


def window_pairs(turns: DataFrame, ending: Column) -> DataFrame:
    """Each turn with the next one's text as its output; the last has ``ending``. turns: store_id, turn, text."""
    order = Window.partitionBy("store_id").orderBy("turn")
    return turns.select("store_id", "turn", F.col("text").alias("input_text"), F.coalesce(F.lead("text").over(order), ending).alias("output_text"))


def flatten_turns(samples: DataFrame) -> DataFrame:
    """Turns of nested dialogues, in order: sample_id, session_no, turn_idx, dia_id, speaker, session_date, text.

    samples: sample_id, conversation (JSON text of session_N lists and session_N_date_time strings).
    """
    held = samples.select("sample_id", F.from_json("conversation", "map<string,string>").alias("held"))
    keys = held.select("sample_id", "held", F.explode(F.map_keys("held")).alias("session")).filter(F.col("session").rlike("^session_[0-9]+$"))
    session = keys.select("sample_id", F.regexp_extract("session", "([0-9]+)$", 1).cast("int").alias("session_no"), F.coalesce(F.col("held")[F.concat("session", F.lit("_date_time"))], F.lit("")).alias("session_date"), F.from_json(F.col("held")[F.col("session")], "array<struct<speaker:string,text:string,dia_id:string,blip_caption:string>>").alias("turns"))
    turn = session.select("sample_id", "session_no", "session_date", F.posexplode("turns").alias("turn_idx", "t"))
    image = F.when(F.length("t.blip_caption") > 0, F.concat(F.lit(" [shared image: "), F.col("t.blip_caption"), F.lit("]"))).otherwise("")
    return turn.select("sample_id", "session_no", "turn_idx", F.coalesce("t.dia_id", F.lit("")).alias("dia_id"), "t.speaker", "session_date", F.concat(F.lit("["), "session_date", F.lit("] "), "t.speaker", F.lit(": "), "t.text", image).alias("text"))


def direct_ingest(pairs: DataFrame, c: Config, dim: int = 64) -> DataFrame:
    """A memory of unit strength for every pair, in order, without gate or decay. pairs: store_id, turn, input_text, output_text."""
    order = Window.partitionBy("store_id").orderBy("turn")
    place = F.row_number().over(order).cast("long")
    out = pairs.withColumn("ts", place).withColumns({"key": hash_embed("input_text", dim), "value": hash_embed("output_text", dim)})
    return out.select("store_id", (F.col("ts") - 1).alias("mem_id"), normalized("key").alias("key"), normalized("value").alias("value"), F.lit(c.initial_strength).alias("strength"), F.lit(c.initial_bias).alias("bias"), "ts", "input_text", "output_text")


def context_states(turns: DataFrame, c: Config) -> DataFrame:
    """Context vector after each turn (Eq 8): an ordered fold over a store's embeddings. turns: store_id, turn, e."""
    step = F.struct("turn", "e")
    ordered = turns.groupBy("store_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    mix = lambda a, b: F.zip_with(a, b, lambda x, y: c.lambda_context * x + (1.0 - c.lambda_context) * y)

    def fold(acc: Column, s: Column) -> Column:
        new = F.when(F.size(acc) == 0, s["e"]).otherwise(normalized(mix(F.element_at(acc, -1)["context"], s["e"])))
        return F.concat(acc, F.array(F.struct(s["turn"].alias("turn"), new.alias("context"))))

    start = F.array().cast("array<struct<turn:bigint,context:array<double>>>")
    states = F.aggregate("steps", start, lambda acc, s: F.when(F.size(acc) == 0, F.array(F.struct(s["turn"].alias("turn"), s["e"].alias("context")))).otherwise(fold(acc, s)))
    return ordered.select("store_id", F.inline(states))
