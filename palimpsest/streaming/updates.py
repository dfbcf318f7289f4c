"""The update cycle as a stateful stream: streaming gives the actions that the batch fold gives."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config
from ..operators.update import ACTIONS, Layer, fold

COLUMNS = ["store_id", "turn", "e_in", "e_out", "input_text", "output_text"]


def update_stream(turns: DataFrame, c: Config, anchors: dict[str, list[float]] | None = None) -> DataFrame:
    """Actions of a stream of turns. A turn waits in the state until all earlier turns of its store, counted from 0, have come; repeats are dropped."""
    known = {k: np.asarray(v) for k, v in (anchors or {}).items()}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        layer, waiting, due = pickle.loads(state.get[0]) if state.exists else (Layer(c, known), {}, 0)
        for batch in batches:
            for r in batch[COLUMNS].itertuples(index=False):
                if r.turn >= due:
                    waiting.setdefault(r.turn, tuple(r))
        ready = []
        while due in waiting:
            ready.append(waiting.pop(due))
            due += 1
        out = fold(layer, pd.DataFrame(ready, columns=COLUMNS)) if ready else []
        state.update((pickle.dumps((layer, waiting, due)),))
        yield pd.DataFrame(out, columns=["store_id", "turn", "action", "mem_id", "best_sim", "gate"]).astype({"mem_id": "Int64"})

    return turns.select(*COLUMNS).groupBy("store_id").applyInPandasWithState(run, ACTIONS, "layer binary", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str, width: str) -> DataFrame:
    """Extension: events by type in tumbling windows of event time, closed by a watermark. events: ts, event_type, value."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
