"""A running memory: turns stream in, snapshots hold what they leave, recall answers from the last snapshot.

A ``MemorySession`` keeps three tables under one path: turns (appended), actions (the stream's output) and versioned
snapshots. Recall reads a snapshot and changes nothing, so it needs no lock against updates. A snapshot holds each store's state,
so the next one folds only the turns that came since; a question to one store reads that store's buckets only.

What a prompt held is kept with its turn, and the fold gives feedback on it right behind the turn's update, as the response is known then.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .config import Config
from .functions.text import hash_embed
from .functions.vectors import normalized
from .operators import hierarchy, ingest, recall, reports, sparse, spread, update
from .sources import snapshots
from .streaming.updates import update_stream

TURNS = "store_id long, turn long, input_text string, output_text string, recalled array<long>"


def embed(text: str | Column) -> Column:
    """Offline embedding, for where no model is given."""
    return normalized(hash_embed(text))


def input_text(request: Mapping[str, Any]) -> str:
    """What the user says in a request: its input, or the contents of a list of them, joined by blanks."""
    given = request.get("input", "")
    if isinstance(given, str):
        return given
    return " ".join(x if isinstance(x, str) else str(x.get("content", "")) for x in given if isinstance(x, str) or "content" in x)


def with_context(request: Mapping[str, Any], context: str) -> dict[str, Any]:
    """The request with ``context`` behind its instructions."""
    if not context:
        return dict(request)
    known = request.get("instructions")
    return dict(request) | {"instructions": f"{known}\n\n{context}" if known else context}


@dataclass
class MemorySession:
    spark: SparkSession
    path: str
    config: Config = field(default_factory=Config)
    embed: Callable[[str], Column] = embed
    query: StreamingQuery | None = None
    #: Turns of a wrapped client after which a new snapshot is made; 0: only when asked for.
    snapshot_every: int = 0

    def observe(self, turns: DataFrame) -> None:
        """Appends turns (store_id, turn, input_text, output_text, and recalled: ids of what the prompt held), numbered from 0 in each store."""
        if "recalled" not in turns.columns:
            turns = turns.withColumn("recalled", F.lit(None).cast("array<long>"))
        turns.select("store_id", "turn", "input_text", "output_text", "recalled").write.mode("append").parquet(f"{self.path}/turns")

    def _embedded(self, turns: DataFrame) -> DataFrame:
        return turns.withColumns({"e_in": self.embed("input_text"), "e_out": self.embed("output_text")})

    def start(self) -> StreamingQuery:
        """Starts folding turns into actions."""
        self.observe(self.spark.createDataFrame([], TURNS))
        turns = self.spark.readStream.schema(TURNS).parquet(f"{self.path}/turns")
        acts = update_stream(self._embedded(turns), self.config, self._anchors())
        self.query = acts.writeStream.format("parquet").option("path", f"{self.path}/actions").option("checkpointLocation", f"{self.path}/progress").outputMode("append").start()
        return self.query

    def flush(self) -> None:
        """Waits until all observed turns are folded."""
        if self.query is not None:
            self.query.processAllAvailable()

    def stop(self) -> bool:
        """Stops the stream; whether one had run."""
        if self.query is None:
            return False
        self.query.stop()
        self.query = None
        return True

    @property
    def error(self) -> Exception | None:
        """What the stream failed with, if it did."""
        return self.query.exception() if self.query is not None else None

    def _anchors(self) -> dict[str, list[float]]:
        if not self.config.channels_enabled:
            return {}
        rows = self.spark.createDataFrame(list(self.config.channel_anchors.items()), "name string, text string")
        return {r["name"]: r["e"] for r in rows.select("name", self.embed("text").alias("e")).collect()}

    def snapshot(self) -> str:
        """Folds the turns that came since the last snapshot, and saves states, memories, edges, patterns, identities and layer states as a new version."""
        turns = self.spark.read.schema(TURNS).parquet(f"{self.path}/turns").dropDuplicates(["store_id", "turn"])
        last, found = snapshots.load(self.spark, f"{self.path}/snapshots", names=["layers"], verify=False)
        known = last["layers"] if found else None
        if known is not None:
            due = known.select("store_id", "due")
            turns = turns.join(due, "store_id", "left").filter(F.col("turn") >= F.coalesce("due", F.lit(0))).drop("due")
        states = update.advance(known, self._embedded(turns), self.config, self._anchors())
        folding = snapshots.save({"layers": states}, f"{self.path}/folding")  # once, for all tables that are laid out from it
        states = self.spark.read.schema(snapshots.TABLES["layers"]).parquet(f"{self.path}/folding/{folding}/layers")
        return snapshots.save({"layers": states} | {name: update.table_of(states, name) for name in update.TABLES}, f"{self.path}/snapshots")

    def _tables(self, store_id: int | None) -> dict[str, DataFrame]:
        names = ["memories", "edges", "layer_state", *(["l2", "l3"] if self.config.hierarchy_enabled else [])]
        return snapshots.load(self.spark, f"{self.path}/snapshots", store_id, names, verify=False)[0]

    def recall(self, asked: DataFrame, store_id: int | None = None) -> DataFrame:
        """query_id, store_id, mem_id, rank, score, and the memory's columns. asked: query_id, store_id, text. Empty without a snapshot.

        store_id: of all questions, if they are to one store; then only that store is read.
        """
        return self._recall(asked, self._tables(store_id))

    def _recall(self, asked: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
        c, mem = self.config, ingest.with_norms(tables["memories"])
        state = tables["layer_state"].select("store_id", F.col("timestep").alias("now"), F.col("context_vector").alias("context"))
        queries = asked.select("query_id", "store_id", self.embed("text").alias("q"))
        q = recall.effective_query(queries, mem, state, c).select("query_id", "store_id", F.col("q_eff").alias("q"))
        words = sparse.tfidf_by_store(asked, tables["memories"]) if c.sparse_recall_enabled else None
        scored = recall.multi_head(q, mem, state, c, words)
        aware = recall.meet(q, mem).select("query_id", "mem_id", recall.cosine("q", "key", "q_norm", "key_norm").alias("sim"))
        start = scored.select("query_id", "store_id", "mem_id", F.col("score").alias("a0")).join(aware, ["query_id", "mem_id"])
        found = spread.collect(spread.spread(start, tables["edges"], c), c).withColumnRenamed("activation", "score")
        if c.hierarchy_enabled:
            found = hierarchy.rerank(found, q, tables["l2"], tables["l3"], c)
        return found.join(tables["memories"], ["store_id", "mem_id"])

    def prompts(self, asked: DataFrame, k: int | None = None, store_id: int | None = None) -> DataFrame:
        """(query_id, prompt) by the configured report: tension before channels before plain."""
        tables = self._tables(store_id)
        return self._prompts(self._recall(asked, tables), tables, k)

    def _prompts(self, found: DataFrame, tables: dict[str, DataFrame], k: int | None = None) -> DataFrame:
        c = self.config
        found = found.filter(F.col("rank") <= (k or c.top_k))
        if c.tension_enabled:
            roles = recall.tension(found.select("query_id", "store_id", "mem_id", "rank", "score"), ingest.with_norms(tables["memories"]), c)
            return reports.tension_prompt(found.join(roles.select("query_id", "mem_id", "role"), ["query_id", "mem_id"]))
        return reports.channel_prompt(found) if c.channels_enabled else reports.prompt(found)

    def answer_for(self, store_id: int, text: str) -> tuple[str, list[int]]:
        """(prompt, ids of the memories that it holds, best first) for one question; empty if nothing is recalled."""
        asked, tables = self.spark.createDataFrame([(0, store_id, text)], "query_id long, store_id long, text string"), self._tables(store_id)
        found = self._recall(asked, tables).filter(F.col("rank") <= self.config.top_k).cache()
        try:
            row = self._prompts(found, tables).head()
            return (row["prompt"], [r["mem_id"] for r in found.select("rank", "mem_id").orderBy("rank").collect()]) if row else ("", [])
        finally:
            found.unpersist()

    def context_for(self, store_id: int, text: str) -> str:
        """The prompt for one question; empty if nothing is recalled."""
        return self.answer_for(store_id, text)[0]


def enable_memory(client: Any, session: MemorySession, store_id: int) -> MemorySession:
    """Wraps ``client.responses.create``: what is recalled goes into the request, and request, response and what was recalled are observed.

    With ``snapshot_every`` set, a snapshot is made after each so many turns, so that new turns are recalled.
    """
    if getattr(client, "_memory_session", None) is not None:
        return client._memory_session
    original = client.responses.create
    known = session.spark.read.schema(TURNS).parquet(f"{session.path}/turns").filter(F.col("store_id") == store_id).agg(F.max("turn")).head()[0] if session.query is not None else None
    count = 0 if known is None else known + 1

    def create(**request: Any) -> Any:
        nonlocal count
        said = input_text(request)
        context, recalled = session.answer_for(store_id, said) if said.strip() else ("", [])
        response = original(**with_context(request, context))
        session.observe(session.spark.createDataFrame([(store_id, count, said, str(getattr(response, "output_text", "")), recalled)], TURNS))
        count += 1
        if session.snapshot_every and count % session.snapshot_every == 0:
            session.snapshot()
        return response

    client.responses.create = create
    client._memory_session, client._memory_original = session, original
    return session


def disable_memory(client: Any) -> bool:
    """Restores the client and stops the session's stream; whether it was wrapped."""
    if getattr(client, "_memory_session", None) is None:
        return False
    client.responses.create = client._memory_original
    client._memory_session.flush()
    client._memory_session.stop()
    client._memory_session = None
    return True
