"""Two feeds: reader progress and relationship deltas.

Progress: each micro-batch writes one ``batch=N`` partition of reduced changes, so a replayed
batch overwrites its own partition and nothing else is ever rewritten. The current
table is the newest change per key over the partitions; ``compact`` folds them into one.
Deltas: a batch rewrites the buckets of the books it touches (`versions`). Batch numbers
come from the checkpoint, so a table and its checkpoint belong together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotweave.operators import graph, ingest
from plotweave.operators.state import READER, latest_progress
from plotweave.plans.pick import latest
from plotweave.streaming.versions import Versions


def _write_batch(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _run(stream: DataFrame, step, checkpoint: str, wait: bool) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        query.awaitTermination()
    return query


# ------------------------------------------------------------------- progress


def progress_feed(stream: DataFrame, path: str, checkpoint: str, lateness: str = "1 hour", wait: bool = True) -> StreamingQuery:
    """Reader positions (event_id, user_id, book_id, …, at, ts) to a progress table.

    Events sent again within ``lateness`` are dropped by the watermark state. A late
    event simply loses against a newer one, whatever order they arrive in.
    """
    once = stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"]).drop("ts")

    def step(batch: DataFrame, number: int) -> None:
        _write_batch(latest_progress(batch), path, number)

    return _run(once, step, checkpoint, wait)


def current_progress(spark: SparkSession, path: str) -> DataFrame:
    return latest(_read_batches(spark, path).drop("batch"), READER, ["at", "event_id"])


def compact(rows: DataFrame, path: str) -> None:
    """Write the current rows as the first batch of a new table."""
    _write_batch(rows, path, 0)


# --------------------------------------------------------------------- deltas


# Rows as the tables keep them: an edge carries its event's place, so that a fold needs no events.
EDGES = """event_id long, book_id long, from_id long, to_id long, from_char_id long, to_char_id long, explanation string,
  relation_tags string, interaction_count int, sentiment_score float, chapter_idx int, event_idx int, event_ref string"""
STATS = "event_id long, book_id long, character_id long, char_id long, node_weight double"
GRAPH = """book_id long, left_id long, right_id long, evidence_count long, positivity double, latest_labels array<string>,
  latest_reason string, latest_event_id string"""


def _cast(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.replace("\n", " ").split(", ")])


def apply_deltas(table: Versions, edges: DataFrame, stats: DataFrame, replaced: DataFrame, batch: int) -> None:
    """Replace the rows of ``replaced`` events and fold the books of the touched buckets again.

    ``edges`` and ``stats`` are as `EDGES` and `STATS`, ``replaced`` has (event_id, book_id).
    """
    touched = table.touched(replaced)
    versions = table.before(batch)
    made = {}
    for name, incoming, schema in (("edges", edges, EDGES), ("stats", stats, STATS)):
        held = table.rows(name, schema, versions, touched)
        made[name] = table.write(name, ingest.replace_by_event(held, _cast(incoming, schema), replaced), batch)
    made["graph"] = table.write("graph", graph.fold_edges(_with_id(made["edges"])), batch)
    table.commit(made, touched, batch)


def delta_feed(
    stream: DataFrame, events: DataFrame, characters: DataFrame, path: str, checkpoint: str, wait: bool = True, buckets: int = 256
) -> StreamingQuery:
    """Delta uploads to edges, stats and refreshed graphs.

    ``stream`` has (upload_id, book_id, file, json); ``upload_id`` rises. Clean uploads
    replace their events. A batch reads and writes only the buckets of books it touches.
    """
    spark = stream.sparkSession
    table = Versions(spark, path, "book_id", buckets)

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            done = ingest.newest_uploads(ingest.deltas(batch, events, characters))
            _write_batch(done["rejects"], f"{path}/rejects", number)
            _write_batch(done["replaced_events"], f"{path}/replaced", number)
            replaced = spark.read.parquet(f"{path}/replaced/batch={number}")
            apply_deltas(table, graph.edge_facts(done["edges"], events), done["stats"], replaced, number)
        finally:
            batch.unpersist()

    return _run(stream, step, checkpoint, wait)


def _with_id(edges: DataFrame) -> DataFrame:
    """An order inside one event; an event has one edge per direction."""
    return edges.withColumn("id", F.struct("from_id", "to_id"))


def current_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Edges or stats as they are after the newest batch."""
    table = Versions(spark, path, "book_id")
    return table.rows(name, {"edges": EDGES, "stats": STATS, "graph": GRAPH}[name], table.newest())


def current_graph(spark: SparkSession, path: str) -> DataFrame:
    """Folded edges of every book."""
    return current_rows(spark, path, "graph")
