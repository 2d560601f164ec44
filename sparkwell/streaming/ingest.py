"""Incremental ingest: micro-batches of documents become chunks that the table lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkwell.operators.ingest import hashed_chunks, insert


def ingest_stream(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that inserts the chunks of a stream of (doc_id, text) into the Parquet table at path.

    Chunks are identified by hash, so a batch that comes again after a failure adds nothing.
    """

    def batch(rows: DataFrame, _: int) -> None:
        insert(hashed_chunks(rows), path)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def message_key(session: Column, turn: Column) -> Column:
    """A key of a message in which nulls are told from values, and one part from the other."""
    part = lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("-"))
    return F.sha2(F.concat(F.length(part(session)).cast("string"), part(session), part(turn)), 256)


def session_stream(messages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that appends a stream of messages (conv_id, turn, role, text) to the sessions' table at path.

    A message is known by its session and turn, so one that comes again adds nothing and none is changed.
    """

    def batch(rows: DataFrame, _: int) -> None:
        insert(rows.withColumn("hash_id", message_key(F.col("conv_id"), F.col("turn"))), path)

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
