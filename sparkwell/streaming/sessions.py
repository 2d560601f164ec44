"""Chat sessions as the state of a stream: messages are numbered as they come, once each, without a join against all of history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkwell import ship
from sparkwell.streaming.ingest import message_key

ship(__name__)

COLUMNS = ["session", "turn", "role", "text", "number", "n_messages"]
OUT = "session string, turn long, role string, text string, number long, n_messages long"


class Sessions(StatefulProcessor):
    """State of a session: the keys of its messages, and how many there are.  A message that comes again changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = StructType([StructField("n", LongType())])
        self.seen = handle.getMapState("seen", StructType([StructField("key", StringType())]), number)
        self.count = handle.getValueState("count", number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        before, out = n, []
        for frame in rows:
            for r in frame.itertuples(index=False):
                if self.seen.containsKey((r.key,)):
                    continue
                n += 1
                self.seen.updateValue((r.key,), (n,))
                out.append((r.session, r.turn, r.role, r.text, n, n))
        if n > before:
            self.count.update((n,))
            frame = pd.DataFrame(out, columns=COLUMNS)
            frame["turn"] = frame["turn"].astype("Int64")
            yield frame

    def close(self) -> None:
        pass


def numbered_messages(messages: DataFrame) -> DataFrame:
    """(session, turn, role, text, number, n_messages): each new message of a stream (conv_id, turn, role, text), numbered in its session as it came.

    Messages are known by session and turn (by text, too, where the turn is null); null sessions are one.  Needs the RocksDB state store.
    """
    session = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    turn = F.coalesce(F.col("turn").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    rows = messages.select(session.alias("session"), F.col("turn").cast("long").alias("turn"), "role", "text", message_key(F.col("conv_id"), turn).alias("key"))
    return rows.groupBy("session").transformWithStateInPandas(Sessions(), OUT, "append", "none")


def state_stream(messages: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that appends new messages, numbered, to the Parquet files at path.

    The sink and the state go on from the checkpoint, so a run that is started again adds nothing twice.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = numbered_messages(messages)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
