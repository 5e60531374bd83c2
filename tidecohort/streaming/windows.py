"""Event-time windows that run alike on tables and streams (an extension: the analysed pipeline has no streams)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of event files; local timestamps become instants, as watermarks need them."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 hours")


def hourly(events: DataFrame) -> DataFrame:
    """(user_id, hour, n, total) over tumbling hours; late rows beyond the watermark are dropped in append mode."""
    counted = events.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select("user_id", F.col("w.start").alias("hour"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, started, ended, n) of sessions that a pause of ``gap`` ends."""
    counted = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """(user_id, started, n, total) over windows of a length that start every step; an event counts in each that holds it."""
    counted = events.groupBy("user_id", F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select("user_id", F.col("w.start").alias("started"), "n", "total")


RUNNING = "user_id long, n long, most double"


def running(events: DataFrame) -> DataFrame:
    """(user_id, n, most) after each batch of a stream: how many events a user has had, and their largest value.

    The state is two numbers a user; events of a batch may come in any order.
    """

    def update(key, frames, state):
        n, most = state.get if state.exists else (0, None)
        for frame in frames:
            n += len(frame)
            top = frame["value"].max()
            if pd.notna(top):
                most = float(top) if most is None else max(most, float(top))
        state.update((n, most))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most]})

    return events.groupBy("user_id").applyInPandasWithState(update, RUNNING, "n long, most double", "update", GroupStateTimeout.NoTimeout)


KEPT = "user_id long, n long, most double, kinds map<string,long>"


class Counters(StatefulProcessor):
    """For each key: how many events, their largest value, and how many of each kind.

    The two numbers are a value state, the kinds a map state; both end ``ttl_ms`` after the key's last event where that is set.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n long, most double", self.ttl_ms)
        self.kinds = handle.getMapState("kinds", "kind string", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        n, most = self.totals.get() if self.totals.exists() else (0, None)
        counts: dict[str, int] = {}
        for frame in rows:
            n += len(frame)
            top = frame["value"].max()
            if pd.notna(top):
                most = float(top) if most is None else max(most, float(top))
            for kind, k in frame["event_type"].value_counts().items():
                counts[kind] = counts.get(kind, 0) + int(k)
        self.totals.update((n, most))
        for kind, k in counts.items():
            old = self.kinds.getValue((kind,))[0] if self.kinds.containsKey((kind,)) else 0
            self.kinds.updateValue((kind,), (old + k,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "most": [most], "kinds": [{k[0]: v[0] for k, v in self.kinds.iterator()}]})

    def close(self) -> None:
        pass


def counters(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(user_id, n, most, kinds) after each batch of a stream, from keyed state in the state store.

    With a time-to-live the stream runs on the clock and never ends by itself; without one it can read what is there and stop.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.select("user_id", "value", "event_type").groupBy("user_id").transformWithStateInPandas(Counters(ttl_ms), KEPT, "Update", "None" if ttl_ms is None else "ProcessingTime")


def last_state(stream: DataFrame, folder: str) -> DataFrame:
    """The last row of every key once a stream (without time-to-live) has read all that is there.

    Batches and checkpoint lie below ``folder``.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(f"{KEPT}, batch long").parquet(f"{folder}/batches")
    names = [c for c in rows.columns if c not in ("user_id", "batch")]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("user_id", "s.*")
