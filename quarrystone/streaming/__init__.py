"""Structured Streaming over the events table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from quarrystone.storage import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream; its timestamps carry no zone and are read as UTC whatever the session's zone, so that they can carry a watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return raw.withColumn("ts", F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))


def tumbling_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by window and type, tumbling or, with `slide`, sliding; a window's state goes once the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(stream: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Events of each user's sessions: runs of events less than `gap` apart."""
    found = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("s.start").alias("start"), "n")


def first_of_each(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose keys have not been seen within `late`; older keys leave the state, which stays bounded."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class Purchases(StatefulProcessor):
    """Keeps each user's number and sum of purchases, and gives them again with each batch that changes them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("purchases", "n long, cents long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, cents = self.state.get() if self.state.exists() else (0, 0)
        for part in rows:
            n, cents = n + len(part), cents + int(part["cents"].sum())
        self.state.update((n, cents))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "cents": [cents]})

    def close(self) -> None:
        pass


def purchases(stream: DataFrame) -> DataFrame:
    """user_id, n, cents of each batch's users; a state of two numbers a user, however many purchases there are."""
    bought = stream.where("event_type = 'purchase' and user_id is not null").select("user_id", F.round(F.coalesce(F.col("value"), F.lit(0.0)) * 100).cast("long").alias("cents"))
    return bought.groupBy("user_id").transformWithStateInPandas(Purchases(), StructType([StructField(x, LongType()) for x in ("user_id", "n", "cents")]), "Update", "None")


#: No event is as late in time as this (pandas ends in 2262); a row that is closes all windows, sessions and joins before it.
CLOSING = "2250-01-01 00:00:00"


def _closing() -> Column:
    return F.lit(CLOSING + "Z").cast("timestamp")


def with_closing(stream: DataFrame, on: str = "ts", **values: object) -> tuple[DataFrame, Callable[[], None]]:
    """(the stream and a source that is empty so far, a function that puts a row into it with the time CLOSING in `on`, `values` and else nulls).

    What an append-mode query holds back for rows that could still come is given once the closing row has been read; see `drain`. Conditions on the
    stream must let the row pass (`or_closing`) up to the watermark; keys that the stream is joined by must be among `values`, as Spark leaves rows with null keys out early.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/closing_{uuid.uuid4().hex}"
    row = spark.range(1).select(*[(_closing() if f.name == on else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name) for f in stream.schema])
    row.limit(0).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path)), lambda: row.write.mode("append").parquet(path)


def or_closing(condition: str, on: str = "ts") -> Column:
    return F.expr(condition) | (F.col(on) >= _closing())


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own with the state store that custom processors need; the caller's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        value = spark.conf.get(key, None)
        if value is not None:
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


def drain(df: DataFrame, mode: str = "complete", close: Callable[[], None] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """All that the stream yields from what is there now, as a Parquet table in the shared folder, written by the executors.

    In complete mode the last batch's result; else each batch's rows, with batch. A batch that is run again replaces what it wrote. With `close`, the query is started
    once more, from its checkpoint, after `close` has been called. The table is one of `spark`, by default the stream's session.
    """
    own = df.sparkSession
    spark = spark or own
    base = f"{shared_folder(spark)}/stream_{uuid.uuid4().hex}"
    empty = own.createDataFrame([], df.schema)
    empty = empty if mode == "complete" else empty.withColumn("batch", F.lit(0).cast("long"))

    def put(batch: DataFrame, number: int) -> None:
        at = f"{base}/out" if mode == "complete" else f"{base}/out/{number}"
        (batch if mode == "complete" else batch.withColumn("batch", F.lit(number).cast("long"))).write.mode("overwrite").parquet(at)

    empty.write.parquet(f"{base}/out" if mode == "complete" else f"{base}/out/none")
    for before in (None, close) if close else (None,):
        if before:
            before()
        df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(empty.schema).parquet(f"{base}/out" if mode == "complete" else f"{base}/out/*")
