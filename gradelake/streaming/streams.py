"""Structured Streaming over file sources: checkpointed ingestion, routing, settlement, schedules, fan-out.

A folder of Parquet files stands in for a broker. Every query has a checkpoint, starts from the earliest
file and, with ``availableNow``, ends when the folder is read.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from gradelake.operators.ops import any_changed, chunks, global_rank, in_ranges, starting_ranks
from gradelake.sources.staging import written


def read_events(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_batch: int = 100, glob: str = "*.parquet") -> DataFrame:
    """A stream over a folder from its beginning, in micro-batches of some files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)


def ingest(events: DataFrame, out: str, checkpoint: str, seconds: int | None = None) -> None:
    """Append to Parquet; what the checkpoint holds isn't read twice. ``seconds`` bounds the run in time."""
    writer = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    _finish(writer, seconds)


def _finish(writer, seconds: int | None = None) -> None:
    query = writer.trigger(availableNow=True).start()
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()


def settled(rows: DataFrame, valid: Column, transient: Column) -> DataFrame:
    """Add ``settlement``: complete, abandon (worth another attempt) or dead-letter. A test that is null fails."""
    ok, again = F.coalesce(valid, F.lit(False)), F.coalesce(transient, F.lit(False))
    return rows.withColumn("settlement", F.when(again, "abandon").when(ok, "complete").otherwise("dead-letter"))


def route_settled(stream: DataFrame, valid: Column, transient: Column, out: str, checkpoint: str) -> None:
    """One query, partitioned sinks out/settlement=...: a row lands in one of them, once per checkpointed batch."""
    rows = settled(stream, valid, transient)
    _finish(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("settlement"))


def retried(dead: DataFrame, valid: Column, most: int | None = 10, order: str | None = None) -> DataFrame:
    """Dead letters looked at again, the first ``most`` by the unique column ``order`` or all: those that are valid now complete, all others stay as they are."""
    good = F.coalesce(valid, F.lit(False))
    if most is None:
        return dead.withColumn("settlement", F.when(good, "complete").otherwise("dead-letter"))
    if order is None:
        raise ValueError("A limit needs an order.")
    looked = F.col("_rank") < most
    return global_rank(dead, order).withColumnRenamed("rank", "_rank").withColumn("settlement", F.when(looked & good, "complete").otherwise("dead-letter")).drop("_rank")


def by_type(stream: DataFrame, kinds: dict[str, str], type_col: str, checkpoint: str) -> None:
    """Each batch to the folder of its type; unknown types go to the folder under the key None or are left out."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, folder in kinds.items():
            mine = batch.where(F.col(type_col) == kind) if kind is not None else batch.where(~F.coalesce(F.col(type_col).isin(*[k for k in kinds if k]), F.lit(False)))
            # The batch number names the folder, so a batch that is given again replaces itself.
            mine.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batch.unpersist()

    _finish(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint))


def scheduled(rows: DataFrame, at: str, now: Column, cancelled: str | None = None) -> DataFrame:
    """Messages due now: not in the future, and not cancelled."""
    due = F.col(at).isNull() | (F.col(at) <= now)
    return rows.where(due if cancelled is None else due & ~F.coalesce(F.col(cancelled), F.lit(False)))


def retry_schedule(rows: DataFrame, status: str, attempt: str, delay_ms: Column, now: Column, most: int = 3) -> DataFrame:
    """Throttled rows (429) get their next attempt and time; after ``most`` attempts, and for other statuses, none."""
    again = (F.col(status) == 429) & (F.col(attempt) < most)
    return rows.withColumn("next_attempt", F.when(again, F.col(attempt) + 1)).withColumn("deliver_at", F.when(again, now + F.make_dt_interval(secs=F.coalesce(delay_ms, F.lit(0)) / 1000)))


def fan_out(spark: SparkSession, folder: str, schema: str, subscriptions: dict[str, Column], out: str, checkpoint: str) -> None:
    """A topic: one query per subscription over the same source, each with its own checkpoint and filter."""
    for name, test in subscriptions.items():
        ingest(read_events(spark, folder, schema).where(test), f"{out}/{name}", f"{checkpoint}/{name}")


def flattened(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON arrays of events to one row per event, for both field spellings: (event_id, event_type, subject)."""
    kind = "array<struct<id:string,eventType:string,type:string,subject:string>>"
    one = rows.select(F.explode(F.from_json(payload, kind)).alias("e"))
    return one.select(F.col("e.id").alias("event_id"), F.coalesce("e.eventType", "e.type").alias("event_type"), F.col("e.subject").alias("subject"))


def event_batches(stream: DataFrame, handle, checkpoint: str, size: int = 100, order: str | None = None, partition: str | None = None) -> None:
    """Hand events on in batches of at most ``size``: handle(rows, number of the micro-batch), where the column ``batch`` of rows numbers them.

    Consecutive events by ``order``, a unique key, share a batch; without it, those that stand together in a file do. With
    ``partition``, a batch holds events of one partition, and each has its own numbers from 0.
    """

    def each(rows: DataFrame, number: int) -> None:
        key = order or "_n"
        numbered = rows if order else rows.withColumn("_n", F.monotonically_increasing_id())
        if partition is None:
            out = chunks(numbered, key, size).withColumnRenamed("chunk", "batch")
        else:
            out = starting_ranks(in_ranges(numbered, partition, key), [partition]).withColumn("batch", F.floor(F.col("_nth") / size)).drop("_nth")
        handle(out.drop("_n"), number)

    _finish(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint))


def produce(rows: DataFrame, folder: str, size: int = 10) -> None:
    """Append rows to a folder that streams read, at most ``size`` to a file."""
    rows.write.mode("append").option("maxRecordsPerFile", size).parquet(folder)


def received(queue: DataFrame, key: str, consumers: int, most: int = 5) -> DataFrame:
    """Add ``consumer`` and ``receive``: each message of a queue goes to exactly one of the competing consumers, at most ``most`` in one receive.

    Messages are dealt by a hash of their key, so a message that is read again goes to the same one; a consumer gets
    its messages in key order, numbered in ranges of that order.
    """
    dealt = queue.withColumn("consumer", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(consumers)).cast("int"))
    return starting_ranks(in_ranges(dealt, "consumer", key), ["consumer"]).withColumn("receive", F.floor(F.col("_nth") / most)).drop("_nth")


def poll(read, terminal: set[str], seconds: float, every: float = 1.0) -> str:
    """The status that ``read()`` gives once it is terminal; a TimeoutError after the deadline."""
    until = time.monotonic() + seconds
    while True:
        status = read()
        if status in terminal:
            return status
        if time.monotonic() + every > until:
            raise TimeoutError(f"The operation is still {status}.")
        time.sleep(every)


#: Micro-batches whose changes are kept apart in the state of sessions before it is written as a whole.
WHOLE_EVERY = 32


def session_sequences(stream: DataFrame, key: str, order: str, out: str, checkpoint: str) -> None:
    """First in, first out per session key: rows of each batch numbered after those that the key had before, in out/rows.

    Rows stay in Spark, so values of any type come out as they went in. They are numbered in ranges of (key, order), so a
    key may have any number of rows in a batch. The state is one count for each key: each batch writes those of its
    keys to out/state, and every WHOLE_EVERY batches those of all. A batch that is given again replaces what it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = starting_ranks(in_ranges(batch, key, order), [key])
        counts = rows.groupBy(key).agg(F.max("_nth").alias("_last")).withColumnRenamed(key, "_key")
        first = (number - 1) // WHOLE_EVERY * WHOLE_EVERY if number else 0
        parts = [f"{out}/state/micro_batch={k}" for k in range(first, number)]
        kind = T.StructType([T.StructField("key", batch.schema[key].dataType), T.StructField("seen", T.LongType())])
        before = spark.read.schema(kind).parquet(*parts) if parts else spark.createDataFrame([], kind)
        before = before.groupBy("key").agg(F.max("seen").alias("seen"))
        now = written(counts.join(before, F.col("_key").eqNullSafe(F.col("key")), "left").select("_key", F.coalesce("seen", F.lit(0)).alias("_seen"), "_last"), "sessions")
        numbered = rows.join(now.select("_key", "_seen"), rows[key].eqNullSafe(F.col("_key"))).withColumn("sequence", F.col("_seen") + F.col("_nth") + 1)
        numbered.select(*batch.columns, "sequence").write.mode("overwrite").parquet(f"{out}/rows/micro_batch={number}")
        state = now.select(F.col("_key").alias("key"), (F.col("_seen") + F.col("_last") + 1).alias("seen"))
        if number % WHOLE_EVERY == 0:
            state = state.unionByName(before).groupBy("key").agg(F.max("seen").alias("seen"))
        state.write.mode("overwrite").parquet(f"{out}/state/micro_batch={number}")

    _finish(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint))


class _Delivery(StatefulProcessor):
    """Holds one message of a key until its time; a cancellation forgets it."""

    def __init__(self, schema: T.StructType, cancelled: str | None):
        self.schema, self.cancelled = schema, cancelled

    def init(self, handle) -> None:
        self.handle = handle
        self.message = handle.getValueState("message", self.schema)

    def _forget(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.message.clear()

    def handleInputRows(self, key, rows, timerValues):
        rows = list(rows)  # those of one message
        if self.cancelled and any(r[self.cancelled] for r in rows):
            self._forget()
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        for r in rows:
            if r["_due"] is None or r["_due"] <= now:
                yield r
            else:
                self._forget()
                self.message.update(tuple(r))
                self.handle.registerTimer(r["_due"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.message.exists():
            yield Row(**dict(zip(self.schema.names, self.message.get())))
        self.message.clear()

    def close(self) -> None:
        pass


def delivered(stream: DataFrame, key: str, at: str, out: str, checkpoint: str, seconds: float, cancelled: str | None = None, every: str = "1 second") -> None:
    """Scheduled messages, appended to ``out`` once their time has come, by a timer of each message; the query runs for some seconds.

    key tells messages apart. A row whose ``cancelled`` is true takes back the message of its key if that still waits
    (or came in the same batch); a later row of the same key replaces it. A message without a time, or whose time is past,
    is given out at once. Messages that wait stay in the checkpoint's state store, so a query that is started again gives
    each of them out, once.
    """
    spark = stream.sparkSession
    rows = stream.withColumn("_due", F.unix_millis(F.col(at)))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    try:
        timed = rows.groupBy(key).transformWithState(_Delivery(rows.schema, cancelled), rows.schema, "Append", "ProcessingTime")
        query = timed.drop("_due").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
        if not query.awaitTermination(seconds):
            query.stop()
    finally:
        spark.conf.set(name, before)


def with_settings(stream: DataFrame, settings: Callable[[], DataFrame], sentinels: Column, keys: list[str], values: list[str], out: str, checkpoint: str) -> None:
    """Each micro-batch joined with settings by ``keys``, and appended to ``out``.

    All settings are read again when one of the rows that ``sentinels`` marks is new or changed since they were read, else
    the batch keeps those read before: a change becomes visible as a whole, and only once its sentinel moves.
    """
    held: list[DataFrame] = []

    def each(batch: DataFrame, number: int) -> None:
        fresh = settings()
        if not held or any_changed(held[0].where(sentinels), fresh.where(sentinels), keys, values).first()["changed"]:
            held[:] = [written(fresh, "settings")]
        batch.join(held[0], keys, "left").write.mode("overwrite").parquet(f"{out}/micro_batch={number}")

    _finish(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint))
