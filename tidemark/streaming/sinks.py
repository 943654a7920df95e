"""Sinks of streams. All are safe to repeat: a batch that is written again leaves the same rows."""

from __future__ import annotations

import json
import logging
import queue
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)
Write = Callable[[DataFrame, int], None]


def drained(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that the sources hold now, through the stream and into files; what came out, as a batch."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def each_batch(df: DataFrame, write: Write, checkpoint: str, mode: str = "update", trigger: str | None = None) -> StreamingQuery:
    """A stream into a sink: every so often, as "60 seconds", or all that is there now. What a batch has read and where it
    stopped is in the checkpoint before the next one begins, so the interval is also that between checkpoints."""
    writer = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def upsert(folder: str, key: list[str], order: str | None = None, compact_every: int = 16) -> Write:
    """Keeps the last row of each key, by an order column where a key may come twice in a batch: without one that is an
    error. Every batch is a folder of its own, so writing it again replaces it; every so many batches, all that is there
    becomes one table, and only what came since is read beside it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cols = [c for c in batch.columns if c not in key]
        row = F.struct(*cols)
        if order is None:
            last = F.when(F.count("*") == 1, F.min(row)).otherwise(F.raise_error(F.lit("a key comes twice in a batch, which has no order")))
        else:
            last = F.max_by(row, F.struct(F.col(order), row))
        rows = batch.groupBy(*key).agg(last.alias("_row")).select(*key, "_row.*", F.lit(batch_id).cast("long").alias("_batch")).select(*batch.columns, "_batch")
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id:09d}")
        if batch_id and batch_id % compact_every == 0:
            compact(batch.sparkSession, folder, key, batch_id)

    return write


def _latest(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """All batches after the last table, with that table."""
    names = _names(spark, folder)
    upto = upto if upto is not None else max((int(n[6:]) for n in names if n.startswith("batch=")), default=0)
    base = max((int(n[6:]) for n in names if n.startswith("table=") and int(n[6:]) <= upto), default=-1)
    parts = [f"{folder}/{n}" for n in names if (n.startswith("batch=") and base < int(n[6:]) <= upto) or n == f"table={base:09d}"]
    return spark.read.parquet(*parts)


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(path)]


def _last_of(rows: DataFrame, key: list[str]) -> DataFrame:
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), "_batch").alias("_row")).select(*key, "_row.*").select(*rows.columns)


def compact(spark: SparkSession, folder: str, key: list[str], batch_id: int) -> None:
    """One table of everything up to a batch. It is complete or not there, and a repetition writes the same."""
    _last_of(_latest(spark, folder, batch_id).where(F.col("_batch") <= batch_id), key).write.mode("ignore").parquet(f"{folder}/table={batch_id:09d}")


def upserted(spark: SparkSession, folder: str, key: list[str]) -> DataFrame:
    """The table that an upsert sink holds: of each key, the row of its last batch."""
    return _last_of(_latest(spark, folder), key).drop("_batch")


def routed(folder: str, route: str, names: tuple[str, ...]) -> Write:
    """One scan of a batch into a folder for each route."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name in names:
                batch.where(F.col(route) == name).drop(route).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id:09d}")
        finally:
            batch.unpersist()

    return write


def several(*writes: Write) -> Write:
    """Several sinks of one stream, which is scanned once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for w in writes:
                w(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def hypertable(folder: str, time: str) -> Write:
    """Appends to a table partitioned by day, so that ranges of time prune its files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"day": F.to_date(time), "batch": F.lit(batch_id)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(folder)

    return write


def printed(df: DataFrame, checkpoint: str, rows: int = 20, trigger: str | None = None, mode: str = "append") -> StreamingQuery:
    """A stream onto the driver's console, some rows of each batch."""
    writer = df.writeStream.outputMode(mode).format("console").option("numRows", rows).option("truncate", "false").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def appended(folder: str) -> Write:
    """Appends rows; a batch that comes again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id:09d}")

    return write


def topic(options: Mapping[str, str], name: str, key: list[str] | None = None) -> Write:
    """Appends rows as JSON to a topic; with a key, readers that keep the last row of each key see an upsert. A batch
    that comes again is written again, under the same keys."""

    def write(batch: DataFrame, batch_id: int) -> None:
        as_json(batch, key).write.format("kafka").options(**{k: v for k, v in options.items() if k.startswith("kafka.")}).option("topic", name).save()

    return write


def jdbc(url: str, name: str, properties: Mapping[str, str]) -> Write:
    """Appends rows to a database table, with the batch's number, by which a batch that comes again is known there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.jdbc(url, name, mode="append", properties=dict(properties))

    return write


class FanOut:
    """Rows of streams to subscribers of this process, as JSON with the name of their stream. Each subscriber has a queue of
    bounded length; one that has let it run full is dropped, and holds up neither the stream nor the others."""

    def __init__(self, most: int = 500) -> None:
        self.most = most
        self.queues: list[queue.Queue[dict]] = []

    def subscribe(self) -> queue.Queue[dict]:
        q: queue.Queue[dict] = queue.Queue(self.most)
        self.queues.append(q)
        return q

    def unsubscribe(self, q: queue.Queue[dict]) -> None:
        if q in self.queues:
            self.queues.remove(q)

    def sink(self, name: str) -> Write:
        """A batch's rows come to the driver one partition at a time, and only while somebody listens: this is for the few
        rows of a dashboard."""

        def write(batch: DataFrame, batch_id: int) -> None:
            if not self.queues:
                return
            for row in as_json(batch).toLocalIterator():
                envelope = {"topic": name, "data": json.loads(row["value"])}
                for q in list(self.queues):
                    try:
                        q.put_nowait(envelope)
                    except queue.Full:
                        self.unsubscribe(q)

        return write


def logged(label: str) -> Write:
    def write(batch: DataFrame, batch_id: int) -> None:
        log.info("%s: batch %d has %d rows", label, batch_id, batch.count())

    return write


def as_json(df: DataFrame, key: str | list[str] | None = None) -> DataFrame:
    """Rows as JSON text in a value column, with a key if one is named: what a topic takes. A key of several columns is
    JSON too."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    if not key:
        return df.select(value)
    whole = F.col(key).cast("string") if isinstance(key, str) else F.to_json(F.struct(*key))
    return df.select(whole.alias("key"), value)
