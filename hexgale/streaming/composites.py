"""Incremental composites and resumable processing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# 16-day windows that start on 2001-01-01 begin 11 days after the windows counted from 1970-01-01.
WINDOW, OFFSET = "16 days", "11 days"


def tumbling_composite(
    stream: DataFrame, keys: Sequence[str], time: str, value: str, *, window: str = WINDOW, offset: str = OFFSET, lateness: str = "16 days"
) -> DataFrame:
    """Maximum and count per key and 16-day window with a watermark (S1); works on a batch frame too.

    State is one row per open key and window; maximum and count combine map-side, so a hot key is one
    row per task.
    """
    timed = stream.withColumn("_ts", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_ts", lateness)
    out = timed.groupBy(*keys, F.window("_ts", window, startTime=offset).alias("_w")).agg(
        F.max(value).alias("max_value"), F.count(value).alias("n_values")
    )
    return out.select(*keys, F.col("_w.start").cast("date").alias("period_start"), "max_value", "n_values")


def file_stream(
    spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_batch: int | None = None, pattern: str | None = None
) -> DataFrame:
    """Stream over the files of a folder, optionally only names that match a pattern."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to parquet for all files present, then stop."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def process_incrementally(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Process new files batch by batch into per-batch folders.

    The checkpoint remembers finished files. A batch that is repeated after a failure overwrites its own
    folder, so nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, place = _file_system(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(place)] if fs.exists(place) else []


class BatchSink:
    """Sink of a stream whose batches may be repeated and interrupted at any place.

    A batch is written to a folder with its number, and a marker follows when it is complete. Readers see marked batches
    only, so half a batch does not exist for them; a repeated batch overwrites its own folder. Rows of batches are parts
    that ``merge`` adds up. Every ``every`` batches all parts so far are merged into one table, so the number of folders
    that are read stays small; such a table never replaces one that it was read from.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], every: int = 20):
        self.spark, self.path, self.merge, self.every = spark, path, merge, every

    def marked(self, kind: str) -> list[int]:
        return sorted(int(name.split("-")[1]) for name in _names(self.spark, f"{self.path}/marks") if name.startswith(f"{kind}-"))

    def mark(self, kind: str, number: int) -> None:
        fs, place = _file_system(self.spark, f"{self.path}/marks/{kind}-{number}")
        fs.create(place, True).close()

    def folders(self, below: int | None = None) -> list[str]:
        """Folders that together hold every complete batch (before a number) once."""
        merged = max((n for n in self.marked("merged") if below is None or n < below), default=-1)
        parts = [n for n in self.marked("part") if n > merged and (below is None or n <= below)]
        return [f"{self.path}/merged-{merged}"] * (merged >= 0) + [f"{self.path}/part-{n}" for n in parts]

    def write(self, part: DataFrame, number: int) -> None:
        part.write.mode("overwrite").parquet(f"{self.path}/part-{number}")
        self.mark("part", number)
        if (number + 1) % self.every == 0:
            whole = self.merge(self.spark.read.parquet(*self.folders(below=number)))
            whole.write.mode("overwrite").parquet(f"{self.path}/merged-{number}")
            self.mark("merged", number)

    def read(self, schema) -> DataFrame:
        """The merged rows of all complete batches; no rows of the schema before the first."""
        folders = self.folders()
        return self.merge(self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema))


def composite_parts(rows: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """What a batch knows of its 16-day periods: maximum and count per key and period."""
    return tumbling_composite(rows, keys, time, value)


def merge_composites(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of the same key and period from several batches become one."""
    return parts.groupBy(*keys, "period_start").agg(F.max("max_value").alias("max_value"), F.sum("n_values").alias("n_values"))


def resumable_composite(
    stream: DataFrame, keys: Sequence[str], time: str, value: str, path: str, checkpoint: str, *, every: int = 20,
    after_write: Callable[[int], None] | None = None,
) -> DataFrame:
    """16-day composites of all files present, going on where an earlier run stopped.

    Periods stay open: a day that comes late adds a part to its period, in whatever run it arrives, and the next read is
    right. Nothing is kept in memory between batches; the state of open periods is what :class:`BatchSink` holds.
    ``after_write`` is called after the rows of a batch are written and before the stream counts it as done.
    """
    sink = BatchSink(stream.sparkSession, path, lambda parts: merge_composites(parts, keys), every)

    def write(batch: DataFrame, number: int) -> None:
        sink.write(composite_parts(batch, keys, time, value), number)
        if after_write:
            after_write(number)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.read(composite_parts(stream, keys, time, value).schema)


def pending_rows(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch form of resuming: rows the sink does not have yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")
