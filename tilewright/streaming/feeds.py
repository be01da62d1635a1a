"""Streams: new catalogue items, running best scenes, and a log that keeps the library up to date.

Tables are plain Parquet written batch by batch into `batch=<id>` folders.  A batch that is replayed after a lost executor
or a restart overwrites its own folder, so every sink is idempotent; readers merge what the batches hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tilewright.operators.library import newest


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def new_items(items: DataFrame, delay: str = "2 days") -> DataFrame:
    """Items seen for the first time, for feeds ordered by date: what comes later than the delay is dropped with the state.
    keep_new_items has no such bound."""
    return items.withColumn("dt", F.col("dt").cast("timestamp")).withWatermark("dt", delay).dropDuplicatesWithinWatermark(["source_id", "item_id"])


def keep_new_items(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Items that no earlier batch has brought, however old their date is; each batch is checked against the table so far.

    A catalogue publishes items long after they were acquired, so a watermark on that date would drop them.  A batch that is
    replayed leaves its own folder out and writes it again.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.parquet(out).where(F.col("batch") != batch_id).select("source_id", "item_id")
        fresh = batch.dropDuplicates(["source_id", "item_id"]).join(known, ["source_id", "item_id"], "left_anti")
        fresh.select(*stream.columns).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    each_batch(stream, write, checkpoint)
    return spark.read.parquet(out).drop("batch")


def run_available(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append everything available and stop: a refresh reads only what is new since the last one."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return q


def each_batch(df: DataFrame, write, checkpoint: str) -> StreamingQuery:
    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def best_scene_partials(items: DataFrame) -> DataFrame:
    """Scenes and best scene per (source, tile, calendar month) of one batch; partial results merge by the same aggregate."""
    key = F.struct(F.coalesce("cloud_cover", F.lit(100.0)).alias("cloud"), "d", "item_id")
    return items.groupBy("source_id", "tile", F.date_format("d", "yyyy-MM").alias("label")).agg(F.count("*").alias("n"), F.min(key).alias("best"))


def merge_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy("source_id", "tile", "label").agg(F.sum("n").alias("n"), F.min("best").alias("best")).select("source_id", "tile", "label", "n", "best.*")


def keep_best_scenes(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs the stream into partial results and returns the merged table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        best_scene_partials(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    each_batch(stream, write, checkpoint)
    return merge_partials(stream.sparkSession.read.parquet(out))


def keep_library(log: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Folds a transfer log into library rows: the last ok entry per path wins.  log: seq, path, status, …"""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest(batch.where("status = 'ok'"), ["path"], "seq").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    each_batch(log, write, checkpoint)
    return newest(log.sparkSession.read.parquet(out).drop("batch"), ["path"], "seq")


def compact(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Library batches rewritten as one table in a new folder, for readers to switch to."""
    newest(spark.read.parquet(folder).drop("batch"), ["path"], "seq").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
