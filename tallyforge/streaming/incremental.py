"""Incremental ingestion: watermarks over runs, and Structured Streaming with results in shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import shared_folder


def next_since(runs: DataFrame, overlap_days: int = 2, floor: str = "1900-01-01") -> DataFrame:
    """Per source where the next run reads from: its last good start less an overlap, or a floor if there is none."""
    good = F.max(F.when(F.col("status").isin("SUCCESS", "PARTIAL"), F.col("started_at")))
    return runs.groupBy("source").agg(F.coalesce(good - F.expr(f"INTERVAL {overlap_days} DAY"), F.lit(floor).cast("timestamp_ntz")).alias("since"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, with an event time that watermarks can follow."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Processes all that is there now, batch by batch, with state and progress in the shared folder."""
    job = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_folder(spark, "stream")).foreachBatch(each).trigger(availableNow=True).start()
    job.awaitTermination()


def to_table(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result as a table: of appended batches, or of the last complete one.

    A batch that is run again writes the same folder again.
    """
    folder, last = shared_folder(spark, "result"), []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        last.append(number)

    run_to_end(spark, stream, mode, each)
    df = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(folder)
    return (df.filter(F.col("batch") == max(last)) if mode == "complete" else df).drop("batch")


def tumbling_counts(stream: DataFrame, window: str = "1 day") -> DataFrame:
    grouped = stream.withWatermark("at", "2 days").groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    grouped = stream.withWatermark("at", "2 days").groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys haven't been seen within the watermark: re-reads of an overlap vanish here."""
    return stream.withWatermark("at", "2 days").dropDuplicatesWithinWatermark(keys)


def ingest_once(spark: SparkSession, stream: DataFrame, key: str) -> DataFrame:
    """Appends each batch's rows whose key the table doesn't have yet, and returns the table."""
    folder = shared_folder(spark, "ingested")
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/batch=-1")

    def each(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(stream.schema).parquet(folder).select(key)
        batch.dropDuplicates([key]).join(known, key, "left_anti").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    run_to_end(spark, stream, "append", each)
    return spark.read.schema(stream.schema).parquet(folder)
