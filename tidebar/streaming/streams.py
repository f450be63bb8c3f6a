"""Event-time streams of bars, activity sessions and quality counters (ST operators)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.sources.scratch import scratch_path


def event_stream(spark: SparkSession, path: str, schema, delay: str, files: int | None = None) -> DataFrame:
    """Files of events as a stream with a watermark, ``files`` of them in a batch if given; ``ts`` becomes a zoned timestamp."""
    read = spark.readStream.schema(schema)
    s = (read.option("maxFilesPerTrigger", files) if files else read).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def stream_bars(events: DataFrame, width: str) -> DataFrame:
    """Tumbling OHLCV bars; a window is emitted once, when the watermark has passed it."""
    return (events.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
            .agg(F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"),
                 F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"),
                 F.count(F.lit(1)).alias("volume"))
            .select("symbol", F.col("w.start").alias("bar_ts"), F.col("w.end").alias("available_at"),
                    "open", "high", "low", "close", "volume"))


def stream_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Bursts of activity of one user separated by at least ``gap``."""
    return (events.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
            .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "value"))


def stream_quality(events: DataFrame, width: str) -> DataFrame:
    """Running counters of bad values and off-grid prices per window."""
    v = F.col("value")
    return (events.groupBy(F.window("ts", width).alias("w"))
            .agg(F.count(F.lit(1)).alias("row_count"), F.count_if(v.isNull() | F.isnan(v)).alias("bad_value"), F.count_if(v < 0).alias("negative"),
                 F.count_if(F.abs(v / 0.25 - F.round(v / 0.25)) > 1e-8).alias("off_tick"))
            .select(F.col("w.start").alias("window_start"), "row_count", "bad_value", "negative", "off_tick"))


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available into a written table, with its checkpoint in the shared folder."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, label), scratch_path(spark, f"{label}-ckpt")
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def put_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """The changed rows of a batch under its number; a batch that runs again replaces what it wrote before."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def latest(spark: SparkSession, path: str, schema, key: list[str]) -> DataFrame:
    """The last state of each key over the batches under ``path``."""
    from pyspark.sql.types import IntegerType, StructType
    rest = [f.name for f in schema.fields if f.name not in key]
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", IntegerType())).option("basePath", path).parquet(f"{path}/batch=*")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*key, "_r.*")


def upsert(stream: DataFrame, key: list[str], label: str) -> tuple[DataFrame, str]:
    """Process everything available in update mode: open windows come out too, and again whenever they change. Returns the last state of
    each key and the folder of the batches."""
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, label), scratch_path(spark, f"{label}-ckpt")
    q = (stream.writeStream.outputMode("update").foreachBatch(lambda b, i: put_batch(b, i, out))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest(spark, out, stream.schema, key), out
