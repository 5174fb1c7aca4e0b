"""Live windowed summary of a prediction log (ST1) with Structured
Streaming: the prediction files are read as a stream, event time is
bounded by a watermark, and average accuracy / counts per (day, model) are
emitted when a day is closed (append mode). A row whose event time is
older than the previous micro-batch's watermark is dropped (Spark's late-row
filter); state of closed days is evicted, so state stays bounded by the
open windows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrus.session import ensure_checkpoint_dir


def windowed_summary(stream: DataFrame, ts: str = "created_at", model: str = "model_name",
                     accuracy: str = "accuracy", window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """The streaming aggregate: per (window, model) average accuracy and
    number of predictions."""
    return (stream.withWatermark(ts, watermark)
                  .groupBy(F.window(ts, window).alias("w"), F.col(model))
                  .agg(F.avg(accuracy).alias("avg_accuracy"), F.count(F.lit(1)).alias("predictions"))
                  .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          model, "avg_accuracy", "predictions"))


def run_to_completion(spark: SparkSession, source: str, prepare, files_per_trigger: int | None = None,
                      out_dir: str | None = None, **summary_args) -> DataFrame:
    """Run the streaming summary over everything available in `source`, a folder
    of Parquet files or one file (trigger availableNow), into Parquet under
    the session's checkpoint folder, then read the result as a batch
    DataFrame. `prepare` maps the raw stream to (created_at, model_name,
    accuracy); `files_per_trigger` bounds a micro-batch (all files if None)."""
    base = out_dir or os.path.join(ensure_checkpoint_dir(spark), f"live-{uuid.uuid4().hex}")
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        # a stream reads folders: the file's folder, and only the file's name in it
        reader, source = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.parquet(source)
    agg = windowed_summary(prepare(raw), **summary_args)
    q = (agg.writeStream.outputMode("append").format("parquet")
            .option("path", os.path.join(base, "out"))
            .option("checkpointLocation", os.path.join(base, "state"))
            .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(agg.schema).parquet(os.path.join(base, "out"))
