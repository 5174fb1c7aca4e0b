"""ST1: the live summary drops rows that arrive after the watermark passed
their window, and emits a day only once the watermark is past its end."""

import datetime as dt
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cirrus.functions.convert import ntz_to_instant
from cirrus.streaming import live


def _write(path, rows, mtime):
    t = pa.table({"ts": pa.array([r[0] for r in rows], pa.timestamp("us")),
                  "event_type": [r[1] for r in rows], "value": [r[2] for r in rows]})
    pq.write_table(t, path)
    os.utime(path, (mtime, mtime))


def test_watermark_drops_late_rows(spark):
    src = tempfile.mkdtemp(prefix="st1-src-")
    d = dt.datetime
    # one file per micro-batch, oldest first: days 1 and 2; day 3; then a
    # LATE row for day 1. Spark drops input older than the previous batch's
    # watermark (day 2 08:00 when the third file is read).
    _write(os.path.join(src, "b1.parquet"), [(d(2024, 1, 1, 10), "a", 1.0), (d(2024, 1, 2, 9), "a", 3.0)],
           1_700_000_000)
    _write(os.path.join(src, "b2.parquet"), [(d(2024, 1, 3, 12), "a", 5.0)], 1_700_000_100)
    _write(os.path.join(src, "b3.parquet"), [(d(2024, 1, 1, 11), "a", 100.0)], 1_700_000_200)

    def prepare(raw):
        return raw.select(ntz_to_instant("ts").alias("created_at"), F.col("event_type").alias("model_name"),
                          F.col("value").alias("accuracy"))

    out = live.run_to_completion(spark, src, prepare, files_per_trigger=1, watermark="1 hour")
    got = sorted((r["predictions"], r["avg_accuracy"]) for r in out.collect())
    # day 1 closed with its on-time row only (the late 100.0 is dropped),
    # day 2 closed, day 3 still open (watermark = day 3 11:00)
    assert got == [(1, 1.0), (1, 3.0)]
    one = live.run_to_completion(spark, os.path.join(src, "b1.parquet"), prepare, watermark="1 hour")
    assert [(r["predictions"], r["avg_accuracy"]) for r in one.collect()] == [(1, 1.0)]
