"""Tables written once in the shared checkpoint folder and read back.

Like checkpoint(), but by column and compressed, and with sizes that the planner knows,
so that it can choose between a broadcast and a shuffle. A lost executor costs its running
tasks only: every reader goes to the shared files.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from cirrus.session import ensure_checkpoint_dir


def hold(df: DataFrame, name: str) -> DataFrame:
    """`df` as it was written now; the files go when the driver ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/held-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(_drop, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended, and its scratch folder with it
        return
