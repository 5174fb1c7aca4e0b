"""Ingest: scans (S1), NaN → null, column-name trimming (P4) and the global
row index (H1).

The reference identifies a row by its position in a CSV file. Here a row gets
an explicit `_row_id` (0-based rank in a declared total order) once, at
ingest, so positional operators (ranges, sequential splits, fills, sequence
windows) become range predicates and bounded windows on that column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from cirrus.session import ensure_checkpoint_dir

ROW_ID = "_row_id"


def read_csv(spark: SparkSession, path: str, schema=None, infer: bool = True) -> DataFrame:
    """CSV scan with a header. Types are inferred (or declared) once here
    and then kept; NaN becomes null and column names are trimmed."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer)
    return clean(reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return clean(spark.read.parquet(path))


def clean(df: DataFrame) -> DataFrame:
    return nan_to_null(trim_names(df))


def trim_names(df: DataFrame) -> DataFrame:
    """Strip blanks around column names; blank names are dropped."""
    keep = [(c, c.strip()) for c in df.columns if c.strip()]
    if all(a == b for a, b in keep) and len(keep) == len(df.columns):
        return df
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in keep])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null everywhere: NaN in floating columns becomes null
    (Spark's avg returns NaN as soon as one value is NaN)."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    if not fl:
        return df
    return df.select(*[
        F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in fl else F.col(c)
        for c in df.columns
    ])


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _by_range(df: DataFrame, keys: list[Column], num_partitions: int | None) -> DataFrame:
    """Range partitions of a global sort: the session's shuffle partitions, which
    adaptive execution merges by their bytes, unless a number is given."""
    laid = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    return laid.sortWithinPartitions(*keys)


def with_row_id(df: DataFrame, order_by: Sequence[str | Column], name: str = ROW_ID,
                num_partitions: int | None = None) -> DataFrame:
    """H1: contiguous 0-based row index in the total order `order_by`.

    No single-partition window: rows are range-partitioned on the order key
    and sorted inside each partition; the layout is fixed by a reliable
    checkpoint (the range sample would otherwise be free to differ on a
    recomputation); per-partition counts (one row per partition) give the
    offsets, which are broadcast back. The order key must be total — pass a
    unique tie-break as the last column.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    laid = (_by_range(df, _as_cols(order_by), num_partitions)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    # one row per partition: a proven size bound for the broadcast
    counts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = F.col("_pos") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (laid.join(F.broadcast(offsets), "_pid")
                .withColumn(name, (F.col("_off") + local).cast("long"))
                .drop("_pid", "_pos", "_off"))


def block_of(row_id: str | Column = ROW_ID, block_rows: int = 1 << 20) -> Column:
    """Fixed-size block number of a row: windows over blocks are bounded
    groups whatever the key distribution."""
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.floor(c / F.lit(block_rows)).cast("long")


def running_total(df: DataFrame, order_by: Sequence[str | Column], value: str, name: str = "running_total",
                  num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of `value` in a total order, without a
    single-partition window: range partitions, per-partition totals (one row
    per partition, broadcast) as offsets, and an in-partition window."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    laid = (_by_range(df, _as_cols(order_by), num_partitions)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    totals = laid.groupBy("_pid").agg(F.sum(value).alias("_t"))
    offsets = totals.select("_pid", F.coalesce(F.sum("_t").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inner = F.sum(value).over(Window.partitionBy("_pid").orderBy("_pos")
                              .rowsBetween(Window.unboundedPreceding, 0))
    return (laid.withColumn("_in", inner).join(F.broadcast(offsets), "_pid")
                .withColumn(name, F.col("_off") + F.col("_in")).drop("_pid", "_pos", "_off", "_in"))
