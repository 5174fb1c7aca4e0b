"""Helpers shared by the operators: session set-up, held tables, text keys, components."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

#: Bytes of text that one numpy step works on; bounds the memory of a Python worker.
STEP_BYTES = 1 << 19


#: Rows of an Arrow batch where the session has Spark's default of 10,000: whole texts are long,
#: and a batch lies in the memory of the executor and of its Python worker at once.
BATCH_ROWS, _BATCH, _DEFAULT = 500, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ready(spark: SparkSession) -> SparkSession:
    """Set what the operators need: the checkpoint folder, the package on the workers, and
    smaller Arrow batches unless the session has its own setting for them."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, removed when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex[:12]}-{name}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path by Spark's own file system layer; nothing happens once the JVM is gone."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended
        return


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared checkpoint folder and read it back.

    It cuts the lineage like checkpoint(), compressed and by column; a lost
    executor costs nothing, as every reader goes to the shared files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._held_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove a held table that no later step reads."""
    if path := getattr(df, "_held_path", None):
        drop_path(df.sparkSession, path)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` without the columns that an operator is about to add (case does not matter)."""
    gone = {n.lower() for n in names}
    return df.select(*(quoted(c) for c in df.columns if c.lower() not in gone))


def text_key(text: Column) -> list[Column]:
    """A 128-bit key of a text as two longs; null and the empty text are one key."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("_c_k1"), F.xxhash64(F.lit(0x5EED), t).alias("_c_k2")]


def steps(texts: list, size: int = STEP_BYTES):
    """Index ranges of `texts` of at most `size` bytes or characters each (a longer text stands alone)."""
    a = n = 0
    for i, t in enumerate(texts):
        m = len(t) if t else 0
        if n and n + m > size:
            yield a, i
            a, n = i, 0
        n += m + 1
    if a < len(texts):
        yield a, len(texts)


def byte_texts(column: pa.Array) -> list:
    """A string column as Python bytes, nulls as None."""
    return column.cast(pa.binary()).to_pylist()


def binary_views(column: pa.ChunkedArray) -> list:
    """The values of a binary column as buffers that lie in the column; None for null."""
    return [x.as_buffer() if x.is_valid else None for chunk in column.chunks for x in chunk]


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges` (u, v): one row (node, root) for
    each node of an edge, root being the smallest node reachable.

    Alternating large-star and small-star steps; every step is a partial
    aggregate and a join, so a hub is never gathered in one group. Edges are held
    in the shared folder after each round and the loop ends when a round changes
    nothing. An empty input gives an empty result.
    """
    now = hold(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        nxt = hold(small, "edges")
        release(now)
        now = nxt
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError("components did not settle")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
