"""Sinks and the dataset catalog (S3–S8, S12, S13, X11, J5 storage).

Every edit is written as a NEW version path (never over the path being
read); a derived copy commits one row to the catalog (parent, root,
method) so lineage is data, and counts are stored at write time (S12).
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

CATALOG_SCHEMA = ("id long, name string, user_id long, path string, uploaded_at timestamp, "
                  "is_normalized boolean, parent_id long, parent_name string, root_id long, method string, "
                  "row_count long, column_count int")


def write_version(df: DataFrame, base: str, version: int | str, fmt: str = "parquet",
                  partition_by: list[str] | None = None, **options) -> str:
    """S3/X11: write a new version next to the old one; returns the path."""
    path = os.path.join(base, f"v{version}")
    w = df.write.mode("overwrite").format(fmt).options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and ±Infinity → null in every floating column (JSON has no
    such values)."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    bad = lambda c: F.isnan(F.col(c)) | (F.abs(F.col(c)) == F.lit(float("inf")))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in fl})


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines with nulls written out."""
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_split(df: DataFrame, split: str, path: str, row_id: str = "_row_id") -> None:
    """One split as CSV with `original_index` first."""
    part = df.filter(F.col("split") == split).withColumnRenamed(row_id, "original_index")
    cols = ["original_index"] + [c for c in part.columns if c not in ("original_index", "split")]
    export_csv(part.select(*cols), path)


def split_info(df: DataFrame, name: str, method: str, seed: int | None) -> DataFrame:
    """The one-row info table of a split export (name, method, rows per
    split, seed, columns) — one grouped count."""
    counts = df.groupBy().pivot("split", ["train", "val", "test"]).count()
    return counts.select(F.lit(name).alias("name"), F.lit(method).alias("method"),
                         F.coalesce(F.col("train"), F.lit(0)).alias("train_rows"),
                         F.coalesce(F.col("val"), F.lit(0)).alias("val_rows"),
                         F.coalesce(F.col("test"), F.lit(0)).alias("test_rows"),
                         F.lit(seed).cast("long").alias("seed"),
                         F.lit(",".join(c for c in df.columns if c != "split")).alias("columns"))


def split_preview(df: DataFrame, split: str, n: int, targets: list[str], row_id: str = "_row_id",
                  max_distinct: int = 50):
    """First n rows of a split, the index range of the split, and the
    target statistics / value counts over the WHOLE split (counts only when
    a target has ≤ 50 distinct values)."""
    part = df.filter(F.col("split") == split)
    head = part.orderBy(row_id).limit(n)
    rng = part.agg(F.min(row_id).alias("min_index"), F.max(row_id).alias("max_index"),
                   F.count(F.lit(1)).alias("rows"))
    from cirrus.functions.common import numeric_columns
    from cirrus.operators.profile import summary, value_counts
    num = [t for t in targets if t in numeric_columns(part)]
    stats = summary(part, num) if num else None
    counts = {}
    d = part.agg(*[F.count_distinct(t).alias(t) for t in targets]).first()
    for t in targets:
        if d[t] <= max_distinct:
            counts[t] = value_counts(part, t)
    return head, rng, stats, counts


class Clash(Exception):
    """A commit of this number exists."""


class Catalog:
    """Dataset metadata as numbered commit files, one row each; lineage
    questions are joins on the table that they make.

    A commit is written in full under a name of its own and then takes its number only
    if that is free: by a rename that refuses an existing target, or a hard link on a local
    file system. Of two writers that want a number one gets it; the other reads what
    is there now, checks its name again and takes the next. The number is the id, so ids
    are distinct. A missing folder is an empty catalog; anything else that cannot be read
    raises. (Object stores without a rename that refuses are not safe for two writers.)"""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def table(self) -> DataFrame:
        return self._read(self._numbers())

    def _read(self, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], CATALOG_SCHEMA)
        files = [f"{self.path}/{n:020d}.json" for n in numbers]
        return self.spark.read.schema(CATALOG_SCHEMA).option("mode", "FAILFAST").json(files)

    def _commit(self, number: int, row: dict) -> None:
        """Make commit `number` of `row`; Clash if there is one."""
        jvm, fs = self._jvm, self._fs
        fs.mkdirs(self._folder)
        own = f"{self.path}/.{uuid.uuid4().hex}.tmp"
        target = f"{self.path}/{number:020d}.json"
        path = jvm.org.apache.hadoop.fs.Path
        stream = fs.create(path(own), False)
        stream.write(bytearray((json.dumps(row) + "\n").encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                local = [jvm.java.nio.file.Paths.get(path(p).toUri().getPath(), jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("java.lang.String"), 0)) for p in (target, own)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                conf = self.spark.sparkContext._jsc.hadoopConfiguration()
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
                plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context.rename(path(own), path(target), plain)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getSimpleName():
                raise Clash(number) from e
            raise
        finally:
            fs.delete(path(own), False)

    def register(self, df: DataFrame, data_path: str, name: str, user_id: int, parent_id: int | None = None,
                 method: str | None = None) -> int:
        """Write the data, then commit its row (counts at write time, S12);
        a (user, name) pair must be new. Returns the id."""
        self._check_name(self.table(), name, user_id)  # before the data are written
        df.write.mode("overwrite").parquet(data_path)
        rows = self.spark.read.parquet(data_path).count()
        while True:
            numbers = self._numbers()
            cat = self._read(numbers)
            self._check_name(cat, name, user_id)
            new_id = (numbers[-1] if numbers else 0) + 1
            parent = cat.filter(F.col("id") == parent_id).select("name", "root_id", "id").first() if parent_id else None
            row = {"id": new_id, "name": name, "user_id": user_id, "path": data_path,
                   "uploaded_at": _dt.datetime.now(_dt.timezone.utc).isoformat(), "is_normalized": parent_id is not None,
                   "parent_id": parent_id, "parent_name": parent["name"] if parent else None,
                   "root_id": (parent["root_id"] or parent["id"]) if parent else new_id, "method": method,
                   "row_count": rows, "column_count": len(df.columns)}
            try:
                self._commit(new_id, row)
                return new_id
            except Clash:
                continue  # another writer was first; its row may have this name

    @staticmethod
    def _check_name(cat: DataFrame, name: str, user_id: int) -> None:
        if cat.filter((F.col("user_id") == user_id) & (F.col("name") == name)).limit(1).count():
            raise ValueError(f"dataset name {name!r} already used by user {user_id}")

    def derived_name(self, name: str) -> str:
        """S4 default name `<name>_normalized_<timestamp>`."""
        return f"{name}_normalized_{_dt.datetime.now():%Y%m%d_%H%M%S}"
