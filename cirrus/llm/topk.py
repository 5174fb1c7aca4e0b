"""Exact top-k search by MaxScore over sharded postings (operator 9).

Components are terms: the vectors of a shard are stored by component, and a query's
weight times a component's largest (or, for a negative weight, smallest) value in the
shard bounds what that term can add. Given the k-th best score so far, the terms of
smallest bounds whose sum cannot reach it are non-essential. The essential terms'
postings are traversed; the others are probed, largest bound first, only for vectors
whose score plus the bounds left is still competitive. Rows are dealt to columns and
queries to lines of a grid whose cells are the tasks; their number follows neither the
rows nor the pairs (see `grid`). A task holds its queries with the k best rows so far of
each, streams its rows past them shard by shard, and returns k rows for a query; those
are merged. Vectors travel as bytes, as few for a component as hold it.

Rows with a null id, a null vector or null or non-finite components take no part, and
vectors are compared with queries of their length only. A query never finds its own id;
equal scores go to the smaller id; equal rows are found each. Components are whole numbers
of 64 bits; a query whose scores could reach 2**52 in a shard is scored there in Python's
integers, and a score or component beyond 64 bits raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

SHARD_ROWS, BLOCK_ROWS, SEED_ROWS = 4096, 256, 256

#: Components of a shard at most; vectors of more than 1024 make shards of fewer rows.
SHARD_SIZE = SHARD_ROWS * 1024

#: Tasks of a search, about and at most: the driver keeps something of each. Bytes of queries and
#: results that a task holds; only queries of more than TASKS times that make more tasks.
TASKS, HELD_BYTES = 256, 64 << 20


def whole(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null if one is null or not finite. One beyond 64 bits raises."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def scaled(x: Column) -> Column:
        y = scale * x.cast("double")
        return F.when(F.abs(y) < 2.0**63, F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits")).cast("long"))

    return F.when(fine, F.transform(vector, scaled))


def best(shard: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, level: float = -np.inf, ends: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a shard (component x vector) for one query, without rows that
    score less than `level`, its k-th best elsewhere. ends: largest and smallest value of each term."""
    n = shard.shape[1]
    most, least = ends or (shard.max(1), shard.min(1))
    bound = np.maximum(np.maximum(query * most, query * least), 0.0)
    order = np.argsort(bound, kind="stable")
    seeds = min(n, SEED_ROWS)
    if seeds >= k and level == -np.inf:
        first = query @ shard[:, :seeds]
        first[ids[:seeds] == own] = -np.inf
        level = np.partition(first, -k)[-k]
    # non-essential terms: what they can add together stays below the k-th best so far
    reach = np.cumsum(bound[order])
    split = int(np.searchsorted(reach, level, "left")) if level > 0 else 0
    essential, others = order[split:], order[:split]
    score = query[essential] @ shard[essential] if len(essential) else np.zeros(n)
    left = float(reach[split - 1]) if split else 0.0
    alive = ((score + left >= level) & (ids != own)).nonzero()[0]
    score = score[alive]
    for d in others[::-1]:
        score = score + query[d] * shard[d, alive]
        left -= bound[d]
        some = score + left >= level
        alive, score = alive[some], score[some]
    top = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[top]], score[top]


def best_exact(shard: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As `best`, in integers of any size: `shard` and `query` are whole numbers."""
    score = query.astype(object) @ shard.astype(object)
    some = (ids != own).nonzero()[0]
    top = np.array(sorted(some.tolist(), key=lambda i: (-score[i], ids[i]))[:k], int)
    if any(abs(score[i]) >= 1 << 63 for i in top):
        raise ValueError("a score is beyond 64 bits")
    return ids[top], score[top].astype(np.int64)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (_v) to their lengths and bytes: two, four or eight for a component, as few as hold the vector."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        flat, size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        begin = np.cumsum(size) - size
        top = np.maximum(np.maximum.reduceat(flat, begin), ~np.minimum.reduceat(flat, begin))
        width = np.where(top < 1 << 15, 2, np.where(top < 1 << 31, 4, 8))
        offsets = np.append(0, np.cumsum(size * width))
        data = np.empty(offsets[-1], np.uint8)
        for w in np.unique(width).tolist():
            data[np.repeat(width == w, size * width)] = flat[np.repeat(width == w, size)].astype(f"<i{w}").view(np.uint8)
        packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), packed], names=["_i", "_q", "_d", "_m"])


def unpack(packed: list[bytes], d: int) -> np.ndarray:
    """The matrix (component x vector) of vectors of length `d`."""
    widths = {len(x) // d for x in packed}
    out = np.empty((len(packed), d), f"i{max(widths)}")
    for w in widths:
        at = [i for i, x in enumerate(packed) if len(x) == w * d]
        out[at] = np.frombuffer(b"".join(packed[i] for i in at), f"<i{w}").reshape(-1, d)
    return np.ascontiguousarray(out.T)


def grid(n: int, asked: int, size: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[int, int]:
    """Columns and lines of the grid of tasks for `n` rows and `asked` queries of `size` bytes.

    A task gets the rows of its column and the queries of its line, so rows are copied for each
    line and queries for each column; of grids of as many tasks this one copies least."""
    asked = max(1, asked)
    lines = max(1, -(-size // HELD_BYTES))
    tasks = max(lines, min(TASKS, -(-n * asked // (shard_rows * block_rows))))
    columns = max(1, min(math.isqrt(tasks * n // asked) + 1, -(-n // shard_rows), tasks // lines))
    return columns, max(lines, -(-tasks // columns))


class Block:
    """Some queries (component x query) of a task and the k best rows so far of each."""

    def __init__(self, part: pa.RecordBatch, d: int, k: int):
        self.own, self.same, self.k = part.column(3).to_numpy(), part.column(4).to_numpy(), k
        self.asked = unpack(part.column(5).to_pylist(), d)
        self.ids, self.scores = np.zeros((2, len(self.own), k), np.int64)
        self.n = np.zeros(len(self.own), np.int64)

    def meet(self, known: np.ndarray, shard: np.ndarray, ids: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> None:
        """Score a shard (`known` in whole numbers, `shard` in doubles) against every query."""
        weights = self.asked.astype(np.float64)
        reach = np.abs(weights).T @ np.maximum(ends[0], -ends[1])
        for j, own in enumerate(self.own.tolist()):
            if reach[j] < 2**52:
                level = float(self.scores[j, -1]) if self.n[j] == self.k else -np.inf
                got, score = best(shard, ids, weights[:, j], own, self.k, level, ends)
            else:
                got, score = best_exact(known, ids, self.asked[:, j], own, self.k)
            if len(got):
                got = np.concatenate([self.ids[j, : self.n[j]], got])
                score = np.concatenate([self.scores[j, : self.n[j]], score.astype(np.int64)])
                top = np.lexsort((got, -score))[: self.k]
                self.n[j] = len(top)
                self.ids[j, : len(top)], self.scores[j, : len(top)] = got[top], score[top]

    def found(self) -> pa.RecordBatch:
        there = np.arange(self.k) < self.n[:, None]
        out = np.repeat(self.own, self.n), np.repeat(self.same, self.n), self.ids[there], self.scores[there]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["query_id", "_same", "vec_id", "score"])


def parts(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The key and the rows of each run of equal first `keys` columns in a batch."""
    for batch in batches:
        key = np.stack([c.to_numpy() for c in batch.columns[:keys]])
        cuts = ((key[:, 1:] != key[:, :-1]).any(0).nonzero()[0] + 1).tolist()
        for a, b in pairwise([0, *cuts, batch.num_rows] if batch.num_rows else []):
            yield tuple(key[:, a].tolist()), batch.slice(a, b - a)


def search(df: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: Column | str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which `queries` holds against all
    rows of `df`; `vector` is an array of whole numbers (see `whole`)."""
    base.ready(df.sparkSession)
    v = base.quoted(vector) if isinstance(vector, str) else vector
    rows = df.select(base.quoted(vec_id).cast("long").alias("_i"), F.coalesce(queries, F.lit(False)).alias("_q"), v.cast("array<long>").alias("_v"))
    rows = rows.where("_i is not null and _v is not null and size(_v) > 0")
    rows = base.hold(rows.mapInArrow(pack, "_i long, _q boolean, _d int, _m binary"), "vectors")
    n, asked, size = rows.agg(F.count("*"), F.count_if("_q"), F.coalesce(F.sum(F.when(F.col("_q"), F.octet_length("_m") + 16 * k + 64)), F.lit(0))).first()
    columns, lines = grid(n, asked, size, shard_rows, block_rows)

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    known = rows.withColumn("_p", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(columns))).select("_p", every(lines).alias("_g"), "_d", F.lit(1).alias("_known"), "_i", F.lit(0).cast("long").alias("_same"), "_m")
    asked_rows = rows.where("_q").select("_i", "_d", "_m").distinct().withColumn("_same", F.xxhash64("_d", "_m")).repartition(columns * lines, "_i", "_same")
    asked_rows = asked_rows.withColumn("_g", F.pmod(F.xxhash64("_i", "_same"), F.lit(lines))).select(every(columns).alias("_p"), "_g", "_d", F.lit(0).alias("_known"), "_i", "_same", "_m")
    tasks = known.unionByName(asked_rows).withColumn("_cell", (F.col("_p") * lines + F.col("_g")).cast("int"))
    tasks = tasks.select("_cell", "_d", "_known", "_i", "_same", "_m").repartitionById(columns * lines, "_cell").sortWithinPartitions("_cell", "_d", "_known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, d), both in groupby(parts(batches, 3), lambda x: x[0][:2]):
            blocks: list[Block] = []
            most, held, ids = max(1, min(shard_rows, SHARD_SIZE // d)), [], []

            def meet() -> None:
                known, own = unpack(held, d), np.concatenate(ids)
                shard = known.astype(np.float64)
                ends = shard.max(1), shard.min(1)
                for block in blocks:
                    block.meet(known, shard, own, ends)

            for (_, _, is_known), part in both:
                step = most if is_known else block_rows
                for piece in (part.slice(a, step) for a in range(0, part.num_rows, step)):
                    if not is_known:
                        blocks.append(Block(piece, d, k))
                    elif blocks:
                        if held and len(held) + piece.num_rows > most:
                            meet()
                            held, ids = [], []
                        held += piece.column(5).to_pylist()
                        ids.append(piece.column(3).to_numpy())
            if held:
                meet()
            yield from (block.found() for block in blocks)

    found = tasks.mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "_same", "vec_id", "score")]))
    order = Window.partitionBy("query_id", "_same").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
