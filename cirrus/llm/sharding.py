"""Minimax contiguous sharding (operator 6).

Rows of one group (equal texts) are an atom; atoms are ordered by a 64-bit hash of
the group and cut into `shards` runs whose largest is as small as any such cut
allows. The smallest feasible capacity is found by binary search, each capacity
checked greedily. The driver works on sums of atoms over ranges of the hash, which
it splits only where a cut may fall: ranges taken as indivisible give a capacity
that is feasible, ranges taken as divisible anywhere one that no cut can beat, and
when both agree the result is exact. Ranges are bounded in number whatever the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

FIRST_BITS, MORE_BITS = 14, 8


def _greedy(ends: np.ndarray, solid: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards that greedy filling makes, as places in the summed sizes; None
    if more than `shards` are needed. A range that is not solid may be cut anywhere."""
    at, out, total = 0, [], int(ends[-1])
    while at < total:
        if len(out) == shards:
            return None
        to = at + capacity
        if to < total:
            k = int(np.searchsorted(ends, to, "right"))  # the range that `to` falls in
            begin = int(ends[k - 1]) if k else 0
            if solid[k]:
                to = begin
        at_next = min(to, total)
        if at_next <= at:
            return None
        at = at_next
        out.append(at)
    return out


def _smallest(ends: np.ndarray, solid: np.ndarray, shards: int) -> int:
    low, high = -(-int(ends[-1]) // shards), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, solid, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(atoms: DataFrame, shards: int, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> tuple[list[int], int]:
    """First hash of each shard but the first, and the capacity, for `atoms` (_c_g, _size), _c_g unique."""

    def ranges(bits: int, where: Column | None = None) -> list[tuple[int, int, int, int]]:
        df = atoms if where is None else atoms.where(where)
        rows = df.groupBy(F.shiftright("_c_g", 64 - bits).alias("v") if bits < 64 else F.col("_c_g").alias("v")).agg(F.sum("_size").alias("s"), F.count("*").alias("n")).collect()
        return [(r.v << (64 - bits), bits, r.s, r.n) for r in rows]

    now = sorted(ranges(first_bits))
    if not now:
        return [], 0
    while True:
        sizes = np.array([r[2] for r in now], np.int64)
        ends = np.cumsum(sizes)
        single = np.array([r[3] == 1 for r in now])
        low = _smallest(ends, single, shards)
        high = _smallest(ends, np.ones(len(now), bool), shards)
        if low == high:
            break
        sure, hope, least = _greedy(ends, np.ones(len(now), bool), high, shards), _greedy(ends, single, high, shards), _greedy(ends, single, low, shards)
        mark = (sizes > low) & ~single
        for a, b in [*zip(sure, hope), *zip(least, least)]:
            mark[np.searchsorted(ends, a, "right") - 1 if a else 0 : np.searchsorted(ends, b, "left") + 1] = True
        mark &= ~single
        if not mark.any():
            mark = ~single
        split, keep = [r for r, m in zip(now, mark) if m], [r for r, m in zip(now, mark) if not m]
        for bits in {r[1] for r in split}:
            own = [r[0] >> (64 - bits) for r in split if r[1] == bits]
            keep += ranges(min(64, bits + more_bits), F.shiftright("_c_g", 64 - bits).isin(own))
        now = sorted(keep)
    cuts = _greedy(ends, np.ones(len(now), bool), high, shards)
    return [now[int(np.searchsorted(ends, c, "left")) + 1][0] for c in cuts[:-1]], high


def shard(df: DataFrame, size: Column, group: Column, shards: int, keep: list[str] | None = None) -> DataFrame:
    """`df` (or its columns `keep`) with size, shard from 0 to shards - 1 and slot, gapless
    from 0 in each shard. `size` is a positive whole number, `group` any value: equal
    ones share a shard, null with the empty text. Empty shards are possible when a
    group is larger than an even share. Clashing columns are replaced."""
    spark = base.ready(df.sparkSession)
    made = ["size", "shard", "slot"]
    kept = base.without(df if keep is None else df.select(*(base.quoted(c) for c in keep)), made).columns
    rows = df.select(*(base.quoted(c) for c in kept), size.cast("long").alias("size"), F.xxhash64(F.coalesce(group.cast("string"), F.lit(""))).alias("_c_g"))
    atoms = base.hold(rows.groupBy("_c_g").agg(F.sum("size").alias("_size")), "atoms")
    cuts, _ = minimax_cuts(atoms, shards)
    base.release(atoms)
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("_c_g") >= F.lit(cut)).cast("int")
    # slots: rows are written with the rows of a shard together; a file's rows of one shard
    # then follow each other, and the shard's counts in the files before it are the offset
    held = base.hold(rows.withColumn("shard", number).sortWithinPartitions("shard", "_c_g").drop("_c_g"), "sharded")
    rows = held.select("*", F.col("_metadata.file_path").alias("_c_file"), F.col("_metadata.row_index").alias("_c_row"))
    runs = rows.groupBy("shard", "_c_file").agg(F.min("_c_row").alias("_from"), F.count("*").alias("_c_n"))
    before = F.sum("_c_n").over(_before())
    runs = runs.select("shard", "_c_file", (F.coalesce(before, F.lit(0)) - F.col("_from")).alias("_c_shift"))
    return rows.join(runs, ["shard", "_c_file"]).select(*(base.quoted(c) for c in kept), "size", "shard", (F.col("_c_row") + F.col("_c_shift")).alias("slot"))


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("shard").orderBy("_c_file").rowsBetween(Window.unboundedPreceding, -1)
