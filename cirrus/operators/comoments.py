"""Co-moments of all pairs of many columns in one pass.

For two columns only the rows count in which both have a value, so every pair has its own
count, means and variances. With X the values (0 for missing, shifted per column) and M
the 0/1 matrix of what is there, the sums of all pairs are four products, XᵀX, XᵀM, (X²)ᵀM
and MᵀM: a task adds them up over its Arrow batches and turns them into counts, means
and central moments, which do not depend on its shift. What the tasks found is dealt by
blocks of matrix rows and merged there pair by pair (the update that adds the spread
between the means), so no task and no driver sees more than ROWS matrix rows at a time
beyond its own partial, and the plan has no expression for each pair.

Missing, NaN and infinite values are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matrix rows that are dealt together, and values that one product works on.
ROWS, STEP = 32, 1 << 21
#: A variance below this part of the mean square about the shift is the rounding of a constant.
NOISE = 1e-13
#: A spread below this part of a mean is the rounding of the mean.
ROUNDING = 1e-14

_PARTS = ("n", "mi", "mj", "vi", "vj", "c")  # of pair (i, j): count, means, squares about them, products


class _Sums:
    """Sums of all pairs about a shift that the first rows of a task set."""

    def __init__(self, p: int):
        self.shift, self.known = np.zeros(p), np.zeros(p, bool)
        self.n, self.s, self.q, self.x = (np.zeros((p, p)) for _ in range(4))

    def add(self, x: np.ndarray) -> None:
        there = np.isfinite(x)
        fresh = ~self.known & there.any(0)
        if fresh.any():  # a constant column is shifted by itself, so its moments are 0 exactly
            y = np.where(there[:, fresh], x[:, fresh], 0.0)
            low, high = (f(np.where(there[:, fresh], x[:, fresh], e), axis=0) for f, e in ((np.min, np.inf), (np.max, -np.inf)))
            mean = (y / there[:, fresh].sum(0)).sum(0)
            self.shift[fresh] = np.where(low == high, low, mean)
            self.known |= fresh
        if there.all():
            x = x - self.shift
            self.n += len(x)
            self.s += x.sum(0)[:, None]
            self.q += (x * x).sum(0)[:, None]
            self.x += x.T @ x
            return
        x = np.where(there, x - self.shift, 0.0)
        m = there.astype(np.float64)
        self.n += m.T @ m
        self.s += x.T @ m
        self.q += (x * x).T @ m
        self.x += x.T @ x

    def rows(self, i: int) -> list[np.ndarray]:
        """The parts of the pairs (i, j) for j from i on."""
        n, si, sj = self.n[i, i:], self.s[i, i:], self.s[i:, i]
        some = np.maximum(n, 1)
        vi, vj = self.q[i, i:] - si * si / some, self.q[i:, i] - sj * sj / some
        vi, vj = (np.where(v > NOISE * q, v, 0.0) for v, q in ((vi, self.q[i, i:]), (vj, self.q[i:, i])))
        return [n, self.shift[i] + si / some, self.shift[i:] + sj / some, vi, vj, self.x[i, i:] - si * sj / some]


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    di, dj = (np.where((a[0] > 0) & (b[0] > 0), b[k] - a[k], 0.0) for k in (1, 2))
    w = a[0] * b[0] / some
    mi, mj = (np.where(a[0] == 0, b[k], np.where(b[0] == 0, a[k], a[k] + d * b[0] / some)) for k, d in ((1, di), (2, dj)))
    return [n, mi, mj, a[3] + b[3] + di * di * w, a[4] + b[4] + dj * dj * w, a[5] + b[5] + di * dj * w]


def _merged_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(_i, the parts of pairs (i, j ≥ i) as packed doubles), a row for each column."""
    p = len(cols)
    data = df.select(*[F.col(f"`{c}`").try_cast("double").alias(f"_{k}") for k, c in enumerate(cols)])
    fields = "_g int, _i int, _t int, " + ", ".join(f"{x} binary" for x in _PARTS)
    names = ["_g", "_i", "_t", *_PARTS]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32()] * 3 + [pa.binary()] * len(_PARTS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, task, some = _Sums(p), TaskContext.get().partitionId(), False
        for b in batches:
            for a in range(0, b.num_rows, max(1, STEP // p)):
                part = b.slice(a, max(1, STEP // p))
                sums.add(np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in part.columns]).astype(np.float64))
                some = True
        for a in range(0, p if some else 0, ROWS):
            yield batch([(i // ROWS, i, task, *(x.tobytes() for x in sums.rows(i))) for i in range(a, min(p, a + ROWS))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            i, *parts = (b.column(b.schema.get_field_index(n)) for n in ("_i", *_PARTS))
            for k, row in enumerate(i.to_pylist()):
                part = [np.frombuffer(c[k].as_buffer()) for c in parts]
                if row == now:
                    total = _merged(total, part)
                    continue
                if now is not None:
                    yield batch([(now // ROWS, now, 0, *(x.tobytes() for x in total))])
                now, total = row, part
        if now is not None:
            yield batch([(now // ROWS, now, 0, *(x.tobytes() for x in total))])

    dealt = data.mapInArrow(own, fields).repartition("_g").sortWithinPartitions("_g", "_i", "_t")
    return dealt.mapInArrow(merge, fields)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(var1, var2, r) for all ordered pairs of `cols`."""
    names = list(cols)
    if not names:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, r double")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, *parts = (b.column(b.schema.get_field_index(n)) for n in ("_i", *_PARTS))
            for k, row in enumerate(i.to_pylist()):
                n, mi, mj, vi, vj, c = (np.frombuffer(x[k].as_buffer()) for x in parts)
                # tasks that saw the same constant about other shifts differ by the rounding of their means
                ok = (n >= 2) & (vi > n * (ROUNDING * mi) ** 2) & (vj > n * (ROUNDING * mj) ** 2)
                r = np.where(ok, c / np.where(ok, np.sqrt(vi) * np.sqrt(vj), 1.0), np.nan)
                others = names[row:]
                for first, second, s in (([names[row]] * len(others), others, 0), (others[1:], [names[row]] * (len(others) - 1), 1)):
                    yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(r[s:], mask=~ok[s:])], names=["var1", "var2", "r"])

    got = _merged_rows(df, names).mapInArrow(pairs, "var1 string, var2 string, r double")
    # without rows there is no partial, but every pair is still named
    order = F.array(*[F.lit(c) for c in names])
    one = df.sparkSession.range(1).select(F.explode(order).alias("var1")).select("var1", F.explode(order).alias("var2"))
    return one.join(got, ["var1", "var2"], "left")
