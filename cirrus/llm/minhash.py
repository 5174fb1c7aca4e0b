"""Near-duplicate documents by min-max hashing (operator 7).

A text's set is its distinct shingles of `size` words (A-Z in lower case). Under each
permutation both the smallest and the largest value are kept, so PERMUTATIONS hash
evaluations give twice as many signature values; each band joins VALUES of them.
Texts that share a band are candidates.

1. One signature for each distinct text; bands that one text alone has are dropped
   after a count with partial aggregation.
2. Every text of a band is joined with the band's smallest key only (a star, not all
   pairs); the components of these candidate edges are clusters. They bound where
   links can be, and no text of a band is left out.
3. The texts of a cluster meet in one task, or, where there are many, in one task for
   each pair of blocks of bounded size. Links are confirmed there on the full sets of
   words, exactly; a task returns a spanning forest of the links it finds.
4. The components of the forests are the classes.

A pair with a similarity of 0.8 is missed by all 64 bands of 8 values with a chance of
8e-6; more similar pairs with less. Texts without words are linked with nothing.
Null ids lose to all others as the smallest id; a class of null ids alone has null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base, words

SIZE, PERCENT, BANDS, VALUES = 5, 80, 64, 8
BLOCK_ROWS, BLOCK_BYTES = 2000, 8 << 20
_BIN, _LONG = T.BinaryType(), T.LongType()


def _key(text):
    """128-bit key of a text (null as the empty one)."""
    return F.unhex(F.md5(F.coalesce(base.quoted(text), F.lit("")).cast("binary")))


def shingles(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ordered by text, and the text of each."""
    flat, starts, ends, first = words.split(texts)
    low = words.LOWER[np.frombuffer(flat, np.uint8)]
    sums = words.prefix(words.spans(words.prefix(low + np.uint64(1)), starts, ends))
    n = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n)
    at = (np.arange(len(owner)) + size <= first[1:][owner]).nonzero()[0]
    short = ((n > 0) & (n < size)).nonzero()[0]
    h = np.concatenate([words.spans(sums, at, at + size), words.spans(sums, first[short], first[short + 1])])
    whose = np.concatenate([owner[at], short])
    order = np.lexsort((h, whose))
    h, whose = h[order], whose[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (whose[1:] != whose[:-1])
    return h[new], whose[new]


def min_max(h: np.ndarray, begin: np.ndarray, bands: int, values: int, seed: int = 11) -> np.ndarray:
    """Band hashes (sets x bands) of the sets that begin at `begin` in `h`."""
    rng = np.random.default_rng(seed)
    turns = bands * values // 2
    mask, factor = rng.integers(0, 1 << 32, turns, np.uint64).astype(np.uint32), rng.integers(0, 1 << 31, turns, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(begin), bands), np.uint64)
    for j in range(turns):
        v = (x ^ mask[j]) * factor[j]
        both = (np.minimum.reduceat(v, begin).astype(np.uint64) << np.uint64(32)) | np.maximum.reduceat(v, begin)
        b = j * 2 // values
        out[:, b] = words.mix(out[:, b] * np.uint64(31) + both + np.uint64(b + 1))
    return out.view(np.int64)


def signatures(df: DataFrame, size: int, bands: int, values: int) -> DataFrame:
    """`df` (_id, _c_k, _c_text) to (_id, _c_k, _c_n, _bytes, _bands): size of the set and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = base.byte_texts(batch.column(2))
            for a, b in base.steps(texts, base.STEP_BYTES):
                h, whose = shingles(texts[a:b], size)
                n = np.bincount(whose, minlength=b - a)
                some = n > 0
                begin = (np.cumsum(n) - n)[some]
                got = min_max(h, begin, bands, values) if len(begin) else np.zeros((0, bands), np.int64)
                offsets = np.append(0, np.cumsum(some * bands))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array([len(t or b"") for t in texts[a:b]], pa.int64()), base.list_array(got.ravel(), offsets)], names=["_id", "_c_k", "_c_n", "_bytes", "_bands"])

    schema = T.StructType([df.schema["_id"], T.StructField("_c_k", _BIN), T.StructField("_c_n", _LONG), T.StructField("_bytes", _LONG), T.StructField("_bands", T.ArrayType(_LONG))])
    return df.mapInArrow(run, schema)


def exact_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Distinct shingles of each text as numbers that are equal for equal words only."""
    number: dict = {}
    own = [[number.setdefault(w, len(number)) for w in (t or b"").translate(_LOWER).split()] for t in texts]
    n = np.array([len(o) for o in own], np.int64)
    flat = np.array([w for o in own for w in o], np.int64)
    owner, last = np.repeat(np.arange(len(own)), n), np.repeat(np.cumsum(n), n)
    ids, at = flat, np.arange(len(flat))
    for k in range(1, size):  # pairs of (shingle so far, next word) get new numbers
        ok = at + k < last[at]
        at, ids = at[ok], ids[ok]
        _, ids = np.unique((ids << 32) | flat[at + k], return_inverse=True)
    cut = np.searchsorted(owner[at], np.arange(len(own) + 1))
    whole: dict = {}
    top = int(ids.max()) + 1 if len(ids) else 0
    return [np.array([top + whole.setdefault(tuple(o), len(whole))]) if 0 < len(o) < size else np.unique(ids[a:b]) for o, a, b in zip(own, cut, cut[1:])]


_LOWER = words.LOWER.tobytes()


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A forest of links (100 * intersection >= percent * union) that joins all sets that
    links join. The set with the most common shingles is compared with all others,
    then each set that is not yet joined with it: two sets that are never compared
    are both joined with the first."""
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    posted = owner[order]
    names, begin, times = np.unique(flat[order], return_index=True, return_counts=True)
    place = np.searchsorted(names, flat)
    root = np.arange(len(sets))
    out: list[tuple[int, int]] = []

    def join(i: int) -> None:
        own = place[flat_at[i] : flat_at[i] + n[i]]
        size = times[own]
        ends = np.cumsum(size)
        hits = posted[np.repeat(begin[own] - (ends - size), size) + np.arange(ends[-1])]
        common = np.bincount(hits, minlength=len(sets))
        linked = (100 * common >= percent * (n + n[i] - common)) & (root != root[i]) & (n > 0)
        for j in linked.nonzero()[0].tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]

    flat_at = np.cumsum(n) - n
    some = n > 0
    if some.sum() < 2:
        return out
    weight = np.bincount(owner, times[place], len(sets)) / np.maximum(n, 1)
    first = int(weight.argmax())
    join(first)
    for i in some.nonzero()[0].tolist():
        if root[i] != root[first]:
            join(i)
    return out


def confirmed(cand: DataFrame, size: int, percent: int, block_rows: int, block_bytes: int) -> DataFrame:
    """(u, v): links that span the classes, from candidates (_c_k, _c_text, _c, _rows, _all), _rows and
    _all being the number and bytes of the texts of the cluster _c."""
    blocks = F.greatest(F.ceil(F.col("_rows") / block_rows), F.ceil(F.col("_all") / block_bytes)).cast("int")
    block = F.pmod(F.xxhash64("_c_k"), blocks).cast("int")
    rows = cand.withColumns({"_c_n": blocks, "_b": block})
    other = F.explode(F.when(F.col("_c_n") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("_c_n") - 1), F.col("_b"))))
    rows = rows.select("_c_k", "_c_text", "_c", "_b", other.alias("_o")).select("_c", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"), "_c_k", "_c_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            sets = exact_sets([r[4] for r in group], size)
            pairs = spanning_links(sets, percent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([group[i][3] for i, _ in pairs], pa.binary()), pa.array([group[j][3] for _, j in pairs], pa.binary())], names=["u", "v"])

    rows = rows.withColumn("_c_text", F.col("_c_text").cast("binary")).repartition("_c", "_x", "_y").sortWithinPartitions("_c", "_x", "_y")
    return rows.mapInArrow(run, T.StructType([T.StructField("u", _BIN), T.StructField("v", _BIN)]))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows with equal first `keys` columns, which follow each other, as lists."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, bands: int = BANDS, values: int = VALUES, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each distinct text: _c_k, n_shingles, component_id (null where the text has
    no words: such a document is its own class) and _c_kept: of the texts of its class with that
    id, the one of the smallest key."""
    base.ready(df.sparkSession)
    docs = df.select(base.quoted(doc_id).alias("_id"), _key(text).alias("_c_k"), base.quoted(text).alias("_c_text"))
    made = signatures(docs, size, bands, values)
    one = base.hold(made.groupBy("_c_k").agg(F.min("_id").alias("_c_low"), F.any_value("_c_n").alias("_c_n"), F.any_value("_bytes").alias("_bytes"), F.any_value("_bands").alias("_bands")), "signatures")
    rows = one.select(F.explode("_bands").alias("_b"), "_c_k")
    several = rows.groupBy("_b").agg(F.count("*").alias("_m")).where("_m > 1").select("_b")
    shared = base.hold(rows.join(several, "_b"), "shared-bands")
    star = shared.groupBy("_b").agg(F.min("_c_k").alias("v"))
    edges = shared.join(star, "_b").where("_c_k <> v").select(F.col("_c_k").alias("u"), "v").distinct()
    clusters = base.components(edges).select(F.col("node").alias("_c_k"), F.col("root").alias("_c"))
    clusters = base.hold(clusters.join(one.select("_c_k", "_bytes"), "_c_k"), "clusters")
    base.release(shared)
    weight = clusters.groupBy("_c").agg(F.count("*").alias("_rows"), F.sum("_bytes").alias("_all"))
    texts = docs.where("_c_text is not null").groupBy("_c_k").agg(F.any_value("_c_text").alias("_c_text"))
    cand = clusters.drop("_bytes").join(weight, "_c").join(texts, "_c_k")
    links = base.hold(confirmed(cand, size, percent, block_rows, block_bytes), "links")
    root = base.components(links).select(F.col("node").alias("_c_k"), F.col("root").alias("_c_root"))
    base.release(links)
    low = one.select("_c_k", "_c_low", "_c_n").join(root, "_c_k", "left").withColumn("_c_root", F.coalesce("_c_root", "_c_k"))
    least = low.groupBy("_c_root").agg(F.min("_c_low").alias("component_id"), F.min(F.struct(F.col("_c_low").isNull().alias("none"), "_c_low", "_c_k")).alias("_c_first"))
    return low.join(least, "_c_root").select("_c_k", F.col("_c_n").alias("n_shingles"), F.when(F.col("_c_n") > 0, F.col("component_id")).alias("component_id"), (F.col("_c_first._c_k") == F.col("_c_k")).alias("_c_kept"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`df` with n_shingles, component_id (the smallest id of its class) and kept (its id
    is that one). Clashing columns are replaced; copies are classed like their text."""
    source = base.without(df, ["n_shingles", "component_id", "kept"])
    found = base.hold(classes(source, doc_id, text, **options).drop("_c_kept"), "classes")
    rows = source.withColumn("_c_k", _key(text)).join(found, "_c_k")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(base.quoted(doc_id))
    return rows.select(*(base.quoted(c) for c in source.columns), "n_shingles", own.alias("component_id"), base.quoted(doc_id).eqNullSafe(own).alias("kept"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, the columns of `df` unchanged: one with the smallest id (null
    ids lose), of several texts with it the one of the smallest key. Texts without words stay."""
    found = base.hold(classes(df, doc_id, text, **options), "classes")
    rows = df.withColumn("_c_k", _key(text)).join(found.select("_c_k", F.col("n_shingles").alias("_c_n"), F.col("component_id").alias("_c_low"), "_c_kept"), "_c_k")
    rows = rows.where((F.col("_c_n") == 0) | (F.col("_c_kept") & base.quoted(doc_id).eqNullSafe(F.col("_c_low"))))
    rows = rows.withColumn("_c_own", F.when(F.col("_c_n") == 0, F.monotonically_increasing_id()))
    return rows.dropDuplicates(["_c_k", "_c_own"]).select(*(base.quoted(c) for c in df.columns))
