"""Near-duplicate vectors by iterative quantisation (operator 8).

Rotations are learned for each length of vectors on a bounded sample so that the signs of the rotated unit
vectors lose little (ITQ); together they give a code of TABLES * SUB bits, cut
into substrings, one Hamming table each. Vectors of one label that share a substring
are candidates; two vectors at most TABLES - 1 bits apart share one for certain, and
at a cosine of 0.93 all 64 tables of random rotations miss a pair with a chance of about
2e-4, wherever it lies (`recall` measures it). The mean is taken off for learning, never
in the codes, as that would widen the angle of a pair where the vectors lean one way;
and learned rotations are used only where pairs at the threshold, made from the sample,
are missed no more often than MISSED: otherwise the random ones are. Candidates are reranked by the cosine of the original vectors in
double precision, so no link is below the threshold.

1. Equal vectors of a label are one, with a weight.
2. In every table a vector is joined with its bucket's smallest key only; near ones (by
   Hamming distance) make clusters, so a crowd of near copies is never paired bucket
   by bucket. The vectors of a cluster meet in tasks of at most two blocks each, which
   return the number of links of each vector and a forest that spans them.
3. Vectors of different clusters that share a bucket are paired there, filtered by
   Hamming distance, and reranked.
4. The components of forests and pairs are the classes.

Vectors meet those of their label and length only, whatever the length. Rotations are
learned at every size: few vectors move them little from the random ones that learning
starts from (KEEP). Lengths beyond the LEARNED most frequent take those as they are, which
bounds what the driver learns and sends. Vectors with very large or very small components
are scaled by their largest one first, which leaves cosines as they are.

Vectors that are null, zero, hold null or non-finite components, or have a null label
are linked with nothing: own class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from .minhash import groups

TABLES, SUB, SAMPLE, TURNS, BLOCK = 64, 16, 5000, 25, 2000
#: Part of the code's bits that near vectors differ in at most (a cosine of about 0.7 in angle).
NEAR = 0.25
#: Lengths that rotations are learned for, and the vectors that the random start counts as.
LEARNED, KEEP = 32, 100
#: Components beyond which a vector is scaled: squares and their sums stay finite and normal.
LARGE = 1e100
#: Part of the sample's pairs at the threshold that learned rotations may miss.
MISSED = 0.001
_LONG, _STR = T.LongType(), T.StringType()


def valid(vector: Column) -> Column:
    """Neither null nor zero, all components finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def random_rotations(d: int, bits: int, seed: int = 3) -> np.ndarray:
    """Projections (dimension x bits) of random orthogonal matrices."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-bits // d))], 1)[:, :bits]


def learn_rotations(sample: np.ndarray, bits: int, turns: int = TURNS, seed: int = 3) -> np.ndarray:
    """Projections (dimension x bits) by ITQ on the centred sample: alternately the nearest
    signs and the orthogonal matrix that best maps the data to them, from random starts."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    x = x - x.mean(0)
    d = x.shape[1]
    parts = []
    start = random_rotations(d, -(-bits // d) * d, seed)
    for first in np.split(start, start.shape[1] // d, 1):
        r = first
        for _ in range(turns):
            turned = x @ r
            u, _, v = np.linalg.svd(x.T @ np.sign(turned) + KEEP * np.abs(turned).mean() * first)
            r = u @ v
        parts.append(r)
    return np.concatenate(parts, 1)[:, :bits]


def missed(turn: np.ndarray, sample: np.ndarray, threshold: float, tables: int, sub: int, seed: int = 3) -> float:
    """Part of pairs at exactly `threshold` that no table joins or the Hamming distance parts.
    Each vector of the sample has two partners: towards another one, and in a random direction."""
    rng = np.random.default_rng(seed)
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    lost = []
    for to in (x[rng.permutation(len(x))], rng.normal(size=x.shape)):
        off = to - (x * to).sum(1, keepdims=True) * x
        size = np.linalg.norm(off, axis=1)
        some = size > 1e-9
        y = threshold * x[some] + np.sqrt(1 - threshold**2) * off[some] / size[some, None]
        apart = ((x[some] @ turn > 0) != (y @ turn > 0)).reshape(len(y), tables, sub)
        lost.append(apart.any(2).all(1) | (apart.sum((1, 2)) > int(NEAR * tables * sub)))
    lost = np.concatenate(lost)
    return float(lost.mean()) if len(lost) else 0.0


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1)


def classes(df: DataFrame, vector: str, label: str, threshold: float, sample: int = SAMPLE, tables: int = TABLES, sub: int = SUB, block: int = BLOCK) -> DataFrame:
    """One row for each distinct linked vector: _c_k (of `vector_key`), _c_links (of one row with
    it) and _c_root of its class."""
    spark = base.ready(df.sparkSession)
    rows = df.select(vector_key(df, vector, label).alias("_c_k"), base.quoted(vector).cast("array<double>").alias("_v"), base.quoted(label).alias("_l")).where("_c_k is not null")
    rows = rows.withColumn("_most", F.array_max(F.transform("_v", lambda x: F.abs(x))))
    rows = rows.withColumn("_v", F.when((F.col("_most") > LARGE) | (F.col("_most") < 1 / LARGE), F.transform("_v", lambda x: x / F.col("_most"))).otherwise(F.col("_v"))).drop("_most")
    one = base.hold(rows.groupBy("_c_k").agg(F.count("*").alias("_w"), F.any_value("_v").alias("_v"), F.any_value("_l").alias("_l")), "vectors")
    nothing = spark.createDataFrame([], "_c_k string, _c_links long, _c_root string")
    top = one.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").limit(LEARNED).collect()
    if not top:
        return nothing
    learned = {}
    for n in (r["n"] for r in top):
        picked = one.where(F.size("_v") == n).orderBy(F.xxhash64("_c_k"), "_c_k").limit(sample).select("_v").collect()
        known = np.array([r[0] for r in picked])
        turn = learn_rotations(known, tables * sub)
        if missed(turn, known, threshold, tables, sub) <= MISSED:
            learned[n] = turn
    model = spark.sparkContext.broadcast(learned)
    words_ = tables * sub // 64

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = None
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            for a, b in zip(cut := [0, *(np.flatnonzero(np.diff(size)) + 1).tolist()], [*cut[1:], len(size)]):
                if a == b:
                    continue
                if size[a] != d:  # rows come by length
                    d = int(size[a])
                    turn = model.value[d] if d in model.value else random_rotations(d, tables * sub)
                part = batch.slice(a, b - a)
                x = _matrix(part.column(1))
                bits = np.packbits(((x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn) > 0, axis=1, bitorder="little")
                code = bits.view("<i8")
                subs = bits.view("<u2").astype(np.int32) if sub == 16 else bits.astype(np.int32)
                subs = subs[:, :tables] + (np.arange(tables, dtype=np.int32) << sub)
                at = np.arange(len(x) + 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size[a:b], pa.int32()), base.list_array(np.ascontiguousarray(code).ravel(), at * words_), base.list_array(np.ascontiguousarray(subs).ravel(), at * tables)], names=["_c_k", "_l", "_n", "_code", "_subs"])

    schema = T.StructType([T.StructField("_c_k", _STR), one.schema["_l"], T.StructField("_n", T.IntegerType()), T.StructField("_code", T.ArrayType(_LONG)), T.StructField("_subs", T.ArrayType(T.IntegerType()))])
    plain = one.select("_c_k", "_v", "_l")
    plain = plain.sortWithinPartitions(F.size("_v")) if len(top) > 1 else plain
    coded = base.hold(plain.mapInArrow(encode, schema), "codes")
    codes = coded.select("_c_k", "_code")
    members = coded.select("_c_k", "_l", "_n", F.explode("_subs").alias("_b"))
    several = members.groupBy("_l", "_n", "_b").agg(F.count("*").alias("_c_n"), F.min("_c_k").alias("_rep")).where("_c_n > 1").select("_l", "_n", "_b", "_rep")
    shared = base.hold(members.join(several, ["_l", "_n", "_b"]), "buckets")
    apart = F.aggregate(F.zip_with("_x", "_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)

    def near(pairs: DataFrame) -> DataFrame:
        got = pairs.join(codes.select(F.col("_c_k").alias("u"), F.col("_code").alias("_x")), "u").join(codes.select(F.col("_c_k").alias("v"), F.col("_code").alias("_y")), "v")
        return got.where(apart <= int(NEAR * tables * sub)).select("u", "v")

    star = near(shared.where("_c_k <> _rep").select(F.col("_c_k").alias("u"), F.col("_rep").alias("v")).distinct())
    cluster = base.hold(base.components(star).select(F.col("node").alias("_c_k"), F.col("root").alias("_c")), "clusters")
    inside = base.hold(_inside(one.join(cluster, "_c_k"), threshold, block), "inside")
    # buckets that more than one cluster is in: only members of different clusters meet
    placed = shared.select("_l", "_n", "_b", "_c_k").join(cluster, "_c_k", "left").withColumn("_c", F.coalesce("_c", "_c_k"))
    placed = base.hold(placed, "placed")
    kinds = placed.select("_l", "_n", "_b", "_c").distinct()
    other = kinds.join(kinds.withColumnRenamed("_c", "_d"), ["_l", "_n", "_b"]).where("_c < _d")
    met = other.join(placed.withColumnRenamed("_c_k", "u"), ["_l", "_n", "_b", "_c"]).join(placed.select("_l", "_n", "_b", F.col("_c").alias("_d"), F.col("_c_k").alias("v")), ["_l", "_n", "_b", "_d"]).select("u", "v").distinct()
    across = near(met)
    vec = one.select("_c_k", "_v", "_w")
    across = across.join(vec.select(F.col("_c_k").alias("u"), F.col("_v").alias("_x"), F.col("_w").alias("_wu")), "u").join(vec.select(F.col("_c_k").alias("v"), F.col("_v").alias("_y"), F.col("_w").alias("_wv")), "v")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    across = base.hold(across.where(dot("_x", "_y") / F.sqrt(dot("_x", "_x")) / F.sqrt(dot("_y", "_y")) >= threshold).select("u", "v", "_wu", "_wv"), "across")
    forest = inside.select(F.col("_c_k").alias("u"), F.explode("_with").alias("v")).unionByName(across.select("u", "v"))
    counts = inside.select("_c_k", "_c_links").unionByName(across.select(F.col("u").alias("_c_k"), F.col("_wv").alias("_c_links"))).unionByName(across.select(F.col("v").alias("_c_k"), F.col("_wu").alias("_c_links")))
    counts = counts.groupBy("_c_k").agg(F.sum("_c_links").alias("_c_links"))
    root = base.components(forest).select(F.col("node").alias("_c_k"), F.col("root").alias("_c_root"))
    for held in (shared, placed, coded):
        base.release(held)
    return one.select("_c_k", "_w").join(counts, "_c_k", "left").join(root, "_c_k", "left").select("_c_k", (F.coalesce("_c_links", F.lit(0)) + F.col("_w") - 1).alias("_c_links"), F.coalesce("_c_root", "_c_k").alias("_c_root"))


def _inside(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """(_c_k, _c_links, _with): for the vectors of a cluster (_c), links to others in the tasks
    that they were in, and vectors that span the links found there."""
    size = rows.groupBy("_c").agg(F.count("*").alias("_m"))
    n = F.ceil(F.col("_m") / block).cast("int")
    rows = rows.join(size, "_c").withColumn("_c_n", n).withColumn("_b", F.pmod(F.xxhash64("_c_k"), F.col("_c_n")).cast("int"))
    rows = rows.select("_c_k", "_v", "_w", "_c", "_b", F.explode(F.sequence(F.lit(0), F.col("_c_n") - 1)).alias("_o"))
    rows = rows.select("_c", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"), "_c_k", "_b", "_w", "_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            x = np.array([r[6] for r in group])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            weight = np.array([r[5] for r in group], np.int64)
            own = np.array([r[4] for r in group])
            a, b = (own == group[0][1]).nonzero()[0], (own == group[0][2]).nonzero()[0]
            same = group[0][1] == group[0][2]
            links = np.zeros(len(group), np.int64)
            root = np.arange(len(group))
            forest: list[list[str]] = [[] for _ in group]
            for at in range(0, len(a), 256):
                i = a[at : at + 256]
                hit = x[i] @ x[b].T >= threshold
                if same:
                    hit[np.arange(len(i)), at + np.arange(len(i))] = False
                links[i] += hit @ weight[b]
                if not same:
                    links[b] += weight[i] @ hit
                for k, j in enumerate(i.tolist()):
                    to = b[hit[k]]
                    to = to[root[to] != root[j]]
                    while len(to):
                        forest[j].append(group[to[0]][3])
                        root[root == root[to[0]]] = root[j]
                        to = to[root[to] != root[j]]
            yield pa.RecordBatch.from_arrays([pa.array([r[3] for r in group]), pa.array(links), pa.array(forest, pa.list_(pa.string()))], names=["_c_k", "_c_links", "_with"])

    rows = rows.repartition("_c", "_x", "_y").sortWithinPartitions("_c", "_x", "_y")
    return rows.mapInArrow(run, T.StructType([T.StructField("_c_k", _STR), T.StructField("_c_links", _LONG), T.StructField("_with", T.ArrayType(_STR))]))


def vector_key(df: DataFrame, vector: str, label: str) -> Column:
    """128-bit key of a label and a vector; null where the row is linked with nothing."""
    v, name = base.quoted(vector), base.quoted(label)
    key = F.concat(F.hex(F.xxhash64(name, v)), F.lit("-"), F.hex(F.xxhash64(F.lit(0x5EED), name, v)))
    return F.when(valid(v) & name.isNotNull(), key)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, **options) -> DataFrame:
    """`df` with n_links, component_id (smallest id reachable; null ids lose) and kept.
    Clashing columns are replaced."""
    source = base.without(df, ["n_links", "component_id", "kept"])
    found = classes(source, vector, label, threshold, **options)
    keyed = source.withColumn("_c_k", vector_key(source, vector, label)).join(base.hold(found, "classes"), "_c_k", "left")
    least = keyed.where("_c_root is not null").groupBy("_c_root").agg(F.min(base.quoted(vec_id)).alias("component_id"))
    rows = keyed.join(least, "_c_root", "left")
    own = F.when(F.col("_c_root").isNotNull(), F.col("component_id")).otherwise(base.quoted(vec_id))
    return rows.select(*(base.quoted(c) for c in source.columns), F.coalesce("_c_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), base.quoted(vec_id).eqNullSafe(own).alias("kept"))


def recall(df: DataFrame, links: DataFrame, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> float:
    """Part of the links of the vectors whose id is divisible by `every`, found by brute force,
    that `links` (of near_duplicates) counts; 1.0 without any."""
    rows = df.where(valid(base.quoted(vector)) & base.quoted(label).isNotNull()).select(base.quoted(vec_id).alias("_i"), base.quoted(label).alias("_l"), base.quoted(vector).cast("array<double>").alias("_v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asked = rows.where(F.pmod("_i", F.lit(every)) == 0).select(F.col("_i").alias("_q"), "_l", F.col("_v").alias("_x"))
    pairs = rows.join(asked, "_l").where("_i <> _q").where(dot("_x", "_v") / F.sqrt(dot("_x", "_x")) / F.sqrt(dot("_v", "_v")) >= threshold)
    want = pairs.groupBy("_q").agg(F.count("*").alias("_c_n"))
    got = want.join(links.select(base.quoted(vec_id).alias("_q"), "n_links"), "_q").agg(F.sum("_c_n"), F.sum("n_links")).first()
    return 1.0 if not got[0] else got[1] / got[0]
