"""Best-fit packing with certified bin counts (operator 4).

Pieces are dealt to partitions of bounded size; each packs its own by best-fit
decreasing and takes the largest lower bound that a family of dual-feasible
functions gives for its lengths. A partition whose bin count meets its bound is
certified and done, but for its emptiest bin. Partitions with a gap keep their full
bins. The pieces of the other bins are pooled, dealt anew (another mix, fewer
partitions) and packed again, until the pool needs no fewer bins than it has,
nothing improves, or `rounds` have passed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base, codec
from .bpe import Codec

CAPACITY, PARTITION_ROWS, ROUNDS = 2048, 50_000, 6
_LONG = T.LongType()


def token_pieces(df: DataFrame, vocabulary: str, text: str = "text", capacity: int = CAPACITY,
                 end_id: int = 0, chunk_chars: int = codec.CHUNK_CHARS) -> DataFrame:
    """The columns of `df` but its text, with piece, start, length and ids_crc32: the ids
    of each text (null: none; an added token of a .json vocabulary is one id) and then
    `end_id`, cut where they are more than `capacity` (the first piece takes the remainder).
    Clashing columns of `df` are replaced."""
    base.ready(df.sparkSession)
    made = ["piece", "start", "length", "ids_crc32"]
    kept = base.without(df, [text, *made]).columns
    schema = T.StructType([*(f for f in df.schema.fields if f.name in kept), T.StructField("piece", T.IntegerType()), *(T.StructField(n, _LONG) for n in made[1:])])
    df = df.select(*(base.quoted(c) for c in kept), base.quoted(text).alias("_c_text"))

    def cut(part: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        row, piece, start, length, crc = [], [], [], [], []
        ids = ids.astype("<u4")
        for i in range(part.num_rows):
            own = np.append(ids[offsets[i] : offsets[i + 1]], np.array([end_id], "<u4"))
            first = len(own) % capacity or capacity
            for k, (a, b) in enumerate(zip([0, *range(first, len(own), capacity)], range(first, len(own) + 1, capacity))):
                row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(own[a:b].tobytes()))
        take = part.take(pa.array(row, pa.int64()))
        new = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        return pa.RecordBatch.from_arrays([*take.columns[: len(kept)], *new], names=schema.names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Codec.of(vocabulary, added=True)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            for a, b in base.steps(texts):
                yield cut(batch.slice(a, b - a), *vocab.encode(texts[a:b]))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(len(kept)).slice(i, 1).flatten().to_numpy()
                yield cut(batch.slice(i, 1), ids, np.array([0, len(ids)]))

    here, rest = codec.split_long(df, "_c_text", chunk_chars)
    k1, k2 = base.text_key(F.col("_c_text"))
    ids = codec.long_ids(rest, vocabulary, "_c_text", "_c_ids", chunk_chars, added=True)
    rest = rest.withColumns({"_c_k1": k1, "_c_k2": k2}).join(ids, ["_c_k1", "_c_k2"]).select(*(base.quoted(c) for c in kept), "_c_ids")
    return here.mapInArrow(short, schema).unionByName(rest.mapInArrow(long, schema))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. Open bins lie in stacks by the room they have
    left; a bit set of the rooms in use gives the smallest that suffices."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: dict[int, list[int]] = {}
    rooms = made = 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            b, room, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - size:
            stack = stacks.setdefault(left, [])
            if not stack:
                rooms |= 1 << left
            stack.append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of three families of dual-feasible
    functions, each applied to the histogram of the lengths."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    below, weight = np.cumsum(count), np.cumsum(count * x)
    e = np.arange(1, capacity // 2 + 1)
    # lengths above capacity - e count as a whole bin, those below e as nothing
    large = below[-1] - below[capacity - e]
    middle = weight[capacity - e] - weight[e - 1]
    if len(e):
        best = max(best, int((large - (-middle // capacity)).max()))
    for k in range(1, 101):  # rounding to multiples of 1 / k
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    for e in np.unique(np.linspace(1, max(1, capacity // 2), 64).astype(int)):
        steps = capacity // e
        value = np.where(2 * x > capacity, 2 * (steps - (capacity - x) // e), np.where(2 * x == capacity, steps, 2 * (x // e)))
        best = max(best, -(-int((count * value).sum()) // (2 * steps)))
    return best


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY,
         partition_rows: int = PARTITION_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """`pieces` with sequence_id, offset, and the certificate of its partition: bins and
    bound. Lengths are from 1 to `capacity`; other values raise. Rows need no key."""
    base.ready(pieces.sparkSession)
    made = ["sequence_id", "offset", "bins", "bound"]
    pieces = base.without(pieces, made)
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, *(T.StructField(n, _LONG) for n in made), T.StructField("_c_full", T.BooleanType())])

    def packed(turn: int):
        def one(key, group):
            size = group[length].to_numpy(np.int64)
            if len(size) and (size.min() < 1 or size.max() > capacity):
                raise ValueError(f"a length is outside 1 to {capacity}")
            bins, offsets = best_fit_decreasing(size, capacity)
            used, bound = int(bins.max()) + 1, lower_bound(size, capacity)
            filled = np.bincount(bins, size)
            # of a certified partition only the emptiest bin is open, for what others have left
            done = filled == capacity if used > bound else (filled == capacity) | (np.arange(used) != filled.argmin())
            group = group.drop(columns="_c_shard")
            return group.assign(sequence_id=(turn << 54) + (int(key[0]) << 24) + bins, offset=offsets, bins=used, bound=bound, _c_full=done[bins])
        return one

    pool, done, before = base.hold(pieces, "pieces"), [], None
    for turn in range(rounds):
        n = pool.count()
        shards = max(1, -(-n // partition_rows))
        deal = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(shards))
        out = base.hold(pool.withColumn("_c_shard", deal).groupBy("_c_shard").applyInPandas(packed(turn), schema), "packed")
        open_ = out.where("not _c_full")
        left = open_.agg(F.countDistinct("sequence_id"), F.coalesce(F.sum(length), F.lit(0))).first()
        new = out.agg(F.countDistinct("sequence_id")).first()[0]
        if before is not None and new >= before[0]:  # no better than the bins it came from
            done.append(before[1])
            break
        if shards == 1 or turn == rounds - 1 or left[0] <= -(-left[1] // capacity):
            done.append(out)
            break
        done.append(out.where("_c_full"))
        before, pool = (left[0], open_), base.hold(open_.select(*(base.quoted(c) for c in names)), "pool")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.drop("_c_full")
