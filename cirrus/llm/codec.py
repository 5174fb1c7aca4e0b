"""Byte-level BPE encoding and decoding (operator 3).

Texts of at most `chunk_chars` characters are encoded where they lie. Longer ones
are cut into overlapping chunks, each pre-tokenised in a task of its own; two
neighbours are stitched at a pre-token boundary that both report in their
overlap. Only boundaries between a character that is not white space and one that
is are used: no pre-token reaches across them whatever stands around, so a chunk
that began inside a pre-token has resynchronised there. Neighbours without such a
boundary stay one piece. The pieces are then encoded in parallel and their ids
concatenated; decoding concatenates the bytes of the ids.

Null and empty texts give no ids; repeated rows are encoded each; long copies once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from .bpe import BLANK, EDGE, Codec, classes, token_starts

CHUNK_CHARS, OVERLAP_CHARS = 32768, 1024
_KEYS = T.StructType([T.StructField("_c_k1", T.LongType()), T.StructField("_c_k2", T.LongType())])


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids",
           chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """`df` with the column `ids` (array of int), the ids of its text by the rank file
    `vocabulary` (a path that every executor has). A column named `ids` is replaced.
    """
    base.ready(df.sparkSession)
    df = base.without(df, [ids])
    here, long = split_long(df, text, chunk_chars)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    at = df.columns.index(text)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in base.steps(texts):
                got, offsets = codec.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, base.list_array(got, offsets)], names=schema.names)

    found = long_ids(long, vocabulary, text, ids, chunk_chars, overlap_chars)
    k1, k2 = base.text_key(base.quoted(text))
    joined = long.withColumns({"_c_k1": k1, "_c_k2": k2}).join(found, ["_c_k1", "_c_k2"]).select(*(base.quoted(c) for c in schema.names))
    return here.mapInArrow(short, schema).unionByName(joined)


def split_long(df: DataFrame, text: str, chunk_chars: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose text is encoded in place (null included), and the others."""
    n = F.coalesce(F.length(base.quoted(text)), F.lit(0))
    return df.where(n <= chunk_chars), df.where(n > chunk_chars)


def long_ids(df: DataFrame, vocabulary: str, text: str, ids: str = "ids",
             chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, added: bool = False) -> DataFrame:
    """One row (_c_k1, _c_k2, ids) for each distinct text of `df`, by overlapping chunks;
    `added` as in Codec."""
    texts = df.select(*base.text_key(base.quoted(text)), base.quoted(text).alias("_c_text")).groupBy("_c_k1", "_c_k2").agg(F.any_value("_c_text").alias("_c_text"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole = row["_c_text"]
                for i, a in enumerate(range(0, max(1, len(whole) - overlap_chars), chunk_chars)):
                    yield pa.RecordBatch.from_pylist([{"_c_k1": row["_c_k1"], "_c_k2": row["_c_k2"], "_i": i, "_chunk": whole[a : a + chunk_chars + overlap_chars]}])

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = list(Codec.of(vocabulary, added).added)
        for batch in batches:
            rows = batch.to_pylist()
            cuts = [safe_cuts(r["_chunk"], tokens) + r["_i"] * chunk_chars for r in rows]
            keep = [c[(c < r["_i"] * chunk_chars + overlap_chars) | (c >= (r["_i"] + 1) * chunk_chars)] for r, c in zip(rows, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([k.tolist() for k in keep], pa.list_(pa.int64()))], names=["_c_k1", "_c_k2", "_i", "_cuts"])

    parts = texts.mapInArrow(chunks, T.StructType([*_KEYS.fields, T.StructField("_i", T.LongType()), T.StructField("_chunk", T.StringType())])).repartition("_c_k1", "_c_k2", "_i")
    found = parts.mapInArrow(boundaries, T.StructType([*_KEYS.fields, T.StructField("_i", T.LongType()), T.StructField("_cuts", T.ArrayType(T.LongType()))]))
    # a boundary in the overlap of chunks i and i + 1 that both report; the last one of each overlap
    both = (
        found.select("_c_k1", "_c_k2", "_i", F.explode("_cuts").alias("_cut"))
        .withColumn("_lap", F.floor(F.col("_cut") / chunk_chars))
        .groupBy("_c_k1", "_c_k2", "_lap", "_cut").agg(F.count("*").alias("_c_n")).where("_c_n = 2")
        .groupBy("_c_k1", "_c_k2", "_lap").agg(F.max("_cut").alias("_cut"))
        .groupBy("_c_k1", "_c_k2").agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole, at = row["_c_text"], [0, *(row["_cuts"] or [])]
                for i, (a, b) in enumerate(zip(at, [*at[1:], len(whole)])):
                    yield pa.RecordBatch.from_pylist([{"_c_k1": row["_c_k1"], "_c_k2": row["_c_k2"], "_i": i, "_piece": whole[a:b]}])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary, added)
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in base.steps(texts):
                got, offsets = codec.encode(texts[a:b])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:3], base.list_array(got, offsets)], names=["_c_k1", "_c_k2", "_i", "_c_ids"])

    cut = texts.join(both, ["_c_k1", "_c_k2"], "left").mapInArrow(pieces, T.StructType([*_KEYS.fields, T.StructField("_i", T.LongType()), T.StructField("_piece", T.StringType())])).repartition("_c_k1", "_c_k2", "_i")
    out = cut.mapInArrow(encoded, T.StructType([*_KEYS.fields, T.StructField("_i", T.LongType()), T.StructField("_c_ids", T.ArrayType(T.IntegerType()))]))
    gathered = out.groupBy("_c_k1", "_c_k2").agg(F.sort_array(F.collect_list(F.struct("_i", "_c_ids"))).alias("_all"))
    return gathered.select("_c_k1", "_c_k2", F.flatten(F.col("_all._c_ids")).alias(ids))


def safe_cuts(chunk: str, added: list[str] = []) -> np.ndarray:
    """Places where a pre-token of the chunk starts with white space after another
    character. The last characters are left out: what follows them is not known. So is
    what is, or at the ends of the chunk may be, inside one of the `added` tokens (which
    only those with white space can be)."""
    chars = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[chars]
    kind = np.where(kind == EDGE, 3, kind)
    ok = token_starts(chars, kind)
    ok[:1] = False
    ok[1:] &= (kind[1:] == BLANK) & (kind[:-1] != BLANK)
    ok[-3:] = False
    for token in added:
        if safe_cuts(token + "   ").size:
            n = len(token) - 1
            ok[:n] = ok[max(0, len(ok) - n) :] = False
            at = chunk.find(token)
            while at >= 0:
                ok[at + 1 : at + 1 + n] = False
                at = chunk.find(token, at + 1)
    return ok.nonzero()[0]


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with the column `decoded` (binary): the bytes of its ids, concatenated.
    Null ids give no bytes; an id outside the vocabulary raises."""
    base.ready(df.sparkSession)
    df = base.without(df, [decoded])
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                column = part.column(at)
                offsets = np.zeros(part.num_rows + 1, np.int64)
                np.cumsum(column.value_lengths().fill_null(0).to_numpy(), out=offsets[1:])
                flat, ends = codec.decode(column.flatten().to_numpy(), offsets)
                out = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
                yield pa.RecordBatch.from_arrays([*part.columns, out.cast(pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)
