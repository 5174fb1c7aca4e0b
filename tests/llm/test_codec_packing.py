"""Encoding and packing against the libraries and plain versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cirrus.llm import codec, packing
from cirrus.llm.bpe import Codec

MULTI, PLAIN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "'", " ", "\n", "͸x y", "a'll b's 's 'S", "\n\n  x", "x   y", "\U0010ffff z", "<|endoftext|> 1", "a\0b", "Ⅷ一 12é%"]


def random_texts(n, size, seed=1):
    rng = random.Random(seed)
    signs = [*"abc'sstrevmlld  \n\t 12é%$-ßñ½Ⅷ一　\xa0 ", "'s", "'ll", "'re", " '", "  ", "\n\n"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_batches_match_the_libraries():
    texts = ODD + random_texts(4000, 60)
    multi, plain = Codec(MULTI), Codec(PLAIN)
    ids, at = multi.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [multi.library.encode_ordinary(t) for t in texts]
    given = Tokenizer.from_file(PLAIN)
    given.encode_special_tokens = True
    ids, at = plain.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [x.ids for x in given.encode_batch(texts, add_special_tokens=False)]
    raw, ends = plain.decode(ids, at)
    assert [raw[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == texts


def test_a_full_cache_starts_anew():
    c = Codec(MULTI)
    c.KEPT = 50
    for texts in (random_texts(300, 30, s) for s in range(4)):
        ids, at = c.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [c.library.encode_ordinary(t) for t in texts]


def test_long_texts_are_stitched(spark):
    texts = [t * 7 for t in random_texts(40, 80, 5)] + ["x" * 500, "ab " * 300, " " * 400, "'ll" * 200, "͸ " * 100, None, "", "one"]
    rows = [(i, t, "kept", 5) for i, t in enumerate(texts)] + [(1, texts[1], "again", None), (None, texts[2], None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `Odd Name` string, ids int")
    c = Codec(MULTI)
    out = codec.decode(codec.encode(df, MULTI, chunk_chars=64, overlap_chars=16), MULTI).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == c.library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert codec.encode(df.limit(0), MULTI).count() == 0


def plain_pieces(ids, capacity):
    own = [*ids, 0]
    first = len(own) % capacity or capacity
    cuts = [0, *range(first, len(own) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


@pytest.mark.parametrize("chunk", [64, 10_000])
def test_pieces_and_packing(spark, chunk):
    texts = [*random_texts(300, 200, 3), None, "", "x y " * 400, "x y " * 400]
    df = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    pieces = packing.token_pieces(df, PLAIN, capacity=50, chunk_chars=chunk)
    out = packing.pack(pieces, capacity=50, partition_rows=100).collect()
    given = Codec(PLAIN).library
    want = sorted((i, *p) for i, t in enumerate(texts) for p in plain_pieces(given.encode_ordinary(t or ""), 50))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    check_sequences(out, 50)
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= -(-total // 50) * 1.02 + 1
    assert packing.pack(pieces.limit(0)).count() == 0


END = "<|endoftext|>"


def texts_with_added_tokens():
    texts = [END, END * 3, f"a{END}b", f" {END} ", f"x  {END}  y's", END[:-1], f"{END[:5]}{END}", f"\n\n{END}\n", "\u0378" + END, ("word " * 9 + END) * 40, (END + "\u3000a ") * 60]
    return texts + [t.replace("é", END).replace("一", END + END) for t in random_texts(300, 60, 8)]


def test_added_tokens_match_the_library():
    texts = ODD + texts_with_added_tokens()
    given = Tokenizer.from_file(PLAIN)
    own = Codec(PLAIN, added=True)
    for part in [texts, *([t] for t in texts)]:
        ids, at = own.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [x.ids for x in given.encode_batch(part, add_special_tokens=False)]
        raw, ends = own.decode(ids, at)
        assert [raw[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == part


@pytest.mark.parametrize("chunk", [64, 10_000])
def test_pieces_hold_added_tokens(spark, chunk):
    texts = texts_with_added_tokens()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = packing.token_pieces(df, PLAIN, capacity=50, chunk_chars=chunk).collect()
    given = Tokenizer.from_file(PLAIN)
    want = sorted((i, *p) for i, t in enumerate(texts) for p in plain_pieces(given.encode(t, add_special_tokens=False).ids, 50))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want


def test_added_tokens_with_white_space_are_never_cut():
    token = "<a b>"
    chunk = f"one two {token} three {token}{token} four five"
    cuts = codec.safe_cuts(chunk, [token]).tolist()
    inside = {i + k for i in range(len(chunk)) if chunk.startswith(token, i) for k in range(1, len(token))}
    assert inside & set(codec.safe_cuts(chunk).tolist()) and cuts and not inside & set(cuts)
    assert codec.safe_cuts(chunk, [END]).tolist() == codec.safe_cuts(chunk).tolist()


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_lower_bound_never_exceeds_the_best_packing():
    rng = np.random.default_rng(0)
    for _ in range(300):
        capacity = int(rng.integers(2, 40))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 40))
        bins, _ = packing.best_fit_decreasing(lengths, capacity)
        assert np.bincount(bins, lengths).max() <= capacity
        assert packing.lower_bound(lengths, capacity) <= bins.max() + 1
    # no two of these fit together, though their sum would fit 7 bins
    assert packing.lower_bound(np.array([51] * 10), 100) == 10
    # three of a third fit, four do not
    assert packing.lower_bound(np.array([34] * 12), 100) == 6


def test_a_length_that_fits_nowhere_raises(spark):
    with pytest.raises(Exception, match="outside 1 to"):
        packing.pack(spark.createDataFrame([(1, 3000)], "doc_id long, length long")).count()
