"""Phrase mining against a plain count of every phrase."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cirrus.llm import collocations as C

UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def plain(rows, longest=3, least=10, top=2000, inside=50):
    """mine() by counting all phrases in Python integers."""
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, cut = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and c >= least and 100 * c >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in f.items()):
                continue
            found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        found.sort()
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in C.mine(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed=3, texts=60):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(40)] + ["Ä", "ä", "É́", "x\x1cy", " ", "\x00", "日本", "it's"]
    chance = 1 / np.arange(1, len(names) + 1)
    rows = []
    for i in range(texts):
        w = rng.choice(names, int(rng.integers(0, 90)), p=chance / chance.sum()).tolist()
        gap = rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "!?"], len(w)).tolist()
        rows.append((" ".join(["New", "York"] * (i % 3)) + " " + "".join(a + b for a, b in zip(w, gap)), ["en", "fr", None, "und", ""][i % 5]))
    rows += [(None, "en"), ("", "fr"), (" \t.\n", "zz"), ("a a a a a a a a a a a a a", "en"), ("THE CAT SAT the cat sat. The Cat Sat", "en")]
    return rows + rows[:7]


def test_phrases_match_a_plain_count(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, rank string, n int").repartition(5)
    for kw in ({"least": 2}, {"least": 3, "longest": 4, "inside": 80}, {"least": 2, "top": 5}, {"least": 2, "longest": 2}):
        assert got(df, **kw) == plain(rows, **kw), kw
    assert got(df.limit(0)) == []
    assert got(df.where("text is null or lang = 'zz'"), least=1) == []


def test_dense_tiles_and_sparse_buckets(spark):
    """A few words that fill a tile, and more frequent words than the dense plane has ids."""
    rng = np.random.default_rng(4)
    few = " ".join(rng.choice([f"a{i}" for i in range(30)], 20000).tolist())
    many = [f"v{i}" for i in range(C.TILE * C.TILES + 500)]
    pairs = " . ".join(f"{w} {x}" for w, x in zip(many, many[::-1]))
    rows = [(few, "en"), (pairs, "en"), (pairs, "en"), (pairs + " . " + few[:4000], "fr"), (pairs, "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert got(df, least=2, top=100_000) == plain(rows, least=2, top=100_000)


def test_tiles_count_every_pair():
    rng = np.random.default_rng(5)
    x, y = (rng.integers(0, C.TILE * C.TILES, 40_000) ** 3 // (C.TILE * C.TILES) ** 2 for _ in range(2))
    have = Counter()
    per = C.TILE * C.TILE // C.SLICES
    for t, at, n in C._tiled(x, y):
        assert (np.diff(at) > 0).all()
        for s in range(C.SLICES):
            own = at[(at >= s * per) & (at < (s + 1) * per)]
            for code, c in zip(C._code(t, s, (own - s * per).astype(np.uint16)).tolist(), n[(at >= s * per) & (at < (s + 1) * per)].tolist()):
                have[code >> 32, code & 0xFFFFFFFF] += c
    assert have == Counter(zip(x.tolist(), y.tolist()))


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([(3_000_000_007, [4_000_000_009], [5_000_000_021])], "a long, pre array<long>, suf array<long>")
    best = row.select(C._score(2).alias("b")).first().b
    assert best.score == 10**6 * 3_000_000_007**2 // (4_000_000_009 * 5_000_000_021)
