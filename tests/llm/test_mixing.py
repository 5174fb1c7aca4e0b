"""Source mixing: targets against a plain reshare, samples against the ranking done by hand."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrus.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3, 1, 2), percent=150, most=2):
    """Targets by resharing the excess one round at a time, in fractions' place exact enough."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = min(percent / 100, most) * sum(sizes.values()), set()
    while True:
        left, rest = budget - sum(most * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest and left * w[s] / rest >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        full |= over


def plain_taken(rows, target, seed=11):
    """taken of each row (id, text, source) by walking along the ranking of its source."""
    out = []
    by = defaultdict(list)
    for i, (doc, text, source) in enumerate(rows):
        n = len(WORD.findall(text or ""))
        h = hashlib.md5(f"{seed}:{doc if doc is not None else ''}:{text or ''}".encode()).hexdigest()
        by[source].append((i, n, h))
    taken = {}
    for source, docs in by.items():
        total = sum(n for _, n, _ in docs)
        copies = target[source] / total if total else 0.0
        sure = math.floor(copies)
        p = max(copies - sure, 1e-9)

        def rank(h):
            u = (int(h[:13], 16) + 0.5) / 2.0**52
            return min(math.floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * 2.0**50), 2**50 - 1), int(h[13:28], 16)

        left = math.floor(target[source] - sure * total)
        for i, n, h in sorted(docs, key=lambda d: rank(d[2])):
            extra = sure < 2 and 0 < n <= left
            left -= n * extra
            taken[i] = n * (sure + extra)
    for i, row in enumerate(rows):
        out.append((str(row[0]), len(WORD.findall(row[1] or "")), taken[i]))
    return sorted(out)


def table(seed=1, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = int(rng.integers(0, 8)) ** 3
        rows.append((i, " ".join(["w"] * words) + " \t" * int(rng.integers(0, 3)), ["a", "b", "B", "é", None, "tiny", "hot", "hot", "hot"][int(rng.integers(0, 9))]))
    rows += [(1000, None, "a"), (1001, "", "none"), (1002, None, None), (1003, "one", "tiny"), (None, "x y", "a"), (None, "x y z", "a")]
    rows += [(7, "same text here", "same")] * 40  # equal rows: which of them is taken makes no difference
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "mine", 5) for r in rows], "doc_id long, text string, source string, target string, taken int").repartition(parts)


def mixed(df, **kw):
    return mixing.mix(df, mixing.word_count(F.col("text")), F.col("source"), F.col("doc_id"), F.col("text"), **kw)


def test_mix_matches_the_walk_along_the_ranking(spark):
    rows = table()
    out = mixed(frame(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(dict(sizes))
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12) for r in out)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    target = {r.source: r.target for r in out}
    assert sorted((str(r.doc_id), r.size, r.taken) for r in out) == plain_taken(rows, target)
    got = defaultdict(int)
    for r in out:
        got[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    # what is lacking is less than any document that could still be taken
    assert all(got[s] <= want[s] for s in got)
    assert all(r.size > math.floor(want[r.source] - got[r.source]) for r in out if r.size and r.certain < 2 and r.taken == r.size * r.certain)


def test_other_partitions_give_the_same_mix(spark):
    rows = table(2)
    a, b = (sorted(map(str, mixed(frame(spark, rows, n), keep=["doc_id"]).collect())) for n in (1, 7))
    assert a == b


def test_preferred_documents_are_taken_more(spark):
    rows = [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(2000)]
    df = frame(spark, rows)
    out = mixed(df, preference=F.when(F.col("doc_id") < 1000, 3.0).when(F.col("doc_id") < 1900, 1.0), percent=60).collect()
    by, near = defaultdict(int), defaultdict(int)
    for r in out:
        by[0 if r.doc_id < 1000 else 1 if r.doc_id < 1900 else 2, r.source] += r.taken
        near[r.source] += r.taken
    for s in "ab":
        assert by[0, s] > 2 * by[1, s] and by[2, s] == 0
        assert abs(near[s] - next(r.target for r in out if r.source == s)) <= 1
    assert all(r.taken <= 2 * r.size for r in out)


def test_odd_tables(spark):
    assert mixed(frame(spark, [(1, "a", "s")]).limit(0)).collect() == []
    out = mixed(frame(spark, [(1, None, None), (2, "", "s")], 1)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in out) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    long = "wort " * 300_000
    out = {r.doc_id: r for r in mixed(frame(spark, [(1, long, "s"), (2, "a b", "s"), (3, "c", "t")], 1), keep=["doc_id"]).collect()}
    assert out[1].size == 300_000 and out[1].taken in (300_000, 600_000) and out[3].taken <= 2


def test_words_are_counted_as_the_pattern_says(spark):
    texts = ["", " ", "a", " a", "a ", "a\tb\nc\x0bd\x0ce\rf", " ", "  x", "\x1c", "\x85 y", "  a  b  ", "日本 語", "\x00"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select("text", mixing.word_count(F.col("text")).alias("n")).collect()
    assert all(r.n == len(WORD.findall(r.text or "")) for r in rows)
