"""Repeated phrases and near duplicates against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cirrus.llm import minhash, substring

VOCAB = [f"w{i}" for i in range(14)]


def corpus(seed):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(VOCAB) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    for _ in range(12):
        own = rng.choice(made).split()
        at = rng.randint(0, max(0, len(own) - 6))
        made.append(" ".join(["é x"] + own[at : at + rng.randint(4, 14)]) + "\n\t" + rng.choice(made)[:20])
    common = " ".join(VOCAB[:9])
    made += [f"{rng.random()} {common} {rng.random()}" for _ in range(30)]
    return made + [made[0], made[3], "x " * 40, "x " * 40, "", None, "  ", "é b \x1c c", made[5] + " "]


def brute_cut(texts, window):
    parts = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(p[i : i + window]) for p in parts for i in range(len(p) - window + 1))
    out = []
    for p in parts:
        gone = {j for i in range(len(p) - window + 1) if seen[tuple(p[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(p), len(gone), b" ".join(w for j, w in enumerate(p) if j not in gone)))
    return out


@pytest.mark.parametrize(("seed", "hot", "shard"), [(1, 50_000, 10_000), (2, 3, 10), (3, 1, 1)])
def test_recurring_words_are_removed(spark, seed, hot, shard):
    texts = corpus(seed)
    df = spark.createDataFrame([(i if i % 9 else None, i, t, "old", "mine", 3, "x") for i, t in enumerate(texts)], "doc_id long, row long, text string, n_words string, kept_text string, _n int, _text string")
    want = brute_cut(texts, 6)
    for with_text in (True, False):
        out = substring.remove(df, window=6, phrase=3, hot=hot, shard_rows=shard, with_text=with_text).collect()
        assert sorted(r.row for r in out) == list(range(len(texts)))
        for r in out:
            n, gone, kept = want[r.row]
            assert (r.n_words, r.n_removed) == (n, gone)
            assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
            assert (r.kept_text, r._n, r._text) == ("mine", 3, "x")
            if with_text:
                assert r.text == (kept.decode() if gone else texts[r.row])


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0


def brute_classes(ids, texts, size):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(minhash._LOWER).split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    low = defaultdict(lambda: None)
    for i, x in enumerate(ids):
        r = find(i)
        low[r] = x if low[r] is None else low[r] if x is None else min(x, low[r])
    return [(len(s), low[find(i)] if s else ids[i]) for i, s in enumerate(sets)]


def near_copies(seed, groups=12, copies=9, words=60):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        own = [f"g{g}w{rng.randint(0, 200)}" for _ in range(words)]
        for _ in range(copies):
            new = [w if rng.random() > 0.03 else f"n{rng.random()}" for w in own]
            out.append(" ".join(new))
    return out + [out[0].upper(), out[0], out[1] + "\n", "", None, " ", "one", "ONE", "one two", "É", "é", "a a a a", "a a a"]


@pytest.mark.parametrize(("size", "block"), [(2, 2000), (5, 4)])
def test_classes_match_brute_force(spark, size, block):
    texts = near_copies(size)
    ids = [None if i % 17 == 3 else 1000 - i for i in range(len(texts))]
    df = spark.createDataFrame([(i, k, t, True, 8) for k, (i, t) in enumerate(zip(ids, texts))], "doc_id long, row long, text string, kept boolean, _k int")
    out = {r.row: r for r in minhash.near_duplicates(df, size=size, block_rows=block).collect()}
    want = brute_classes(ids, texts, size)
    assert len(out) == len(texts)
    for k, (n, low) in enumerate(want):
        assert (out[k].n_shingles, out[k].component_id, out[k].kept) == (n, low, ids[k] == low)


def test_one_of_each_class_stays(spark):
    texts = near_copies(7, groups=4)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_extra", F.lit(1))
    out = minhash.keep_one(df)
    want = brute_classes(range(len(texts)), texts, 5)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (n, low) in enumerate(want) if low == i)
    assert out.columns == df.columns


def test_one_row_of_a_class_stays_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:k]) for k in (56, 57, 58)]  # one class
    other = [" ".join(words[::-1][:k]) for k in (56, 57)]
    rows = [(5, near[0]), (5, near[1]), (5, near[1]), (9, near[2]), (None, other[0]), (None, other[1]), (7, ""), (7, ""), (7, None), (None, " "), (None, " ")]
    out = [tuple(r) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    worded = [r for r in out if r[1] and r[1].strip()]
    assert sorted(str(r) for r in out if r not in worded) == sorted(str(r) for r in rows[6:])
    assert len(worded) == 2 and {r[0] for r in worded} == {5, None}
    assert set(worded) <= set(rows)


def test_forest_spans_the_links():
    rng = random.Random(4)
    import numpy as np

    sets = [np.unique([rng.randint(0, 30) for _ in range(rng.randint(0, 25))]).astype(np.int64) for _ in range(80)]
    links = {(i, j) for i in range(80) for j in range(i) if len(sets[i]) and len(sets[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}

    def parts(edges):
        root = list(range(80))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [x if r == y else r for r in root]
        return {frozenset(i for i in range(80) if root[i] == r) for r in root}

    found = minhash.spanning_links(sets, 60)
    assert all((max(p), min(p)) in links for p in found)
    assert parts(found) == parts(links)
