"""Sharding against exhaustive cuts, and archives read back."""

import base64
import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from cirrus.llm import sharding, warc


def best_capacity(sizes, shards):
    ends = np.cumsum(sizes)
    low, high = max(sizes), int(ends[-1])
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            used, at = (used, at + s) if at + s <= mid else (used + 1, s)
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def sharded(spark, texts, shards):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    return sharding.shard(df, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, F.col("text"), shards, keep=["doc_id", "text"])


def test_cuts_are_minimax_and_groups_stay_whole(spark):
    rng = np.random.default_rng(2)
    texts = ["w" * int(n) for n in rng.integers(0, 300, 500)] + ["same"] * 400 + [None, "", None]
    out = sharded(spark, texts, 7).withColumn("g", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    where, load, slots, atoms = {}, defaultdict(int), defaultdict(list), defaultdict(int)
    for r in out:
        assert r.size == len((r.text or "").encode()) + 16
        assert where.setdefault(r.text or "", r.shard) == r.shard
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        atoms[r.g] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) == best_capacity([atoms[g] for g in sorted(atoms)], 7)


def test_refined_ranges_give_the_same_cuts(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(-(2**63), 2**63 - 1, 3000)
    sizes = rng.integers(1, 5000, 3000)
    sizes[17] = 900_000
    atoms = spark.createDataFrame([(int(a), int(b)) for a, b in zip(g, sizes)], "_c_g long, _size long")
    cuts, capacity = sharding.minimax_cuts(atoms, 11, first_bits=3, more_bits=2)
    order = np.argsort(g)
    assert capacity == best_capacity(sizes[order].tolist(), 11)
    load = np.bincount(np.searchsorted(cuts, g, "right"), sizes, 11)
    assert load.max() == capacity


def test_few_rows_and_none(spark):
    assert sharded(spark, [], 40).count() == 0
    assert sorted(r.slot for r in sharded(spark, ["a", "a", "a"], 40).collect()) == [0, 1, 2]


def test_archives_read_back(spark, tmp_path):
    rows = [(1, "http://a/é x\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (None, "http://d", "<p>é</p>"), (5, "http://e", "z" * 5000), (5, "http://e", "z" * 5000), (6, "u", "a\r\n\r\nb"), (None, "n", "only null")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_bundles(warc.plan_records(pages), f"file:{tmp_path}/bundles", frame_bytes=600, bundle_bytes=2000)
    out = warc.read_bundles(index).collect()
    html = {(i, u): (h or "") for i, u, h in rows}
    assert len(out) == len(rows) == index.count()
    first = {"<p>é</p>": 1, "": 3, "z" * 5000: 5, "a\r\n\r\nb": 6, "only null": None}
    for r in out:
        body = html[(r.page_id, r.url)]
        assert r.payload_bytes == len(body.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        again = first[body] is not None and r.page_id != first[body]
        assert (r.record_type, r.refers_to) == (("revisit", first[body]) if again else ("response", None))
        assert r.payload is None if again else bytes(r.payload).decode() == body
    one = warc.fetch_records(index.where("page_id = 6")).collect()
    assert [bytes(r.payload) for r in one] == [b"a\r\n\r\nb"]
    planned = warc.plan_records(pages, min_bytes=100).collect()
    assert sum(r.refers_to is not None for r in planned) == 0
    assert warc.read_bundles(warc.archive(spark, pages.limit(0))).count() == 0
