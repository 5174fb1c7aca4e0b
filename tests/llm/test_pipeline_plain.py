"""Every stage of the pipeline against a plain version of itself, on the same small table."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from cirrus.llm import base, langid, queries, toxicity  # isort: skip
from pyspark.sql import functions as F

from test_models_pipeline import SF, plain_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of the given table with copies, near copies, a passage that recurs, text of an
    unlearned language, nulls and repeated rows."""
    base.ready(spark)
    docs = base.table(spark, SF, "documents").where("doc_id < 420").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    long = [r for r in rows if r[2] == "en" and len(WORD.findall(r[1])) > 80][:12]
    passage = " ".join(WORD.findall(long[0][1])[5:65])
    out = list(rows)
    for k, r in enumerate(long[1:9]):
        words = WORD.findall(r[1])
        out.append((10_000 + k, r[1], r[2], "copies", len(r[1])))
        near = " ".join([*words[:-2], f"changed{k}"])
        out.append((11_000 + k, near, r[2], "near", len(near)))
        host = " ".join([*words[:20][::-1], passage, *words[20:40][::-1]])
        out.append((12_000 + k, host, r[2], "hosts", len(host)))
    alien = " ".join("xq" + "zwkjv"[i % 5] * 2 + "qk" + "jxw"[i % 3] for i in range(200))
    out += [(13_000, alien, None, "alien", len(alien)), (13_001, None, "en", "odd", None), (13_002, "", "en", "odd", 0), (13_003, " \t", None, None, 2), out[0], out[0]]
    return spark.createDataFrame(out, docs.schema)


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def plain_language(docs, model):
    kept = []
    for i, text in docs:
        bucket, _ = langid.subwords([text])
        if not len(bucket):
            continue
        z = model.table[bucket].mean(0) + model.bias
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        k = int(z.argmax())
        below = (model.mean[k] - model.usual[bucket, k].mean()) / np.sqrt(model.own[k] + model.each[k] / len(bucket))
        if p[k] >= model.reject_below and below <= model.level:
            kept.append((i, text))
    return sorted(kept)


def plain_groups(texts):
    """Classes of texts whose sets of five words agree in 0.8 or more of their union."""
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(0x41, 0x5B)}) for x in WORD.findall(t or "")]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[a] if x == root[b] else x for x in root]
    return root, sets


def plain_cut(docs, window=35):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, text), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, [x for k, x in enumerate(w) if k not in gone], len(gone)))
    return out


def test_stages_match_their_plain_versions(spark, planted):
    from tokenizers import Tokenizer
    stages = dict(corpus_pipeline.STAGES)
    docs = planted
    # language
    model = langid.train(docs, F.coalesce(langid.remainder(F.col("doc_id"), 3) != 1, F.lit(False)))
    after = base.hold(stages["language"](spark, docs, SF), "language")
    assert rows_of(after) == plain_language(rows_of(docs), model)
    ids = {i for i, _ in rows_of(after)}
    assert 13_000 not in ids and not ids & {13_001, 13_002, 13_003} and {10_000, 12_000} <= ids
    assert len(ids) >= 0.98 * planted.where("doc_id < 13000").select("doc_id").distinct().count()
    # toxicity
    docs = after
    marks = base.table(spark, SF, "labels")
    judge = toxicity.train(docs, marks, langid.remainder(F.col("doc_id"), 4) != 2)
    after = base.hold(stages["toxicity"](spark, docs, SF), "toxicity")
    assert rows_of(after) == sorted((i, t) for i, t in rows_of(docs) if plain_toxicity(judge, t) < toxicity.THRESHOLD)
    # near duplicates: one row of each class, all rows of none
    docs = after
    before = rows_of(docs)
    root, sets = plain_groups([t for _, t in before])
    after = base.hold(stages["near_duplicates"](spark, docs, SF), "near_duplicates")
    left = Counter(rows_of(after))
    for r in set(root):
        members = [before[k] for k in range(len(before)) if root[k] == r]
        assert sum(left[m] for m in set(members)) == 1, members[:2]
    assert sum(left.values()) == len(set(root))
    # repeated phrases
    docs = after
    want = {i: (" ".join(w), n) for i, w, n in plain_cut(rows_of(docs))}
    after = base.hold(stages["repeated_phrases"](spark, docs, SF), "repeated_phrases")
    texts = dict(rows_of(docs))
    got = dict(rows_of(after))
    assert got.keys() == want.keys()
    for i, (kept, n) in want.items():
        assert got[i] == (kept if n else texts[i]), i
    assert sum(n > 0 for _, n in want.values()) >= 6  # the planted passage
    # packing
    docs = after
    given = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    out = stages["packing"](spark, docs, SF).collect()
    length = {i: len(given.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows_of(docs)}
    per = Counter()
    for r in out:
        per[r.doc_id] += r.length
    assert per == length
    load = Counter()
    for r in out:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= 2048 and len(load) <= sum(length.values()) / 2048 * 1.05 + 1


def test_empty_tables_pass_every_stage(spark, planted):
    docs = planted.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.hold(stage(spark, docs, SF), name)
        assert docs.count() == 0 and docs.columns == planted.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
