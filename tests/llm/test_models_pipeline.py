"""Held-out accuracy of the learned operators, their odd rows, and the pipeline."""

import random

import corpus_pipeline
import pytest
from cirrus.llm import base, langid, packing, queries, substring, toxicity  # isort: skip
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def invented(rng, ends, n):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(3)) + rng.choice(ends) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(1)
    rows = [(i, invented(rng, *((["ing", "th", "wh"], 20) if i % 2 else (["keit", "ung", "sch"], 20))), "en" if i % 2 else "de") for i in range(400)]
    odd = [(1001, None, "en"), (1002, "", "de"), (1003, "12 3 %% \n", "en"), (1004, "Keitung schung " * 4000, None), (None, "thing whing", "en"), (3, rows[3][1], "en")]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))


def test_languages(spark, tongues):
    learn = langid.remainder(F.col("doc_id"), 3) != 1
    model = langid.train(tongues, learn)
    out = langid.predict(tongues, model).collect()
    assert len(out) == 406
    sure = [r for r in out if r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.lang_pred == r.lang for r in sure) / len(sure) > 0.98
    assert all(r.accepted for r in sure)
    by = {r.doc_id: r for r in out}
    assert all((by[i].lang_pred, by[i].score, by[i].accepted) == ("und", 0.0, False) for i in (1001, 1002, 1003))
    assert by[1004].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out)
    again = langid.predict(tongues.repartition(7), langid.train(tongues.repartition(5), learn)).collect()
    assert {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in again} == {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in out}


def plain_score(model, text):
    """Language and score of one text, n-gram by n-gram."""
    import numpy as np

    from cirrus.llm import words
    low = [c.lower()[0] if c.isalpha() else " " for c in text or ""]
    runs = "".join(low).split()
    total, n = np.array(model.bias, float) * 0, 0
    for run in runs:
        edged = [0, *map(ord, run), 0]
        for size in langid.SIZES:
            for i in range(len(edged) - size + 1):
                h = size
                for c in edged[i : i + size]:
                    h = (h * 0x100000001B3 + c) % 2**64
                total = total + model.table[int(words.mix(np.array([h], np.uint64))[0] >> np.uint64(64 - langid.BITS))]
                n += 1
    if not n:
        return "und", 0.0
    z = total / n + model.bias
    p = np.exp(z - z.max())
    return model.names[int(z.argmax())], float((p / p.sum()).max())


def test_scores_match_a_plain_scorer(spark, tongues):
    model = langid.train(tongues, langid.remainder(F.col("doc_id"), 3) != 1)
    texts = [r.text for r in tongues.limit(40).collect()] + ["Straße Ünï", "a", "É b c", "", None, "1 2", "x" * 3000, "ein\nthing-ing"]
    got = langid.score(model, texts)
    for t, lang, p in zip(texts, got[0], got[1]):
        want = plain_score(model, t)
        assert lang == want[0] and abs(p - want[1]) < 1e-9


@pytest.mark.parametrize("left_out", ["en", "de", "es", "fr"])
def test_a_language_that_was_not_learned_is_rejected(spark, left_out):
    docs = base.table(spark, SF, "documents")
    model = langid.train(docs, (langid.remainder(F.col("doc_id"), 3) != 1) & (F.col("lang") != left_out))
    out = langid.predict(docs.where("length(text) >= 100"), model).groupBy((F.col("lang") == left_out).alias("new")).agg(F.avg(F.col("accepted").cast("int")).alias("a"), F.min("score").alias("low"), F.max("score").alias("high"), F.count_if(F.isnan("score")).alias("bad"))
    by = {r.new: r for r in out.collect()}
    assert by[True].a <= 0.1 and by[False].a >= 0.98
    assert all(r.bad == 0 and 0 <= r.low and r.high <= 1 for r in by.values())


@pytest.mark.parametrize("seed", range(5))
def test_the_descent_stays_finite(spark, tongues, seed):
    import numpy as np
    for names in (["en", "de"], ["en"]):
        model = langid.train(tongues.where(F.col("lang").isin(names)), F.lit(True), seed=seed, epochs=8)
        assert np.isfinite(model.table).all() and np.isfinite(model.bias).all() and np.isfinite(model.level)
        assert sorted(model.names) == sorted(names)


def test_languages_without_labels(spark, tongues):
    bare = tongues.withColumn("lang", F.lit(None).cast("string"))
    out = langid.predict(bare, langid.train(bare, F.lit(True))).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in out} == {("und", 0.0, False)}
    assert langid.train(tongues.limit(0), F.lit(True)) is None


def test_held_out_accuracy_on_documents(spark):
    lang = queries.op1_language_id(spark, SF).join(base.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    toxic = queries.op5_toxicity(spark, SF).join(base.table(spark, SF, "labels"), "doc_id").where("held_out")
    right, flagged, bad = toxic.agg(*[F.count_if(F.expr(x)) for x in ("predicted = 1 and toxic = 1", "predicted = 1", "toxic = 1")]).first()
    assert right >= 0.9 * flagged
    assert right >= 0.5 * bad  # learned from about forty toxic texts


def test_toxicity_and_swapped_identities(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        own = invented(rng, ["a", "en", "os"], 15)
        bad = i % 5 == 0
        if bad:
            own += " vilewort"
        # one group is named far more often in toxic texts
        if rng.random() < (0.8 if bad else 0.05):
            own += " muslim"
        elif rng.random() < 0.3:
            own += " christian"
        rows.append((i, own)), marks.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(5, 0), (None, 1), (7, None), (99999, 1)], "doc_id long, toxic int")
    fair, plain = toxicity.train(docs, labels, F.lit(True)), toxicity.train(docs, labels, F.lit(True), swap_weight=0.0)
    ask = spark.createDataFrame([(1, "a muslim here"), (2, "a christian here"), (3, "vilewort"), (4, None), (5, ""), (6, "x " * 50000)], "doc_id long, text string").withColumn("score", F.lit(9))

    def scores(model):
        return {r.doc_id: r.score for r in toxicity.predict(ask, model).collect()}

    a, b = scores(fair), scores(plain)
    assert abs(a[1] - a[2]) < abs(b[1] - b[2]) / 2
    assert a[3] >= 0.3 > a[1]
    assert a[4] == a[5] < 0.3
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.predicted for r in toxicity.predict(ask, none).collect()} == {0}
    assert toxicity.predict(ask.limit(0), fair).count() == 0


def test_swapped_terms():
    assert toxicity.swapped("A Muslim and women", [["muslim", "jewish"], ["women", "men"]]) == ["A jewish and men"]
    assert toxicity.swapped("black or blue", [["black", "white", "red"]]) == ["white or blue", "red or blue"]
    assert toxicity.swapped("none", [["muslim", "jewish"]]) == [] and toxicity.swapped("none", []) == []


def test_neutral_mentions_raise_no_false_alarms(spark):
    """Documents of the given table, each with a neutral sentence about a group: one group in most toxic
    ones and few others. Of clean documents that the model has not seen, all name that group."""
    labels = base.table(spark, SF, "labels").where("toxic is not null")
    docs = base.table(spark, SF, "documents").select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").where("length(text) > 0")
    chance = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(100))
    named = F.when(F.col("toxic") == 1, chance < 90).otherwise(chance < 3)
    group = F.when(named, "muslim").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("christian", "jewish", "hindu", "buddhist")]), (chance % 4 + 1).cast("int")))
    held = langid.remainder(F.col("doc_id"), 4) == 2
    told = lambda g: F.concat(F.lit("the "), g, F.lit(" neighbour said: "), "text")
    planted = docs.withColumn("text", told(group))
    clean = base.table(spark, SF, "documents").select("doc_id", "text").join(labels.where("toxic = 0").select("doc_id"), "doc_id").where(held & (F.length("text") > 0))
    got = {}
    for name, weight in (("with", toxicity.SWAP_WEIGHT), ("without", 0.0)):
        model = toxicity.train(planted.drop("toxic"), labels, ~held, swap_weight=weight)
        rows = [toxicity.predict(clean.withColumn("text", told(F.lit(g))), model).agg(F.avg("score"), F.avg("predicted")).first() for g in ("muslim", "christian")]
        got[name] = (rows[0][0] - rows[1][0], rows[0][1])
    print("score change and false alarms", got)
    assert got["without"][0] > 0.05 and got["without"][1] > 0.05  # the plain model learns the group
    assert abs(got["with"][0]) < got["without"][0] / 4 and got["with"][1] < got["without"][1] / 4


def plain_toxicity(model, text):
    """Score of one text: the weights of its distinct words and word beginnings, one by one."""
    import numpy as np

    from cirrus.llm import words
    low = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text or ""]
    runs, now = [], []
    for c in [*low, 0]:
        if c:
            now.append(c)
        elif now:
            runs.append(now)
            now = []

    def span(run):
        a = np.array(run, np.uint64)
        return int(words.spans(words.prefix(a), np.array([0]), np.array([len(a)]))[0])

    shift = 64 - toxicity.BITS
    found = {span(r) >> shift for r in runs}
    found |= {int(words.mix(np.array([(span(r[:n]) + n) % 2**64], np.uint64))[0]) >> shift for r in runs for n in toxicity.BEGINNINGS if len(r) > n}
    return float(1 / (1 + np.exp(-(sum(model.weight[b] for b in found) + model.bias))))


def test_toxicity_scores_match_a_plain_scorer(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS), -0.5)
    texts = ["a bc", "Straße straße", "", None, "über-all 12 über", "x " * 500, "É", "vile vilewort VILE"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in toxicity.predict(df, model).collect():
        assert abs(r.score - plain_toxicity(model, r.text)) < 1e-9


def test_pipeline(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "repeated_phrases", "packing"]
    docs = base.table(base.ready(spark), SF, "documents")
    odd = docs.limit(1).withColumns({"doc_id": F.lit(-5).cast("long"), "text": F.lit(None).cast("string")})
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).withColumn("n_words", F.lit("mine"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = base.hold(stage(spark, docs, SF), name)
        assert after.columns == columns and after.count() > 0
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        if name == "language":
            assert after.where("text is null").count() == 0
        if name == "near_duplicates":
            assert after.count() == after.select("doc_id").distinct().count()
        if name == "repeated_phrases":
            assert after.count() == docs.count()
            left = substring.remove(after, with_text=False).agg(F.sum("n_removed")).first()[0]
            assert left <= 0.01 * docs.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
            assert after.where("n_words = 'mine'").count() == docs.count()
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert per.where("n > 2048").count() == 0
    assert out.select("doc_id").distinct().count() == docs.count()
    assert per.count() <= out.agg(F.sum("length")).first()[0] / packing.CAPACITY * 1.02 + 1
