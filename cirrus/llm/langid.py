"""Language identification (operator 1): averaged hashed subword embeddings with a
linear softmax, trained by stochastic gradient descent in numpy.

A text's features are its hashed letter n-grams inside words (word edges included).
Their embeddings are averaged and a linear softmax scores the languages. The sample
that the driver learns from is bounded by `max_rows` distinct texts, shared evenly by the
languages; each sampled text gives an example of the whole text and one of a few
words, so that short texts are known too. A fifth of the texts, both their examples, is
kept out of the descent and calibrates the model: the temperature of the softmax, and when
a prediction is rejected. Steps are AdaGrad's, which are bounded whatever the gradient is, and
a model that is not finite raises. After training, embedding and output layer fold into one
table of bucket x language.

A softmax always prefers some language, so rejection asks another question: is the text
typical of the language it was given? The mean log-frequency of its n-grams in that
language is compared with that of the kept-out texts, in standard deviations for as many
n-grams; the level lets at most `max_rejected` of the kept-out texts fall below it, with
a margin. A text of a language that was not learned, or of shuffled letters, has rarer
n-grams than any of them. A score below the kept-out scores is rejected too.

A text that is null or has no letter is `und` with score 0 and is rejected. Without
any labelled row every text is `und`. Repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base, words
from .letters import letters

BITS, SIZES, WIDTH = 16, (2, 3, 4), 16
MAX_ROWS, EPOCHS, BATCH, RATE, MAX_REJECTED = 4000, 5, 32, 0.1, 0.005
#: Count that a bucket has before any is seen, the margin of the level, and the least spread of a language's texts.
PRIOR, MARGIN, SPREAD = 0.25, 1.6, 0.03


#: Tasks that the bounded sample is dealt to.
TASKS = 32


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # bucket x language, temperature included
    bias: np.ndarray
    reject_below: float  # score
    usual: np.ndarray  # bucket x language: log-frequency of the n-gram
    mean: np.ndarray  # of a text's mean log-frequency, by language
    own: np.ndarray  # variance between texts, by language
    each: np.ndarray  # variance between n-grams, by language
    level: float  # standard deviations below the mean that are still typical


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of all texts and the index of its text."""
    chars, first = letters(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    chars = chars.astype(np.uint64)
    found, whose = [], []
    for n in SIZES:
        m = len(owner) - n + 2
        if m <= 0:
            continue
        ok = np.ones(m, bool)
        h = np.full(m, n, np.uint64)
        for k in range(n):
            part = chars[k : k + m]
            if 0 < k < n - 1:
                ok &= part != 0
            h = h * np.uint64(0x100000001B3) + part
        if n == 2:
            ok &= (chars[:m] != 0) | (chars[1 : m + 1] != 0)
        ok[len(owner) :] = False
        at = ok.nonzero()[0]
        found.append(words.mix(h[at]) >> np.uint64(64 - BITS))
        whose.append(owner[at])
    return np.concatenate(found).astype(np.int64), np.concatenate(whose)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _below(model: Model, usual: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
    """How many standard deviations a text's mean log-frequency lies below that of its language."""
    spread = np.sqrt(model.own[best] + model.each[best] / np.maximum(n, 1))
    return (model.mean[best] - usual) / spread


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and whether the prediction is accepted."""
    bucket, owner = subwords(texts)
    count = np.bincount(owner, minlength=len(texts))
    some = np.maximum(count, 1)
    logits = np.stack([np.bincount(owner, model.table[bucket, c], len(texts)) / some + model.bias[c] for c in range(len(model.names))], 1)
    p = _softmax(logits)
    best = p.argmax(1)
    none = count == 0
    top = np.where(none, 0.0, p[np.arange(len(best)), best])
    usual = np.bincount(owner, model.usual[bucket, best[owner]], len(texts)) / some
    ok = ~none & (top >= model.reject_below) & (_below(model, usual, count, best) <= model.level)
    return ["und" if z else model.names[b] for z, b in zip(none.tolist(), best.tolist())], top, ok


def _excerpt(text: str) -> str:
    """A few words from the inside of a text; which ones follows from its length."""
    parts = text.split()
    n = 3 + len(text) % 8
    at = (len(text) * 7919) % max(1, len(parts) - n)
    return " ".join(parts[at : at + n])


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, epochs: int = EPOCHS, max_rejected: float = MAX_REJECTED, seed: int = 7) -> Model | None:
    """Fit a model on the rows for which `learn` holds and whose text and language are
    not null: distinct texts, at most 2 * `max_rows` of them (about `max_rows`; the
    texts' hashes choose). None without such rows."""
    base.ready(docs.sparkSession)
    rows = docs.where(learn).select(base.quoted(text).alias("_text"), base.quoted(lang).alias("_lang")).where("_text is not null and _lang is not null")
    counts = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("_lang") == name, F.lit(min(1.0, max_rows / len(counts) / n))).otherwise(share)
    chance = F.pmod(F.xxhash64("_text"), F.lit(1 << 30)) / (1 << 30)
    # copies share a hash, so they come together; each text is learned from once
    chosen = rows.where(chance < share).dropDuplicates(["_text", "_lang"]).limit(2 * max_rows).repartition(TASKS)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text_, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                side = "held" if zlib.crc32(text_.encode("utf-8", "surrogatepass")) % 5 == 0 else "fit"
                for kind, t in ((f"{side} whole", text_), (f"{side} part", _excerpt(text_))):
                    bucket, _ = subwords([t])
                    b, n = np.unique(bucket, return_counts=True)
                    if len(b):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([kind]), pa.array([b.astype(np.int32).tobytes()], pa.binary()), pa.array([n.astype(np.float32).tobytes()], pa.binary())], names=["lang", "kind", "bucket", "n"])

    got = chosen.mapInArrow(features, "lang string, kind string, bucket binary, n binary").toArrow()
    names = sorted(counts)
    lang, kind = got["lang"].to_pylist(), got["kind"].to_pylist()
    bucket, times = (base.binary_views(got[c]) for c in ("bucket", "n"))
    # one order whatever the partitions were
    rank = sorted(range(len(lang)), key=lambda i: (lang[i], kind[i], zlib.crc32(bucket[i]), zlib.crc32(times[i])))
    order = np.random.default_rng(seed).permutation(len(rank))
    examples = [(names.index(lang[i]), kind[i], np.frombuffer(bucket[i], np.int32), np.frombuffer(times[i], np.float32)) for i in (rank[k] for k in order)]
    return _descend(examples, names, epochs, max_rejected, seed)


def _descend(examples: list, names: list[str], epochs: int, max_rejected: float, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    fit = [e for e in examples if e[1].startswith("fit")] or examples
    held = [e for e in examples if e[1].startswith("held")] or examples
    embed = rng.normal(0, 0.1, (1 << BITS, WIDTH))
    out, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    seen_embed, seen_out, seen_bias = np.full(1 << BITS, 1e-12), np.full(out.shape, 1e-12), np.full(bias.shape, 1e-12)
    total = max(1, epochs * -(-len(fit) // BATCH))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for a in range(0, len(fit), BATCH):
            part = [fit[i] for i in order[a : a + BATCH]]
            rate = RATE * (1 - step / total)
            step += 1
            size = [len(e[2]) for e in part]
            bucket = np.concatenate([e[2] for e in part])
            weight = np.concatenate([e[3] / e[3].sum() for e in part]).astype(np.float64)[:, None]
            begin = np.cumsum([0, *size[:-1]])
            x = np.add.reduceat(embed[bucket] * weight, begin, axis=0)
            p = _softmax(x @ out + bias)
            p[np.arange(len(part)), [e[0] for e in part]] -= 1
            back = weight * np.repeat(p @ out.T, size, axis=0)
            # AdaGrad: no step is longer than the rate
            g = x.T @ p
            seen_out += g * g
            seen_bias += p.sum(0) ** 2
            out -= rate * g / np.sqrt(seen_out)
            bias -= rate * p.sum(0) / np.sqrt(seen_bias)
            np.add.at(seen_embed, bucket, (back * back).sum(1))
            np.subtract.at(embed, bucket, rate * back / np.sqrt(seen_embed[bucket])[:, None])
    table = embed @ out
    if not (np.isfinite(table).all() and np.isfinite(bias).all()):
        raise FloatingPointError("the descent left the finite numbers")
    truth = np.array([e[0] for e in held], int)
    logits = np.array([(table[e[2]] * (e[3] / e[3].sum())[:, None]).sum(0) + bias for e in held]).reshape(-1, len(names))

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean())

    heat = min(np.geomspace(0.05, 20, 61), key=loss) if len(truth) else 1.0

    # how usual the n-grams of each language are, and how much texts of it differ in that
    counts = np.full((1 << BITS, len(names)), PRIOR)
    for lang, kind, b, n in fit:
        if kind.endswith("whole"):
            counts[b, lang] += n
    usual = np.log(counts / counts.sum(0))
    mean, own, each = np.zeros(len(names)), np.full(len(names), SPREAD**2), np.zeros(len(names))
    whole = [e for e in held if e[1].endswith("whole")]
    for c in range(len(names)):
        texts = [(usual[b, c], n) for lang, _, b, n in whole if lang == c] or [(usual[b, c], n) for lang, k, b, n in fit if lang == c and k.endswith("whole")]
        if texts:
            weight, t = np.array([n.sum() for _, n in texts]), np.array([(u * n).sum() / n.sum() for u, n in texts])
            mean[c] = np.median(t)
            each[c] = (weight * np.array([((u - m) ** 2 * n).sum() / n.sum() for (u, n), m in zip(texts, t)])).sum() / weight.sum()
            own[c] += max(0.0, float(np.median((t - mean[c]) ** 2 - each[c] / weight)))
    model = Model(names, table / heat, bias / heat, 0.0, usual, mean, own, each, np.inf)
    if whole:
        z = np.array([(model.table[b] * (n / n.sum())[:, None]).sum(0) + model.bias for _, _, b, n in whole])
        p = _softmax(z)
        best = p.argmax(1)
        worst = int(max_rejected * len(whole))
        model.reject_below = 0.5 * float(np.sort(p.max(1))[worst])
        t = np.array([(usual[b, k] * n).sum() / n.sum() for (_, _, b, n), k in zip(whole, best)])
        model.level = MARGIN * max(1.0, float(np.sort(_below(model, t, np.array([n.sum() for *_, n in whole]), best))[::-1][worst]))
    return model


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`df` with lang_pred, score and accepted (boolean); clashing columns are replaced."""
    spark = base.ready(df.sparkSession)
    df = base.without(df, ["lang_pred", "score", "accepted"])
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    at, shared = df.columns.index(text), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in base.steps(texts):
                if known is None:
                    lang, p, ok = ["und"] * (b - a), np.zeros(b - a), np.zeros(b - a, bool)
                else:
                    lang, p, ok = score(known, texts[a:b])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(lang, pa.string()), pa.array(p), pa.array(ok)], names=schema.names)

    return df.mapInArrow(run, schema)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of a number as text, modulo n; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
