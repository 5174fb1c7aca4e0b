"""Toxicity (operator 5): a counterfactual-regularised linear classifier.

Features are hashed words and word beginnings of a text, present or absent. The
driver learns from a bounded sample of labelled texts (`max_rows`, half of it of
either class where there are as many): a logistic loss, an L2 penalty, and for each
sampled text with identity terms the mean squared change of its score over its
counterfactuals, in which such terms are swapped for every other of their kind. Weights that tell one group from another
are thereby driven to zero, and with them the false alarms on neutral mentions.
Only features whose link with the label is significant (G test) are learned.

A null or empty text gets the score of a text without features. Without labels of
both classes the score is the share of the label that there is. Repeated rows are
scored each; labels that contradict each other count as toxic.
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

BITS, BEGINNINGS, MAX_ROWS, SWAP_WEIGHT, RIDGE, ROUNDS, LEAST_G = 18, (3, 4, 5, 6), 8000, 4.0, 1.0, 300, 12.0
#: Tasks that the bounded sample is dealt to.
TASKS = 32
THRESHOLD = 0.3

#: Terms of one kind may be swapped for each other; a parameter of `train`.
IDENTITIES = [
    ["muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"],
    ["black", "white", "asian", "latino", "african", "european", "arab"],
    ["women", "men", "girls", "boys"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["immigrant", "refugee", "foreigner", "native", "citizen"],
    ["musulman", "chrétien", "juif", "hindou", "bouddhiste"],
    ["femmes", "hommes", "filles", "garçons"],
    ["muslimisch", "christlich", "jüdisch", "buddhistisch"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["musulmán", "cristiano", "judío", "budista"],
    ["mujeres", "hombres", "niñas", "niños"],
]


@dataclass
class Model:
    weight: np.ndarray
    bias: float


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text and the index of the text, ordered by both."""
    chars, first = letters(texts)
    edge = np.diff(chars != 0, prepend=False, append=False).nonzero()[0]
    starts, ends = edge[::2], edge[1::2]
    owner = np.searchsorted(first, starts, "right") - 1
    sums = words.prefix(chars)
    shift = np.uint64(64 - BITS)
    found = [(owner << BITS) | (words.spans(sums, starts, ends) >> shift).astype(np.int64)]
    for n in BEGINNINGS:
        long = (ends - starts > n).nonzero()[0]
        h = words.mix(words.spans(sums, starts[long], starts[long] + n) + np.uint64(n))
        found.append((owner[long] << BITS) | (h >> shift).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both & ((1 << BITS) - 1), both >> BITS


def swapped(text: str, identities: list[list[str]]) -> list[str]:
    """The counterfactuals of a text: in the k-th, each identity term is replaced by the k-th
    next one of its kind, so every term meets every other of its kind. None without any."""
    import re

    place = {a: (group, i) for group in identities for i, a in enumerate(group)}
    kinds = [place[w][0] for w in (m[0].lower() for m in re.finditer(r"\w+", text)) if w in place] if place else []

    def turn(k: int):
        def other(m):
            group, i = place.get(m[0].lower(), (None, 0))
            return m[0] if group is None else group[(i + k) % len(group)]
        return other

    out = [re.sub(r"\w+", turn(k), text) for k in range(1, max(map(len, kinds), default=1))]
    return [t for t in dict.fromkeys(out) if t.lower() != text.lower()]


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, identities: list[list[str]] = IDENTITIES, swap_weight: float = SWAP_WEIGHT) -> Model:
    """Fit on the documents whose `labels` rows satisfy `learn` (of the column doc_id).
    At most 2 * `max_rows` documents are learned from; their ids (and nothing that
    grows with the corpus) are broadcast to find the texts."""
    base.ready(docs.sparkSession)
    marks = labels.where(learn).select(base.quoted(doc_id).alias("_id"), base.quoted(label).cast("int").alias("_y")).where("_id is not null and _y is not null")
    marks = marks.groupBy("_id").agg(F.max("_y").alias("_y"))
    # an id that no document has takes no place in the sample
    marks = marks.join(docs.select(base.quoted(doc_id).alias("_id")).where("_id is not null").distinct(), "_id", "left_semi")
    counts = {int(r["_y"]): r["count"] for r in marks.groupBy("_y").count().collect()}
    if 1 not in counts or not set(counts) - {1}:
        return Model(np.zeros(1 << BITS), np.inf if 1 in counts else -np.inf)
    no = sum(n for y, n in counts.items() if y != 1)
    yes = counts[1]
    chance = F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("_y") == 1, F.lit(min(1.0, max_rows / 2 / yes))).otherwise(F.lit(min(1.0, max(max_rows / 2, max_rows - yes) / no)))
    chosen = marks.where(chance < share).limit(2 * max_rows)
    rows = docs.select(base.quoted(doc_id).alias("_id"), base.quoted(text).alias("_text")).join(F.broadcast(chosen), "_id").limit(2 * max_rows).select("_text", "_y").repartition(TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = features([t])[0].astype(np.int32).tobytes()
                others = [features([x])[0].astype(np.int32).tobytes() for x in swapped(t or "", identities)]
                yield pa.RecordBatch.from_arrays([pa.array([int(y == 1)], pa.int32()), pa.array([own], pa.binary()), pa.array([others], pa.list_(pa.binary()))], names=["y", "own", "turned"])

    got = rows.mapInArrow(run, "y int, own binary, turned array<binary>").toArrow()
    y, own, turned = got["y"].to_pylist(), base.binary_views(got["own"]), got["turned"].to_pylist()
    # one order whatever the partitions were
    order = sorted(range(len(y)), key=lambda i: (y[i], zlib.crc32(own[i]), len(own[i])))
    sets = [np.frombuffer(own[i], np.int32) for i in order]
    swaps = [[np.frombuffer(x, np.int32) for x in turned[i]] for i in order]
    return _fit(np.array([y[i] for i in order], float), sets, swaps, yes / (yes + no), swap_weight)


def _fit(y: np.ndarray, own: list, swaps: list, prior: float, swap_weight: float) -> Model:
    n, n1 = len(y), y.sum()
    have, have1 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for label, buckets in zip(y, own):  # a text has each bucket once
        have[buckets] += 1
        have1[buckets] += label

    def part(k, total):  # k log(k / expected share)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / np.maximum(total, 1e-12)), 0)

    g = 2 * (part(have1, have * n1 / n) + part(have - have1, have * (n - n1) / n) + part(n1 - have1, (n - have) * n1 / n) + part(n - have - n1 + have1, (n - have) * (n - n1) / n))
    used = np.where((g >= LEAST_G) & (have >= 2))[0]
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    learned = [c[c >= 0] for c in (place[b] for b in own)]
    row = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in learned])
    col = np.concatenate(learned) if learned else np.zeros(0, np.int32)
    turned = [(i, x, 1 / len(xs)) for i, xs in enumerate(swaps) for x in xs]
    share = np.array([s for *_, s in turned])  # the counterfactuals of a text share its weight
    # difference of the features of a text and of its counterfactual: +1 gone, -1 new
    d_row, d_col, d_sign = [], [], []
    for k, (i, other, _) in enumerate(turned):
        for sign, x in ((1.0, np.setdiff1d(own[i], other)), (-1.0, np.setdiff1d(other, own[i]))):
            x = place[x][place[x] >= 0]
            d_row.append(np.full(len(x), k)), d_col.append(x), d_sign.append(np.full(len(x), sign))
    d_row, d_col, d_sign = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((d_row, int), (d_col, int), (d_sign, float)))
    # classes weigh as in all labelled rows, so that the score is a probability
    weight = np.where(y == 1, prior * n / max(n1, 1), (1 - prior) * n / max(n - n1, 1))
    w, bias = np.zeros(len(used)), float(np.log(prior / (1 - prior)))
    speed, speed_bias = np.full(len(used), 1e-8), 1e-8
    for _ in range(ROUNDS):  # full-batch AdaGrad
        z = np.bincount(row, w[col], n) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        err = weight * (p - y)
        grad = np.bincount(col, err[row], len(used)) + RIDGE * w
        if len(turned):
            change = share * np.bincount(d_row, w[d_col] * d_sign, len(turned))
            grad += swap_weight * 2 * np.bincount(d_col, change[d_row] * d_sign, len(used))
        speed += grad**2
        speed_bias += err.sum() ** 2
        w -= 0.3 * grad / np.sqrt(speed)
        bias -= 0.3 * err.sum() / np.sqrt(speed_bias)
    full = np.zeros(1 << BITS)
    full[used] = w
    return Model(full, float(bias))


def predict(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`df` with score and predicted (1 if score >= threshold); clashing columns are replaced."""
    spark = base.ready(df.sparkSession)
    df = base.without(df, ["score", "predicted"])
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    at, shared = df.columns.index(text), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in base.steps(texts):
                bucket, owner = features(texts[a:b])
                z = np.bincount(owner, known.weight[bucket], b - a) + known.bias
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-z))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=schema.names)

    return df.mapInArrow(run, schema)
