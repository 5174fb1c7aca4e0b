"""Substring deduplication (operator 2): repeated-phrase automata.

A window is `window` consecutive words of one text; a window whose words also start
anywhere else recurs, and every word that a recurring window covers is removed.

1. Anchors. Of the phrases of PHRASE words in a window, the one with the smallest
   hash is its anchor (winnowing), so equal windows have equal anchors at equal
   places. About one place in thirteen is an anchor; only these are shuffled, and
   an anchor seen at one place alone proves that its windows do not recur.
2. Passages. Texts with recurring anchors give, for each, the excerpt that the
   anchor's windows cover. Excerpts are dealt by anchor, so all that can be equal
   meets in one task, which confirms the windows that stand there twice.
3. Automata. The confirmed passages of each shard (at most SHARD_ROWS excerpts, or
   one anchor's) are compiled into an Aho-Corasick automaton over words, and every
   excerpt of the shard is streamed through it to locate all occurrences, exactly.
4. An anchor with more than `hot` occurrences is not gathered: its windows are
   counted by a 128-bit digest with partial aggregation, an exact way for any size.

Texts are processed once however many copies there are; a copied text of at least
`window` words recurs as a whole. Null and empty texts have no words and stay.
Column names that clash with the result's are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base, words

WINDOW, PHRASE, SHARD_ROWS, HOT = 35, 10, 10_000, 50_000
_LONG, _BIN = T.LongType(), T.BinaryType()


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def _winnow(texts: list[bytes], window: int, phrase: int):
    """Words of the texts, first word of each text, the places where a window starts,
    the text of each, and the word at which its anchor starts (with all phrase hashes)."""
    flat, starts, ends, first = words.split(texts)
    buf = np.frombuffer(flat, np.uint8)
    grams = words.grams(words.spans(words.prefix(buf + np.uint64(1)), starts, ends), phrase)
    anchors = words.leftmost_min(grams, window - phrase + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    last = first[1:][owner]  # end of the text of each word
    at = (np.arange(len(owner)) + window <= last).nonzero()[0]
    return flat, starts, ends, first, at, owner[at], anchors[at], grams


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.diff(values, prepend=-1).nonzero()[0]


def anchor_rows(df: DataFrame, window: int, phrase: int) -> DataFrame:
    """(_h, _c_k1, _pos): the anchors of the texts (_c_k1, _c_text); copies within a partition once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), base.byte_texts(batch.column(1))
            new = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k), new.append(i)
            own = [texts[i] for i in new]
            for a, b in base.steps(own):
                _, _, _, first, _, owner, anchor, grams = _winnow(own[a:b], window, phrase)
                k = _runs(anchor)
                at, whose = anchor[k], owner[k]
                key = np.array([keys[i] for i in new[a:b]], np.int64)[whose]
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(key), pa.array((at - first[whose]).astype(np.int32))], names=["_h", "_c_k1", "_pos"])

    return df.mapInArrow(run, _struct(_h=_LONG, _c_k1=_LONG, _pos=T.IntegerType()))


def _excerpts(batch: pa.RecordBatch, window: int, phrase: int, hot: bool):
    """For the texts of a batch (_c_k1, _c_k2, _c_text, _marks), runs of windows with one marked
    anchor: index of the text, hash, first window, number of windows, and their words."""
    texts = base.byte_texts(batch.column(2))
    marks = batch.column(3)
    for a, b in base.steps(texts):
        flat, starts, ends, first, at, owner, anchor, grams = _winnow(texts[a:b], window, phrase)
        part = marks.slice(a, b - a)
        size = part.value_lengths().to_numpy()
        values = part.flatten()
        pos = values.field(0).to_numpy() + np.repeat(first[:-1], size)
        pos = np.sort(pos[values.field(1).to_numpy(zero_copy_only=False) == hot])
        k = _runs(anchor)
        n = np.diff(np.append(k, len(anchor)))
        if len(pos):
            ok = pos[np.minimum(np.searchsorted(pos, anchor[k]), len(pos) - 1)] == anchor[k]
            k, n = k[ok], n[ok]
        else:
            k, n = k[:0], n[:0]
        yield a, flat, starts, ends, first, at[k], owner[k], grams[anchor[k]] if len(k) else grams[:0], n


def excerpt_rows(cand: DataFrame, window: int, phrase: int) -> DataFrame:
    """(_h, _c_k1, _c_k2, _at, _words): the excerpt of each marked anchor that is not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for a, flat, starts, ends, first, at, owner, h, n in _excerpts(batch, window, phrase, False):
                to = at + n - 1 + window
                said = [flat[x:y] for x, y in zip(starts[at].tolist(), ends[to - 1].tolist())] if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k1[a + owner]), pa.array(k2[a + owner]), pa.array(at - first[owner]), pa.array(said, pa.binary())], names=["_h", "_c_k1", "_c_k2", "_at", "_words"])

    return cand.mapInArrow(run, _struct(_h=_LONG, _c_k1=_LONG, _c_k2=_LONG, _at=_LONG, _words=_BIN))


def locate(rows: list[tuple[int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """For excerpts (anchor, words) that hold every occurrence of their windows: (index,
    first word, end) of the words that recurring windows cover."""
    import ahocorasick

    number: dict[bytes, int] = {}
    parts = [[number.setdefault(w, len(number)) for w in x.split()] for _, x in rows]
    flat = np.array([w for p in parts for w in p], np.uint64)
    size = np.array([len(p) for p in parts])
    ends = np.cumsum(size)
    # an excerpt holds the windows from its first word to window words before its end
    count = size - window + 1
    begin = np.repeat(ends - size - (np.cumsum(count) - count), count) + np.arange(count.sum())
    digest = words.grams(words.mix(flat + np.uint64(1)), window)[begin]
    _, inverse, times = np.unique(digest, return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    owner = np.repeat(np.arange(len(rows)), count)
    # confirmed passages: runs of windows that recur
    edge = again & (np.diff(owner, prepend=-1) != 0) | again & ~np.append(False, again[:-1])
    start = edge.nonzero()[0]
    if not len(start):
        return []
    stop = (again & np.append(~again[1:] | (np.diff(owner) != 0), True)).nonzero()[0]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    first_word = (ends - size)[owner[start]]
    held = set()
    for i, a, b in zip(owner[start].tolist(), (begin[start] - first_word).tolist(), (begin[stop] + window - first_word).tolist()):
        held.add(i)
        automaton.add_word(tuple(parts[i][a:b]), b - a)
    automaton.make_automaton()
    out = []
    for i, p in enumerate(parts):
        spans: list[list[int]] = []
        for end, n in automaton.iter(tuple(p)):
            a, b = end - n + 1, end + 1
            while spans and a <= spans[-1][1]:
                last = spans.pop()
                a, b = min(a, last[0]), max(b, last[1])
            spans.append([a, b])
        out += [(i, a, b) for a, b in spans]
    return out


def located_rows(excerpts: DataFrame, window: int, shard_rows: int) -> DataFrame:
    """(_c_k1, _c_k2, _a, _b): spans of words to remove, from excerpts dealt by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def shard(rows: list[tuple]) -> pa.RecordBatch:
            found = locate([(r[0], r[4]) for r in rows], window)
            columns = [[rows[i][1] for i, _, _ in found], [rows[i][2] for i, _, _ in found], [rows[i][3] + a for i, a, _ in found], [rows[i][3] + b for i, _, b in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_c_k1", "_c_k2", "_a", "_b"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) > shard_rows:  # cut between anchors; a larger anchor stays whole
                cut = shard_rows
                while cut < len(held) and held[cut][0] == held[cut - 1][0]:
                    cut += 1
                if cut == len(held):
                    break
                yield shard(held[:cut])
                held = held[cut:]
        if held:
            yield shard(held)

    return excerpts.repartition("_h").sortWithinPartitions("_h").mapInArrow(run, _struct(_c_k1=_LONG, _c_k2=_LONG, _a=_LONG, _b=_LONG))


def hot_rows(cand: DataFrame, window: int, phrase: int) -> DataFrame:
    """(_c_k1, _c_k2, _a, _b) of the recurring windows whose anchor is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for a, flat, starts, ends, first, at, owner, _, n in _excerpts(batch, window, phrase, True):
                whose = np.repeat(owner, n)
                place = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
                said = [hashlib.blake2b(b" ".join(flat[x:y].split()), digest_size=16).digest() for x, y in zip(starts[place].tolist(), ends[place + window - 1].tolist())] if len(place) else []
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.binary()), pa.array(k1[a + whose]), pa.array(k2[a + whose]), pa.array(place - first[whose])], names=["_d", "_c_k1", "_c_k2", "_a"])

    rows = cand.where(F.exists("_marks", lambda m: m["_hot"])).mapInArrow(run, _struct(_d=_BIN, _c_k1=_LONG, _c_k2=_LONG, _a=_LONG))
    again = rows.groupBy("_d").agg(F.count("*").alias("_c_n")).where("_c_n > 1").select("_d")
    return rows.join(again, "_d").select("_c_k1", "_c_k2", "_a", (F.col("_a") + window).alias("_b"))


def recurring(df: DataFrame, text: str = "text", window: int = WINDOW, phrase: int = PHRASE, shard_rows: int = SHARD_ROWS, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """One row for each distinct text that recurs in part: _c_k1, _c_k2, n_words, n_removed,
    kept_sha256 and (with_text) kept_text, the words that stay joined by one space."""
    base.ready(df.sparkSession)
    docs = df.where(base.quoted(text).isNotNull()).select(*base.text_key(base.quoted(text)), base.quoted(text).alias("_c_text"))
    anchors = base.hold(anchor_rows(docs.select("_c_k1", "_c_text"), window, phrase), "anchors")
    place = F.xxhash64("_c_k1", "_pos")
    seen = anchors.groupBy("_h").agg(F.count("*").alias("_c_n"), F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    seen = seen.where("_lo <> _hi").select("_h", (F.col("_c_n") > hot).alias("_hot"))
    marks = anchors.join(seen, "_h").groupBy("_c_k1").agg(F.collect_set(F.struct("_pos", "_hot")).alias("_marks"))
    # the marks get the whole key first, so that the texts are shuffled once, by it
    marks = marks.join(docs.select("_c_k1", "_c_k2").distinct(), "_c_k1")
    texts = docs.groupBy("_c_k1", "_c_k2").agg(F.any_value("_c_text").alias("_c_text"))
    cand = base.hold(texts.join(marks, ["_c_k1", "_c_k2"]).select("_c_k1", "_c_k2", "_c_text", "_marks"), "candidates")
    base.release(anchors)
    spans = located_rows(excerpt_rows(cand, window, phrase), window, shard_rows)
    spans = spans.unionByName(hot_rows(cand, window, phrase))
    spans = spans.groupBy("_c_k1", "_c_k2").agg(F.collect_list(F.struct("_a", "_b")).alias("_spans"))
    done = cand.select("_c_k1", "_c_k2", "_c_text").join(spans, ["_c_k1", "_c_k2"])
    names = ["_c_k1", "_c_k2", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans_of = batch.column(3)
            for i, t in enumerate(base.byte_texts(batch.column(2))):
                own = t.split()
                covered = np.zeros(len(own) + 1, np.int64)
                pairs = spans_of[i].values
                np.add.at(covered, pairs.field(0).to_numpy(), 1)
                np.add.at(covered, pairs.field(1).to_numpy(), -1)
                stay = (np.cumsum(covered)[:-1] == 0).nonzero()[0]
                kept = b" ".join([own[j] for j in stay.tolist()])
                rows.append((len(own), len(own) - len(stay), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = list(zip(*rows))
            out = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])] if rows else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out][: len(names)], names=names)

    kinds = dict(_c_k1=_LONG, _c_k2=_LONG, n_words=_LONG, n_removed=_LONG, kept_sha256=T.StringType(), kept_text=T.StringType())
    return done.mapInArrow(run, _struct(**{n: kinds[n] for n in names}))


def copies(df: DataFrame, text: str = "text") -> DataFrame:
    """(_c_k1, _c_k2) of the texts that more than one row has."""
    rows = df.where(base.quoted(text).isNotNull()).select(*base.text_key(base.quoted(text)))
    return rows.groupBy("_c_k1", "_c_k2").agg(F.count("*").alias("_c_n")).where("_c_n > 1").select("_c_k1", "_c_k2", F.lit(True).alias("_c_copied"))


def own_words(df: DataFrame, text: str = "text", replace: bool = False) -> DataFrame:
    """`df` with _c_k1, _c_k2, _c_n and _c_sha: the count of words and the digest of all words joined
    by a space; its text is dropped, or with `replace` kept as _c_text."""
    keys = dict(zip(("_c_k1", "_c_k2"), base.text_key(base.quoted(text))))
    rest = base.without(df, [text])
    frame = df.withColumns(keys).select(*(base.quoted(c) for c in rest.columns), "_c_k1", "_c_k2", base.quoted(text).alias("_c_text"))
    kept = T.StructType([f for f in frame.schema.fields if replace or f.name != "_c_text"])
    schema = T.StructType([*kept.fields, T.StructField("_c_n", _LONG), T.StructField("_c_sha", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for t in base.byte_texts(batch.column(batch.num_columns - 1)):
                own = (t or b"").split()
                n.append(len(own)), sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=schema.names)

    return frame.mapInArrow(run, schema)


def remove(df: DataFrame, text: str = "text", window: int = WINDOW, phrase: int = PHRASE, shard_rows: int = SHARD_ROWS, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """`df` with n_words, n_removed and kept_sha256. With `with_text`, its text keeps only
    the words that stay, joined by one space, where any were removed (else it is as it
    was); without, the text is dropped and no text is shuffled for the result."""
    made = ["n_words", "n_removed", "kept_sha256"]
    source = base.without(df, made)
    found = recurring(source, text, window, phrase, shard_rows, hot, with_text)
    found = found.select("_c_k1", "_c_k2", F.col("n_removed").alias("_c_removed"), F.col("kept_sha256").alias("_c_kept"), *([F.col("kept_text").alias("_c_stays")] if with_text else []))
    rows = own_words(source, text, replace=with_text).join(found, ["_c_k1", "_c_k2"], "left").join(copies(source, text), ["_c_k1", "_c_k2"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    whole = F.col("_c_copied").isNotNull() & (F.col("_c_n") >= window)
    digests = [
        F.col("_c_n").alias("n_words"),
        F.when(whole, F.col("_c_n")).otherwise(F.coalesce("_c_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, empty).otherwise(F.coalesce("_c_kept", "_c_sha")).alias("kept_sha256"),
    ]
    stays = F.when(whole, F.lit("")).otherwise(F.coalesce("_c_stays", "_c_text")) if with_text else None
    columns = [stays.alias(c) if c == text else base.quoted(c) for c in source.columns if with_text or c != text]
    return rows.select(*columns, *digests)
