"""Phrase collocations by direct-address tiling (operator 11).

Texts become blocks: the words of many texts of one language as numbers of the block's own
vocabulary. Words that are frequent enough get ids by falling frequency, and the blocks are
rewritten with them, -1 standing for all else and for the edges of pieces. One step then
makes phrases of k + 1 words out of ids of phrases of k:

1. Adjacent ids of a block (phrases that overlap in all but one word) are an address in a
   plane. Where both ids are small, the plane is cut into tiles of TILE x TILE, counted with
   a dense bincount (a block with little in a tile sorts instead); everything else is
   sorted COO. Each block sends what it has counted, packed in arrays, to the tasks that
   add tiles (in SLICES interleaved slices) and buckets of COO.
2. Pairs that are frequent enough are ranked again by frequency: these are the ids of the
   next step. They go back to the blocks that hold them, which are rewritten.

So a phrase counts only if all its parts are frequent, and nothing but the frequent part of
the vocabulary is ever ranked. Counts of the parts travel with the ids (all first and all
last parts of a phrase), so each cut of a phrase is scored without a search. No vocabulary
is broadcast or kept whole by a task: blocks meet their own words only, and the joins that
look words up take the HEAD most frequent ones, which many phrases share, by broadcast and
the others by key. COO buckets follow the number of words, so their size does not.

Null texts are empty, a null language is `und`; repeated texts count each time. Texts
without words and empty tables give no rows. Only the two columns are read, so other columns
and clashing names play no part. Equal scores are ordered by count, then phrase in byte order.
More than 2**31 frequent words or phrases of one length in a language raise.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ingest import with_row_id
from . import base, words

LONGEST, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: Bytes of text in the blocks of a task before they are sent on.
BLOCK_BYTES = 4 << 20
#: Side of a tile, tiles along a side of the dense plane, interleaved slices of a tile.
TILE, TILES, SLICES = 256, 8, 16
#: Occurrences of pairs that one COO bucket is meant for, and the fewest buckets.
BUCKET, BUCKETS = 1 << 20, 64
#: Words or phrases that the look-ups broadcast; width of a class of scores; top rows are first taken in so many salts.
HEAD, CLASS, SALTS = 4096, 1000, 64

_BREAK = b"\xff"  # no UTF-8 text holds this byte
_EDGES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\x0a" * 10 + b" ")


def _tokens(text: bytes) -> list[bytes]:
    """Words of a text in A-Z lower case, with _BREAK where a piece ends."""
    return text.lower().translate(_EDGES).replace(b"\x0a", b" " + _BREAK + b" ").split()


def _numbered():
    table = defaultdict(count().__next__)
    table[_BREAK]  # number 0
    return table


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks (_b, _lang, _words, _counts, _seq) of `docs` (_text, _lang)."""
    names = ["_b", "_lang", "_words", "_counts", "_seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        tables, parts, held = defaultdict(_numbered), defaultdict(list), 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, table in tables.items():
                seq = np.concatenate(parts[lang])
                times = np.bincount(seq, minlength=len(table))[1:]
                vocabulary = pa.array([w for w in table if w != _BREAK], pa.binary()).cast(pa.string())
                offsets = pa.array([0, len(vocabulary)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), pa.array([lang], pa.string()), pa.ListArray.from_arrays(offsets, vocabulary), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))), pa.array([(seq - 1).astype(np.int32).tobytes()], pa.binary())], names=names)
            tables.clear()
            parts.clear()

        for batch in batches:
            for text, lang in zip(base.byte_texts(batch.column(0)), batch.column(1).to_pylist()):
                if not text:
                    continue
                found = _tokens(text)
                found.append(_BREAK)
                parts[lang].append(np.fromiter(map(tables[lang].__getitem__, found), np.int32, len(found)))
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield from sent()
                    held = 0
        yield from sent()

    return docs.mapInArrow(run, "_b long, _lang string, _words array<string>, _counts array<long>, _seq binary")


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    """`rows` with _id: their number in their language by falling count `a`."""
    at = base.hold(with_row_id(rows, ["_lang", F.desc("a"), *order], "_id"), "ranked")
    first = at.groupBy("_lang").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    return at.join(first, "_lang").withColumn("_id", F.when(F.col("_n") < 1 << 31, F.col("_id") - F.col("_first")).otherwise(F.raise_error(F.lit("more than 2**31 frequent phrases of one length")).cast("long"))).drop("_first", "_n")


def _word_ids(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """Blocks (_b, _lang, _seq) with ids of `table` (_lang, phrase, _id) in place of their own numbers."""
    own = blocks.select("_b", "_lang", F.posexplode("_words").alias("_at", "phrase"))
    known = own.join(table.select("_lang", "phrase", "_id"), ["_lang", "phrase"]).groupBy("_b").agg(F.collect_list(F.struct("_at", "_id")).alias("_known"))  # at most a block's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seq = np.frombuffer(batch.column(2)[i].as_buffer(), np.int32)
                pairs = batch.column(3)[i].values
                at, ids = (c.to_numpy(zero_copy_only=False) for c in pairs.flatten())
                out = np.full(int(max(seq.max(), at.max())) + 2, -1, np.int32)
                out[at] = ids  # the last place stays -1, for edges
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([out[seq].tobytes()], pa.binary())], names=["_b", "_lang", "_seq"])

    return blocks.select("_b", "_lang", "_seq").join(known, "_b").mapInArrow(run, "_b long, _lang string, _seq binary")


def _tiled(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tile, addresses, counts) of pairs in the dense plane; addresses put the slice first."""
    tile = (x // TILE) * TILES + y // TILE
    flat = (x % TILE) * TILE + y % TILE
    address = (flat % SLICES) * (TILE * TILE // SLICES) + flat // SLICES
    order = np.argsort(tile, kind="stable")
    edges = np.searchsorted(tile[order], np.arange(TILES * TILES + 1))
    for t, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if b - a >= TILE * TILE // 8:
            dense = np.bincount(address[order[a:b]], minlength=TILE * TILE)
            at = dense.nonzero()[0]
            yield t, at, dense[at]
        elif b > a:
            yield t, *np.unique(address[order[a:b]], return_counts=True)


def _pairs(blocks: DataFrame, buckets: int) -> DataFrame:
    """What each block counts of its adjacent ids: (_lang, _t, _s, _b, _at, _n), a tile and slice or -1 and
    a bucket of COO, with packed places (addresses, or both ids in one number) and counts."""
    names = ["_lang", "_t", "_s", "_b", "_at", "_n"]
    per = TILE * TILE // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, lang, raw in zip(*(c.to_pylist() for c in batch.columns)):
                seq = np.frombuffer(raw, np.int32)
                x, y = seq[:-1], seq[1:]
                ok = (x >= 0) & (y >= 0)
                x, y = x[ok], y[ok]
                near = (x < TILE * TILES) & (y < TILE * TILES)
                rows: list[list] = [[], [], [], []]

                def put(t, s, at, n):
                    for c, v in zip(rows, (t, s, at.tobytes(), n.astype(np.int32).tobytes())):
                        c.append(v)

                for t, at, n in _tiled(x[near], y[near]):
                    cut = np.searchsorted(at, np.arange(SLICES + 1) * per)
                    for s, (c, d) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                        if d > c:
                            put(t, s, (at[c:d] - s * per).astype(np.uint16), n[c:d])
                code, n = np.unique(x[~near].astype(np.uint64) << np.uint64(32) | y[~near].astype(np.uint64), return_counts=True)
                bucket = (words.mix(code) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")  # codes stay sorted in their bucket
                cut = np.concatenate([[0], np.diff(bucket[order]).nonzero()[0] + 1, [len(order)]]) if len(order) else np.zeros(1, int)
                for c, d in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    put(-1, int(bucket[order[c]]), code[order[c:d]], n[order[c:d]])
                m = len(rows[0])
                for a in range(0, m, 512):
                    t, s, at, n = (c[a : a + 512] for c in rows)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(t), pa.string()), pa.array(t, pa.int32()), pa.array(s, pa.int32()), pa.array([b] * len(t), pa.int64()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=names)

    return blocks.select("_b", "_lang", "_seq").mapInArrow(run, "_lang string, _t int, _s int, _b long, _at binary, _n binary")


def _code(tile: int, part: int, at: np.ndarray) -> np.ndarray:
    """Both ids in one number, from a tile's addresses or as they are in COO."""
    if tile < 0:
        return at
    flat = at.astype(np.int64) * SLICES + part
    x, y = (tile // TILES) * TILE + flat // TILE, (tile % TILES) * TILE + flat % TILE
    return x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)


def _merged(at: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted COO from pieces of it."""
    code, times = np.concatenate(at), np.concatenate(n)
    order = np.argsort(code, kind="stable")
    code, times = code[order], times[order]
    new = np.concatenate([[0], np.diff(code).nonzero()[0] + 1]) if len(code) else np.zeros(0, int)
    return code[new], np.add.reduceat(times, new) if len(code) else times


def _frequent(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs (_lang, _t, _s, _code, _x, _y, a) that occur at least `least` times in all blocks."""
    names = ["_lang", "_t", "_s", "_code", "_x", "_y", "a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense, at, n, size = None, None, [], [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            if now[1] >= 0:
                place = (dense >= least).nonzero()[0]
                times = dense[place]
            else:
                place, times = _merged(at, n)
                place, times = place[times >= least], times[times >= least]
            code = _code(now[1], now[2], place)
            for a in range(0, len(place), 8192):
                c = code[a : a + 8192]
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(c), pa.string()), pa.array([now[1]] * len(c), pa.int32()), pa.array([now[2]] * len(c), pa.int32()), pa.array(place[a : a + 8192].astype(np.uint64).view(np.int64)),
                                                  pa.array((c >> np.uint64(32)).astype(np.int64)), pa.array((c & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(times[a : a + 8192])], names=names)

        for batch in batches:
            for lang, t, s, places, times in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, t, s) != now:
                    if now is not None:
                        yield from summed()
                    now, at, n, size = (lang, t, s), [], [], 0
                    dense = np.zeros(TILE * TILE // SLICES, np.int64)
                times = np.frombuffer(times, np.int32).astype(np.int64)
                if t >= 0:
                    dense[np.frombuffer(places, np.uint16)] += times  # a block names an address once
                else:
                    at.append(np.frombuffer(places, np.uint64))
                    n.append(times)
                    size += len(times)
                    if size > BUCKET:
                        code, total = _merged(at, n)
                        at, n, size = [code], [total], 0
        if now is not None:
            yield from summed()

    dealt = pairs.select("_lang", "_t", "_s", "_at", "_n").repartition("_lang", "_t", "_s").sortWithinPartitions("_lang", "_t", "_s")
    return dealt.mapInArrow(run, "_lang string, _t int, _s int, _code long, _x long, _y long, a long")


def _next_blocks(blocks: DataFrame, pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Blocks with the ids of `table` (_lang, _t, _s, _code, _id) in place of their adjacent ids."""
    known = table.groupBy("_lang", "_t", "_s").agg(F.collect_list(F.struct("_code", "_id")).alias("_known"))  # a slice or a bucket
    both = known.select("_lang", "_t", "_s", F.lit(0).alias("_m"), F.lit(None).cast("long").alias("_b"), F.lit(None).cast("binary").alias("_at"), "_known")
    both = both.unionByName(pairs.select("_lang", "_t", "_s", F.lit(1).alias("_m"), "_b", "_at", F.lit(None).cast("array<struct<_code:long,_id:long>>").alias("_known")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, code, ids = None, None, None
        for batch in batches:
            lang, t, s, m, b = (batch.column(i).to_pylist() for i in range(5))
            out: list[list] = [[], [], []]
            for i, key in enumerate(zip(lang, t, s)):
                if m[i] == 0:
                    now = key
                    code, ids = (c.to_numpy(zero_copy_only=False) for c in batch.column(6)[i].values.flatten())
                    order = np.argsort(code.view(np.uint64))
                    code, ids = code.view(np.uint64)[order], ids[order]
                elif key == now:
                    at = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint16 if key[1] >= 0 else np.uint64)
                    place = np.minimum(np.searchsorted(code, at.astype(np.uint64)), len(code) - 1)
                    hit = code[place] == at.astype(np.uint64)
                    if hit.any():
                        for c, v in zip(out, (b[i], _code(key[1], key[2], at[hit]).tobytes(), ids[place[hit]].astype(np.int32).tobytes())):
                            c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["_b", "_codes", "_ids"])

    met = both.repartition("_lang", "_t", "_s").sortWithinPartitions("_lang", "_t", "_s", "_m").mapInArrow(found, "_b long, _codes binary, _ids binary")
    own = met.groupBy("_b").agg(F.collect_list(F.struct("_codes", "_ids")).alias("_own"))  # at most a block's pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seq = np.frombuffer(batch.column(2)[i].as_buffer(), np.int32)
                parts = batch.column(3)[i].as_py()
                code = np.concatenate([np.frombuffer(p["_codes"], np.uint64) for p in parts])
                ids = np.concatenate([np.frombuffer(p["_ids"], np.int32) for p in parts])
                order = np.argsort(code)
                code, ids = code[order], ids[order]
                x, y = seq[:-1], seq[1:]
                ok = (x >= 0) & (y >= 0)
                want = x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)
                place = np.minimum(np.searchsorted(code, want), len(code) - 1)
                out = np.where(ok & (code[place] == want), ids[place], np.int32(-1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([out.tobytes()], pa.binary())], names=["_b", "_lang", "_seq"])

    return blocks.select("_b", "_lang", "_seq").join(own, "_b").mapInArrow(run, "_b long, _lang string, _seq binary")


def _looked_up(rows: DataFrame, table: DataFrame, head: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """`rows` with `columns` of the row of `table` whose _id is `key`. Ids of `head` are looked up by
    broadcast: many phrases share them."""
    def named(t: DataFrame) -> DataFrame:
        return t.select("_lang", F.col("_id").alias(key), *(F.col(a).alias(b) for a, b in columns.items()))

    marked = rows.join(F.broadcast(head.select("_lang", F.col("_id").alias(key), F.lit(True).alias("_h"), *(F.col(a).alias(b) for a, b in columns.items()))), ["_lang", key], "left")
    return marked.where("_h").drop("_h").unionByName(marked.where("_h is null").drop("_h", *columns.values()).join(named(table), ["_lang", key]))


def counted(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (_lang, n), and the phrases of 1, 2, ... words that occur at
    least `least` times: (_lang, _id, _x, _y, phrase, last, pre, suf, a), where _x and _y are the
    ids of the phrase without its last and first word, pre and suf the counts of its 1, 2, ...
    first and last words."""
    blocks = base.hold(_blocks(docs), "blocks")
    own = blocks.select("_lang", F.explode(F.arrays_zip(F.col("_words").alias("w"), F.col("_counts").alias("c"))).alias("e")).select("_lang", "e.w", "e.c")
    vocabulary = base.hold(own.groupBy("_lang", F.col("w").alias("phrase")).agg(F.sum("c").alias("a")), "words")
    sizes = base.hold(vocabulary.groupBy("_lang").agg(F.sum("a").alias("n")), "sizes")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(BUCKETS, -(-n // BUCKET))
    table = base.hold(_ranked(vocabulary.where(F.col("a") >= least), ["phrase"]).select(
        "_lang", "_id", F.lit(None).cast("long").alias("_x"), F.lit(None).cast("long").alias("_y"), "phrase", F.col("phrase").alias("last"), F.array("a").alias("pre"), F.array("a").alias("suf"), "a"), "phrases")
    base.release(vocabulary)
    now = base.hold(_word_ids(blocks, table), "ids")
    base.release(blocks)
    tables = [table]
    for k in range(2, longest + 1):
        pairs = base.hold(_pairs(now, buckets), "pairs")
        fresh = base.hold(_ranked(_frequent(pairs, least), ["_x", "_y"]), "frequent")
        head = base.hold(table.orderBy(F.desc("a"), "_lang", "_id").limit(HEAD), "head")
        rows = _looked_up(fresh.drop("_t", "_s", "_code"), table, head, "_x", {"phrase": "_p", "pre": "_pre"})
        rows = _looked_up(rows, table, head, "_y", {"last": "last", "suf": "_suf"})
        table = base.hold(rows.select("_lang", "_id", "_x", "_y", F.concat_ws(" ", "_p", "last").alias("phrase"), "last", F.concat("_pre", F.array("a")).alias("pre"), F.concat("_suf", F.array("a")).alias("suf"), "a"), "phrases")
        tables.append(table)
        if k < longest:
            after = base.hold(_next_blocks(now, pairs, fresh), "ids")
            base.release(now)
            now = after
        base.release(pairs)
    base.release(now)
    return sizes, tables


def _score(k: int) -> Column:
    """Least (score, cut, l, r) of the cuts of a phrase of k words; whole numbers throughout."""
    def cut(j: int) -> Column:
        l, r = F.col("pre")[j - 1], F.col("suf")[k - j - 1]
        wide = [c.cast("decimal(15,0)") for c in (F.col("a"), l, r)]
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide[0] * wide[0], wide[1] * wide[2])
        return F.struct(score.cast("long").alias("score"), F.lit(j).alias("cut"), l.alias("l"), r.alias("r"))

    return F.array_min(F.array(*(cut(j) for j in range(1, k))))


def mine(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 to `longest` words
    that occur at least `least` times; those go whose words lie in a longer one that has at least `inside`
    percent of their count."""
    base.ready(df.sparkSession)
    docs = df.select(base.quoted(text).cast("string").alias("_text"), F.coalesce(base.quoted(lang).cast("string"), F.lit("und")).alias("_lang"))
    sizes, tables = counted(docs, longest, least)
    kept = None
    for k, table in enumerate(tables[1:], 2):
        rows = table.select("_lang", "_id", "phrase", "a", _score(k).alias("_best"))
        if k < longest:  # what lies in a much longer phrase lies in one that is longer by a word
            longer = tables[k].select("_lang", F.explode(F.array("_x", "_y")).alias("_id"), F.col("a").alias("_c")).groupBy("_lang", "_id").agg(F.max("_c").alias("_c"))
            rows = rows.join(longer, ["_lang", "_id"], "left").where(F.col("_c").isNull() | (100 * F.col("_c") < inside * F.col("a"))).drop("_c")
        kept = rows if kept is None else kept.unionByName(rows)
    if kept is None:
        raise ValueError("phrases have two words at least")
    order = [F.desc("_best.score"), F.desc("a"), F.col("phrase")]
    kept = base.hold(kept, "scored")
    # classes of scores from the best down, until a language has enough: at most 10**6 / CLASS + 1 of them
    classes = kept.groupBy("_lang", F.floor(F.col("_best.score") / CLASS).alias("_class")).agg(F.count("*").alias("_c"))
    above = F.coalesce(F.sum("_c").over(Window.partitionBy("_lang").orderBy(F.desc("_class")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least_class = classes.withColumn("_above", above).where(F.col("_above") < top).groupBy("_lang").agg(F.min("_class").alias("_class"))
    kept = kept.join(least_class, "_lang").where(F.col("_best.score") >= F.col("_class") * CLASS).drop("_class")
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("_lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("_lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "_lang").select(F.col("_lang").alias("lang"), "rank", "phrase", "a", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), "n", F.col("_best.score").alias("score"))
