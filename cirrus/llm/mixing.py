"""Mixing sources to target weights by Pareto order sampling (operator 12).

Sources share a budget of words by weight; a source's target stops at `most` times its
size and what is over is shared again by weight, until none is above. A document then has
an expected number of copies, its source's target over its source's size (times the
document's preference, if one is given). Whole copies are certain; the rest of the number,
p, is the chance of one more, which Pareto sampling decides: with u random in (0, 1),
documents are ranked by u / (1 - u) over p / (1 - p), and the first of a source are taken
until the sample has the words that its target lacks. A document that has more words than
are lacking is passed over and the ranking goes on, so the sample's size is that of the
target but for what the shortest document left over has, and no document is cut.

Everything is DataFrame code in the JVM. No source is ever sorted or gathered: the place
where a source's sample ends is found from sums of words over buckets of the rank's leading
bits, then of the bits behind them in the one bucket that the end lies in. A row is taken
or not by comparing its own rank with the ends of its source. Sources are few or many: their
table is joined, weighed by a distributed row number and never broadcast by a hint.

u comes from the md5 of seed, id and text, so reruns and other partitions give the same
mix; only rows that agree in all three are told apart by their place in the written table,
and which of them is taken makes no difference. Null texts have no words; documents without
words are taken 0 words. Null sources are one source, the last. A source without words has
target 0. Null, NaN and negative preferences count as 0: no sure copy, and the last ranks.
Columns of `df` with the names of the result are replaced; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ingest import with_row_id
from . import base

SHARE_PERCENT, MOST, WEIGHTS, SEED = 150, 2, (3, 1, 2), 11
#: A row's rank, then the rest of its md5, then its place: names and bits, and the bits that one step of the search looks at.
KEYS, STEP_BITS = {"_k1": 50, "_k2": 60, "_k3": 60}, 10
_END = (1 << 63) - 1
#: Least chance of one more copy that a document is ranked by.
LEAST = 1e-9

_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09 to 0x0D; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return F.length(F.translate(F.regexp_replace(t, _WORD, "w"), " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sources: DataFrame, percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """`sources` (source_size, _w) with target: shares of percent / 100 of all sizes by weight
    _w, at most `most` times the size; the excess is shared again until no share is above."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = min(percent * total / 100, float(most * total))
    cap = F.col("source_size") * F.lit(float(most))
    level, num, den, capped = 0.0, budget, 1, -1
    while True:
        # sources at their cap under the last level; the others share what these leave
        full = F.col("_w") * F.lit(num) / F.lit(den) >= cap if capped >= 0 else F.lit(False)
        n, used, weight = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0))).first()
        if n == capped or not weight:
            break
        capped, num, den = n, budget - used, weight
    share = F.col("_w") * F.lit(num) / F.lit(den)
    return sources.withColumn("target", F.least(share, cap))


def _after(a: list[str], b: list[str]) -> Column:
    """Whether the rank in columns `a` comes after the one in columns `b`."""
    out = F.lit(False)
    for x, y in reversed(list(zip(a, b))):
        out = (F.col(x) > F.col(y)) | ((F.col(x) == F.col(y)) & out)
    return out


def _ends(rows: DataFrame, state: DataFrame) -> DataFrame:
    """For each source of `state` (_s, _left) the rank (_k1, _k2, _k3) of the first row of
    `rows` (_s, size, _k1, _k2, _k3) at which the words run over _left, and the words left
    before it; a source whose rows all fit is left out.

    Each step looks at STEP_BITS more bits of the rank, only in the bucket found so far:
    sums with partial aggregation, at most 2**STEP_BITS of them for a source."""
    known = state.select("_s", "_left", *(F.lit(0).cast("long").alias(k) for k in KEYS))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    for i, (key, size) in enumerate(KEYS.items()):
        for shift in range(size - STEP_BITS, -1, -STEP_BITS):
            inside = rows.join(known.select("_s", "_left", *(F.col(k).alias(f"_a{k}") for k in KEYS)), "_s")
            for k in list(KEYS)[:i]:
                inside = inside.where(F.col(k) == F.col(f"_a{k}"))
            inside = inside.where(F.shiftright(key, shift + STEP_BITS) == F.shiftright(f"_a{key}", shift + STEP_BITS))
            sums = inside.groupBy("_s", "_left", *(f"_a{k}" for k in KEYS), F.shiftright(key, shift).alias("_b")).agg(F.sum("size").alias("_n"), F.count("*").alias("_rows"), *(F.min(k).alias(f"_m{k}") for k in KEYS))
            cross = sums.withColumn("_before", before).where("_before <= _left and _before + _n > _left")
            bucket = {k: F.col(f"_a{k}") if j < i else F.shiftleft("_b", shift) if j == i else F.lit(0).cast("long") for j, k in enumerate(KEYS)}
            found = base.hold(cross.select("_s", (F.col("_left") - F.col("_before")).alias("_left"), *(F.when(F.col("_rows") == 1, F.col(f"_m{k}")).otherwise(bucket[k]).alias(k) for k in KEYS), "_rows"), "ends")
            base.release(known)
            known = found
            if not known.where("_rows > 1").limit(1).count():
                return known.drop("_rows")
    return known.drop("_rows")


def mix(df: DataFrame, size: Column, source: Column, doc_id: Column, text: Column, keep: list[str] | None = None, preference: Column | None = None,
        percent: int = SHARE_PERCENT, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """`df` (or its columns `keep`) with size, source_size, target (its source's), certain
    (whole copies that are sure), taken (words that the mix takes, repeats counted).

    Sources weigh `weights`, repeating, in code point order with null last, and share
    `percent` of all words. `preference` is a positive number that a document's expected
    copies are in proportion to inside its source."""
    spark = base.ready(df.sparkSession)
    made = ["size", "source_size", "target", "certain", "taken"]
    kept = base.without(df if keep is None else df.select(*(base.quoted(c) for c in keep)), made).columns
    name = source.cast("string")
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))
    wish = F.lit(1.0) if preference is None else F.greatest(F.coalesce(F.when(~F.isnan(preference), preference.cast("double")), F.lit(0.0)), F.lit(0.0))
    slim = base.hold(df.select(*(base.quoted(c) for c in kept), size.cast("long").alias("size"), F.when(name.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), name)).alias("_s"), mark.alias("_h"), wish.alias("_wish")), "sizes")

    sources = base.hold(slim.groupBy("_s").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_wish")).alias("_wished")), "sources")
    weighed = with_row_id(sources, ["_s"], "_at").withColumn("_w", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("_at") % len(weights) + 1).cast("int")))
    shares = base.hold(targets(base.hold(weighed.drop("_at"), "weighed"), percent, most), "targets")

    # expected copies, whole copies, and the rank of one more
    rows = slim.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_place")).join(shares, "_s")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if preference is not None:
        copies = F.when(F.col("_wished") > 0, copies * F.col("_wish") * F.col("source_size") / F.col("_wished")).otherwise(copies)
    rows = rows.withColumn("_copies", F.least(copies, F.lit(float(most)))).withColumn("certain", F.floor("_copies").cast("long"))
    p, u = F.greatest(F.col("_copies") - F.col("certain"), F.lit(LEAST)), (F.conv(F.substring("_h", 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    rows = rows.withColumns({"_p": p, "_u": u})
    odds, against = F.col("_u") * (1 - F.col("_p")), (1 - F.col("_u")) * F.col("_p")
    top = 1 << KEYS["_k1"]
    ranked = base.hold(rows.select(
        *(base.quoted(c) for c in kept), "_s", "size", "source_size", "target", "certain",
        F.least(F.floor(odds / (odds + against) * float(top)), F.lit(top - 1)).cast("long").alias("_k1"),  # order of odds / against, as a number below 1
        F.conv(F.substring("_h", 14, 15), 16, 10).cast("long").alias("_k2"), F.shiftrightunsigned("_place", 4).alias("_k3")), "ranked")
    base.release(slim)

    # where the samples end; every round passes over the document that ended the last one
    sure = ranked.groupBy("_s", "target").agg(F.sum(F.col("size") * F.col("certain")).alias("_sure"))
    state = base.hold(sure.select("_s", F.floor(F.col("target") - F.col("_sure")).cast("long").alias("_left"), *(F.lit(-1).cast("long").alias(f"_f{k}") for k in KEYS)).where("_left > 0"), "state")
    open_rows, taken = ranked.where(F.col("size") > 0).where(F.col("certain") < most).select("_s", "size", *KEYS), []
    starts = [f"_f{k}" for k in KEYS]
    while True:
        fits = base.hold(open_rows.join(state, "_s").where("size <= _left").where(_after(list(KEYS), starts)).select("_s", "size", *KEYS), "open")
        ends = _ends(fits, state)
        run = state.join(ends.select("_s", *(F.col(k).alias(f"_t{k}") for k in KEYS)), "_s", "left")
        taken.append(base.hold(run.select("_s", F.col("_left").alias("_most"), *starts, *(F.coalesce(f"_t{k}", F.lit(_END)).alias(f"_t{k}") for k in KEYS)), "runs"))
        state = base.hold(ends.select("_s", "_left", *(F.col(k).alias(f"_f{k}") for k in KEYS)).where("_left > 0"), "state")
        open_rows = fits
        if not state.limit(1).count():
            break

    runs = taken[0]
    for more in taken[1:]:
        runs = runs.unionByName(more)
    fields = ["_most", *starts, *(f"_t{k}" for k in KEYS)]
    runs = base.hold(runs.groupBy("_s").agg(F.collect_list(F.struct(*fields)).alias("_runs")), "runs")  # a few for a source

    def inside(r: Column) -> Column:
        def behind(a: list[Column], b: list[Column]) -> Column:
            out = F.lit(False)
            for x, y in reversed(list(zip(a, b))):
                out = (x > y) | ((x == y) & out)
            return out

        rank = [F.col(k) for k in KEYS]
        return (F.col("size") <= r["_most"]) & behind(rank, [r[f"_f{k}"] for k in KEYS]) & behind([r[f"_t{k}"] for k in KEYS], rank)

    extra = (F.col("size") > 0) & (F.col("certain") < most) & F.coalesce(F.exists("_runs", inside), F.lit(False))
    return ranked.join(runs, "_s", "left").select(*(base.quoted(c) for c in kept), "size", "source_size", "target", "certain",
                                                  (F.col("size") * (F.col("certain") + extra.cast("long"))).alias("taken"))
