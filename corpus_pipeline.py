"""The corpus pipeline: stages over the documents table, each written as Parquet and reread.

Every stage works on all that the one before kept: documents whose language is
rejected go, then toxic ones, then all but one of each class of near duplicates;
phrases that recur are cut out of the texts, and what is left is packed into
sequences of tokens. All stages but the last return the columns they were given.
Null and empty texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cirrus.llm import base, langid, minhash, packing, queries, substring, toxicity


def _apart(docs: DataFrame, used: list[str]):
    """`docs` with the columns that an operator does not use under names that no operator
    adds, and a function that gives back the columns of `docs` from what it returns."""
    hidden = {c: f"_kept_{i}" for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(hidden), lambda df: df.select(*(base.quoted(hidden.get(c, c)).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (operator 1)."""
    model = langid.train(docs, F.coalesce(langid.remainder(F.col("doc_id"), 3) != 1, F.lit(False)))
    inner, back = _apart(docs, ["text"])
    return back(langid.predict(inner, model).where("accepted"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic (operator 5)."""
    labels = base.table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, langid.remainder(F.col("doc_id"), 4) != 2)
    inner, back = _apart(docs, ["text"])
    return back(toxicity.predict(inner, model).where("predicted = 0"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (operator 7): five words, 0.8 or more."""
    return minhash.keep_one(docs)


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring phrases (operator 2); n_chars follows the text."""
    inner, back = _apart(docs, ["text", "n_chars"])
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return back(substring.remove(inner).withColumn("n_chars", chars))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 2048 ids packed into sequences (operator 4); no longer the columns of documents."""
    pieces = packing.token_pieces(docs.select("doc_id", "text"), queries.vocabulary("byte_bpe_50k.json"))
    return packing.pack(pieces)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("repeated_phrases", cut), ("packing", pack)]

#: The stages learn models and encode tokens, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents; the rows of the last."""
    docs = base.table(base.ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = base.hold(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
