"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgate.llm import minhash, mixing, packing, pii, toxicity
from siltgate.llm.scratch import Scratch, read

#: Tables of dropped ids with at most so many rows (under 64 MB) are broadcast.
SMALL = 2_000_000


def _row(docs: DataFrame) -> F.Column:
    """All columns as one, so that no name of theirs meets one of a stage's own."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def _back(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col("row")[c].alias(c) for c in names])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under 0.7; the lexicon is learned from ``labels``.

    Null and empty texts stay; rows with a null doc_id and repeated rows are judged by their text like
    all others; whole texts are read; all columns are returned untouched, also those called
    score or predicted; an empty table stays empty. A score of just 0.7 goes.
    """
    words, begin = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return _back(toxicity.score(docs.select(_row(docs), "text"), words, begin).where("predicted = 0"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 over five-word shingles: the smallest doc_id.

    Rows that share a doc_id are one document, which stays or goes as a whole; of its rows with the same
    text one stays, the first in the order of a hash of all columns. Null, empty and blank texts are no copies of each other.
    Rows with a null doc_id stay. Whole texts are compared; all columns are returned; an empty table stays empty.
    """
    found = Scratch(spark, "stage-copies").table(minhash.near_duplicates(docs, width=5, percent=80).select("doc_id", "kept"))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    small = lambda df: F.broadcast(df) if df.count() <= SMALL else df
    out = docs.join(small(gone), "doc_id", "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        some = out.join(small(repeated), "doc_id", "left_semi")
        keyed = some.select(_row(some), F.xxhash64("doc_id").alias("k"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"), F.col("text").isNull().alias("n"))
        one = keyed.groupBy("k", "t", "n").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.join(small(repeated), "doc_id", "left_anti").select(*docs.columns).unionByName(_back(one, docs.columns))
    return out.select(*docs.columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data generalised, disclosing terms removed; n_chars, where there is one, follows the text.

    Null texts stay null, with their n_chars; every row stays, repeated rows are changed alike, and no other column
    is touched, whatever its name; whole texts are read; an empty table stays empty.
    """
    out = pii.sanitised(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated probabilities keep.

    A null source or language is a value of its own; texts without words have no weight and go where any document
    has words; rows of one doc_id are decided alike, rows with a null doc_id by their text; all
    columns are returned untouched, also those called topic, weight or kept; an empty table stays empty.
    """
    base = docs.select(_row(docs), "doc_id", "text", "source", "lang")
    return _back(mixing.mix(base).where("kept"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' place in sequences of the permitted lengths.

    A null or empty text has its end token alone; null doc_ids and repeated rows are packed each for
    itself; longer texts than a sequence are cut, none is shortened; other columns are ignored; see ``best_fit`` for ties.
    """
    return packing.best_fit(docs.select("doc_id", packing.word_count(F.col("text")).alias("n_tokens")))


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("pii", sanitise),
    ("mixing", sample_mixture),
    ("best-fit packing", pack_sequences),
]

#: The shingle join, the learned lexicon and the packing have no SQL form; a brute-force version tests the run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
