"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, media, merkle, minhash, mixing, oracles, packing, passages, pii, pivots, secretscan, tokenfile, toxicity, urlfilter
from .scratch import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8, over whole ``documents``."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


#: The contract's rules.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` against the five rules; unmatched ones are allowed."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    out = urlfilter.judge(pages, urlfilter.rule_table(spark, URL_RULES), default="allow")
    return out.select("page_id", "host", "path", "rule", "verdict")


@query
def op3_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of ``embeddings`` for every vec_id divisible by 100."""
    return ann.neighbours(read(spark, sf_dir, "embeddings"), k=10, every=100)


@query
def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and disclosing terms of whole ``documents``."""
    return pii.span_table(read(spark, sf_dir, "documents"))


@query
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probabilities and the sample of ``documents``."""
    out = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


@query
def op6_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` as TIFF pages, written and read back."""
    return media.round_trips(read(spark, sf_dir, "documents"))


@query
def media_pages_by_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` written by seven ways of the format in turn, then read page by page."""
    out = media.pages(media.written(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "page", "width", "height", "samples", "bits", F.sha2("pixels", 256).alias("pixels_sha256"), "error")


@query
def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-repeated passages of 50 words or more in whole ``documents``."""
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


@query
def op8_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of whole ``documents``, read back."""
    import public_tokenizers

    return tokenfile.token_table(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of whole ``documents``; the lexicon is learned from ``labels``."""
    return toxicity.toxic_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed by their words and one end token each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", packing.word_count(F.col("text")).alias("n_tokens"))
    return packing.best_fit(docs)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of ``documents``, checked after tampering."""
    return merkle.checked(read(spark, sf_dir, "documents"))


@query
def op12_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern matches and the network's findings in whole ``documents``."""
    return secretscan.span_table(read(spark, sf_dir, "documents"))


@query
def op13_pivot_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings`` for every vec_id divisible by 50."""
    return pivots.hard_negatives(read(spark, sf_dir, "embeddings"))


ORACLES.update(
    op1_minhash_near_dedup=oracles.MINHASH,
    op2_url_filter=oracles.urls(URL_RULES),
    op5_mix_sources=oracles.mix(),
    op11_merkle_manifest=oracles.MERKLE,
    op13_pivot_hard_negatives=oracles.HARD_NEGATIVES,
    media_pages_by_codec=oracles.PAGES,
)
