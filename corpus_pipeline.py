"""The corpus pipeline: five stages, each one operator of ``riskspark.llm``, from documents to tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, langid, line_dedup, mixing, ngram_join
from riskspark.llm.common import table
from riskspark.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, ``n_chars`` being that of the text as it now is."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, under the language found; those that none explains go."""
    model = langid.fit(docs.where(langid.training_rows()))
    named = langid.identify(docs, model).where("explained")
    return named.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; those of which nothing is left go."""
    cleaned = line_dedup.remove_boilerplate(docs)
    emptied = (F.col("n_removed") > 0) & (F.regexp_count("text", F.lit(r"\S")) == 0)
    return _counted(cleaned.where(~F.coalesce(emptied, F.lit(False))), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words to a shingle, a similarity of 0.8 or more."""
    return ngram_join.one_per_group(docs, width=5, percent=80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row per document and pass, with the words that the pass takes."""
    return _counted(mixing.mixed_documents(docs), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per row of the mix, with digests of the ids and of what they decode to.

    Ids are stored before they are decoded: one Python worker a core holds the vocabulary then, and not two.
    """
    encoded = cut_lineage(bpe.encode(docs.select("doc_id", "text")).drop("text"), "ids")
    return bpe.digests(bpe.decode(encoded)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Learned models, pseudorandom permutations and tokens are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table, each one's result being stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = cut_lineage(docs, "stage")
    return docs
