"""From raw documents to token ids: quality rules, near duplicates, mixing, encoding.

Every stage works on all that its predecessor kept. The first three return the
columns of `documents`; the last one returns `doc_id`, `source` and the token ids.
Documents that the mix repeats come as so many rows.

Every stage has a defined result for odd rows. Null and empty texts have no words, so
the quality rules reject them; given to a later stage they are linked with nothing,
have size 0 in the mix, which takes none of them, and have no tokens. Null ids, sources
and languages are values like others: one row of null id stays for each text, and null
sources are one source. Of repeated rows and of ties the deduplication keeps one (the
smallest id); the mix and the encoder treat each row by itself. Texts of any length are
taken whole, an empty table stays empty, and further columns go along, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import bpe, catalog, mixing, ngram_join, quality_rules
from runloom.session import park


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return quality_rules.apply_policy(docs, "v2")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return ngram_join.keep_one(docs, n=5, similarity=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.repeat(docs, weights=(3, 1, 2), share=1.5, max_epochs=2.0)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text."""
    coded = bpe.encode(docs, catalog.vocabulary(), keep=("doc_id", "source"))
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [("quality_rules", keep_good), ("ngram_join", keep_one_of_each), ("mixing", mix_sources), ("bpe", encode_texts)]
#: Token ids can not be expressed in SQL; tests/llm compares run() with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = park(stage(spark, docs, sf_dir), name)
    return docs
