"""The corpus pipeline: language, near duplicates, benchmark passages, source mix and token files, each on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next one. All but the last return the columns
of documents; the last returns doc_id, start, n_tokens and ids_crc32 as they
read back from the token files, a row for each copy that the mix takes.

Defined results: rows with null or empty text go with language_id, as they have
no letter; rows that repeat a doc_id and a text stay until near_dedup, which
keeps all rows of the smallest doc_id of a group; null ids are kept and never
linked; a very long text is handled whole; an empty table stays empty through
all stages; columns of other names, such as those that an operator adds
itself, are carried on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, langid, minhash_dedup, mixing, queries
from parley.llm._shared import Scratch
from parley.shipping import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learned language claims go: those without a letter, and those that every language codes badly."""
    ship(spark)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0)) == 1
    return langid.keep_identified(docs, langid.fit(docs, ~held_out))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, a similarity of 0.8 or more."""
    return minhash_dedup.deduplicate(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in code-point order weigh 1, 2, 3, repeating; each document stays as often as it is taken."""
    return mixing.mixed(docs, weights=(1, 2, 3))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, summed up as they read back."""
    return queries.token_summary(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Learned language models, sketches and tokenizers are not expressible in SQL. Tests hold near_dedup and decontamination to brute-force versions; of the other stages, the tests of their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), ""
    try:
        for name, stage in STAGES:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
            if before:
                scratch.delete(before)
            before = name
    except BaseException:
        scratch.delete()
        raise
    return docs
