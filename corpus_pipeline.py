"""A training-data pipeline over `documents`: toxic documents, repeated lines and near-duplicates go, sources are
mixed, and what is left is encoded.

Each stage works on all rows that its predecessor kept and returns the columns of documents, but the last one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.byte_bpe import decode_documents, encode_documents
from loamwork.llm.common import staged
from loamwork.llm.contract import mix_levels, mix_weights
from loamwork.llm.line_dedup import line_dedup
from loamwork.llm.mixing import mixed
from loamwork.llm.near_dups import without_near_duplicates
from loamwork.llm.toxicity import score, train

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for toxic (probability 0.5 or more) go; the classifier learns from labels.

    Null and empty texts score like a word without letters. Without labels of both kinds all have the same score.
    An empty table gives an empty result. Repeated rows stay or go together.
    """
    scorer = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, scorer, out="__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 10 characters that several documents hold stay in the document with the smallest id only.

    n_chars follows the text that stays. Null texts become empty; rows without id count as one document after all
    others; repeated rows are one document. An empty table gives an empty result.
    """
    columns = docs.columns
    kept = line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group whose five-word shingles are similar by 0.8 or more: that with the smallest id.

    Texts without words are equal to each other. Null ids come last; of rows of the same id the one with the least
    hash of its columns stays, of rows equal in all columns one. An empty table gives an empty result.
    """
    return without_near_duplicates(docs, shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as before, dealt over domain, language and source to the target weights of op1_mix; rows repeat by epoch.

    A leaf gives at most four epochs; what it cannot give goes to its siblings first. Null texts have no words and are
    taken with their leaf's whole epochs only; null levels are a node of their own. An empty table gives an empty result.
    """
    taken = mixed(docs, mix_levels(), mix_weights(), max_epochs=4)
    copies = F.explode(F.expr("array_repeat(0, cast(copies AS int))"))
    return taken.where("copies > 0").select("row", copies).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document as digests, with the digest of the decoded bytes. Null texts are empty: no tokens."""
    encoded = encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    return decode_documents(encoded, RANKS).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: A trained classifier, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
