"""Exact deduplication by 128-bit content hash with a byte comparison inside hash groups. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged, text_of


def md5_128(text: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    content_hash: Callable[[Column], Column] = md5_128,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Grouping by (hash, text) compares the bytes of
    equal hashes; copies are combined before the shuffle, so a group of any size arrives as one row per task.
    Only the hash then travels with the rows, to meet the classes of several rows; those are written first, so that
    adaptive execution can split a hot hash. Hashes shared by different texts (collisions) take a second join on the
    text itself.

    Null texts count as empty. Null ids never win against other ids; a group of null ids only has a null
    keep_id and all of its rows are kept. Repeated rows with the winning id are all kept. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_of(text_col)).alias("body")).withColumn(
        "hash", content_hash(F.col("body"))
    )
    classes = staged(
        rows.groupBy("hash", "body")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", "keep_id", "group_size"),
        "exact-classes",
    )
    by_hash = classes.groupBy("hash").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    by_hash = staged(by_hash.where("group_size > 1 OR texts > 1"), "exact-copies")
    slim = rows.select("doc_id", "hash", F.sha2("body", 256).alias("text_sha256"))
    alone = F.col("texts").isNull()
    found = slim.join(by_hash, "hash", "left").where(alone | (F.col("texts") == 1)).select(
        "hash",
        "doc_id",
        "text_sha256",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
    )
    clashing = by_hash.where("texts > 1").select("hash")
    if not clashing.isEmpty():
        apart = rows.join(clashing, "hash", "left_semi")
        groups = apart.groupBy("hash", "body").agg(
            best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        found = found.unionByName(
            apart.join(groups, ["hash", "body"])
            .withColumn("text_sha256", F.sha2("body", 256))
            .drop("body")
        )
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
