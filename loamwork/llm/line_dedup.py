"""Line deduplication across documents: hash normalised lines, find those of several documents, reassemble the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, staged, text_of


def line_key(line: Column) -> Column:
    """The line without outer blanks, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, max_documents: int = 1
) -> DataFrame:
    """The input rows with text_col rebuilt from the lines that stay, plus n_lines and n_dropped.

    A key of at least min_chars code points that more than max_documents distinct documents hold loses its
    lines everywhere but in the document with the smallest id. Only hashes and positions are grouped; the
    text moves once, to meet the positions that its row loses. The hashes that many documents hold are written first,
    so the join with them reads both sides from shuffles of its own and adaptive execution can split a hot hash.

    Null or empty texts are one empty line. Rows without id count together as one document after all others.
    Repeated rows of an id are the same document; each is rebuilt from its own lines. Columns named n_lines
    or n_dropped in the input are replaced; other columns pass unchanged.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    body = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = rows.select("row", F.col("row")[id_col].alias("id"), F.xxhash64(body).alias("part"))
    lines = (
        docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
        .select("id", F.xxhash64("body").alias("part"), F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .select("id", "part", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "part", "pos", F.unhex(F.md5("key")).alias("hash"))
    )
    lines = staged(lines, "line-hashes")
    count = (
        F.when(F.min("id") < F.max("id"), 2).otherwise(F.count("id").cast("boolean").cast("int"))
        if max_documents == 1
        else F.count_distinct("id")
    )
    common = (
        lines.groupBy("hash")
        .agg(F.min("id").alias("first_id"), (count + F.max(F.col("id").isNull()).cast("int")).alias("documents"))
        .where(F.col("documents") > max_documents)
        .select("hash", "first_id")
    )
    common = staged(common, "common-lines")
    lost = (
        lines.join(common, "hash")
        .where(~F.col("id").eqNullSafe(F.col("first_id")))
        .groupBy("id", "part")
        .agg(F.collect_set("pos").alias("lost"))
        .withColumnsRenamed({"id": "lost_id", "part": "lost_part"})
    )
    met = rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("part") == F.col("lost_part")), "left")
    met = met.select("row", body.alias("body"), "lost", F.split(body, "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("body")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    )
    #: In a step of their own, so that no input column's name can be taken for one of these.
    met = met.select(
        "row",
        kept.alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return met.select(*own, F.col("kept").alias(text_col), F.col("n_lines"), F.col("n_dropped"))
