"""Joins of the corpus build: lookups with precedence, provenance, inheritance, overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gather(parents: DataFrame, ids: str, children: DataFrame, child_id: str, key: str, value: str) -> DataFrame:
    """key and the children's values in the order of the parent's array of ids; ids without a child are left out."""
    asked = parents.select(key, F.posexplode(ids).alias("__pos", child_id))
    met = asked.join(children.select(child_id, F.col(value).alias("__v")), child_id)
    ordered = F.array_sort(F.collect_list(F.struct("__pos", "__v")))
    return met.groupBy(key).agg(F.transform(ordered, lambda x: x["__v"]).alias(value))


def coalesced(base: DataFrame, key: str, tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Left joins on key; columns maps each output to its sources table.column in order, the first non-null wins."""
    out = base.alias("base")
    for name, df in tables.items():
        out = out.join(df.alias(name), F.col(f"base.{key}") == F.col(f"{name}.{key}"), "left")
    return out.select(F.col(f"base.{key}").alias(key), *(F.coalesce(*map(F.col, sources)).alias(c) for c, sources in columns.items()))


def by_first_key(rows: DataFrame, row_id: str, keys: list[str], files: DataFrame, file_key: str, prefer: Column, order: Column) -> DataFrame:
    """rows with the file that the first of their keys finds; of several files the preferred, then in order.

    Each key is one equi-join; the pick looks only at a row's own candidates.
    """
    w = Window.partitionBy(file_key).orderBy(F.when(prefer, 0).otherwise(1), order)
    picked = files.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    out = rows
    for i, k in enumerate(keys):
        side = picked.select(F.col(file_key).alias(f"__k{i}"), F.struct("*").alias(f"__f{i}"))
        out = out.join(side, out[k] == side[f"__k{i}"], "left").drop(f"__k{i}")
    found = F.coalesce(*(F.col(f"__f{i}") for i in range(len(keys))))
    return out.withColumn("file", found).drop(*(f"__f{i}" for i in range(len(keys))))


def inventory_status(has_pdf: Column, found: Column, outcome: Column) -> Column:
    """Status of a crawled record: metadata_only, missing, present but not accepted, or present."""
    return (
        F.when(~has_pdf & found.isNull(), "metadata_only")
        .when(found.isNull(), "pdf_missing_from_local")
        .when(outcome != "accepted", "pdf_present_not_accepted")
        .otherwise("pdf_present")
    )


def frozen_split(rows: DataFrame, frozen: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """rows with the split that any of their keys has in the frozen manifest; more than one is a conflict (error)."""
    out = rows
    for i, k in enumerate(keys):
        side = frozen.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"__k{i}")).agg(F.collect_set(split).alias(f"__s{i}"))
        out = out.join(side, out[k] == side[f"__k{i}"], "left").drop(f"__k{i}")
    found = F.array_distinct(F.flatten(F.array_compact(F.array(*(F.col(f"__s{i}") for i in range(len(keys)))))))
    out = out.withColumn("__found", found).drop(*(f"__s{i}" for i in range(len(keys))))
    conflict = F.raise_error(F.concat(F.lit("conflicting frozen splits: "), F.array_join("__found", ","))).cast("string")
    return out.withColumn("frozen_split", F.when(F.size("__found") > 1, conflict).otherwise(F.get("__found", F.lit(0)))).drop("__found")


def provenance(passages: DataFrame, key: str, text: str, pages: DataFrame, page_text: str, words: int = 4, share: float = 0.5) -> DataFrame:
    """Share of each passage's word shingles that any page holds, and whether it reaches `share`.

    Shingles meet by hash, so no passage is searched in every page.
    """
    def shingles(df: DataFrame, col: str, *keep: str) -> DataFrame:
        ws = F.regexp_extract_all(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
        df = df.select(*keep, ws.alias("ws")).where(F.size("ws") >= words)
        each = F.transform(F.sequence(F.lit(0), F.size("ws") - words), lambda i: F.xxhash64(F.array_join(F.slice("ws", i + 1, words), " ")))
        return df.select(*keep, F.explode(F.array_distinct(each)).alias("h"))

    own = shingles(passages, text, key)
    held = own.join(shingles(pages, page_text), "h", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    total = own.groupBy(key).agg(F.count(F.lit(1)).alias("shingles"))
    out = total.join(held, key, "left").na.fill(0, ["found"])
    return out.withColumn("share", F.round(F.col("found") / F.col("shingles"), 4)).withColumn("verbatim", F.col("found") / F.col("shingles") >= share)


def overlapping(spans: Column, start: Column, end: Column) -> Column:
    """Of an array of (start, end) those that overlap the half-open range."""
    return F.filter(spans, lambda s: (s["end"] > start) & (s["start"] < end))


def inherited(children: DataFrame, parents: DataFrame, key: str, column: str) -> DataFrame:
    """Children whose value differs from the parent's (error) or whose parent is absent (warning)."""
    p = parents.select(F.col(key).alias("__k"), F.col(column).alias("__v"))
    met = children.join(p, children[key] == p["__k"], "left")
    severity = F.when(F.col("__k").isNull(), "warning").when(~F.col(column).eqNullSafe(F.col("__v")), "error")
    return met.withColumn("severity", severity).where("severity IS NOT NULL").drop("__k", "__v")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side that lacks them: missing (only in a) or unexpected (only in b)."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        right.join(left, key, "left_anti").withColumn("side", F.lit("unexpected"))
    )


def guarded_prune(active: DataFrame, disk: DataFrame, key: str, digest: str) -> DataFrame:
    """Files on disk that aren't active. Refuses if an active file is missing on disk or has changed since."""
    present = disk.select(F.col(key).alias("__k"), F.col(digest).alias("__d"))
    met = active.join(present, active[key] == present["__k"], "left")
    bad = met.where(F.col("__k").isNull() | (F.col(digest) != F.col("__d"))).select(key).limit(1)
    if not bad.isEmpty():
        raise ValueError("an active source is missing or has changed; nothing is pruned")
    return disk.join(active.select(key), key, "left_anti")


def last_non_empty(df: DataFrame, key: str, precedence: str, columns: list[str]) -> DataFrame:
    """For each key and column the non-empty value with the highest precedence."""
    given = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(precedence))
    return df.groupBy(key).agg(*(F.max_by(c, given(c)).alias(c) for c in columns))


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
