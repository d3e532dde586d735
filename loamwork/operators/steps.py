"""Small steps of reports, samples and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import staged


def overlaps(tokens: DataFrame, spans: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Pairs of tokens (key, token, start, end) and spans (key, span, char_start, char_end) that overlap, half-open.

    Both meet in cells of `width` characters, so no token is held against all spans of its key; a pair counts in
    the cell where the later of the two begins.
    """
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    left = tokens.where("end > start").withColumn("__c", cell("start", "end"))
    right = spans.where("char_end > char_start").withColumn("__c", cell("char_start", "char_end"))
    met = left.join(right, [key, "__c"]).where("end > char_start AND start < char_end")
    return met.where(F.col("__c") == F.floor(F.greatest("start", "char_start") / width)).drop("__c")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with the columns of the table's row of the same composite key (of several rows the least); null without one."""
    least = F.min(F.struct(*columns)).alias("__found")
    return rows.join(table.groupBy(*keys).agg(least), keys, "left").select(*(c for c in rows.columns if c not in columns), *(F.col(f"__found.{c}").alias(c) for c in columns))


def with_lineage(rows: DataFrame, accepted: DataFrame, key: str, source: str) -> DataFrame:
    """Rows of accepted documents with their source's id."""
    return rows.join(accepted.select(key, source), key)


def review_card(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows, mean and median (between the middle two of an even number) of a value for each reason."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.median(value).alias("median"))


def totals(tables: dict[str, DataFrame], **sums: tuple[str, Column]) -> DataFrame:
    """One row: the number of rows of each table, and for each name in sums a sum over (table, column)."""
    out = None
    for name, df in tables.items():
        own = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(s) for s, (t, c) in sums.items() if t == name]
        one = df.agg(F.count(F.lit(1)).alias(f"n_{name}"), *own)
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    return out


def generation_stats(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """One row: planned, generated, skipped (done before) and left."""
    known = done.select(*keys).distinct().withColumn("__done", F.lit(True))
    met = planned.join(known, keys, "left")
    existing = F.col("__done").isNotNull()
    return met.agg(F.count(F.lit(1)).alias("processed"), F.count_if(~existing).alias("generated"), F.count_if(existing).alias("skipped_existing"))


def head_of_each(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each split in the given order. Each task keeps n of a split before the shuffle (group limit)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def every_nth(df: DataFrame, order: str, n: int, most: int) -> DataFrame:
    """Rows 0, n, 2n, ... in order, at most `most`: a systematic sample. order is a column that tells all rows apart.

    Ranges of the order are counted first, so that rows are numbered in many tasks.
    """
    ranged = staged(df.repartitionByRange(F.col(order)).select("*", F.spark_partition_id().alias("__p")), "systematic")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__p").count().withColumn("__s", F.coalesce(F.sum("count").over(before), F.lit(0)))  # a row for each task
    own = F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1 + F.col("__s")
    placed = ranged.join(F.broadcast(starts.select("__p", "__s")), "__p").withColumn("__i", own)
    return placed.where((F.col("__i") % n == 0) & (F.col("__i") < n * most)).drop("__p", "__s", "__i")


def longest(df: DataFrame, by: str, text: str, order: str) -> DataFrame:
    """For each key its longest candidate; of equally long ones the first in order."""
    return df.groupBy(by).agg(F.max_by(text, F.struct(F.char_length(text), -F.col(order))).alias(text))


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in order (the --limit of a command); the rest isn't sorted whole."""
    return df.orderBy(*order).limit(n)


def not_subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of a that b lacks; none if a is a subset."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def without_completed(tasks: DataFrame, log: DataFrame, key: str, interrupted: str) -> DataFrame:
    """Tasks whose last run in the log wasn't completed; an interrupted run counts as none."""
    done = log.where(~F.coalesce(F.col(interrupted), F.lit(False))).select(key).distinct()
    return tasks.join(done, key, "left_anti")
