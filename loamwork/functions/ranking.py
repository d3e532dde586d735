"""Numbering and running sums of groups of any size: each group is worked on in parts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, within: list[str], order: str, name: str, part_chars: int = 2) -> DataFrame:
    """Number the rows of each group from 1 in the order of a hex digest column.

    The digest's first characters divide a group into parts that keep its order; a part's numbers start after
    the counts of the parts before it, so no task sees a whole group.
    """
    df = df.withColumn("__part", F.substring(order, 1, part_chars))
    keys = [*within, "__part"]
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = df.withColumn("__own", own).alias("a").join(starts.alias("b"), on)
    return joined.select(
        *(F.col(f"a.{c}") for c in df.columns if c != "__part"), (F.col("__own") + F.col("__start")).cast("long").alias(name)
    )


def order_statistics(df: DataFrame, within: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """For each group the values at index floor(p * n) of its sorted values, exactly.

    Values are counted first, so the sort is over distinct values and no list of values is collected.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*within, value).count()
    whole = Window.partitionBy(*within)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("__upto", F.sum("count").over(upto)).withColumn("__n", F.sum("count").over(whole))
    picks = [F.min(F.when(F.col("__upto") > F.floor(F.col("__n") * p), F.col(value))).alias(name) for name, p in at.items()]
    return counted.groupBy(*within).agg(
        F.sum("count").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.round(F.sum(F.col(value) * F.col("count")) / F.sum("count"), 4).alias("mean"), *picks,
    )
