"""Connected components of an edge table, without collecting edges or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any orderable type to (node, root): root is the least node that node can reach.

    Large-star and small-star steps alternate until the edges are stars around their roots; each round is
    written to the shared folder, so the plan stays short and lost executors cost one round. What a star's edges meet
    is written as well, so adaptive execution can split the edges of a hub. Nodes without an
    edge to another node have no row. Repeated edges, loops and nulls in an edge are ignored.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "stars-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "stars-large")
        lower = staged(large.groupBy("u").agg(F.min("v").alias("m")), "stars-lower")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(small.unionByName(lower.withColumnRenamed("m", "v")).distinct(), "stars")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
