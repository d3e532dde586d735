"""Mixing sources to target weights by hierarchical budgeting over a tree such as domain, language, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: A word is a run of anything but [\x20\x09-\x0D]; n_tokens counts words unless a token column is given.
WORD = r"[^\x20\x09-\x0D]+"


def filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Nodes (parent columns, name, cap, weight, budget of the parent) with column alloc.

    Children share their parent's budget by weight; what a child cannot take (its cap) goes to its siblings, by
    weight again. In order of cap / weight the children that are full come first, so one pass of running sums
    finds them. Shares are whole tokens and add up to the budget exactly, which is at most the sum of caps.
    Products are decimals of 38 digits, so budget * sum of weights may reach 10**38.
    """
    wide = "decimal(38,0)"
    nodes = nodes.withColumns({c: F.col(c).cast(wide) for c in ("cap", "weight", "budget")})
    ratio = F.col("cap").cast("double") / F.col("weight").cast("double")
    order = Window.partitionBy(*parent).orderBy(ratio, F.col(name).asc_nulls_first())
    above, below = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumn("before", F.coalesce(F.sum("cap").over(above), F.lit(0)).cast(wide))
    nodes = nodes.withColumn("left", F.sum("weight").over(below).cast(wide))
    full = F.col("cap") * F.col("left") <= (F.col("budget") - F.col("before")) * F.col("weight")
    nodes = nodes.withColumn("full", full)
    nodes = nodes.withColumn("rest", (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))).cast(wide))
    nodes = nodes.withColumn("shares", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole).cast(wide))
    nodes = nodes.withColumn("past", (F.col("shares") - F.col("left")).cast(wide))
    cut = lambda c: F.expr(f"({c} * rest) div shares")
    alloc = F.when(F.col("full"), F.col("cap")).otherwise(cut("(past + weight)") - cut("past"))
    return nodes.withColumn("alloc", alloc.cast("long")).drop("before", "left", "full", "rest", "shares", "past", "budget")


def mixed(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[str, Column],
    budget_per_mille: int = 1000,
    max_epochs: int = 4,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    temper: float | None = None,
) -> DataFrame:
    """The input rows as column `row`, with columns for the levels, n_tokens and copies (how often the row is taken).

    levels names the tree from the root's children to the leaves, each with its column; weights has a positive
    integer for each level's node (an expression over the level's column). With `temper` a leaf weighs its
    tokens to that power instead and an inner node the sum of its leaves. The budget is budget_per_mille of all
    tokens, at most what max_epochs of every leaf hold. A leaf takes whole epochs while its budget lasts; of the
    next epoch, in the order of md5(seed:epoch:id), it takes documents until its tokens reach the budget.

    Rows of the same leaf and id come at the same place and are taken together. Null texts have no tokens; null
    levels are a node of their own; null ids count as the id ''. Leaves without tokens take nothing. An empty
    table gives an empty result.
    """
    names = list(levels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in levels.items()))
    tokens = F.regexp_count(F.coalesce(F.col("row")[text_col], F.lit("")), F.lit(WORD)).cast("long")
    rows = rows.withColumn("n_tokens", tokens)
    key = F.coalesce(F.col("row")[id_col].cast("string"), F.lit(""))
    slim = staged(rows.select(*names, "n_tokens", key.alias("id")), "mix-tokens")
    leaves = staged(slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    size = F.greatest(F.floor(F.pow("tokens", F.lit(temper or 1.0))), F.lit(1)).cast("long")
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs).withColumn("size", size)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"))
    total = total.select(F.least(F.expr(f"tokens * {budget_per_mille} div 1000"), "cap").alias("alloc"))
    same = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    level, above = total, []
    for i, name in enumerate(names):
        path = names[: i + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("size").alias("size"))
        nodes = nodes.withColumn("weight", F.col("size") if temper else weights[name].cast("long")).drop("size")
        up = level.withColumnRenamed("alloc", "budget")
        if above:
            up = up.select(*(F.col(c).alias(f"up_{c}") for c in above), "budget")
            nodes = nodes.join(up, [nodes[c].eqNullSafe(up[f"up_{c}"]) for c in above]).drop(*(f"up_{c}" for c in above))
        else:
            nodes = nodes.crossJoin(F.broadcast(up))  # one row
        level, above = filled(nodes, above, name).select(*path, "alloc"), path
    plan = leaves.select(*names, "tokens").join(level.select(*(F.col(c).alias(f"l_{c}") for c in names), "alloc"), [leaves[c].eqNullSafe(F.col(f"l_{c}")) for c in names])
    plan = staged(
        plan.where("tokens > 0").select(
            *names, F.expr("alloc div tokens").alias("epochs"), (F.col("alloc") % F.col("tokens")).alias("rest")
        ),
        "mix-plan",
    )
    #: The place of an id in a leaf's next epoch; running sums go through 256 parts of the order at once.
    place = lambda id_, epochs: F.md5(F.concat_ws(":", F.lit(str(seed)), epochs.cast("string"), id_))
    asked = plan.select(*(F.col(c).alias(f"p_{c}") for c in names), "epochs", "rest")
    on = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in names]
    placed = slim.join(asked.where("rest > 0"), on).withColumn("place", place(F.col("id"), F.col("epochs")))
    placed = placed.groupBy(*names, "rest", "place").agg(F.sum("n_tokens").alias("tokens")).withColumn("part", F.substring("place", 1, 2))
    parts = placed.groupBy(*names, "part").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(c).alias(f"p_{c}") for c in names), F.col("part").alias("p_part"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*names, "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    placed = placed.join(parts, on + [F.col("part") == F.col("p_part")]).withColumn("before", before)
    last = placed.where("before < rest").groupBy(*names).agg(F.max("place").alias("last"))
    last = last.select(*(F.col(c).alias(f"q_{c}") for c in names), "last")
    plan = plan.join(last, [plan[c].eqNullSafe(F.col(f"q_{c}")) for c in names], "left").select(*names, "epochs", "last")
    plan = staged(plan, "mix-cuts").select(*(F.col(c).alias(f"p_{c}") for c in names), "epochs", "last")
    copies = F.col("epochs") + F.when(place(key, F.col("epochs")) <= F.col("last"), 1).otherwise(0)
    return rows.join(plan, on, "left").select(
        "row", *names, "n_tokens", F.coalesce(copies, F.lit(0)).cast("long").alias("copies")
    )


def weight_of(column: str, given: dict[str, int], otherwise: int = 1) -> Column:
    """The weight of each value of a level."""
    out = F.lit(otherwise)
    for value, weight in given.items():
        out = F.when(F.col(column) == value, weight).otherwise(out)
    return out
