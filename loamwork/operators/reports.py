"""Counts and summaries of whole tables in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.storage import staged


def counters(df: DataFrame, dims: list[str], missing: str = "unknown") -> DataFrame:
    """dim, value, n: how often each value of each column occurs. One scan; null counts as `missing`."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit(missing)).alias("value")) for d in dims))
    return df.select(F.inline(pairs)).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


def curation_summary(df: DataFrame, by: str, tokens: Column, least: int) -> DataFrame:
    """Input, eligible and short rows, tokens and share of the eligible, for each value of a column."""
    ok = tokens >= least
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("input"),
        F.count_if(ok).alias("eligible"),
        F.count_if(~ok).alias("short"),
        F.sum(F.when(ok, tokens)).cast("long").alias("eligible_tokens"),
        F.round(100.0 * F.count_if(ok) / F.count(F.lit(1)), 2).alias("eligible_share"),
    )


def term_totals(df: DataFrame, pattern: str, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """name, n, n_docs of each match of a pattern in the lower-cased texts: occurrences and distinct ids with it.

    A document's terms are told apart inside its row, so counts combine before the shuffle, which carries each term
    once a task; only the rows of repeated ids are counted by term and id.
    """
    terms = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(pattern), F.lit(0))
    repeated = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col(id_col).alias("__id"))
    repeated = staged(repeated, "repeated-ids")  # few: small enough then to meet the texts without a shuffle of them
    here = F.col(id_col).eqNullSafe(F.col("__id"))
    single = df.join(repeated, here, "left_anti").select(T.bound(terms, lambda ts: F.concat(
        F.transform(ts, lambda t: F.struct(t.alias(name), F.lit(1).alias("n"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct(ts), lambda t: F.struct(t.alias(name), F.lit(0).alias("n"), F.lit(1).alias("d"))),
    )).alias("ts")).select(F.inline("ts")).groupBy(name).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    several = df.join(repeated, here, "left_semi").select(id_col, F.explode(terms).alias(name)).groupBy(name, id_col).agg(F.count(F.lit(1)).alias("n"))
    several = several.groupBy(name).agg(F.sum("n").alias("n"), F.count(id_col).alias("d"))
    return single.unionByName(several).groupBy(name).agg(F.sum("n").alias("n"), F.sum("d").alias("n_docs"))


def quality_flags(df: DataFrame, **flags: Column) -> DataFrame:
    """One row: how many rows each flag holds for."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()))


def state_report(tables: dict[str, DataFrame], key: str, states: list[str]) -> DataFrame:
    """Rows of each table and state for each key; a row's state is the first of its true columns, in order of states."""
    parts = []
    for name, df in tables.items():
        state = F.lit(None)
        for s in reversed(states):
            state = F.when(F.col(s), F.lit(s)).otherwise(state)
        parts.append(df.select(key, F.concat(F.lit(f"{name}_"), state).alias("what")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = [f"{t}_{s}" for t in tables for s in states]
    return out.groupBy(key).pivot("what", names).count().na.fill(0, names)


def delta(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """key, now, before, change of a counter against its stored state."""
    n, b = now.select(key, F.col(value).alias("now")), before.select(key, F.col(value).alias("before"))
    joined = n.join(b, key, "full").na.fill(0, ["now", "before"])
    return joined.withColumn("change", F.col("now") - F.col("before"))
