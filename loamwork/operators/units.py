"""Lines of documents as ordered units, and windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = " \t\r"


def lines_of(text: Column) -> Column:
    """Trimmed lines of a text that aren't blank."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)))
    return F.filter(trimmed, lambda x: x != "")


def lines(docs: DataFrame, *keep: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kept columns, ordinal (from 0) and text of each line that isn't blank."""
    return docs.select(key, *keep, F.posexplode(lines_of(F.col(text))).alias("ordinal", "line"))


def within(key: str = "doc_id", order: str = "ordinal"):
    """A document's lines in order: documents spread over tasks, and no group is larger than a document."""
    return Window.partitionBy(key).orderBy(order)


def with_offsets(units: DataFrame, key: str = "doc_id", gap: int = 2, text: str = "line") -> DataFrame:
    """start and end of each unit in the document rebuilt with gaps of that many characters."""
    before = F.sum(F.char_length(text) + gap).over(within(key).rowsBetween(Window.unboundedPreceding, -1))
    units = units.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))
    return units.withColumn("end", F.col("start") + F.char_length(text))


def islands(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Runs of equal consecutive values: key, island (from 1), value, n and first position."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise(changed)
    numbered = rows.withColumn("__c", changed).withColumn("island", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min(value).alias(value), F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at"))


def carried(units: DataFrame, heading: Column, name: str, key: str = "doc_id") -> DataFrame:
    """The latest heading at or before each unit."""
    w = within(key).rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn(name, F.last(F.when(heading, F.col("line")), ignorenulls=True).over(w))


def body_start(units: DataFrame, heading: Column, ahead: int = 30, least: int = 800, key: str = "doc_id") -> DataFrame:
    """The first heading of each document that at least `least` prose characters follow within `ahead` units."""
    prose = F.when(~heading, F.char_length("line")).otherwise(0)
    follows = F.coalesce(F.sum(prose).over(within(key).rowsBetween(1, ahead)), F.lit(0))
    marked = units.withColumn("__h", heading).withColumn("__f", follows)
    return marked.groupBy(key).agg(
        F.min(F.when(F.col("__h") & (F.col("__f") >= least), F.col("ordinal"))).alias("start_ordinal"), F.count(F.lit(1)).alias("n_lines")
    )


def gaps(units: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose position isn't one more than the one before (or 0 at the start), with the position expected."""
    w = Window.partitionBy(key).orderBy(order)
    expected = F.coalesce(F.lag(order).over(w), F.lit(-1)) + 1
    return units.withColumn("expected", expected).where(F.col(order) != F.col("expected")).select(key, order, "expected")


def without_runs(lines_: Column) -> Column:
    """An array of lines without those equal to the one before, per row and without a shuffle."""
    return F.filter(lines_, lambda x, i: (i == 0) | (F.get(lines_, i - 1) != x))
