"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import staged as staged

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What [\x20\x09-\x0D] holds.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in; other text keeps its other letters as they are."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a worker makes of one stays small beside the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
