"""JSON-lines, binary and page-table scans, partitioned and append sinks, checksum manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType, bad: str = "fail") -> DataFrame:
    """JSON lines with an explicit schema; bad lines fail, are skipped, or are kept in column _corrupt_record."""
    mode = {"fail": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad]
    if bad == "keep":
        schema = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_with_precedence(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """JSON lines of several files in order: column precedence grows with the file's place in the list."""
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    place = F.lit(-1)
    for i, p in enumerate(paths):
        place = F.when(name == p.rstrip("/").rsplit("/", 1)[-1], i).otherwise(place)
    return spark.read.schema(schema).json(paths).withColumn("precedence", place)


def read_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, content of all files below root that fit the pattern, in no order."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def audited(files: DataFrame) -> DataFrame:
    """path, bytes, sha256, magic and font count of binary files (fonts in the first 500 KB)."""
    head = F.decode(F.substring("content", 1, 500_000), "ISO-8859-1")
    return files.select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.left(head, F.lit(5)).alias("magic"),
        F.regexp_count(head, F.lit("/Font")).alias("fonts"),
    )


def pages_of(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page_index, text, error of each page by an extractor (content -> page texts); a failure is one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(extract(bytes(content)))]
                except Exception as failure:  # any library's error becomes an audit row
                    rows.append((path, -1, None, f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(rows, columns=["path", "page_index", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_index int, text string, error string")


def write_splits(df: DataFrame, path: str, by: str = "split", kind: str = "parquet") -> None:
    """One folder for each value; fails if the path exists, as releases never change."""
    df.write.mode("errorifexists").partitionBy(by).format(kind).save(path)


def append(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("append").format(kind).save(path)


def projected(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there, in order."""
    return df.select(*(c for c in wanted if c in df.columns))


def sealed(spark: SparkSession, root: str, own: str = "checksums") -> DataFrame:
    """sha256 and path below root of every file but the manifest itself."""
    files = read_files(spark, root, "*")
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = root.split("://")[-1].rstrip("/")
    relative = F.substring(path, len(base) + 2, 1_000_000)
    return files.select(F.sha2("content", 256).alias("sha256"), relative.alias("path")).where(~F.startswith("path", F.lit(own)))


def owners(rows: DataFrame, path: str, order: str) -> DataFrame:
    """rows with the first row's id of those that point at the same file."""
    w = Window.partitionBy(path).orderBy(order)
    return rows.withColumn("owner", F.when(F.col(path).isNotNull(), F.first(order).over(w)))
