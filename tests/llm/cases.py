"""Small tables with the awkward rows that every operator must handle."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "hash string, body string, key string, part string, row string, slot string, kept string, fp string, root string, id string, lines string, lost string, count long, class long, rank long, keep_id long, n_lines long"


def awkward(seed: int = 0) -> list[tuple]:
    """Null and empty texts, null ids, repeated rows, ties, other scripts, and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉß") for _ in range(rng.randint(1, 7)))
    texts = ["\n".join(" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    texts += [None, "", "", "\n", " \t\r\n ", "ÀB c", "àB c", "Same line here\nother", "x\n  SAME LINE HERE\t\nx", "日本語 のテキスト 😀", "a" * 3000, "word " * 2000]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    rows += [(100 + i, rows[i % 7][1], None, None, 1) for i in range(12)]
    rows += [(None, "Same line here\nother", "de", "t", 3), (None, None, None, None, None), rows[3], rows[3], (3, "another text of the same id", "en", "s", 5)]
    rng.shuffle(rows)
    return rows


def table(spark: SparkSession, rows: list[tuple], extra: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        for field in CLASHING.split(", "):
            name, kind = field.split()
            df = df.selectExpr("*", f"cast('7' AS {kind}) AS `{name}`")
    return df


def norm(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def skew_split(spark: SparkSession, make) -> bool:
    """Whether adaptive execution splits a hot key of the frame that make() gives, with thresholds of a few KB."""
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        df = make()
        df.collect()
        return "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
