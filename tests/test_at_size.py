"""Forms that hold at size: exact shares, joins that no broadcast carries, folds that see one document at a time."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from loamwork.operators import dedup as D
from loamwork.plans import registry


def rows_of(spark, tmp_path, name, docs, columns=("doc_id", "lang", "source", "text")):
    """The query's rows over these documents, and those of its SQL."""
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").select(*columns).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()), key=repr)
    if name not in registry.oracle_sql():
        return got, df
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return got, sorted(con.execute(registry.oracle_sql()[name]).fetchall(), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strata_whose_share_is_a_half(spark, tmp_path):
    docs = [(g * 1000 + i, f"l{g}", "s", "x") for g in (7, 10, 45, 85) for i in range(g)]
    got, want = rows_of(spark, tmp_path, "stratified_split", docs)
    assert got == want


def test_title_pairs_meet_without_a_broadcast(spark):
    rng = random.Random(3)
    words = ["data", "base", "systems", "modern", "query", "plans", "cost", "models", "graph", "joins"]
    rows = [(i, " ".join(rng.sample(words, rng.randint(2, 6)))) for i in range(120)]
    df = D.fuzzy_pairs(spark.createDataFrame(rows, "id int, core string"), "id", "core", loose=None)
    assert "Broadcast" not in plan(df)
    first = {}
    for i, c in rows:
        first.setdefault(c, i)
    want = {(first[c], i) for i, c in rows if first[c] != i}
    for x, i in first.items():
        for y, j in first.items():
            a, b, short, long = set(x.split()), set(y.split()), min(len(x), len(y)), max(len(x), len(y))
            inside = short >= 20 and (x in y or y in x) and short / long >= 0.82
            if i < j and (inside or long - short <= long * 0.3 and len(a & b) / len(a | b) >= 0.8):
                want.add((i, j))
    assert {(r.a, r.b) for r in df.collect()} == want


def test_close_values_meet_without_a_broadcast(spark):
    values = [0, 7, 15, 1 << 40, -1, -8]
    df = D.close_pairs(spark.createDataFrame([(v,) for v in values], "s long"), "s", 3)
    assert "Broadcast" not in plan(df)
    near = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert {tuple(r) for r in df.collect()} == near


def test_keywords_combine_in_their_rows_and_repeated_ids_count_once(spark, tmp_path):
    docs = [(1, "en", "s", "word word other ½words"), (1, "en", "s", "word Other"), (2, "en", "s", "WORD\nother"), (3, "en", "s", None), (4, "en", "s", "Straße straße")]
    got, want = rows_of(spark, tmp_path, "topk_keywords", docs)
    assert got == want
    df = registry.queries()["topk_keywords"](spark, str(tmp_path))
    assert "Generate inline" in plan(df) and "LeftAnti" in plan(df)


def test_folds_take_groups_as_arrays(spark, tmp_path):
    docs = [(i, "en", "s", "\n".join(f"line {k} of it, and\nmore words here." for k in range(i))) for i in range(1, 40)]
    for name in ("packed_passages", "healed_sentences", "merged_sentences", "model_windows", "segmented_sentences"):
        got, df = rows_of(spark, tmp_path, name, docs)
        assert len(got) == 39 and not re.search("FlatMapGroupsInPandas|MapInPandas", plan(df)), name


def test_copies_of_lines_are_counted_without_a_join(spark, tmp_path):
    docs = [(i, "en", "s", f"a line of twenty characters and more\nanother such line, number {i % 4}\nshort") for i in range(30)]
    got, want = rows_of(spark, tmp_path, "line_fingerprint_dedup", docs, ("doc_id", "lang", "source", "text"))
    assert got == want
    assert "Join" not in plan(registry.queries()["line_fingerprint_dedup"](spark, str(tmp_path)))


def test_languages_and_tags_at_their_edges(spark, tmp_path):
    docs = [(i, "en", s, t) for i, (s, t) in enumerate([("src1", None), ("src12", ""), ("src1", "the và của"), ("src1", "Apothe the_ token = x"), ("src1", "token = error, COPYRIGHT"), ("src1", "other theme"), ("src2", "được")])]
    for name in ("detected_language", "topic_filter_tags"):
        got, want = rows_of(spark, tmp_path, name, docs)
        assert got == want, name
