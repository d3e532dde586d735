"""Merges, normal forms and titles at their edges, and the driver entry without optional parts."""

import subprocess
import sys
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loamwork.functions import storage
from loamwork.functions import text as T
from loamwork.operators import dedup as D
from loamwork.operators import steps as S


def kept(rows):
    ids, titles, out = set(), set(), []
    for n, i, t in rows:
        if i in ids or (t and t in titles):
            continue
        out.append(n)
        ids.add(i)
        titles |= {t} - {""}
    return out


CASES = [
    [(1, "a", "x"), (2, "a", "y"), (3, "b", "y")],  # the dropped second row registers no title
    [(1, "a", "x"), (2, "b", "x"), (3, "b", "z")],
    [(1, "a", ""), (2, "b", ""), (3, "a", "t"), (4, "c", "t"), (5, "c", "u")],
    [(i, f"i{i * 7 % 11}", f"t{i * 5 % 13}") for i in range(60)],
]


@pytest.mark.parametrize("rows", CASES)
def test_first_wins_as_one_pass_would(spark, rows):
    df = spark.createDataFrame(rows, "n int, i string, t string").repartition(3)
    got = D.first_wins(df, [F.col("i"), F.col("t")], [F.col("n")])
    assert sorted(r.n for r in got.collect()) == kept(rows) and got.columns == ["n", "i", "t"]


def test_first_wins_of_an_empty_table(spark):
    df = spark.createDataFrame([], "n int, i string")
    assert D.first_wins(df, [F.col("i")], [F.col("n")]).collect() == []


def test_fingerprints_fold_and_compose(spark):
    rows = [("Straße  É",), ("STRASSE e\u0301",), ("strasse\u00a0é\n",)]
    got = spark.createDataFrame(rows, "t string").select(T.fingerprint(F.col("t")).alias("f"), T.ascii_key(F.col("t")).alias("k"), T.letter_key(F.lit("Đại 日本 x")).alias("l"))
    assert got.select("f").distinct().count() == 1 and {(r.k, r.l) for r in got.collect()} == {("strasse e", "dai 日本 x")}


def test_paragraphs_join_hyphens(spark):
    text = "in-\nside a well-\nKnown\u00a0 line\r\n\n so\u00adft"
    assert spark.range(1).select(T.normalized_paragraph(F.lit(text))).first()[0] == "inside a well- Known line soft"


def test_titles_inside_each_other_meet_without_a_common_word(spark):
    rows = [(1, "electrocardiographicall"), (2, "electrocardiographically"), (3, "deep learning for images"), (4, "deep learning for image"), (5, "deep learning for images")]
    got = {(r.a, r.b): r.rule for r in D.fuzzy_pairs(spark.createDataFrame(rows, "id int, core string"), "id", "core").collect()}
    assert got == {(1, 2): "inside", (3, 4): "inside", (3, 5): "equal"}


def test_the_sequence_rule_against_brute_force(spark):
    words = ["data", "base", "systems", "modern", "query", "plans", "cost", "models", "graph", "joins"]
    rows = [(i, " ".join(words[(i * k + k * k) % 10] for k in range(1, 4 + i % 4))) for i in range(40)]
    got = {(r.a, r.b) for r in D.fuzzy_pairs(spark.createDataFrame(rows, "id int, core string"), "id", "core").collect() if r.rule == "sequence"}
    first = {}
    for i, c in rows:
        first.setdefault(c, i)
    want = set()
    for x, i in first.items():
        for y, j in first.items():
            a, b = set(x.split()), set(y.split())
            jac, short, long = len(a & b) / len(a | b), min(len(x), len(y)), max(len(x), len(y))
            inside = short >= 20 and (x in y or y in x) and short / long >= 0.82
            if x < y and not inside and long - short <= long * 0.3 and 0.65 <= jac < 0.8 and SequenceMatcher(None, x, y).ratio() >= 0.85:
                want.add((min(i, j), max(i, j)))
    assert got == want


def test_overlaps_across_cells(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 3000), (1, 1, 3000, 3001), (1, 2, 5, 5)], "k int, token int, start int, end int")
    spans = spark.createDataFrame([(1, 0, 10, 2500), (1, 1, 2999, 3001), (2, 2, 0, 9)], "k int, span int, char_start int, char_end int")
    assert sorted((r.token, r.span) for r in S.overlaps(tokens, spans, "k").collect()) == [(0, 0), (0, 1), (1, 1)]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master, applicationId = "local-cluster[2,1,512]", "app"

    with pytest.raises(ValueError):
        storage.shared_dir(Session)


def test_other_queries_stay_when_a_library_is_missing():
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['tiktoken'] = None; import __spark_entry__ as e; print(len(e.queries()) > 80, 'pipeline' in e.queries())"
    root = str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120).stdout
    assert out.split()[0] == "True"
