import hashlib

import pytest
from pyspark.sql import functions as F

from loamwork.llm.exact_dedup import exact_dedup, md5_128

from .cases import SCHEMA, awkward, norm, skew_split, table


def brute(rows, best):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    out = []
    for r in rows:
        ids = [i for i in groups[norm(r[1])] if i is not None]
        keep = best(ids) if ids else None
        out.append((r[0], keep, len(groups[norm(r[1])]), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=repr)


#: A hash that no, some, or all texts share: collisions must not merge different texts.
HASHES = [md5_128, lambda t: F.substring(md5_128(t), 1, 1), lambda t: F.lit(b"same")]


@pytest.mark.parametrize("content_hash", HASHES)
@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_equals_brute_force(spark, keep, best, content_hash):
    rows = awkward()
    got = exact_dedup(table(spark, rows), keep=keep, content_hash=content_hash).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == brute(rows, best)


def test_empty_table(spark):
    assert exact_dedup(table(spark, [])).collect() == []


def test_the_plan_has_no_python(spark):
    plan = exact_dedup(table(spark, awkward()))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_a_hot_text_is_split(spark):
    rows = [(i, "the same text" if i % 2 else f"text {i % 1500}", "en", "s", 1) for i in range(6000)]
    assert skew_split(spark, lambda: exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(8)))


def test_texts_of_some_megabytes(spark):
    rows = [(1, "A b" * 10**6, "en", "s", 1), (2, "a B" * 10**6, "en", "s", 1), (3, "a b" * 10**6 + "c", "en", "s", 1)]
    got = {r.doc_id: r.keep_id for r in exact_dedup(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
