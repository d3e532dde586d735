"""Each stage of the pipeline against a plain version on a small table."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamwork.llm.near_dups import bands, dealt, fingerprint, limits, run_joins, shingle_set, without_near_duplicates
from loamwork.llm.simhash import shingle_bytes

from .cases import SCHEMA, awkward, table


def shingles(text):
    return set(shingle_bytes(text or "", 5))


def brute_groups(rows, similarity=0.8):
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union == 0 or len(sets[i] & sets[j]) / union >= similarity:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return Counter(find(i) for i in range(len(rows)))


def edited(n=40, words=200, seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        rows.append((g * 10, " ".join(base), "en", "src1", 1))
        for c in range(1, 4):
            copy = list(base)
            for _ in range(c - 1):
                copy[rng.randrange(words)] = "edited"
            rows.append((g * 10 + c, " ".join(copy), "en", f"src{c}", 1))
    return rows


def test_one_of_each_near_duplicate_group_stays(spark):
    rows = awkward() + [(r[0] + 10_000, *r[1:]) for r in edited()]
    kept = without_near_duplicates(table(spark, rows)).collect()
    assert len(kept) == len(brute_groups(rows))
    groups = brute_groups(edited())
    assert sorted(k.doc_id - 10_000 for k in kept if (k.doc_id or 0) >= 10_000) == sorted(edited()[g][0] for g in groups)


def test_near_duplicates_of_an_empty_table(spark):
    assert without_near_duplicates(table(spark, [])).collect() == []


def form_letters(n=300, seed=4):
    """Letters of 176 shared and 24 own words, similar by less than 0.8, each with an edited copy."""
    rng = random.Random(seed)
    shared, rows = [f"s{rng.randrange(5000)}" for _ in range(176)], []
    for i in range(n):
        own = [f"o{rng.randrange(10**6)}" for _ in range(24)]
        rows.append((2 * i, " ".join(shared + own), "en", "s", 1))
        rows.append((2 * i + 1, " ".join(shared + own[:-1] + ["edited"]), "en", "s", 1))
    return rows


def test_a_rejected_link_of_a_long_run_loses_no_pair(spark):
    rows = form_letters()
    assert len(brute_groups(rows)) == 300
    assert sorted(k.doc_id for k in without_near_duplicates(table(spark, rows)).collect()) == list(range(0, 600, 2))


def test_unlike_texts_of_equal_fingerprints_stay(spark):
    rng, rows = random.Random(6), []
    for i in range(12):
        own = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows.append((2 * i, " ".join(own + ["x"] * 400), "en", "s", 1))
        rows.append((2 * i + 1, " ".join(own[:-1] + ["edited"] + ["x"] * 300), "en", "s", 1))
    assert len(brute_groups(rows)) == 12
    assert sorted(k.doc_id for k in without_near_duplicates(table(spark, rows)).collect()) == list(range(0, 24, 2))


def test_repeats_do_not_hide_a_near_duplicate(spark):
    rng, rows = random.Random(7), []
    for i in range(12):
        own = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * i, " ".join(own), "en", "s", 1), (2 * i + 1, " ".join(own + [f"again{i}"] * 80), "en", "s", 1)]
    assert len(brute_groups(rows)) == 12
    assert sorted(k.doc_id for k in without_near_duplicates(table(spark, rows)).collect()) == list(range(0, 24, 2))


def similar_pair(rng, least, most):
    """Two texts of Jaccard 0.8 to 0.86 by edits and additions (short texts have few values to take)."""
    while True:
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(least, most))]
        copy, j = list(own), 1.0
        while j > 0.86:
            if rng.random() < 0.5:
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            else:
                copy.append(f"e{rng.randrange(10**6)}")
            x, y = shingles(" ".join(own)), shingles(" ".join(copy))
            j = len(x & y) / len(x | y)
        if j >= 0.8:
            return " ".join(own), " ".join(copy)


@pytest.mark.parametrize("least, most", [(6, 12), (12, 40), (40, 130), (130, 400), (1000, 1300)])
def test_joint_recall_of_limit_and_bands(least, most):
    """Of pairs near the limit nearly all are candidates, whatever their length and their repeats."""
    rng, found, n = random.Random(least), 0, 300
    for i in range(n):
        a, b = similar_pair(rng, least, most)
        sets = [shingle_set(a, 5), shingle_set(b + (" " + b.split()[-1]) * 90 * (i % 2 and least > 100), 5)]
        bits = [np.unpackbits(np.frombuffer(fingerprint(s), np.uint8)) for s in sets]
        close = (bits[0] != bits[1]).sum() <= limits(np.array([len(s) for s in sets]), 0.8).max()
        found += close and (bands(sets[0]) == bands(sets[1])).any()
    assert found / n >= 0.96


def test_planted_similarities_are_found_up_to_the_limit(spark):
    """Recall by brute force on families whose members are similar by 0.6 to 1."""
    rng, rows = random.Random(12), []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        for c in range(6):
            copy = [f"e{rng.randrange(10**6)}" if rng.random() < 0.02 * c else w for w in base]
            rows.append((g * 10 + c, " ".join(copy), "en", "s", 1))
    kept, groups = without_near_duplicates(table(spark, rows)).count(), len(brute_groups(rows))
    assert groups <= kept <= groups + 0.05 * (len(rows) - groups)


def test_joins_of_a_mixed_run_leave_no_similar_pair_apart():
    rng, rows = random.Random(3), []
    for i in range(60):
        copy = [f"s{k}" if rng.random() > 0.03 else f"e{rng.randrange(10**6)}" for k in range(200)]
        rows.append((i, " ".join(copy), "en", "s", 1))
    sets = [shingle_set(r[1], 5) for r in rows]
    words = np.stack([np.frombuffer(fingerprint(s), np.uint64) for s in sets])
    a, b = run_joins(words, limits(np.array([len(s) for s in sets]), 0.8), np.arange(60), sets, 0.8)
    root = list(range(60))
    for x, y in zip(a, b):
        p, q = root[x], root[y]
        root = [p if r == q else r for r in root]
    assert len(a) == 60 - len(set(root)) and len(set(root)) == len(brute_groups(rows))


def test_heavy_buckets_are_dealt_so_that_all_pairs_meet(spark):
    rows = spark.createDataFrame([(0, 1, bytes([i])) for i in range(50)] + [(0, 2, b"x"), (0, 2, b"y")], "t int, key long, node binary")
    got = dealt(rows, ["t", "key"], F.lit(1), 20).collect()
    parts = {}
    for r in got:
        parts.setdefault((r.key, r.pair), set()).add(bytes(r.node))
    met = {frozenset((x, y)) for (k, _), nodes in parts.items() if k == 1 for x in nodes for y in nodes if x != y}
    assert len(met) == 50 * 49 // 2
    assert [n for (k, _), n in parts.items() if k == 2] == [{b"x", b"y"}]


def test_ties_and_repeated_rows_give_one_row_each(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1), (1, text, "de", "b", 2), (1, text, "en", "a", 1), (2, text, "en", "a", 1)]
    first = without_near_duplicates(table(spark, rows)).collect()
    assert len(first) == 1 and first == without_near_duplicates(table(spark, rows[::-1])).collect()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A table with toxic and clean documents, labels, and repeated lines."""
    rng, rows, labels = random.Random(8), [], []
    for i in range(900):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        if i % 6 == 0:
            words[rng.randrange(60)] = rng.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(words) + "\nThis line is in all documents.", "en", f"src{i % 3}", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(None, None, None, None, None), (901, "", "en", "src1", 0), (902, None, "de", None, 0), rows[100]]
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_on_a_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        seen[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(seen[name], docs.schema)
    toxic = {i for i in range(0, 900, 6)}
    clean = set(range(900)) - toxic
    left = {r.doc_id for r in seen["toxicity"]}
    assert len(left & toxic) <= 15 and len(clean - left) <= 15
    lines = Counter(line for r in seen["line_dedup"] for line in (r.text or "").split("\n") if len(line) >= 10)
    assert lines["This line is in all documents."] == 1 and max(lines.values()) <= 2  # row 100 is there twice
    assert len(seen["simhash_near_dedup"]) == len(brute_groups([tuple(r) for r in seen["line_dedup"]]))
    words = sum(len((r.text or "").split()) for r in seen["simhash_near_dedup"])
    assert words * 0.9 <= sum(len((r.text or "").split()) for r in seen["mixing"]) <= words * 1.1
    assert Counter(r.doc_id for r in seen["byte_bpe"]) == Counter(r.doc_id for r in seen["mixing"])


def test_run_equals_the_stages(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
