import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.llm.toxicity import Scorer, Settings, held_out, ngrams, score, train

from .cases import SCHEMA, awkward, table

BAD = ["idiot", "moron", "stupid", "worthless"]


def corpus(n=1500, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 200))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 3) * toxic):
            words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus()
    return train(table(spark, docs), spark.createDataFrame(labels, LABELS))


def test_held_out_accuracy(spark, trained):
    docs, labels = corpus()
    got = {r.doc_id: r.p for r in score(table(spark, docs), trained, out="p").collect()}
    own = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == t for i, t in own]) > 0.95


def test_misspellings_score_like_their_word(spark, trained):
    rows = [(0, "aen rost idiiot soe", None, None, None), (1, "aen rost torsan soe", None, None, None)]
    got = {r.doc_id: r.p for r in score(table(spark, rows), trained, out="p").collect()}
    assert got[0] > got[1]


def test_awkward_rows_get_a_score_each(spark, trained):
    rows = awkward()
    got = score(table(spark, rows), trained, out="p").collect()
    assert len(got) == len(rows) and all(0 <= r.p <= 1 for r in got) and got[0].kept == "7"
    empty = {r.p for r in got if not (r.text or "").strip()}
    assert len(empty) == 1


def test_a_long_text_is_scored_to_its_end(spark, trained):
    calm = "aen rost soe nit " * 30_000
    got = {r.doc_id: r.p for r in score(table(spark, [(0, calm, None, None, None), (1, calm + "idiot moron", None, None, None)]), trained, out="p").collect()}
    assert got[1] > 0.5 > got[0]


def test_without_labels_of_both_kinds_the_score_is_their_share(spark):
    docs = table(spark, awkward())
    for labels in ([], [(1, 1, 0), (2, 1, 0), (None, 1, 1), (3, 1, None)]):
        got = score(docs, train(docs, spark.createDataFrame(labels, LABELS)), out="p")
        assert got.agg(F.max("p")).first()[0] < 1e-6
    assert score(table(spark, []), train(table(spark, []), spark.createDataFrame([], LABELS)), out="p").collect() == []


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = corpus(300)
    kept = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    spoilt = kept + [(i, q, 1 - t) for i, q, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    a, b = (train(table(spark, docs), spark.createDataFrame(x, LABELS)) for x in (kept, spoilt))
    assert np.array_equal(a.by_gram, b.by_gram) and (a.scale, a.shift) == (b.scale, b.shift)
    marks = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in marks)


def test_ngrams_of_many_words_equal_those_of_each():
    s = Settings()
    words = ["", "a", "héllo", "日本", "idiot", "x" * 50]
    buckets, ends = ngrams(words, s)
    for w, a, b in zip(words, [0, *ends[:-1]], ends):
        own, _ = ngrams([w], s)
        assert sorted(buckets[a:b].tolist()) == sorted(own.tolist())
