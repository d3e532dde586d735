import random
import re

import numpy as np
import pytest
import xxhash

from loamwork.llm import simhash

from .cases import awkward, norm, table


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", norm(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=3):
    prints = [brute_fingerprint(r[1]) for r in rows]
    label, values = {}, sorted(set(prints))
    for start in values:
        if start in label:
            continue
        label[start], todo = start, [start]
        while todo:
            x = todo.pop()
            for y in values:
                if y not in label and bin(x ^ y).count("1") <= distance:
                    label[y] = start
                    todo.append(y)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[label[p]] = min(r[0], least.get(label[p], r[0]))
    return sorted(((r[0], f"{p:016x}", least.get(label[p])) for r, p in zip(rows, prints)), key=repr)


def near_copies():
    rng = random.Random(3)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(rng.randint(0, 99)) for _ in range(300)]
    rows = []
    for i in range(80):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(300)] = "changed"
        rows.append((500 + i, " ".join(words), "en", "s", 1))
    return rows


@pytest.mark.parametrize("bucket_rows", [200_000, 5])
def test_equals_brute_force(spark, bucket_rows):
    rows = awkward() + near_copies()
    got = simhash.simhash_components(table(spark, rows), bucket_rows=bucket_rows).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_empty_table(spark):
    assert simhash.simhash_components(table(spark, [])).collect() == []


@pytest.mark.parametrize("distance,rows", [(3, 10), (3, 10**6), (2, 10**9), (0, 5)])
def test_exact_tables_meet(distance, rows):
    tables = simhash.exact_tables(64, distance, rows)
    rng = random.Random(1)
    for _ in range(300):
        changed = set(rng.sample(range(64), distance))
        assert any(not changed & set(t) for t in tables)


def test_links_of_runs_connect_like_all_pairs():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 6, np.uint64)
    words = base[rng.integers(0, 6, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, np.uint64))
    keys = np.sort(rng.integers(0, 30, 400))[:, None]
    a, b = simhash._links_of_runs(keys, words[:, None], 3)
    assert all(keys[i] == keys[j] and bin(int(words[i] ^ words[j])).count("1") <= 3 for i, j in zip(a, b))

    def classes(pairs):
        root = list(range(400))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, j in pairs:
            root[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(400)]

    every = [(i, j) for i in range(400) for j in range(i) if keys[i] == keys[j] and bin(int(words[i] ^ words[j])).count("1") <= 3]
    assert classes(zip(a.tolist(), b.tolist())) == classes(every)
