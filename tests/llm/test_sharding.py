import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from loamwork.llm.sharding import CapacityTree, best_fit_decreasing, pack_evenly, shard_documents

from .cases import awkward, table


def plain_best_fit(sizes, capacity):
    """One item at a time, over a list of all bins."""
    left, out = [], Counter()
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= size]
        if fits:
            _, i = min(fits)
        else:
            left.append(capacity)
            i = len(left) - 1
        left[i] -= size
        out[size, i] += 1
    return out


@given(st.lists(st.integers(1, 60), max_size=120))
@settings(max_examples=150, deadline=None)
def test_runs_pack_like_single_items(sizes):
    runs = list(Counter(sizes).items())
    got = Counter()
    for size, number, count in best_fit_decreasing(runs, 60):
        got[size, number] += count
    assert got == plain_best_fit(sizes, 60)


@given(st.lists(st.tuples(st.integers(0, 30), st.booleans()), max_size=200))
@settings(max_examples=100, deadline=None)
def test_tree_gives_the_tightest(steps):
    tree, held = CapacityTree(), []
    for n, (value, add) in enumerate(steps):
        if add:
            tree.add(value, n)
            held.append((value, n))
        else:
            want = min((x for x in held if x[0] >= value), default=None)
            assert tree.take_tightest(value) == want
            if want:
                held.remove(want)


@given(st.lists(st.tuples(st.integers(1, 500), st.integers(1, 30)), max_size=60), st.integers(1, 24))
@settings(max_examples=60, deadline=None)
def test_even_packing_is_whole_and_uses_no_further_bin(runs, bins):
    runs = list(Counter({s: c for s, c in runs}).items())
    got, load = Counter(), defaultdict(int)
    for size, number, count in pack_evenly(runs, bins):
        got[size] += count
        load[number] += size * count
        assert 0 <= number < bins
    assert got == Counter(dict(runs))
    total = sum(s * c for s, c in runs)
    assert max(load.values(), default=0) <= total / bins + 2 * max((s for s, _ in runs), default=0)


def documents(n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.randint(0, 400) + str(rng.randrange(10**9)), "en", "s", 1) for i in range(n)]
    return rows + [(n + i, "a group of copies", "en", "s", 1) for i in range(40)] + [(2 * n + i, "hot " * 90, "en", "s", 1) for i in range(n // 2)]


def check(rows, got, shards=24):
    size = lambda t: len((t or "").encode()) + 8
    want = Counter((repr(r[0]), size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((repr(g.doc_id), g.size, g.text_crc32) for g in got) == want
    slots = defaultdict(list)
    for g in got:
        slots[g.shard].append(g.slot)
    assert all(0 <= s < shards and sorted(x) == list(range(len(x))) for s, x in slots.items())
    assert {(g.law, g.grown_shard) for g in got} <= {("bytes", None)}
    return size


def test_shards_are_even_and_groups_stay_together(spark):
    rows = documents()
    got = shard_documents(table(spark, rows)).collect()
    check(rows, got)
    bytes_, homes = Counter(), defaultdict(set)
    text = {r[0]: r[1] for r in rows}
    for g in got:
        bytes_[g.shard] += g.size
        homes[text[g.doc_id]].add(g.shard)
    assert len(bytes_) == 24 and max(bytes_.values()) <= 1.02 * min(bytes_.values())
    assert [t for t, s in homes.items() if len(s) > 1] == ["hot " * 90]  # larger than an even share


def test_awkward_rows_and_empty_table(spark):
    rows = awkward()
    check(rows, shard_documents(table(spark, rows)).collect())
    assert shard_documents(table(spark, [])).collect() == []
