import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loamwork.llm.mixing import filled, mixed, weight_of

from .cases import SCHEMA, awkward, table

DOMAIN = {"s1": "a", "s2": "a", "s3": "b"}
WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2}, "source": {"s2": 4}}


def fill(budget, children):
    """Shares by weight; the full ones take their cap and the rest share again. children: {name: (cap, weight)}."""
    left, out = dict(children), {}
    while left:
        total = sum(w for _, w in left.values())
        full = [n for n, (cap, w) in left.items() if cap <= Fraction(budget * w, total)]
        if not full:
            return out | {n: Fraction(budget * w, total) for n, (_, w) in left.items()}
        for n in full:
            out[n] = left.pop(n)[0]
            budget -= out[n]
    return out


def leaf_budgets(rows, per_mille, epochs):
    tokens = defaultdict(int)
    for r in rows:
        tokens[DOMAIN.get(r[3]), r[2], r[3]] += len((r[1] or "").replace("\x0b", " ").split())
    weight = lambda level, v: WEIGHTS[level].get(v, 1)

    def down(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        level, caps = ("domain", "lang", "source")[len(prefix)], defaultdict(int)
        for path, n in tokens.items():
            if path[: len(prefix)] == prefix:
                caps[path[len(prefix)]] += n * epochs
        out = {}
        for child, share in fill(budget, {c: (cap, weight(level, c)) for c, cap in caps.items()}).items():
            out |= down((*prefix, child), share)
        return out

    whole = sum(tokens.values())
    return tokens, down((), min(whole * per_mille // 1000, whole * epochs))


def corpus(n=300):
    rng = random.Random(2)
    return [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(1, 60))), rng.choice(["en", "en", "de"]), rng.choice(["s1"] * 6 + ["s2", "s3"]), 1) for i in range(n)]


@pytest.mark.parametrize("per_mille,epochs", [(800, 4), (1000, 1), (3000, 2), (50, 4)])
def test_budgets_go_down_the_tree(spark, per_mille, epochs):
    rows = corpus()
    domain = weight = None
    domain = F.when(F.col("source").isin("s1", "s2"), "a").when(F.col("source") == "s3", "b")
    weight = {k: weight_of(k, v) for k, v in WEIGHTS.items()}
    levels = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    got = mixed(table(spark, rows), levels, weight, per_mille, epochs, seed=9).collect()
    assert len(got) == len(rows)
    tokens, budgets = leaf_budgets(rows, per_mille, epochs)
    by_leaf = defaultdict(list)
    for g in got:
        by_leaf[g.domain, g.lang, g.source].append((g.row.doc_id, g.n_tokens, g.copies))
    for leaf, docs in by_leaf.items():
        taken = sum(n * c for _, n, c in docs)
        assert budgets[leaf] - 1 <= taken + 1 and taken <= budgets[leaf] + max(n for _, n, _ in docs) + 2
        full = int(budgets[leaf]) // tokens[leaf]
        assert {c for _, n, c in docs if n} <= {full, full + 1}
        order = sorted(docs, key=lambda d: hashlib.md5(f"9:{full}:{d[0]}".encode()).hexdigest())
        extra = [c > full for _, n, c in order if n]
        assert extra == sorted(extra, reverse=True)  # a prefix of the next seeded epoch


def test_awkward_rows_and_empty_table(spark):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    weights = {"lang": F.lit(1), "source": F.lit(1)}
    rows = awkward()
    got = mixed(table(spark, rows), levels, weights, max_epochs=2).collect()
    assert len(got) == len(rows) and all(g.copies == 0 for g in got if not g.n_tokens and not any(x.copies for x in got if (x.lang, x.source) == (g.lang, g.source)))
    assert sum(g.copies * g.n_tokens for g in got) > 0
    assert mixed(table(spark, []), levels, weights).collect() == []
    tempered = mixed(table(spark, rows), levels, weights, temper=0.5).collect()
    assert len(tempered) == len(rows)


@pytest.mark.parametrize("tokens", [10**11, 10**13, 10**15])
def test_shares_of_very_many_tokens(spark, tokens):
    """Leaves of up to 10**15 tokens weighing their size to the power 0.7: no overflow, and the shares add up."""
    leaves = [(i, tokens * (1 + i % 3), int((tokens * (1 + i % 3)) ** 0.7)) for i in range(20)]
    budget = sum(c for _, c, _ in leaves) * 3 // 4
    nodes = spark.createDataFrame(leaves, "leaf int, cap long, weight long").withColumn("budget", F.lit(budget)).withColumn("top", F.lit(0))
    got = {r.leaf: r.alloc for r in filled(nodes, ["top"], "leaf").collect()}
    assert sum(got.values()) == budget
    want = fill(budget, {i: (c, w) for i, c, w in leaves})
    assert all(abs(got[i] - want[i]) <= 1 for i in got)
