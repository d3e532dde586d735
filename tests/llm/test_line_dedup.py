from collections import defaultdict

import pytest

from loamwork.llm.line_dedup import line_dedup

from .cases import SCHEMA, awkward, norm, skew_split, table


def brute(rows, min_chars, most):
    key = lambda line: norm(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(r[0])
    out = []
    for r in rows:
        lines, kept = (r[1] or "").split("\n"), []
        for line in lines:
            ids = holders.get(key(line), set())
            first = min((i for i in ids if i is not None), default=None)
            if len(ids) <= most or r[0] == first:
                kept.append(line)
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_chars,most", [(10, 1), (1, 1), (3, 2), (0, 1)])
def test_equals_brute_force(spark, min_chars, most):
    rows = awkward() + [(700 + i, "A common line\nx\n\nown %d\nA COMMON LINE " % i, "en", "s", 1) for i in range(9)]
    got = line_dedup(table(spark, rows), min_chars=min_chars, max_documents=most).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got), key=repr) == brute(rows, min_chars, most)
    assert {r.slot for r in got} == {"7"} and {r.lost for r in got} == {"7"}


def test_empty_table(spark):
    assert line_dedup(table(spark, [])).collect() == []


def test_a_hot_line_is_split(spark):
    rows = [(i, "this line stands in all documents\nown line number %d of its document" % i, "en", "s", 1) for i in range(4000)]
    assert skew_split(spark, lambda: line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(8)))


def test_a_text_of_some_megabytes(spark):
    rows = [(1, "a line of its own\n" * 200_000, "en", "s", 1), (2, "\n".join(f"line number {i}" for i in range(200_000)), "en", "s", 1), (3, "a line of its own", "en", "s", 1)]
    got = {r.doc_id: r for r in line_dedup(table(spark, rows)).collect()}
    assert (got[1].n_dropped, got[2].n_dropped, got[3].n_dropped) == (0, 0, 1) and got[2].text == rows[1][1]
