import hashlib
import random
import re

import pytest

from loamwork.llm.pii import find_pii, reliabilities

from .cases import awkward, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return sorted(found)


def line(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def texts():
    rng = random.Random(4)
    bits = ["a@b.c_x@d.com", "😀é", "me.x@mail7.example.com", "1.2.3.4.5.6.7.8", "999.1.1.1", "0010.0255.1.2", "4111 1111-1111 1111", "4111111111111111", "+1 (017) 555-7713", "+49.30.12345678-", "a@b", "@", "+", " ", "\n", ".", "-", "12", "x", "_"]
    made = ["".join(rng.choice(bits) + rng.choice(["", " ", ",", "x"]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    return made + ["1" * 5000, "1." * 3000, "a" * 5000, "a.b@" * 2000, "10.0.0.1 " * 1300, "+1 " * 2000, "4 1-" * 2000, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x']


def test_base_spans_equal_brute_force(spark):
    rows = awkward() + [(1000 + i, t, None, None, None) for i, t in enumerate(texts())]
    got = find_pii(table(spark, rows)).collect()
    want = []
    for r in rows:
        spans = base(r[1])
        n = [sum(s[2] == k for s in spans) for k in PATTERNS]
        want.append((r[0], *n, hashlib.sha256(line(spans).encode()).hexdigest()))
    assert sorted(((g.doc_id, g.n_email, g.n_ip, g.n_card, g.n_phone, g.base_sha256) for g in got), key=repr) == sorted(want, key=repr)
    for g in got:
        mine = [s for r in rows if r[0] == g.doc_id for s in line(base(r[1])).split(",") if s]
        assert set(filter(None, g.spans.split(","))) <= set(mine) or g.n_added > 0


def test_classifier_adds_secrets_and_leaves_prose_alone(spark):
    rng = random.Random(1)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'Prose of some kind. token = "{key()}" and more.', None, None, None) for i in range(60)]
    rows += [(100 + i, f"Order {rng.randrange(10**15, 10**16)} of 12 pages, section 3.1 and 20 things.", None, None, None) for i in range(60)]
    got = {g.doc_id: g.spans for g in find_pii(table(spark, rows, extra=False)).collect()}
    for i, text, *_ in rows:
        want = base(text) + ([(text.index('"') + 1, 9, "secret", text.index('"') + 41)] if i < 100 else [])
        assert got[i] == line(sorted(want)), text


def test_empty_table(spark):
    assert find_pii(table(spark, [])).collect() == []


def test_reliabilities_follow_agreeing_labelers():
    counts = {("k", 1, 1, 0, 0): 50.0, ("k", -1, 0, -1, 0): 50.0, ("k", 1, 0, 0, 0): 10.0}
    after = reliabilities(counts)
    assert after["k", 1, 1, 0, 0] > 0.95 and after["k", -1, 0, -1, 0] < 0.05 and after["k", 1, 0, 0, 0] > 0.5
