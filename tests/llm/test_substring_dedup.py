import random
import re
from collections import Counter

import numpy as np

from loamwork.llm import contract
from loamwork.llm.substring_dedup import repeated_passages, unit_ends, units_of, without_passages, word_places

from .cases import awkward, norm, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_units(text):
    """The same units, found word by word: ends where the three-word hash is the lowest of nine."""
    words = [m.group() for m in WORD.finditer(text)]
    _, _, hashes = word_places(norm(text).encode())
    assert len(hashes) == len(words)
    return unit_ends(hashes).tolist()


def planted(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorstÉß") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(51, 120)) for _ in range(12)]
    rows, homes = [], {}
    for i in range(120):
        words = prose(rng.randint(80, 300)).split(" ")
        if i % 3 == 0:
            p = rng.randrange(len(passages))
            at = rng.randrange(len(words))
            words[at:at] = passages[p].split(" ")
            homes.setdefault(p, []).append(i)
        text = " ".join(words)
        rows.append((i, text.replace(" ", "\n", 3) if i % 2 else text.upper() if i % 5 == 0 and "ß" not in text else text, "en", "s", 1))
    return rows, passages, homes


def test_planted_passages_go_and_clean_documents_stay(spark):
    rows, passages, homes = planted()
    got = repeated_passages(table(spark, rows)).collect()
    want = {i for docs in homes.values() for i in docs[1:]}
    assert {g.doc_id for g in got} == want
    first = {i: docs[0] for docs in homes.values() for i in docs[1:]}
    length = {i: len(passages[p].split()) for p, docs in homes.items() for i in docs}
    text = {r[0]: r[1] for r in rows}
    for g in got:
        assert g.kept_in == first[g.doc_id] and length[g.doc_id] - 26 <= g.n_words <= length[g.doc_id]
        cut = norm(" ".join(WORD.findall(text[g.doc_id][g.start : g.end])))
        assert any(cut in norm(p) for p in passages) and len(cut.split()) == g.n_words


def test_removal_keeps_the_rest_and_the_offsets(spark):
    rows, _, _ = planted()
    text = {r[0]: r[1] for r in rows}
    for r in without_passages(table(spark, rows)).collect():
        spans, at, rest = r.removed, 0, ""
        for s in spans:
            rest, at = rest + text[r.doc_id][at : s.start], s.end
        assert r.text == rest + text[r.doc_id][at:] and r.kept == "7"


def test_units_cover_all_words():
    rng = random.Random(1)
    for text in ["", " \n", "a", "É ß", *("".join(rng.choice("ab É\n😀 ") for _ in range(300)) for _ in range(50)), "same " * 500]:
        units = units_of(text)
        assert [w for s, e, *_ in units for w in WORD.findall(text[s:e])] == WORD.findall(text)
        assert [len(WORD.findall(text[s:e])) for s, e, *_ in units] == [w for *_, w, _ in units]
        assert np.cumsum([w for *_, w, _ in units]).tolist() == plain_units(text)


def test_word_hashes_do_not_depend_on_their_place(monkeypatch):
    from loamwork.llm import substring_dedup

    data = ("alpha beta gamma " * 200).encode()
    whole = word_places(data)[2]
    assert len(set(whole.tolist())) == 3
    monkeypatch.setattr(substring_dedup, "BLOCK", 50)
    assert (word_places(data)[2] == whole).all()


def test_awkward_rows_copies_and_empty_table(spark):
    rows = awkward()
    got = repeated_passages(table(spark, rows)).collect()
    texts = {norm(r[1]) for r in rows if r[0] is None}
    for g in got:
        assert g.kept_in is not None and (g.doc_id is None or g.kept_in < g.doc_id)
    kept = without_passages(table(spark, rows)).collect()
    assert len(kept) == len(rows) and texts
    copies = [(i, "one two three four five six seven eight nine ten " * 9, "en", "s", 1) for i in range(4)]
    gone = {r.doc_id: r.text for r in without_passages(table(spark, copies)).collect()}
    assert gone[0] == copies[0][1] and {gone[i].strip() for i in (1, 2, 3)} == {""}
    assert repeated_passages(table(spark, [])).collect() == []


def test_within_keeps_the_first_occurrence_only(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    again, a, b, c = prose(120), prose(60), prose(60), prose(60)
    rows = [(1, " ".join([a, again, b, again, c, again]), "en", "s", 1), (2, f"{again} {prose(60)}", "en", "s", 1), (3, prose(200), "en", "s", 1)]
    rows += [rows[0], (None, f"{again} {prose(60)} {again}", "en", "s", 1)]
    assert not [g for g in repeated_passages(table(spark, rows)).collect() if g.doc_id == 1]
    got = [g for g in repeated_passages(table(spark, rows), within=True).collect() if g.unit == "paragraph"]
    assert Counter(g.doc_id for g in got) == {1: 2, 2: 1, None: 2} and {g.kept_in for g in got} == {1}
    assert all(120 - 26 <= g.n_words <= 120 for g in got)
    first = len(f"{a} {again}")
    assert all(g.start >= first for g in got if g.doc_id == 1)


def test_the_query_drops_repeats_inside_a_document(spark, tmp_path):
    again = " ".join(f"w{i * i % 9973}" for i in range(120))
    spark.createDataFrame([(1, f"start {again} middle {again} end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [g.doc_id for g in contract.op8_passage_dedup(spark, str(tmp_path)).collect()] == [1]


def plain_lines(rows, least=16):
    """Every line of at least `least` words but the first of its words by (id, place): (id, start, end, kept_in)."""
    first, out = {}, set()
    texts = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    for none, i, text in texts:
        at = 0
        for line in text.split("\n"):
            words = [m for m in WORD.finditer(line)]
            if len(words) >= least:
                key, owner = " ".join(norm(w.group()) for w in words), None if none else i
                if key in first:
                    out.add((owner, at + words[0].start(), at + words[-1].end(), first[key]))
                first.setdefault(key, owner)
            at += len(line) + 1
    return out


def test_lines_equal_brute_force(spark):
    rng, rows = random.Random(9), []
    lines = [" ".join(rng.choice(["É", "ß", "word", f"w{rng.randrange(50)}"]) + str(k) for k in range(rng.randint(10, 30))) for _ in range(40)]
    for i in range(150):
        own = [rng.choice(lines) if rng.random() < 0.3 else " ".join(f"x{rng.randrange(10**6)}" for _ in range(20)) for _ in range(rng.randint(1, 8))]
        rows.append((i, "\n".join(x.upper() + "\t " if rng.random() < 0.2 and "ß" not in x and "É" not in x else f"  {x}" for x in own), "en", "s", 1))
    got = repeated_passages(table(spark, rows + awkward()[:0]), within=True, min_words=10**6).collect()
    assert {(g.doc_id, g.start, g.end, g.kept_in) for g in got} and {g.unit for g in got} == {"line"}
    want, starts = plain_lines(rows), {}
    covered = {(g.doc_id, g.start, g.end): g for g in got}
    for i, a, b, kept in want:  # neighbouring repeated lines are one row
        assert any(g.doc_id == i and g.start <= a and b <= g.end and g.kept_in <= kept for g in covered.values())
    for g in got:
        inside = sorted((a, b) for i, a, b, _ in want if i == g.doc_id and g.start <= a and b <= g.end)
        assert inside and inside[0][0] == g.start and inside[-1][1] == g.end


def test_a_line_of_20_words_in_many_documents(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    line = prose(20)
    rows = [(i, f"{prose(60)}\n{line}\n{prose(60)}", "en", "s", 1) for i in range(50)]
    got = repeated_passages(table(spark, rows), within=True).collect()
    assert sorted(g.doc_id for g in got) == list(range(1, 50)) and {g.kept_in for g in got} == {0}
    assert all(rows[g.doc_id][1][g.start : g.end] == line for g in got)
    assert all(line not in r.text for r in without_passages(table(spark, rows)).where("doc_id > 0").collect())
