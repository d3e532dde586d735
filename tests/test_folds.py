"""Folds over ordered units: packing, healing, merging, sentences, windows, lineage, layout."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamwork.functions import healing, lineage
from loamwork.operators import layout as L
from loamwork.operators import passages as P


@given(st.lists(st.tuples(st.integers(0, 600), st.booleans()), max_size=60))
@settings(max_examples=200, deadline=None)
def test_passages_partition_units_in_order(units):
    counts, joins = [n for n, _ in units], [j for _, j in units]
    ranges = P.pack(counts, joins, 384, 128, 512)
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(units)))
    for a, b in ranges:
        assert all(joins[i] for i in range(a + 1, b))
        assert b - a == 1 or P.estimate(sum(counts[a:b])) <= 512


def test_short_tails_join_their_predecessor():
    assert P.pack([100, 100, 100, 20], [True] * 4, 300, 128, 512) == [(0, 4)]
    assert P.pack([100, 100, 100, 20], [True, True, True, False], 300, 128, 512) == [(0, 3), (3, 4)]
    assert P.pack([600, 20], [True, True], 384, 128, 512) == [(0, 1), (1, 2)]


def test_estimates_follow_the_token_reserve():
    import math

    assert all(P.estimate(n) == max(1, math.ceil(n * 1.18)) for n in range(20_000))


def test_sentence_bounds_respect_decimals_and_abbreviations():
    text = "TS. Nguyễn Văn A đo được 3.14 mét. TP. Hồ Chí Minh rất đẹp."
    assert [text[a:b] for a, b in P.sentence_bounds(text)] == ["TS. Nguyễn Văn A đo được 3.14 mét.", "TP. Hồ Chí Minh rất đẹp."]
    quoted = 'He said "Stop." Then he left. (All of it.) 12 came.'
    assert [quoted[a:b] for a, b in P.sentence_bounds(quoted)] == ['He said "Stop."', "Then he left.", "(All of it.)", "12 came."]
    assert P.sentence_bounds("   ") == []


@given(st.text(alphabet="ab .,;!?\nÉ1", max_size=400))
@settings(max_examples=200, deadline=None)
def test_sentences_and_pieces_keep_all_but_blanks(text):
    spans = [p for a, b in P.sentence_bounds(text) for p in P.split_long(text, a, b, 10)]
    assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert all(P.estimate(len(P.TOKEN.findall(text[a:b]))) <= 10 for a, b in spans)


def test_release_healing():
    texts = ["Kết quả cho thấy,", "mô hình tốt.", "Chương 2 Tổng quan", "Theo TS.", "Nguyễn Văn A thì mô hì-", "nh này tốt."]
    assert [t for t, _, _ in P.fold(texts, P.heals, 420)] == ["Kết quả cho thấy, mô hình tốt.", "Chương 2 Tổng quan", "Theo TS. Nguyễn Văn A thì mô hình này tốt."]
    assert len(P.fold(["một,", "hai " * 500], P.heals, 420)) == 2


def test_curation_merging():
    texts = ["Hệ thống xử lý dữ liệu,", "bao gồm nhiều bước.", "• Bước một", "• tiếp theo", "Và kết thúc."]
    got = P.fold(texts, P.continues)
    assert got[0] == ("Hệ thống xử lý dữ liệu, bao gồm nhiều bước.", 0, 2)
    assert got[1][0].startswith("• Bước một tiếp theo")


@given(st.lists(st.integers(1, 40), max_size=40))
@settings(max_examples=200, deadline=None)
def test_windows_lose_no_unit(counts):
    got = P.windows_of(counts, 40)
    assert [i for _, a, b, _ in got for i in range(a, b)] == list(range(len(counts)))
    assert all(left <= a < b <= right and sum(counts[left:right]) <= max(40, sum(counts[a:b])) for left, a, b, right in got)


def test_windows_per_section(spark):
    rows = [(1, "a" if i < 6 else "b", i, f"word{i} and more words in line {i}") for i in range(12)]
    got = P.model_windows(spark.createDataFrame(rows, "doc_id long, section string, ordinal int, line string"), max_tokens=42).collect()
    loss = [o for w in got for o, x in zip(w.ordinals, w.loss_mask) if x]
    assert sorted(loss) == list(range(12)) and all(w.token_count <= 42 for w in got)
    assert all(len({rows[o][1] for o in w.ordinals}) == 1 for w in got)


def test_lineage_of_composition_and_blanks():
    n = lineage.normalized("Cafe" + chr(0x301) + "  x" + chr(0xAD) + "y" + chr(0xA0))
    assert n.text == "Café xy" and n.ranges[3] == [(3, 5)] and n.ranges[4] == [(5, 7)] and n.ranges[6] == [(9, 10)] and n.status == "active"
    marks = "a" + chr(0x327) + chr(0x30A)  # the second mark joins the letter, the first stays
    assert [c for c, _ in zip(lineage.normalized(marks).text, range(2))] == [chr(0xE5), chr(0x327)]
    assert lineage.normalized(marks).ranges == [[(0, 1), (2, 3)], [(1, 2)]]
    assert lineage.normalized(chr(0xFFFD) + chr(0xE001)).flags == ["replacement_character", "unresolved_pua"]


def test_lineage_glyph_rules_need_spans_pages_and_evidence(spark):
    glyph, page = chr(0xE001), f"xx a{chr(0xE001)} b"
    spans = [{"text": f"a{glyph} b", "font": "F", "page": 2, "start": 3, "end": 7}]
    key = ("d", "F", 0xE001)
    run = lambda rule, text=f"a{glyph}b", s=spans, p=page, k=key: lineage.normalized(text, "d", s, {k: rule}, {2: p})
    good = run(("ff", "seen", "reviewed"))
    assert (good.text, good.status, good.ranges[1:3]) == ("affb", "active", [[(1, 2)], [(1, 2)]]) and '"source_span": [4, 5]' in good.rules[0]
    assert run(("ff", "seen", "proposed")).flags == ["unverified_glyph_rule", "unresolved_pua"] == run(("ff", "", "reviewed")).flags
    assert run(("ff", "seen", "reviewed"), p="moved " + page).flags == ["source_span_unverified", "unresolved_pua"]
    assert run(("ff", "seen", "reviewed"), s=[]).flags == ["span_alignment_unresolved", "unresolved_pua"]
    assert run(("ff", "seen", "reviewed"), k=("d", "G", 0xE001)).flags == run(("ff", "seen", "reviewed"), k=("e", "F", 0xE001)).flags == ["unresolved_pua"]
    rows = [(1, "d", f"a{glyph}b", spans, "extra"), (2, None, None, None, None), (3, "e", f"a{glyph}b", spans, "x"), (4, "d", "plain", None, "x")]
    units = spark.createDataFrame(rows, "unit_id long, doc_id string, text string, spans array<struct<text: string, font: string, page: int, start: long, end: long>>, status string")
    rules = spark.createDataFrame([("d", "F", 0xE001, "ff", "seen", "reviewed")], "doc_id string, font string, codepoint int, replacement string, evidence string, status string")
    pages = spark.createDataFrame([("d", 2, page), ("e", 2, page)], "doc_id string, page int, text string")
    got = {r.unit_id: (r.normalized.text, r.normalized.status, r.status) for r in lineage.normalized_units(units, rules, pages).collect()}
    assert got == {1: ("affb", "active", "extra"), 2: ("", "active", None), 3: (f"a{glyph}b", "review_required", "x"), 4: ("plain", "active", "x")}
    assert lineage.normalized_units(units.limit(0), rules.limit(0), pages).count() == 0


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_lineage_ranges_cover_each_character(text):
    n = lineage.normalized(text)
    assert len(n.ranges) == len(n.text) and all(r and all(0 <= a < b <= len(text) for a, b in r) for r in n.ranges)
    assert "  " not in n.text


def test_healing_keeps_case_and_leaves_words_alone(spark):
    assert healing.heal("dữliệu Dữliệu HỆTHỐNG DỮLIỆU") == "dữ liệu Dữ Liệu HỆ THỐNG DỮ LIỆU"
    assert healing.heal("Xin chào thế giới.") == "Xin chào thế giới." and healing.heal("dữ dội (a ,b)") == "dữ dội (a ,b)"
    assert healing.heal("thứ3 thức3.2") == "thứ 3 thức 3.2" and healing.heal("Ƣu ƣu") == "Ưu ưu"
    assert healing.heal("thứkth sốN ởParis các • hàm") == "thứ kth số N ở Paris các hàm"
    counts = {"nghiên": 5, "cứu": 5, "khoa": 4, "học": 6, "a": 9}
    assert healing.split_syllables("nghiêncứu", counts) == "nghiên cứu"
    assert healing.split_syllables("NghiênCứu", counts) == "Nghiên cứu"
    assert healing.split_syllables("NGHIÊNCỨU", counts) == "NGHIÊN CỨU"
    assert healing.split_syllables("acứuhọc", counts) == "acứuhọc"
    assert healing.split_syllables("nghiêncứu", {}) == "nghiêncứu"
    texts = spark.createDataFrame([(0, None), (1, ""), (2, "dữliệu nghiêncứu, x")], "id int, text string")
    got = texts.select("id", healing.healed(F.col("text")).alias("h"), healing.unglued(F.col("text"), counts).alias("u")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [(None, None), ("", ""), ("dữ liệu nghiêncứu, x", "dữliệu nghiên cứu, x")]


LINES = (
    "doc_id long, page int, line int, width double, height double, x0 double, y0 double, x1 double, y1 double, text string, "
    "source_start long, source_end long, spans array<struct<text: string, font: string, size: double, x0: double>>"
)


def line(text, y=72.0, x0=72.0, x1=300.0, page=0, font="Times-Roman", size=12.0, n=0, cells=None):
    spans = [{"text": t, "font": font, "size": size, "x0": float(x)} for t, x in (cells or [(text, x0)])]
    box = {"x0": float(x0), "y0": float(y), "x1": float(x1), "y1": float(y + 12)}
    return {"doc_id": 1, "page": page, "line": n, "width": 612.0, "height": 792.0, "text": text, "source_start": 10 * n, "source_end": 10 * n + len(text), "spans": spans} | box


def kinds(lines, **config):
    return [(u.kind, u.text) for u in L.page_units(lines, L.Config(**config))]


def test_layout_columns_never_merge():
    lines = [line("Trái một"), line("Phải một", x0=342, x1=500), line("Trái hai", 88), line("Phải hai", 88, 342, 500)]
    assert [t for _, t in kinds(lines)] == ["Trái một Trái hai", "Phải một Phải hai"]


def test_layout_boundaries():
    lines = [line("Đoạn đầu"), line("Đoạn sau", 130), line("Lệch lề", 146, 110), line("MỤC MỚI", 164, font="Times-Bold", size=14), line("Hình 1. Minh họa", 182)]
    lines += [line("A  B  C", 200, cells=[("A", 72), ("B", 160), ("C", 250)]), line("1  2  3\n", 216, cells=[("1", 73), ("2", 161), ("3", 251)])]
    got = kinds(lines)
    assert [k for k, _ in got] == ["paragraph", "paragraph", "paragraph", "heading", "caption", "table_like"]
    assert got[-1][1] == "A  B  C\n1  2  3"
    bullets = [line("• mục một"), line("còn tiếp", 88, 90), line("• mục hai", 104), line("x", 120, font="Symbol")]
    assert kinds(bullets) == [("bullet_item", "• mục một còn tiếp"), ("bullet_item", "• mục hai"), ("bullet_item", "x")]
    rows = [line("ordinary start"), line("ordinary next", 94, 78)]
    assert [len(kinds(rows, **c)) for c in ({"line_gap": 1.9}, {"line_gap": 1.5}, {"line_gap": 1.9, "edge": 4})] == [1, 2, 2]
    assert kinds([]) == kinds([line(" \t")]) == []


@pytest.mark.parametrize(
    "end, start, right, x0, gap, pages, flagged",
    [
        ("Nội dung chưa kết thúc", "tiếp tục ở trang sau.", 400, 72, 1, [(0, 1)], []),
        ("The quotation says", '"continued on the next page', 400, 72, 1, [(0, 1)], []),
        ("A line ending without a period", "A new sentence.", 400, 72, 1, [(0, 0), (1, 1)], []),
        ("It has ended.", "lower case all the same", 400, 72, 1, [(0, 0), (1, 1)], []),
        ("The project was led by", "Nguyễn Văn A.", 400, 72, 1, [(0, 0), (1, 1)], [1]),
        ("The fiscal year began in", "2024 and ended.", 400, 72, 1, [(0, 0), (1, 1)], [1]),
        ("The report listed contributors", "Nguyễn Văn A.", 530, 72, 1, [(0, 0), (1, 1)], [1]),
        ("Một ý tưởng còn tiếp", "tục nhưng đổi lề.", 400, 126, 1, [(0, 0), (1, 1)], [1]),
        ("a thought may continue", "continued after a blank page.", 400, 72, 2, [(0, 0), (2, 2)], []),
    ],
)
def test_paragraphs_across_pages(spark, end, start, right, x0, gap, pages, flagged):
    lines = [line(end, 744, x1=right, n=1), line(start, 48, x0, 400, page=gap, n=2)]
    got = L.document_units(spark.createDataFrame(lines, LINES)).orderBy("ordinal").collect()
    assert [(r.page_start, r.page_end) for r in got] == pages
    assert [r.ordinal for r in got if r.review_flags == ["ambiguous_page_continuation"]] == flagged
    assert [s.start for r in got for s in r.source_spans] == [10, 20]
    assert " ".join(r.text for r in got) == f"{end} {start}"


def test_units_of_awkward_lines(spark):
    lines = [line("còn tiếp", 40, page=p, n=p) | {"y1": 700.0} for p in range(3)] + [line("x") | {"text": None}, line("y", n=5) | {"x0": None}, line("z") | {"doc_id": None, "spans": None}]
    got = L.document_units(spark.createDataFrame(lines, LINES).withColumn("kind", F.lit("mine"))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.page_start, r.page_end, r.text) for r in got] == [(None, 0, 0, "z"), (1, 0, 2, "còn tiếp còn tiếp còn tiếp")]
    assert L.document_units(spark.createDataFrame([], LINES)).count() == 0


def test_body_bounds():
    pages = ["bìa"] * 3 + ["MỤC LỤC\nChương 1 .... 1\na ..... 2\nb ..... 3"] + ["CHƯƠNG 1\n" + "nội dung " * 200] + ["nội dung " * 200] * 15 + ["TÀI LIỆU THAM KHẢO\n[1] A"]
    assert L.body_bounds(pages) == (4, 20)
    assert L.body_bounds([]) == (0, 0)
