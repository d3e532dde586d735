"""Operators that no query covers alone: joins with guards, dedup rules, parsers, counterfactual records, constraints."""

import random

import pytest
from pyspark.sql import functions as F

from loamwork.functions import ids
from loamwork.functions import text as T
from loamwork.operators import constraints as C
from loamwork.operators import counterfactual as CF
from loamwork.operators import dedup as D
from loamwork.operators import gates as G
from loamwork.operators import joins as J
from loamwork.operators import topics
from loamwork.sources import html as H
from loamwork.sources import records as R


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_document_types_units_and_reasons(spark):
    kinds = {"Luận văn thạc sĩ": "master_thesis", "Khóa luận tốt nghiệp": "bachelor_thesis", "Đồ án": "capstone_project", "Luận án": "doctoral_dissertation", "x": "other"}
    for text, kind in kinds.items():
        assert value(spark, G.document_type(F.lit(text))) == kind
    assert value(spark, G.academic_unit(F.lit("Khoa Công nghệ thông tin"), F.lit(None))) == "information_technology"
    reason = lambda inst, year, ok=True, missing=(): value(spark, G.release_reason(F.lit(inst), F.lit(year), F.lit(ok), F.array(*map(F.lit, missing)).cast("array<string>"), F.lit("gold"), F.lit(False), F.lit(True), ["hcmute"]))
    assert reason("hcmute", 2020) == "excluded_institution_hcmute"
    assert reason("ou", 2023) == "post_cutoff_year" and reason("ou", None) == "unknown_year" and reason("ou", 2020) is None
    assert reason("ou", 2020, False, ["year", "author"]) == "missing_metadata:author,year"


def test_topic_acceptance(spark):
    it = lambda title, faculty="": value(spark, topics.it_topic(F.lit(title), F.lit(""), F.lit(None), F.lit(faculty), ["công nghệ thông tin"], ["phần mềm", "học máy"], ["kế toán"]))
    assert it("Bất kỳ", "Khoa Công nghệ thông tin").accepted and it("Bất kỳ", "Khoa Công nghệ thông tin").tags == ["faculty:công nghệ thông tin"]
    assert it("Ứng dụng học máy").tags == ["học máy"] and not it("Văn học").accepted
    assert it("Phần mềm kế toán").accepted and not it("Kế toán học máy").accepted


def test_relevance_order(spark):
    got = lambda title, body="", kind="bachelor_thesis": value(spark, topics.relevance(F.lit(kind), F.lit(title), F.lit(body), F.lit(None))).reason
    assert got("x", kind="report") == "document_type_out_of_scope"
    assert got("Ngắn") == "invalid_or_placeholder_title" and got("Ngắn", "thuật toán " * 20) == "in_scope_computing"
    assert got("Nghiên cứu vi khuẩn trong đất") == "non_computing_domain"
    assert got("Xây dựng hệ thống quản lý") == "in_scope_computing"
    assert got("Hoạt động marketing của công ty") == "non_computing_domain"
    assert got("Hoạt động marketing của công ty", "dữ liệu " * 25) == "in_scope_computing"


def test_scalar_functions(spark):
    assert value(spark, T.ascii_key(F.lit("Đồ án: Học-máy!"))) == "do an hoc may"
    assert value(spark, T.core_title(F.lit("Khóa luận tốt nghiệp: Phân tích X / Nguyễn A"))) == "phân tích x"
    assert value(spark, T.chat_text(F.lit('```text\n"Một câu. Hai câu."\n```'))) == "Một câu. Hai câu."
    assert value(spark, T.repaired(F.lit("Ä\x91".encode("latin-1").decode("latin-1")))) == "đ"
    assert value(spark, T.repaired(F.lit("Trường"))) == "Trường"
    assert value(spark, ids.logical_id(F.lit("/a/ute_970426_title.pdf"))) == "ute_970426"
    assert value(spark, ids.logical_id(F.lit("20474_2354.pdf"))) == "ou_20474"
    assert value(spark, ids.stable_id("sent", F.lit("a"), F.lit(None))).startswith("sent_")
    assert value(spark, G.person_name(F.lit("Nguyễn Văn A"))) and not value(spark, G.person_name(F.lit("Khoa 12")))
    assert value(spark, T.tone_variants(F.lit("hóa"))) == "hoá"


def test_record_parsers(spark):
    lines = F.array(*map(F.lit, ["245 Phân tích dữ liệu / Trần B", "700 Lê C, hướng dẫn", "700 Trần B", "650 Dữ liệu<br>Học máy<br/>Dữ liệu", "260 H. : Đại học, 2019"]))
    marc = {k: value(spark, c) for k, c in R.marc(lines).items()}
    assert marc == {"title": "Phân tích dữ liệu", "advisors": ["Lê C"], "keywords": ["Dữ liệu", "Học máy"], "year": 2019}
    dc = R.dublin_core(F.lit('{"dc.title":[{"value":"T"}],"dc.contributor.author":[{"value":"A"},{"value":"B"}],"dc.date.issued":[{"value":"2018-05"}],"dc.type":[{"value":"Luận văn thạc sĩ"}]}'))
    assert [value(spark, dc[k]) for k in ("title", "authors", "year", "degree")] == ["T", ["A", "B"], 2018, "master"]
    c = R.citation(F.lit("Thiết kế web / Nguyễn A, Trần B; Lê C (GVHD). -- TP.HCM, 2017"))
    assert [value(spark, c[k]) for k in ("title", "authors", "advisors", "year")] == ["Thiết kế web", ["Nguyễn A", "Trần B"], ["Lê C"], 2017]
    cover = R.cover_fields("TRƯỜNG ĐẠI HỌC\nSinh viên thực hiện: Nguyễn Văn A\nGiảng viên hướng dẫn\nTS. Lê B\nTP. HCM, tháng 6 năm 2018")
    assert cover["author"] == "Nguyễn Văn A" and cover["advisor"] == "TS. Lê B" and cover["year"] == "2018"


def test_html_fields(spark):
    page = F.lit('<html><head><META content="B" name="DC.creator"><meta name="DC.creator" content="A"></head><body><script>x</script><h1>Head</h1><p>Some &amp; text</p></body></html>')
    assert value(spark, H.title_of(page)) == "Head" and sorted(value(spark, H.meta(page, "DC.creator"))) == ["A", "B"]
    assert value(spark, H.visible(page)) == "Head Some & text"
    assert value(spark, H.next_line(F.lit("Tác giả:\n  Nguyễn A\nNăm: 2019"), "Tác giả")) == "Nguyễn A"
    assert value(spark, H.redirect_target(F.lit("https://r.com/ck?u=a1aHR0cHM6Ly9hLnZuL3g"))) == "https://a.vn/x"


def test_frozen_splits_conflict_fails(spark):
    rows = spark.createDataFrame([("d1", "g1"), ("d2", "g2")], "document_id string, group_id string")
    frozen = spark.createDataFrame([("d1", "g1", "train"), ("d9", "g2", "dev")], "document_id string, group_id string, split string")
    got = {r.document_id: r.frozen_split for r in J.frozen_split(rows, frozen, ["document_id", "group_id"]).collect()}
    assert got == {"d1": "train", "d2": "dev"}
    clash = frozen.union(spark.createDataFrame([("x", "g1", "test")], frozen.schema))
    with pytest.raises(Exception, match="conflicting frozen splits"):
        J.frozen_split(rows, clash, ["document_id", "group_id"]).collect()


def test_prune_is_guarded(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha string")
    assert [r.path for r in J.guarded_prune(disk.where("path = 'a'"), disk, "path", "sha").orderBy("path").collect()] == ["b", "c"]
    for bad in ([("a", "9")], [("z", "1")]):
        with pytest.raises(ValueError):
            J.guarded_prune(spark.createDataFrame(bad, disk.schema), disk, "path", "sha")


def test_leaders_equal_the_greedy_loop(spark):
    rng = random.Random(0)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    reps, want = [], {}
    for i in range(40):
        want[i] = next((r for r in reps if (r, i) in pairs), i)
        reps += [i] * (want[i] == i)
    nodes = spark.range(40).withColumnRenamed("id", "node")
    got = {r.node: r.leader for r in D.leaders(nodes, spark.createDataFrame(list(pairs), "lo long, hi long")).collect()}
    assert got == want


def test_near_groups_against_all_pairs(spark):
    rng = random.Random(5)
    base = [f"tu{rng.randrange(500)}" for _ in range(300)]
    texts = [" ".join(base[:i] + ["x"] * (i % 3) + base[i:]) for i in range(12)] + [" ".join(rng.sample(base, 200)) for _ in range(8)] + ["", None, " ".join(base)]
    rows = list(enumerate(texts))
    values = {i: D.simhash_value(t or "") for i, t in rows}
    reps, want = [], {}
    for i, _ in rows:
        want[i] = next((r for r in reps if bin((values[r] ^ values[i]) & (2**64 - 1)).count("1") <= 3), i)
        reps += [i] * (want[i] == i)
    got = {r.doc_id: r.group_id for r in D.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_fuzzy_rules(spark):
    titles = ["phân tích dữ liệu lớn với spark", "phân tích dữ liệu lớn với spark", "phân tích dữ liệu lớn với sparks", "phân tích các dữ liệu lớn với spark", "thiết kế web"]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, core string")
    got = {(r.a, r.b): r.rule for r in D.fuzzy_pairs(df, "id", "core").collect()}
    assert got[0, 1] == "equal" and got[0, 2] == "inside" and got[0, 3] == "jaccard" and not any(4 in p for p in got)


def test_metadata_fingerprints_authors_and_ids(spark):
    fp = lambda t, a, y: value(spark, D.metadata_fingerprint(F.lit(t), F.array(*map(F.lit, a)).cast("array<string>"), F.lit(y)))
    assert fp("Học máy", ["B", "Á"], 2019) == fp("hoc  may", ["A", "b"], 2019) and fp("Học máy", [], 2019) is None
    people = spark.createDataFrame([(1, ["Lê A"]), (2, ["X"]), (3, None)], "id long, authors array<string>")
    known = spark.createDataFrame([("le a",)], "name string")
    assert sorted(r.id for r in D.known_authors(people, "authors", known, "name").collect()) == [2, 3]
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, n int")
    assert sorted(r.id for r in D.unique_ids(twice, "id", [F.col("n")]).collect()) == ["a", "a~2", "b"]


PASSAGE = "Mô hình ResNet-50 và PyTorch đạt 95.5% với batch = 32. Hệ thống hỗ trợ phân tích dữ liệu lớn. API chạy nhanh."


def test_skeleton_and_prompts(spark):
    df = spark.createDataFrame([("p1", PASSAGE)], "id string, text string")
    s = CF.skeleton(df, "id").first()
    assert {"ResNet-50", "PyTorch", "API"} <= set(s.key_entities) and "95.5%" in s.numeric_constraints
    assert s.core_assertions == ["Hệ thống hỗ trợ phân tích dữ liệu lớn."] and s.target_sentences == 3
    plan = CF.work_plan(df, "id", "text", F.lit("ai")).collect()
    assert {r.intervention for r in plan} == set(CF.INTERVENTIONS) and len({r.prompt_hash for r in plan}) == 4
    assert all((PASSAGE in r.prompt) == (r.label == "P") for r in plan)
    done = spark.createDataFrame([("p1", "p_light")], "source_passage_id string, intervention string")
    assert CF.work_plan(df, "id", "text", F.lit("ai"), done).count() == 3


def test_generation_retries_and_packaging(spark):
    plan = CF.work_plan(spark.createDataFrame([("p1", PASSAGE)], "id string, text string"), "id", "text", F.lit("ai"))
    calls = []

    def provider(system, prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return "```\nCâu một. Câu hai, v.v. tiếp.\n```"

    rows = CF.generated(plan.limit(1), provider, wait=0.0)
    units = CF.packaged(rows, "source_passage_id", "answer", "label").orderBy("ordinal").collect()
    assert [u.text for u in units] == ["Câu một.", "Câu hai, v.v. tiếp."] and all(u.label_id == CF.LABELS[u.label] for u in units)


def test_hybrid_invariants(spark):
    rows = [(i, [f"h{j} x" for j in range(i % 5)], [f"p{j}" for j in range(i % 3)], [f"g{j} y z" for j in range(i % 4)]) for i in range(60)]
    got = CF.hybrids(spark.createDataFrame(rows, "id long, h array<string>, p array<string>, g array<string>"), "id", "h", "p", "g").collect()
    assert {r.id for r in got} == {i for i, h, p, g in rows if h and (p or g)} and len({r.recipe for r in got}) == 4
    for r in got:
        words = [(w, label) for w, label in zip([s for s in r.text.replace(" x", "").replace(" y z", "").split()], r.labels)]
        assert all({"h": 0, "p": 1, "g": 2}[w[0]] == label for w, label in words)
        assert r.label_sequence.replace("| ", "").split() == ["HPG"[x] for x in r.labels]
        n = [{0: 2, 1: 1, 2: 3}[x] for x in r.labels]
        assert r.r_g == round(sum(k for k, x in zip(n, r.labels) if x == 2) / sum(n), 4)


def release(spark):
    make = spark.createDataFrame
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = "Một câu. Hai câu."
    return {
        "documents": make([("d", "g", "train", text, "accepted", None)], "document_id string, group_id string, split string, text string, status string, duplicate_of string"),
        "pages": make([("d", 0, text, sha(text))], "document_id string, page_index int, raw_text string, raw_sha256 string"),
        "sentences": make(
            [("s1", "d", 0, 0, 8, [0], "Một câu.", "ok", []), ("s2", "d", 0, 9, 17, [0], "Hai câu.", "ok", [])],
            "sentence_id string, document_id string, page_start int, doc_char_start int, doc_char_end int, source_spans array<int>, text string, normalization_status string, review_flags array<string>",
        ),
        "passages": make([("p", "active", text, sha(text), ["s1", "s2"], 8, True)], "passage_id string, status string, text string, text_sha256 string, sentence_ids array<string>, approx_tokens int, short_tail boolean"),
        "inventory": make([("c", "d")], "crawler_id string, document_id string"),
        "split_manifest": make([("d", "train")], "document_id string, split string"),
    }


BREAKS = {
    "group_split_leak": ("documents", lambda d: d.unionByName(d.withColumn("document_id", F.lit("e")).withColumn("split", F.lit("dev")))),
    "duplicate_document_id": ("documents", lambda d: d.unionByName(d)),
    "raw_page_checksum": ("pages", lambda d: d.withColumn("raw_text", F.lit("x"))),
    "frozen_split_mismatch": ("split_manifest", lambda d: d.withColumn("split", F.lit("test"))),
    "duplicate_not_excluded": ("documents", lambda d: d.withColumn("duplicate_of", F.lit("d"))),
    "duplicate_lineage_missing": ("documents", lambda d: d.withColumn("duplicate_of", F.lit("z"))),
    "inventory_incomplete": ("inventory", lambda d: d.where("false")),
    "inventory_duplicate": ("inventory", lambda d: d.unionByName(d)),
    "document_reference_missing": ("sentences", lambda d: d.withColumn("document_id", F.lit("z"))),
    "source_page_missing": ("sentences", lambda d: d.withColumn("page_start", F.lit(7))),
    "normalized_offset_mismatch": ("sentences", lambda d: d.withColumn("doc_char_start", F.col("doc_char_start") + 1)),
    "source_lineage_missing": ("sentences", lambda d: d.withColumn("source_spans", F.array().cast("array<int>"))),
    "text_checksum": ("passages", lambda d: d.withColumn("text_sha256", F.lit(None).cast("string"))),
    "token_limit_exceeded": ("passages", lambda d: d.withColumn("approx_tokens", F.lit(513))),
    "short_tail_unflagged": ("passages", lambda d: d.withColumn("short_tail", F.lit(False))),
    "unresolved_glyph": ("passages", lambda d: d.withColumn("text", F.lit(chr(0xE001)))),
    "review_unit_active": ("sentences", lambda d: d.withColumn("normalization_status", F.lit("review_required"))),
    "sentence_usage": ("passages", lambda d: d.withColumn("sentence_ids", F.array(F.lit("s1")))),
    "empty_text": ("documents", lambda d: d.withColumn("text", F.lit(" "))),
    "split_unknown": ("documents", lambda d: d.withColumn("split", F.lit("hold"))),
    "duplicate_sentence_id": ("sentences", lambda d: d.withColumn("sentence_id", F.lit("s1"))),
}


def test_a_valid_release_has_no_issue(spark):
    assert C.validate(release(spark), C.release_checks()).collect() == []
    assert set(BREAKS) == set(C.release_checks())


@pytest.mark.parametrize("code", sorted(BREAKS))
def test_each_violation_is_found(spark, code):
    tables = release(spark)
    name, spoil = BREAKS[code]
    tables[name] = spoil(tables[name])
    assert code in {r.code for r in C.release_checks()[code](tables).collect()}
