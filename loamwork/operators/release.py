"""Steps of a release: language and catalogue gates, paragraph and body-sentence selection, mapped names, queues,
manifests, roll-ups, samples."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranking import ranked
from .gates import any_in, first_of

#: Words of Vietnamese prose, catalogue classes, faculties and titles that decide at once.
PROSE_WORDS = [
    "và", "của", "trong", "được", "các", "cho", "với", "nghiên cứu", "đề tài", "khóa luận", "đồ án", "báo cáo",
    "hệ thống", "trường",
]
MARKS = "àáảãạăắằẳẵặâấầẩẫậđèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵ"
PERIODICALS = [
    "tạp chí", "bài báo", "kỷ yếu", "hội thảo", "journal", "proceedings", "conference",
]
DEWEY, OTHER_DEWEY = ["004", "005", "006", "621.39"], ["658", "657", "330", "340", "570", "660", "690", "300", "400", "420"]
OTHER_FACULTIES = [
    "quản trị kinh doanh", "quản trị nhân lực", "marketing", "kinh tế", "tài chính", "ngân hàng", "kế toán",
    "kiểm toán", "luật", "công nghệ sinh học", "sinh học", "xây dựng", "kỹ thuật công trình", "xã hội học",
    "công tác xã hội", "ngôn ngữ anh", "ngôn ngữ trung", "du lịch", "đông nam á",
]
OWN_FACULTIES = ["công nghệ thông tin", "tin học", "khoa học máy tính", "toán - tin"]
#: Terms of schools; the first school with a term in the name wins. VNU-UET is also what SCHOOL_PAIRS tells.
SCHOOLS = [
    (["bách khoa hà nội", "hust"], "HUST"),
    (["bách khoa", "bku", "hcmut", "b`ch khoa"], "HCMUT"),
    (["công nghệ thông tin", "uit"], "UIT"),
    (["khoa học tự nhiên", "hcmus"], "HCMUS"),
    (["đại học công nghệ", "uet"], "VNU-UET"),
    (["bưu chính", "ptit"], "PTIT"),
    (["sư phạm kỹ thuật", "ute"], "HCMUTE"),
    (["cần thơ", "ctu"], "CTU"),
    (["sư phạm hà nội", "hnue"], "HNUE"),
    (["giao thông", "utc"], "UTC"),
    (["công nghiệp", "iuh", "haui"], "IUH / HaUI"),
    (["an giang"], "AGU"),
    (["sài gòn"], "SGU"),
    (["thủy lợi"], "TLU"),
    (["xây dựng"], "NUCE"),
    (["quốc gia tp. hồ chí minh"], "VNU-HCM"),
    (["quốc gia hà nội"], "VNU"),
    (["mở", "ou"], "OU"),
]
#: A school whose name has the first term and one of the others.
SCHOOL_PAIRS = {"VNU-UET": ("công nghệ", ["hà nội", "quốc gia"])}


def vietnamese(text: Column, marks: int = 80, words: int = 3) -> Column:
    """Whether a text has enough marked letters and enough of the common words."""
    low = F.lower(T.filled(text))
    found = F.lit(0)
    for w in PROSE_WORDS:
        found = found + T.has_word(low, w, r"[^\p{L}\p{N}_]").cast("int")
    return (F.regexp_count(low, F.lit(f"[{MARKS}]")) >= marks) & (found >= words)


def catalogue_reason(title: Column, dewey: Column, faculty: Column, on_topic: Column) -> Column:
    """Why a catalogue entry is skipped before its details are fetched, null if it isn't."""
    low, own = F.lower(T.filled(title)), F.lower(T.filled(faculty))
    starts = lambda some: F.coalesce(dewey, F.lit("")).rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in some) + ")")
    return first_of(
        [
            (any_in(low, PERIODICALS), "periodical"),
            (~low.rlike(f"[{MARKS}]"), "no_vietnamese_title"),
            (~on_topic & ~starts(DEWEY), "off_topic"),
            (starts(OTHER_DEWEY), "other_dewey"),
            (any_in(own, OTHER_FACULTIES) & ~any_in(own, OWN_FACULTIES), "other_faculty"),
        ]
    )


def school(name: Column) -> Column:
    def found(low: Column, terms: list[str], code: str) -> Column:
        some = any_in(low, terms)
        if code in SCHOOL_PAIRS:
            first, others = SCHOOL_PAIRS[code]
            some = some | (F.contains(low, F.lit(first)) & any_in(low, others))
        return some

    rules = lambda low: first_of([(low == "", "unclassified"), *((found(low, terms, code), code) for terms, code in SCHOOLS)], "other")
    return T.bound(F.lower(T.filled(name)), rules)


def institution(name: Column) -> Column:
    """Stable id of an institution; unknown names get one from their key."""
    rules = lambda key: first_of(
        [
            (key == "", "institution_unknown"),
            (F.contains(key, F.lit("dai hoc mo")), "ou_hcmc"),
            (F.contains(key, F.lit("su pham ky thuat")) & any_in(key, ["ho chi minh", "tp hcm"]), "hcmute"),
            (F.contains(key, F.lit("dai hoc quoc gia ha noi")) | (key == "vnu hanoi"), "vnu_hanoi"),
        ],
        F.concat(F.lit("institution_"), F.substring(F.sha2(key, 256), 1, 12)),
    )
    return T.bound(T.ascii_key(name), rules)


def institution_of_source(source: Column) -> Column:
    low = F.lower(T.filled(source))
    return first_of([(any_in(low, ["hcmute", "sư phạm kỹ thuật"]), "hcmute"), (any_in(low, ["đại học mở", "(ou)"]), "ou_hcmc"), (any_in(low, ["vnu", "đhqg hà nội"]), "vnu_hanoi")], F.nullif(source, F.lit("")))


def provenance_status(year: Column, cutoff: int = 2022) -> Column:
    return first_of([(year.isNull(), "unknown_year"), (year <= cutoff, "high_confidence_human")], "recent_provenance_uncertain")


END = r"(?iu)^(?:tài\s+liệu\s+tham\s+khảo|references|bibliography|phụ\s+lục|appendix)"
CAPTION = r"(?iu)^(?:hình|bảng|sơ\s+đồ|figure|table)\s+[0-9]"


def selected_paragraphs(units: DataFrame, start: DataFrame, key: str = "doc_id", min_chars: int = 30, min_letters: int = 15) -> DataFrame:
    """Units (key, ordinal, line, kind) with column reason: why a paragraph isn't body text, null if it is.

    start has start_ordinal of each document (units.body_start); the start itself is left out. The body ends at
    the first end heading in the last half.
    """
    n = Window.partitionBy(key)
    units = units.join(start.select(key, "start_ordinal"), key, "left")
    late = F.greatest(F.coalesce("start_ordinal", F.lit(0)) + 1, F.floor(F.count(F.lit(1)).over(n) * 0.5))
    ends = (F.col("kind") == "heading") & F.col("line").rlike(END) & (F.col("ordinal") >= F.col("__late"))
    units = units.withColumn("__late", late).withColumn("__end", F.min(F.when(ends, F.col("ordinal"))).over(n))
    reason = first_of(
        [
            (F.col("ordinal") <= F.coalesce("start_ordinal", F.lit(-1)), "before_main_content"),
            (F.coalesce(F.col("ordinal") >= F.col("__end"), F.lit(False)), "after_references_or_appendix"),
            (F.col("kind") != "prose", F.concat(F.lit("content_type_"), F.col("kind"))),
            (F.col("line").rlike(CAPTION), "standalone_caption"),
            ((F.char_length("line") < min_chars) | (F.regexp_count("line", F.lit(r"\p{L}")) < min_letters), "too_short_or_nonlinguistic"),
        ]
    )
    return units.withColumn("reason", reason).drop("__late", "__end", "start_ordinal")


LAST = re.compile(r"^(?:(?:phan|chuong|section)\s+)?[a-z0-9ivx.-]*\s*[:.-]?\s*(?:(?:danh muc|thu muc)\s+)?(?:tai li\s*eu tham khao|references|bibliography|phu luc|appendix|tu danh gia)\b")
LAST_WORDS = ("tai lieu tham khao", "references", "bibliography", "phu luc", "appendix", "tu danh gia")


def body_sentences(sentences: DataFrame, pages: DataFrame) -> DataFrame:
    """Sentences (doc_id, ordinal, page, text) of the body: margin noise and what follows a page's end heading go.

    Sentences are found on their page from left to right, so a repeated one is looked for after the one before.
    """
    from .dedup import plain_key

    both = sentences.select("doc_id", "ordinal", "page", "text").unionByName(
        pages.select("doc_id", F.lit(None).cast("int").alias("ordinal"), "page", F.col("raw_text").alias("text"))
    )

    def cutoff(raw: str) -> int | None:
        at = 0
        for line in raw.splitlines(keepends=True):
            key = plain_key(line)
            at += len(line)
            if len(key) <= 100 and LAST.match(key):
                return at
        return None

    def noise(text: str) -> bool:
        key = plain_key(text)
        form = len(key) < 180 and "trang" in key and any(w in key for w in ("mssv", "lop", "svth", "dai hoc"))
        return not key or "muc luc" in key[:80] or form

    def run(group: pd.DataFrame) -> pd.DataFrame:
        raw = {int(p): t or "" for p, t in group.loc[group["ordinal"].isna(), ["page", "text"]].itertuples(index=False)}
        ends, cursor, over, rows = {p: cutoff(t) for p, t in raw.items()}, {}, set(), []
        own = group[group["ordinal"].notna()].sort_values("ordinal", kind="stable")
        for doc, ordinal, page, text in own[["doc_id", "ordinal", "page", "text"]].itertuples(index=False):
            page, text = int(page), text or ""
            if noise(text) or page in over:
                continue
            if ends.get(page) is not None:
                at = raw[page].find(text, cursor.get(page, 0))
                at = raw[page].find(text[:40], cursor.get(page, 0)) if at < 0 else at
                if any(w in plain_key(text)[:100] for w in LAST_WORDS) or at >= ends[page]:
                    over.add(page)
                    continue
                if at >= 0:
                    cursor[page] = at + max(1, len(text))
            rows.append((doc, int(ordinal), page, text))
        return pd.DataFrame(rows, columns=["doc_id", "ordinal", "page", "text"])

    kind = sentences.schema["doc_id"].dataType.simpleString()
    return both.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, ordinal int, page int, text string")


def with_lookup(df: DataFrame, table: DataFrame, key: str, column: str, default: str) -> DataFrame:
    """df with the column of a table with one row for each key, or the default."""
    return df.join(table.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def carried_identity(rows: DataFrame, frozen: DataFrame, old: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Identity columns from the frozen manifest, else the old release, else newly minted."""
    f, o = (df.select(F.col(key).alias(f"__{n}"), *(F.col(c).alias(f"__{n}_{c}") for c in columns)) for n, df in (("f", frozen), ("o", old)))
    met = rows.join(f, rows[key] == f["__f"], "left").join(o, rows[key] == o["__o"], "left")
    new = {c: F.coalesce(f"__f_{c}", f"__o_{c}", minted) for c, minted in columns.items()}
    return met.withColumns(new).select(*rows.columns, *(c for c in new if c not in rows.columns))


def synced(rows: DataFrame, path_key: Column, valid: DataFrame, valid_key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose file is valid or that name none, and the rejected rest. No file is deleted."""
    keyed = rows.withColumn("__k", path_key)
    known = valid.select(F.col(valid_key).alias("__k")).distinct()
    kept = keyed.where(F.col("__k").isNull() | (F.col("__k") == "")).unionByName(keyed.join(known, "__k", "left_semi").select(*keyed.columns))
    rejected = keyed.where(F.col("__k") != "").join(known, "__k", "left_anti").select(*keyed.columns)
    return kept.drop("__k"), rejected.drop("__k")


def review_queue(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages that need OCR with their document's path and tier, and the letters they have."""
    own = pages.where("needs_ocr").select("doc_id", "page", F.regexp_count(T.filled(F.col("raw_text")), F.lit(r"\p{L}")).alias("alpha_chars"))
    return own.join(documents.select("doc_id", "path", "tier"), "doc_id")


def metadata_manifest(documents: DataFrame, snapshot: DataFrame, key: str, canonical: list[str], kept: list[str]) -> DataFrame:
    """key, canonical (struct of the document's fields), repository_snapshot (struct of the record's kept fields, or null)."""
    side = snapshot.select(F.col(key).alias("__k"), F.struct(*kept).alias("repository_snapshot"))
    return documents.join(side, documents[key] == side["__k"], "left").select(key, F.struct(*canonical).alias("canonical"), "repository_snapshot")


def rolled_up(sentences: DataFrame, documents: DataFrame, by: str = "paragraph_id") -> DataFrame:
    """Paragraphs of sentences (doc_id, by, ordinal, start, end): first start, last end, ordinals in order, text slice."""
    groups = sentences.groupBy("doc_id", by).agg(
        F.min_by("start", "ordinal").alias("start"), F.max_by("end", "ordinal").alias("end"), F.array_sort(F.collect_list("ordinal")).alias("ordinals")
    )
    met = groups.join(documents.select("doc_id", F.col("text").alias("__t")), "doc_id")
    piece = F.substring("__t", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return met.withColumn("text", piece).withColumn("text_sha256", F.sha2("text", 256)).drop("__t")


def active_ordinals(rows: DataFrame, key: str, order: str, active: Column) -> DataFrame:
    """Numbers from 0 for the active rows of each key, null for the others."""
    upto = F.count(F.when(active, 1)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("active_ordinal", F.when(active, upto - 1))


def ordered_distinct(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key and its values in order, each once at its first place."""
    first = df.groupBy(key, value).agg(F.min(order).alias("__o"))
    listed = F.array_sort(F.collect_list(F.struct("__o", F.col(value).alias("v"))))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x["v"]).alias(value))


def seeded_sample(df: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum, the first by a seeded hash of the key."""
    hashed = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return ranked(hashed, by, "__h", "__n").where(F.col("__n") <= n).drop("__h", "__n")


def merge_statistics(df: DataFrame, source: str, abstract: str, keywords: str) -> DataFrame:
    """Records, share, and share with an abstract of each source; keywords has its own report (top terms)."""
    per = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(T.filled(F.col(abstract))) != "").alias("with_abstract"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select(
        source, "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("share"), F.round(100 * F.col("with_abstract") / F.col("n"), 1).alias("abstract_share")
    )
