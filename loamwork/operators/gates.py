"""Ordered gates: lists of (condition, reason) compiled to one CASE, so the first failing gate names the reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

Rules = Sequence[tuple[Column, str | Column]]


def first_of(rules: Rules, otherwise: str | Column | None = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return out.otherwise(other)


def any_in(text: Column, terms: Sequence[str]) -> Column:
    """Whether any plain term is in the text: one search for all, so that the text's expression is evaluated once."""
    escaped = ("".join(c if c.isalnum() or c == " " else f"\\{c}" for c in t) for t in terms)
    return text.rlike("|".join(escaped)) if terms else F.lit(False)


def integrity_gate(text: Column, control: float = 0.002, symbol: float = 0.02) -> Column:
    """Reason if a text layer is broken: too many control characters or symbols."""
    m = T.integrity(text)
    return F.when((m["control_ratio"] > control) | (m["symbol_ratio"] > symbol), "corrupted_text_encoding")


def pdf_reason(bytes_: Column, pages: Column, chars: Column, fonts: Column, magic: Column, most_mb: int = 35) -> Column:
    """First failing gate of a thesis file: not a PDF, small, large, no fonts, few pages, little text."""
    return first_of(
        [
            (~F.startswith(magic, F.lit("%PDF")), "not_pdf"),
            (bytes_ < 600 * 1024, "too_small"),
            (bytes_ > most_mb * 1024 * 1024, "too_large"),
            (fonts < 2, "scanned"),
            (pages < 35, "too_few_pages"),
            (chars < 20_000, "too_little_text"),
        ]
    )


def release_reason(institution: Column, year: Column, eligible: Column, missing: Column, tier: Column, duplicate: Column, core: Column, excluded: Sequence[str], cutoff: int = 2022) -> Column:
    """Why a document is not released, null if it is; missing is an array of field names."""
    return first_of(
        [
            (institution.isin(list(excluded)), F.concat(F.lit("excluded_institution_"), institution)),
            (year.isNull(), "unknown_year"),
            (year > cutoff, "post_cutoff_year"),
            (~eligible & (F.size(missing) > 0), F.concat(F.lit("missing_metadata:"), F.array_join(F.array_sort(missing), ","))),
            (~eligible & (tier == "quarantine"), "quality_quarantine"),
            (~eligible & duplicate, "duplicate"),
            (~eligible, "not_eligible"),
            (~core, "not_core"),
        ]
    )


#: Signs of code, of tables and of headings that end a body.
CODE = r"(?i)[{};]{2,}|</?[a-z][^>]*>|(?<![\p{L}\p{N}_])(?:class|def|function|public|private|return|import|select|insert|update)(?![\p{L}\p{N}_])"
TABLE = r"\|.*\||\t.*\t"
HEADING = r"(?iu)^(?:chương\s+(?:[0-9]+|[ivxlcdm]+)|[0-9]+(?:\.[0-9]+){0,4}[.)]?\s+\S|mở\s+đầu|kết\s+luận|tóm\s+tắt|abstract|phụ\s+lục|mục\s+lục)"


def content_type(text: Column, section: Column | None = None) -> Column:
    """Kind of a unit: by its section's heading, then code, table, formula, else prose."""
    head = F.lower(T.collapsed(section)) if section is not None else F.lit("")
    size = F.greatest(F.char_length(text), F.lit(1))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    symbols = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]"))
    return first_of(
        [
            (head.rlike(r"^(tài liệu tham khảo|references|bibliography)"), "references"),
            (head.rlike(r"^(phụ lục|appendix)"), "appendix"),
            (head.rlike(r"^(lời cảm ơn|lời cam đoan|mục lục|danh mục|abstract|tóm tắt)"), "front_matter"),
            (F.regexp_count(text, F.lit(CODE)) >= 2, "code"),
            (text.rlike(TABLE), "table"),
            ((F.char_length(text) > 20) & (symbols / size > 0.22) & (letters / size < 0.45), "formula"),
        ],
        "prose",
    )


def is_heading(text: Column) -> Column:
    """Short, not ended like a sentence, and either numbered or named like a heading or nearly all in capitals."""
    letters, upper = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    return (
        (text != "")
        & (F.char_length(text) <= 180)
        & ~text.rlike(r"[.,;]$")
        & (text.rlike(HEADING) | ((letters >= 4) & (upper / F.greatest(letters, F.lit(1)) >= 0.82)))
    )


def document_type(kind: Column) -> Column:
    """Kind of work from free text, by the first rule that fits."""
    return T.bound(T.ascii_key(kind), lambda key: first_of(
        [
            (any_in(key, ["luan an", "doctoral", "phd"]), "doctoral_dissertation"),
            (any_in(key, ["thac si", "master", "luan van"]), "master_thesis"),
            (any_in(key, ["do an", "capstone", "graduation project"]), "capstone_project"),
            (any_in(key, ["khoa luan", "bachelor", "undergraduate thesis"]), "bachelor_thesis"),
            (any_in(key, ["thuc tap", "internship"]), "internship_report"),
            (any_in(key, ["nghien cuu", "cong trinh", "de tai", "research"]), "research_report"),
        ],
        "other",
    ))


#: Aliases of academic units in their order, the first that fits wins.
UNITS = {
    "information_technology": ["cong nghe thong tin", "khoa hoc may tinh", "phan mem", "computer", "information technology"],
    "electrical_engineering": ["dien tu", "dien dien", "tu dong hoa", "dieu khien", "embedded", "iot"],
    "business": ["quan tri kinh doanh", "marketing", "tai chinh", "ke toan", "business"],
    "economics": ["kinh te", "economics"],
    "biotechnology": ["cong nghe sinh hoc", "biotechnology"],
    "mechanical_engineering": ["co khi", "o to", "dong luc", "mechanical"],
    "education": ["giao duc", "day hoc", "education"],
}


def academic_unit(unit: Column, title: Column) -> Column:
    rules = lambda key: first_of([(any_in(key, terms), name) for name, terms in UNITS.items()], "other")
    return T.bound(T.ascii_key(F.concat_ws(" ", unit, title)), rules)


def year_bucket(year: Column) -> Column:
    return first_of(
        [(year.isNull(), "unknown"), (year <= 2010, "pre_2011"), (year <= 2015, "2011_2015"), (year <= 2019, "2016_2019"), (year <= 2021, "2020_2021"), (year == 2022, "2022")],
        "2023_plus",
    )


def language(text: Column) -> Column:
    """vi, en or mixed by the shares of marked words and of common words."""
    return T.bound(F.lower(T.filled(text)), lambda low: T.bound(F.regexp_extract_all(low, F.lit(r"\p{L}+"), F.lit(0)), lambda words: T.bound(_shares(low, words), lambda s: first_of(
        [((s["vi"] >= 0.025) & (s["en"] >= 0.025), "mixed"), (s["vi"] >= 0.025, "vi"), (s["en"] >= 0.025, "en")], "mixed"
    ))))


def _shares(low: Column, words: Column) -> Column:
    """struct(vi, en) of a lower-case text and its words."""
    n = F.greatest(F.size(words), F.lit(1))
    #: From its first mark a match takes the rest of the word, so a word counts once.
    marked = F.regexp_count(low, F.lit(rf"[{''.join(T.MARKED.values())}]\p{{L}}*"))
    common = lambda some: F.size(F.filter(words, lambda w: w.isin(some.split())))
    vi = (marked + 2 * common("và của trong được các nghiên kết hệ một những")) / n
    en = common("the of and in to is for this") / n
    return F.struct(vi.alias("vi"), en.alias("en"))


#: Signs of pages that are not body text (contents, thanks, references, cover), and of running headers.
#: The patterns decide which passages are released, so they are as given.
NON_BODY = [
    r"(?iU)\.{4,}\s*\d+|\bMỤC\s+LỤC\b|\bDANH\s+MỤC\s+(?:HÌNH|BẢNG|TỪ\s+VIẾT\s+TẮT)\b",
    r"(?iU)\bLỜI\s+CẢM\s+ƠN\b|\bLỜI\s+CAM\s+ĐOAN\b|\bLỜI\s+TRI\s+ÂN\b|chân\s+thành\s+cảm\s+ơn|xin\s+(?:gửi\s+lời\s+)?cảm\s+ơn|tỏ\s+lòng\s+biết\s+ơn|biết\s+ơn\s+sâu\s+sắc|tận\s+tình\s+dạy\s+dỗ",
    r"(?iUm)\bTÀI\s+LIỆU\s+THAM\s+KHẢO\b|\bREFERENCES\b|^\[\d+\]\s+[A-ZÀ-Ỹ]",
    r"(?iU)\bGIẢNG\s+VIÊN\s+HƯỚNG\s+DẪN\b|\bCÁN\s+BỘ\s+HƯỚNG\s+DẪN\b|\bSINH\s+VIÊN\s+THỰC\s+HIỆN\b|\bNGƯỜI\s+HƯỚNG\s+DẪN\b|\bHỘI\s+ĐỒNG\s+CHẤM\b",
]
RUNNING_HEADERS = [
    r"LUẬN\s+VĂN\s+TỐT\s+NGHIỆP.*",
    r"KHÓA\s+LUẬN\s+TỐT\s+NGHIỆP.*",
    r"ĐỒ\s+ÁN\s+TỐT\s+NGHIỆP.*",
    r"BÁO\s+CÁO\s+TỐT\s+NGHIỆP.*",
    r"TRƯỜNG\s+ĐẠI\s+HỌC\s+.*",
    r"ĐẠI\s+HỌC\s+QUỐC\s+GIA\s+.*",
    r"HỌC\s+VIỆN\s+CÔNG\s+NGHỆ\s+.*",
    r"CHƯƠNG\s+\d+.*",
    r"Trang\s+\d+",
    r"Page\s+\d+",
]
RUNNING_HEADER = f"(?iU)^(?:{'|'.join(RUNNING_HEADERS)})$"


def is_non_body(text: Column) -> Column:
    out = F.lit(False)
    for pattern in NON_BODY:
        out = out | text.rlike(pattern)
    return out


def is_running_header(text: Column) -> Column:
    return (T.space_tokens(text) <= 15) & F.trim(text).rlike(RUNNING_HEADER)


def passage_eligible(text: Column, tokens: Column, sentences: Column, min_tokens: int = 64, min_sentences: int = 2) -> Column:
    return (tokens >= min_tokens) & (sentences >= min_sentences) & ~is_non_body(text)


def person_name(name: Column) -> Column:
    """Whether a text can be a person's name: 2 to 12 words, no digits, mostly letters, at most 120 characters."""
    letters = F.regexp_count(name, F.lit(r"\p{L}")) / F.greatest(F.char_length(name), F.lit(1))
    label = F.lower(name).rlike("hướng dẫn|sinh viên|khoa|trường|ngành|mssv|lớp")
    return T.space_tokens(name).between(2, 12) & ~name.rlike("[0-9]") & (letters >= 0.55) & (F.char_length(name) <= 120) & ~label


def precedence(fields: dict[str, list[tuple[str, Column]]]) -> tuple[dict[str, Column], Column]:
    """Values of the first non-empty source for each field, and a map of field to the source's name (or missing)."""
    values, origin = {}, []
    for field, sources in fields.items():
        given = [(c.isNotNull() & (c.cast("string") != ""), s, c) for s, c in sources]
        values[field] = first_of([(ok, c) for ok, _, c in given])
        origin += [F.lit(field), first_of([(ok, s) for ok, s, _ in given], "missing")]
    return values, F.create_map(*origin)


def review_flags(**flags: Column) -> Column:
    """Names of the flags that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))
