"""Queries of text forms and of gates on titles, names and passages.

The tables have no Vietnamese titles, so gates on titles read PHRASES in turn (by document id) beside each document's text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates as G
from ..operators import release as R
from ..operators import topics as P
from .dedup import FOLDED
from .registry import query, table

#: Titles, names and headings that meet or miss the gates.
PHRASES = [
    "Khóa luận tốt nghiệp: Ứng dụng học máy trong nhận dạng ảnh / Trần Thị B",
    "Luận văn tốt nghiệp",
    "Nghiên cứu mạng nơ ron và xử lý ngôn ngữ tự nhiên",
    "Tạp chí Khoa học 2019",
    "TRƯỜNG ĐẠI HỌC BÁCH KHOA HÀ NỘI",
    "Nguyễn Văn An",
    "Giảng viên hướng dẫn: TS. Lê Minh",
    "MỤC LỤC",
    "Chương 2 Cơ sở lý thuyết",
    "Trang 12",
    "Building a web platform for embedded IoT systems - Bachelor thesis 2021",
    "Hoạt động marketing và doanh thu bán hàng (2005, 2012)",
    "Vi khuẩn và enzyme trong nuôi tôm",
    "Điều khiển băng chuyền bằng vi điều khiển PIC16",
    "Em xin chân thành cảm ơn quý thầy cô",
    "Kết cấu bê tông của công trình dân dụng",
    "hoà bình và thuỷ triều",
    "Đại học Quốc gia Hà Nội",
    "Đồ án: quản lý thư viện web",
    "",
    "[12] Nguyen A., References",
    "Ngân hàng",
    "ÄÃ¡nh giÃ¡ há»\x87 thá»\x91ng",
    "Here is the answer:\n```text\n\"Straße im Überblick\"\n```",
]
DEWEYS = ["005.1", "621.39", "658.8", "", "340", "006"]
FACULTIES = ["Khoa Công nghệ thông tin", "Khoa Kế toán", "Kế toán - Tin học", ""]


def _literal(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _picked(values: list[str], step: int = 1):
    return F.get(F.array(*map(F.lit, values)), (F.floor(F.col("doc_id") / step) % len(values)).cast("int"))


def _pick(values: list[str], step: int = 1) -> str:
    return f"({_literal(values)})[1 + (doc_id // {step}) % {len(values)}]"


#: documents with phrase, the phrase picked for the row.
ROWS = f"p AS (SELECT *, {_pick(PHRASES)} AS phrase FROM documents)"


def _rows(spark, sf_dir):
    """documents with the phrase by a join (as many rows as PHRASES has), which keeps its expression out of the gates'."""
    phrases = spark.createDataFrame(list(enumerate(PHRASES)), "at int, phrase string")
    docs = table(spark, sf_dir, "documents").withColumn("at", (F.col("doc_id") % len(PHRASES)).cast("int"))
    return docs.join(F.broadcast(phrases), "at").drop("at")


_WS = r"[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]"
_KEY = "replace(strip_accents(replace(lower(coalesce({0}, '')), 'ß', 'ss')), 'đ', 'd')"


def _ascii(c: str) -> str:
    return f"trim(regexp_replace({_KEY.format(c)}, '[^a-z0-9]+', ' ', 'g'))"


@query(rf"""WITH p AS (SELECT doc_id, {_pick(PHRASES)} || chr(10) || coalesce(text, '') || ' co-' || chr(10) || 'op E' || chr(769) || chr(173) || 'x' AS text FROM documents),
l AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(replace(nfc_normalize(text), chr(173), ''), '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{0085}}\x{{2028}}\x{{2029}}]'), lambda x: trim(regexp_replace(x, '{_WS}+', ' ', 'g'))), lambda x: x <> '') AS ls FROM p)
SELECT doc_id, sha256({_ascii('text')}) AS ascii_key, sha256(trim(regexp_replace({_KEY.format('text')}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS letter_key,
 sha256({FOLDED}) AS fingerprint, sha256(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{009F}}]', ' ', 'g')) AS sanitized,
 sha256(trim(regexp_replace(nfc_normalize(text), '{_WS}+', ' ', 'g'), ' :-–—' || chr(9))) AS clean_line,
 sha256(trim(regexp_replace(replace(nfc_normalize(text), chr(173), ''), '{_WS}+', ' ', 'g'))) AS normalized_line,
 sha256(trim(regexp_replace(replace(regexp_replace(array_to_string(ls, chr(10)), '-\n(\p{{Ll}})', '\1', 'g'), chr(10), ' '), ' +', ' ', 'g'))) AS normalized_paragraph FROM l""")
def normal_forms(spark, sf_dir):
    tail = F.lit(" co-\nop É­x")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(_picked(PHRASES), F.lit("\n"), T.filled(F.col("text")), tail).alias("text"))
    t = F.col("text")
    digest = lambda c: F.sha2(c, 256)
    return docs.select(
        "doc_id", digest(T.ascii_key(t)).alias("ascii_key"), digest(T.letter_key(t)).alias("letter_key"), T.fingerprint(t).alias("fingerprint"), digest(T.sanitized(t)).alias("sanitized"),
        digest(T.clean_line(t)).alias("clean_line"), digest(T.normalized_line(t)).alias("normalized_line"), digest(T.normalized_paragraph(t)).alias("normalized_paragraph"),
    )


_TITLE_KEY = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_KINDS = T.WORK_KINDS
_CORE = rf"regexp_replace(regexp_replace(regexp_replace(trim(phrase), '\s*/\s*[^\n]*$', ''), '(?i)\s*[:\-]\s*(?:{_KINDS})[^\n]*$', ''), '(?i)^(?:{_KINDS})\s*[:\-./]?\s*', '')"


@query(rf"""WITH {ROWS} SELECT doc_id, {_TITLE_KEY.format('phrase')} AS title_key, {_TITLE_KEY.format(_CORE)} AS core_title,
 replace(replace(phrase, 'oà', 'òa'), 'uỷ', 'ủy') = phrase AS tones_left,
 TRY_CAST(nullif(regexp_extract(phrase, '(?:^|[^0-9\p{{L}}_])((?:19|20)[0-9]{{2}})(?:$|[^0-9\p{{L}}_])', 1), '') AS INT) AS first_year,
 CASE WHEN lower(phrase) ~ '.*(tiến sĩ|doctor|phd|dissertation).*' THEN 'doctoral' WHEN regexp_matches(lower(phrase), 'thạc sĩ|master') THEN 'master' WHEN regexp_matches(lower(phrase), 'khóa luận|đồ án|bachelor|undergraduate|capstone') THEN 'bachelor' ELSE 'unknown' END AS degree FROM p""")
def title_forms(spark, sf_dir):
    t = F.col("phrase")
    return _rows(spark, sf_dir).select(
        "doc_id", T.title_key(t).alias("title_key"), T.core_title(t).alias("core_title"), (T.tone_variants(t) == T.tone_variants(F.replace(F.replace(t, F.lit("oà"), F.lit("òa")), F.lit("uỷ"), F.lit("ủy")))).alias("same_tones"),
        T.first_year(t).alias("first_year"), T.degree(t).alias("degree"),
    ).drop("same_tones").withColumn("tones_left", ~(F.contains(_picked(PHRASES), F.lit("oà")) | F.contains(_picked(PHRASES), F.lit("uỷ"))))


def _any(c: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def _case(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + f" ELSE {otherwise} END"


_NON_BODY = " OR ".join(f"regexp_matches(whole, '{p.replace('(?iU)', '(?i)').replace('(?iUm)', '(?im)')}')" for p in G.NON_BODY)
_PROSE = " + ".join(rf"regexp_matches(lower(phrase || ' ' || whole), '(?:^|[^\p{{L}}\p{{N}}_]){w}(?:$|[^\p{{L}}\p{{N}}_])')::INT" for w in R.PROSE_WORDS)
_LETTERS = r"len(regexp_extract_all(phrase, '\p{L}'))"
_TOKENS = r"len(regexp_extract_all(phrase, '\S+'))"
_HEADING = r"(?i)^(?:chương\s+(?:[0-9]+|[ivxlcdm]+)|[0-9]+(?:\.[0-9]+){0,4}[.)]?\s+\S|mở\s+đầu|kết\s+luận|tóm\s+tắt|abstract|phụ\s+lục|mục\s+lục)"


@query(rf"""WITH {ROWS}, q AS (SELECT *, phrase || chr(10) || coalesce(text, '') AS whole FROM p)
SELECT doc_id, ({_NON_BODY}) AS non_body, ({_TOKENS} <= 15 AND regexp_matches(trim(phrase), '(?i)^(?:{'|'.join(G.RUNNING_HEADERS)})$')) AS running_header,
 (len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) >= 64 AND len(string_split(coalesce(text, ''), chr(10))) >= 2 AND NOT ({_NON_BODY})) AS eligible,
 ({_TOKENS} BETWEEN 2 AND 12 AND NOT regexp_matches(phrase, '[0-9]') AND {_LETTERS} / greatest(length(phrase), 1) >= 0.55 AND length(phrase) <= 120 AND NOT regexp_matches(lower(phrase), 'hướng dẫn|sinh viên|khoa|trường|ngành|mssv|lớp')) AS person,
 (phrase <> '' AND length(phrase) <= 180 AND NOT regexp_matches(phrase, '[.,;]$') AND (regexp_matches(phrase, '{_HEADING}') OR ({_LETTERS} >= 4 AND len(regexp_extract_all(phrase, '\p{{Lu}}')) / greatest({_LETTERS}, 1) >= 0.82))) AS heading,
 (len(regexp_extract_all(lower(repeat(phrase || ' ', 20)), '[{R.MARKS}]')) >= 80 AND ({_PROSE.replace("|| ' ' || whole", "")}) >= 3) AS vietnamese FROM q""")
def passage_gates(spark, sf_dir):
    t, text = F.col("phrase"), T.filled(F.col("text"))
    whole = F.concat(t, F.lit("\n"), text)
    return _rows(spark, sf_dir).select(
        "doc_id", G.is_non_body(whole).alias("non_body"), G.is_running_header(t).alias("running_header"),
        (G.passage_eligible(text, T.raw_tokens(text), F.size(F.split(text, "\n"))) & ~G.is_non_body(whole)).alias("eligible"),
        G.person_name(t).alias("person"), G.is_heading(t).alias("heading"), R.vietnamese(F.repeat(F.concat(t, F.lit(" ")), F.lit(20))).alias("vietnamese"),
    )


def _starts(prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with(dewey, '{p}')" for p in prefixes) + ")"


_KEYED = f"k AS (SELECT *, {_pick(DEWEYS, 3)} AS dewey, {_pick(FACULTIES, 5)} AS faculty, doc_id % 2 = 0 AS on_topic, lower(phrase) AS low, {_ascii('phrase')} AS key, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (2005 + doc_id % 20)::INT END AS year FROM p)"
_CATALOGUE = _case(
    [
        (_any("low", R.PERIODICALS), "periodical"),
        (f"NOT regexp_matches(low, '[{R.MARKS}]')", "no_vietnamese_title"),
        (f"NOT on_topic AND NOT {_starts(R.DEWEY)}", "off_topic"),
        (_starts(R.OTHER_DEWEY), "other_dewey"),
        (f"{_any('lower(faculty)', R.OTHER_FACULTIES)} AND NOT {_any('lower(faculty)', R.OWN_FACULTIES)}", "other_faculty"),
    ],
    "NULL",
)
_TYPE = _case(
    [
        (_any("key", ["luan an", "doctoral", "phd"]), "doctoral_dissertation"),
        (_any("key", ["thac si", "master", "luan van"]), "master_thesis"),
        (_any("key", ["do an", "capstone", "graduation project"]), "capstone_project"),
        (_any("key", ["khoa luan", "bachelor", "undergraduate thesis"]), "bachelor_thesis"),
        (_any("key", ["thuc tap", "internship"]), "internship_report"),
        (_any("key", ["nghien cuu", "cong trinh", "de tai", "research"]), "research_report"),
    ],
    "'other'",
)
_UNIT = _case([(_any("ukey", terms), name) for name, terms in G.UNITS.items()], "'other'")
_BUCKETS = _case([("year IS NULL", "unknown"), ("year <= 2010", "pre_2011"), ("year <= 2015", "2011_2015"), ("year <= 2019", "2016_2019"), ("year <= 2021", "2020_2021"), ("year = 2022", "2022")], "'2023_plus'")
_UET = "(contains(low, 'công nghệ') AND (contains(low, 'hà nội') OR contains(low, 'quốc gia')))"
_SCHOOL = _case([("low = ''", "unclassified"), *((_any("low", terms) + (f" OR {_UET}" if code == "VNU-UET" else ""), code) for terms, code in R.SCHOOLS)], "'other'")


@query(f"""WITH {ROWS}, {_KEYED}, u AS (SELECT *, {_ascii("faculty || ' ' || phrase")} AS ukey FROM k)
SELECT doc_id, {_CATALOGUE} AS catalogue_reason, {_TYPE} AS document_type, {_UNIT} AS academic_unit, {_BUCKETS} AS year_bucket, {_SCHOOL} AS school FROM u""")
def catalogue_gates(spark, sf_dir):
    t = F.col("phrase")
    year = F.when(F.col("doc_id") % 7 != 0, 2005 + F.col("doc_id") % 20)
    return _rows(spark, sf_dir).select(
        "doc_id", R.catalogue_reason(t, _picked(DEWEYS, 3), _picked(FACULTIES, 5), F.col("doc_id") % 2 == 0).alias("catalogue_reason"), G.document_type(t).alias("document_type"),
        G.academic_unit(_picked(FACULTIES, 5), t).alias("academic_unit"), G.year_bucket(year).alias("year_bucket"), R.school(t).alias("school"),
    )


BODIES = ["", "phần mềm ", "thuật toán và cơ sở dữ liệu ", "vi khuẩn "]


def _relevance(hits: str, with_body: bool) -> str:
    bad, override = "(key = '' OR starts_with(key, 'microsoft word bia') OR length(key) < 12)", _any("key", P.COMPUTING)
    return _case(
        [
            (f"NOT kind IN ({', '.join(repr(k) for k in P.KINDS)})", "document_type_out_of_scope"),
            (f"{bad} AND {hits} >= 20", "in_scope_computing"),
            (bad, "invalid_or_placeholder_title"),
            (f"{_any('key', P.HARDWARE)} AND NOT {_any('key', ['iot', 'internet of things'])} AND NOT {override}", "hardware_only"),
            (f"({_any('key', P.BIOLOGY)} OR {_any('key', P.CIVIL)}) AND NOT {override}", "non_computing_domain"),
            (f"{_any('key', P.BUSINESS)} AND NOT {override} AND {hits} >= 25", "in_scope_computing"),
            (f"{_any('key', P.BUSINESS)} AND NOT {override}", "non_computing_domain"),
            (f"domain = 'computer_science' OR {_any('key', P.HIGH_SIGNAL)} OR {override} OR {hits} >= 20", "in_scope_computing"),
        ],
        "'insufficient_computing_evidence'",
    )


_HITS = " + ".join(f"(length(body) - length(replace(body, '{t}', ''))) // {len(t)}" for t in P.BODY_TERMS)
_REL = f"""WITH {ROWS}, k AS (SELECT doc_id, {_ascii('phrase')} AS key, {_ascii(f"repeat({_pick(BODIES, 11)}, (doc_id % 40)::INT) || coalesce(text, '')")} AS body, {_pick([*P.KINDS, 'other'], 2)} AS kind, CASE WHEN doc_id % 9 = 0 THEN 'computer_science' ELSE 'other' END AS domain FROM p),
h AS (SELECT *, {_HITS} AS hits FROM k)"""


def _decided(spark, sf_dir, with_body: bool):
    body = F.concat(F.repeat(_picked(BODIES, 11), (F.col("doc_id") % 40).cast("int")), T.filled(F.col("text")))
    domain = F.when(F.col("doc_id") % 9 == 0, "computer_science").otherwise("other")
    got = P.relevance(_picked([*P.KINDS, "other"], 2), F.col("phrase"), body, domain, with_body)
    return _rows(spark, sf_dir).select("doc_id", got.alias("r")).select("doc_id", "r.accepted", "r.reason")


@query(f"{_REL} SELECT doc_id, reason = 'in_scope_computing' AS accepted, reason FROM (SELECT doc_id, {_relevance('hits', True)} AS reason FROM h)")
def relevance_with_body(spark, sf_dir):
    return _decided(spark, sf_dir, True)


@query(f"{_REL} SELECT doc_id, reason = 'in_scope_computing' AS accepted, reason FROM (SELECT doc_id, {_relevance('0', False)} AS reason FROM h)")
def relevance_of_titles(spark, sf_dir):
    return _decided(spark, sf_dir, False)
