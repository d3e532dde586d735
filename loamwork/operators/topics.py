"""Topics by weighted keyword counts, and the acceptance of computing topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .gates import any_in, first_of

#: Keywords of each topic; of topics with equal scores the first one here wins.
TOPICS = {
    "artificial_intelligence": [
        "trí tuệ nhân tạo", "học máy", "học sâu", "deep learning", "machine learning", "học có giám sát",
        "học không giám sát", "học tăng cường", "reinforcement learning", "xử lý ngôn ngữ tự nhiên", "nlp",
        "ngôn ngữ tự nhiên", "phân tích cảm xúc", "thị giác máy tính", "computer vision", "nhận dạng",
        "phát hiện khuôn mặt", "phát hiện đối tượng", "phân loại ảnh", "nhận diện", "yolo", "cnn", "transformer",
        "bert", "mạng nơ-ron", "neural network", "dự đoán", "mô hình ngôn ngữ", "llm", "phân cụm", "clustering",
        "trích xuất đặc trưng", "nhận dạng giọng nói", "speech", "ocr", "nhận dạng chữ viết", "khai phá văn bản",
        "text mining", "segmentation", "thực tế ảo", "vr", "tương tác người máy", "hci",
    ],
    "cybersecurity": [
        "an toàn thông tin", "an ninh mạng", "bảo mật", "mật mã", "mã hóa", "tấn công", "phát hiện xâm nhập", "ids",
        "ips", "malware", "mã độc", "phishing", "ransomware", "firewall", "tường lửa", "chữ ký số", "lỗ hổng",
        "vulnerability", "penetration", "xâm nhập", "bảo vệ dữ liệu", "mật mã học", "cryptography", "blockchain",
        "hợp đồng thông minh", "smart contract", "antivirus", "ddos", "xác thực", "authen",
    ],
    "networking": [
        "mạng máy tính", "mạng không dây", "truyền thông", "giao thức", "routing", "định tuyến", "iot",
        "internet of things", "mạng cảm biến", "sensor network", "wsn", "sdn", "software-defined", "5g", "4g", "lte",
        "wifi", "rfid", "lora", "điện toán đám mây", "cloud computing", "edge computing", "sao chép dữ liệu",
        "phân tán", "distributed system", "truyền dữ liệu", "băng thông", "trễ mạng",
    ],
    "information_systems": [
        "hệ thống thông tin", "cơ sở dữ liệu", "database", "sql", "nosql", "kho dữ liệu", "data warehouse",
        "khai phá dữ liệu", "data mining", "erp", "crm", "thương mại điện tử", "e-commerce", "quản lý thông tin",
        "truy vấn", "etl", "big data", "dữ liệu lớn", "quản lý bệnh viện", "quản lý nhân sự", "quản lý bán hàng",
        "gis", "địa lý", "hỗ trợ ra quyết định", "dss", "kinh doanh thông minh", "bi", "business intelligence",
    ],
    "software_engineering": [
        "kỹ thuật phần mềm", "công nghệ phần mềm", "thiết kế hệ thống", "phát triển ứng dụng", "microservices",
        "agile", "scrum", "uml", "design pattern", "kiến trúc phần mềm", "web", "website", "mobile", "android", "ios",
        "react", "flutter", "node", "django", "spring", "kiểm thử phần mềm", "software testing", "test automation",
        "refactoring", "game", "unity", "frontend", "backend", "fullstack", "devops", "ci/cd", "api",
    ],
}
#: What a title without keywords falls back on by its faculty.
FACULTY_TOPICS = [("phần mềm", "software_engineering"), ("an toàn", "cybersecurity"), ("mật mã", "cybersecurity"), ("mạng", "networking"), ("truyền thông", "networking"), ("hệ thống", "information_systems")]
#: Terms of computing in a key without marks, for evidence in a body.
BODY_TERMS = [
    "thuat toan", "lap trinh", "co so du lieu", "phan mem", "he thong", "tri tue nhan tao", "hoc may", "hoc sau",
    "mang no ron", "du lieu", "server", "client", "api", "database", "web", "ung dung", "mo hinh", "giao thuc",
    "an toan thong tin", "ma nguon", "ngon ngu", "dich may", "nhan dang", "thi giac may tinh", "xu ly anh",
    "robot", "cam bien", "java", "python", "php", "sql", "html", "css", "javascript", "reactjs", "react native",
    "django", "data warehouse", "olap", "ontology", "tro ly ao",
]
OVERRIDES = ["hệ thống", "phần mềm", "ứng dụng", "website", "xây dựng hệ thống", "thuật toán", "áp dụng"]


def _escaped(term: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in term)


def word_count(text: Column, terms: Sequence[str]) -> Column:
    """Whole-word occurrences of terms, each term counted on its own."""
    total = F.lit(0)
    for t in terms:
        count = F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){_escaped(t)}(?![\p{{L}}\p{{N}}_])"))
        total = total + F.when(F.contains(text, F.lit(t)), count).otherwise(0)  # a plain search first, as few terms occur
    return total


def classified(df: DataFrame, fields: list[tuple[Column, int]], topics: dict[str, list[str]], faculty: Column | None = None) -> DataFrame:
    """df with topic, confidence and best_score: keyword counts in each field times its weight.

    Without any keyword the faculty decides if it is given, else the first topic stands; the confidence is 0.5 then.
    """
    low = [(F.lower(T.filled(c)), w) for c, w in fields]
    df = df.withColumn("__scores", F.array(*(sum((word_count(c, ks) * w for c, w in low), F.lit(0)) for ks in topics.values())))
    best, total = F.array_max("__scores"), F.aggregate("__scores", F.lit(0), lambda a, x: a + x)
    named = F.get(F.array(*map(F.lit, topics)), (F.array_position("__scores", best) - 1).cast("int"))
    if faculty is not None:
        low_faculty = F.lower(T.filled(faculty))
        fallback = first_of([(F.contains(low_faculty, F.lit(k)), v) for k, v in FACULTY_TOPICS], "software_engineering")
        named = F.when(total == 0, fallback).otherwise(named)
    return (
        df.withColumn("topic", named)
        .withColumn("confidence", F.when(total == 0, F.lit(0.5)).otherwise(F.round(best / total, 4)))
        .withColumn("best_score", best.cast("int"))
        .drop("__scores")
    )


def it_topic(title: Column, abstract: Column, keywords: Column, faculty: Column, faculties: Sequence[str], wanted: Sequence[str], unwanted: Sequence[str], overrides: Sequence[str] = OVERRIDES) -> Column:
    """struct(accepted, tags): a faculty decides at once; else keywords of the whitelist, as whole words, unless the
    title has a term of the blacklist and no override."""
    low_title, low_faculty = F.lower(T.filled(title)), F.lower(T.filled(faculty))
    words = F.lower(F.concat_ws(" ", title, abstract, keywords))
    found = lambda w, k: F.when(F.contains(w, F.lit(k)) & T.has_word(w, k, r"[^\p{L}\p{N}]"), F.lit(k))  # noqa: E731  a plain search first
    all_tags = T.bound(words, lambda w: F.array_compact(F.array(*(found(w, k) for k in wanted))))
    hit = first_of([(F.contains(low_faculty, F.lit(f)), f"faculty:{f}") for f in faculties])
    fits = T.bound(low_title, lambda t: ~any_in(t, unwanted) | any_in(t, overrides))
    none = F.array().cast("array<string>")
    tags = F.when(hit.isNotNull(), F.array(hit)).when(fits, all_tags).otherwise(none)
    return T.bound(tags, lambda t: F.struct((F.size(t) > 0).alias("accepted"), t.alias("tags")))


#: Title terms of the relevance decision, in keys without marks.
HIGH_SIGNAL = [
    "tri tue nhan tao", "artificial intelligence", "hoc may", "machine learning", "hoc sau", "deep learning",
    "mang no ron", "neural network", "xu ly ngon ngu", "computer vision", "thi giac may tinh", "xu ly anh",
    "nhan dang", "phan doan anh", "phan mem", "software", "he thong thong tin", "co so du lieu", "database",
    "sql", "lap trinh", "thuat toan", "algorithm", "an toan thong tin", "bao mat", "cloud", "dien toan dam may",
    "internet of things", "iot", "web application", "ung dung web", "xay dung website", "android", "smartphone",
    "mobilegis", "client server", "khai pha du lieu", "data mining", "du lieu lon", "big data", "ontology",
    "dich may", "tro ly ao", "chatbot", "react", "django", "data warehouse", "olap", "robot", "giao thuc",
    "mang may tinh",
]
BUSINESS = [
    "marketing", "kinh doanh", "doanh thu", "ban hang", "nguoi tieu dung", "y dinh mua", "thai do", "long tin",
    "ngan hang", "chung khoan", "tai chinh", "giao thuc an", "content marketing", "seo website",
]
BIOLOGY = [
    "vi khuan", "virus", "gene ", " gen ", "enzyme", "te bao goc", "dua leo", "tom the", "probiotic", "len men",
    "nam ky sinh", "sinh hoc", "dau nanh", "dna", "pcr", "lactobacillus", "gan do tac", "men gan",
]
CIVIL = [
    "be tong", "ket cau khung", "ket cau bon", "cong trinh dan dung", "co dat", "geopolymer",
]
HARDWARE = [
    "vi dieu khien", "pic16", "pic 16", "pic18", "pic 18", " plc ", "mach dem", "mach chong", "thiet bi dien",
    "he thong dien", "bang chuyen", "rua oto tu dong", "bao chay tu dong", "led 3d",
]
COMPUTING = [
    "tri tue nhan tao", "hoc may", "machine learning", "hoc sau", "deep learning", "mang no ron",
    "neural network", "computer vision", "thi giac may tinh", "xu ly anh", "nhan dang", "phan doan anh",
    "ontology", "dich may", "tro ly ao", "web", "website", "phan mem", "ung dung", "he thong", "data warehouse",
    "olap", "react", "django",
]
KINDS = ["bachelor_thesis", "capstone_project", "master_thesis", "doctoral_dissertation", "research_report"]


def relevance(kind: Column, title: Column, body: Column, domain: Column, with_body: bool = True) -> Column:
    """struct(accepted, reason) of a thesis in computing. Without body evidence (the older rule), a short title or a
    business title is never rescued."""
    hits = F.lit(0)
    if with_body:
        hits = T.bound(T.ascii_key(body), lambda text: sum((T.count_of(text, term) for term in BODY_TERMS), F.lit(0)))
    facts = F.struct(T.ascii_key(title).alias("key"), hits.alias("hits"), kind.alias("kind"), domain.alias("domain"))
    return T.bound(facts, lambda f: _decision(f["key"], f["hits"], f["kind"], f["domain"]))


def _decision(key: Column, hits: Column, kind: Column, domain: Column) -> Column:
    bad = (key == "") | F.startswith(key, F.lit("microsoft word bia")) | (F.char_length(key) < 12)
    override = any_in(key, COMPUTING)
    reason = first_of(
        [
            (~F.coalesce(kind.isin(KINDS), F.lit(False)), "document_type_out_of_scope"),
            (bad & (hits >= 20), "in_scope_computing"),
            (bad, "invalid_or_placeholder_title"),
            (any_in(key, HARDWARE) & ~any_in(key, ["iot", "internet of things"]) & ~override, "hardware_only"),
            ((any_in(key, BIOLOGY) | any_in(key, CIVIL)) & ~override, "non_computing_domain"),
            (any_in(key, BUSINESS) & ~override & (hits >= 25), "in_scope_computing"),
            (any_in(key, BUSINESS) & ~override, "non_computing_domain"),
            ((domain == "computer_science") | any_in(key, HIGH_SIGNAL) | override | (hits >= 20), "in_scope_computing"),
        ],
        "insufficient_computing_evidence",
    )
    return F.struct((reason == "in_scope_computing").alias("accepted"), reason.alias("reason"))
