from pyspark.sql import functions as F

from loamwork.operators import release as R


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_language_and_catalogue_gates(spark):
    prose = "Nghiên cứu của trường được trình bày trong các báo cáo với hệ thống. " * 10
    assert value(spark, R.vietnamese(F.lit(prose))) and not value(spark, R.vietnamese(F.lit("The system of the school")))
    got = lambda title, dewey="", faculty="", topic=True: value(spark, R.catalogue_reason(F.lit(title), F.lit(dewey), F.lit(faculty), F.lit(topic)))
    assert got("Tạp chí Khoa học") == "periodical" and got("Web system") == "no_vietnamese_title"
    assert got("Hệ thống", topic=False) == "off_topic" and got("Hệ thống", "005.1", topic=False) is None
    assert got("Hệ thống", "658.4") == "other_dewey" and got("Hệ thống", "005", "Khoa Kinh tế") == "other_faculty"
    assert got("Hệ thống", "621x39", topic=False) == "off_topic"


def test_mapped_names(spark):
    assert value(spark, R.school(F.lit("ĐH Bách Khoa Hà Nội"))) == "HUST" and value(spark, R.school(F.lit(None))) == "unclassified"
    assert value(spark, R.institution(F.lit("Trường Đại học Mở TP.HCM"))) == "ou_hcmc"
    assert value(spark, R.institution_of_source(F.lit("VNU Repository"))) == "vnu_hanoi" and value(spark, R.institution_of_source(F.lit(""))) is None


def test_body_sentences_end_at_the_last_heading(spark):
    pages = spark.createDataFrame([(1, 0, "Câu một. Câu một.\nTài liệu tham khảo\nCâu một."), (1, 1, "Câu hai.")], "doc_id long, page int, raw_text string")
    rows = [(1, 0, 0, "Câu một."), (1, 1, 0, "Câu một."), (1, 2, 0, "Câu một."), (1, 3, 1, "Câu hai."), (1, 4, 1, "Trang 3 MSSV 123"), (2, 0, 0, "Khác.")]
    got = R.body_sentences(spark.createDataFrame(rows, "doc_id long, ordinal int, page int, text string"), pages).collect()
    assert sorted((r.doc_id, r.ordinal) for r in got) == [(1, 0), (1, 1), (1, 3), (2, 0)]


def test_carried_identity_prefers_frozen(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    frozen = spark.createDataFrame([("a", "f")], "id string, g string")
    old = spark.createDataFrame([("a", "o"), ("b", "o")], "id string, g string")
    got = {r.id: r.g for r in R.carried_identity(rows, frozen, old, "id", {"g": F.concat(F.lit("new-"), "id")}).collect()}
    assert got == {"a": "f", "b": "o", "c": "new-c"}
