"""Queries of the validation rules of each view, over tables made from the test tables with planted violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import constraints as C
from .registry import query, table


def _view(spark, sf_dir) -> dict[str, DataFrame]:
    """A training view: documents as they are, one chunk each of their first half, with violations by the id's remainder."""
    i = F.col("doc_id")
    body = T.filled(F.col("text"))
    every = lambda n, wrong, right: F.when(i % n == 0, wrong).otherwise(right)
    lit = F.lit
    docs = table(spark, sf_dir, "documents").select(
        i.alias("document_id"), body.alias("text"), F.char_length(body).alias("clean_character_count"),
        every(101, lit(""), F.col("source")).alias("institution_id"), F.col("source").alias("institution_name"), every(53, lit(None), lit("t")).alias("title"),
        F.when(i % 59 == 0, F.array().cast("array<string>")).otherwise(F.array(lit("a"))).alias("authors"), every(61, lit(None), lit(2010)).alias("year"), (i % 4 != 3).alias("training_eligible"),
        every(31, lit("excluded"), F.when(i % 3 == 0, "dev").otherwise("train")).alias("split"), every(37, lit("bronze"), lit("gold")).alias("quality_tier"), every(41, lit("xx"), lit("en")).alias("language_detected"),
        every(43, lit("poem"), lit("other")).alias("document_type_id"), every(47, lit(None), lit("cs")).alias("domain_id"), (i % 2 == 0).alias("core_human_eligible"),
        every(23, lit("unknown_year"), lit("high_confidence_human")).alias("provenance_status"), F.floor(i / 6).alias("group_id"),
    )
    j = F.col("document_id")
    half = F.floor(F.char_length("text") / 2)
    off = lambda n, wrong, right: F.when(j % n == 0, wrong).otherwise(right)
    chunks = docs.select(
        off(83, lit("c-1"), F.concat(lit("c"), j.cast("string"))).alias("chunk_id"), off(89, -j - 1, j).alias("document_id"), F.expr("substring(text, 1, cast(floor(char_length(text) / 2) as int))").alias("text"),
        off(19, lit(1), lit(0)).cast("long").alias("start_char"), half.cast("long").alias("end_char"), off(29, lit("test"), F.col("split")).alias("split"), off(71, lit(-1), F.col("group_id")).cast("long").alias("group_id"),
        F.when(j % 5 == 0, "recent_or_uncertain").when(j % 5 == 1, "excluded").otherwise("core_human").alias("subset"), "provenance_status", T.approx_tokens(F.expr("substring(text, 1, cast(floor(char_length(text) / 2) as int))")).alias("approx_tokens"),
        (j % 8 == 0).alias("short_tail"), off(13, lit(None), lit("why")).alias("exclusion_reason"), F.when(j % 73 == 0, F.array(lit("a"), lit("b"))).otherwise(F.array(lit("a"))).alias("section_ids"),
    )
    return {"documents": docs, "chunks": chunks, "passages": docs.select("document_id"), "sentences": docs.select("document_id")}


_VIEW = r"""d AS (SELECT doc_id AS i, coalesce(text, '') AS text, CASE WHEN doc_id % 101 = 0 THEN '' ELSE source END AS inst, source, doc_id % 4 <> 3 AS eligible,
 CASE WHEN doc_id % 31 = 0 THEN 'excluded' WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'train' END AS split, CASE WHEN doc_id % 23 = 0 THEN 'unknown_year' ELSE 'high_confidence_human' END AS prov, doc_id // 6 AS grp FROM documents),
c AS (SELECT CASE WHEN i % 83 = 0 THEN 'c-1' ELSE 'c' || i END AS id, i % 89 <> 0 AS known, i, CASE WHEN i % 29 = 0 THEN 'test' ELSE split END AS csplit, split, CASE WHEN i % 71 = 0 THEN -1 ELSE grp END AS cgrp, grp,
 CASE WHEN i % 5 = 0 THEN 'recent_or_uncertain' WHEN i % 5 = 1 THEN 'excluded' ELSE 'core_human' END AS subset, prov, eligible, substr(text, 1, length(text) // 2) AS half, length(text) AS len, text, i % 8 = 0 AS tail FROM d),
t AS (SELECT *, greatest(1, ceil(len(regexp_extract_all(half, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 1.18))::BIGINT AS tokens FROM c),
core AS (SELECT id, lower(trim(regexp_replace(half, '[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))) AS fp FROM c WHERE subset = 'core_human'),
firsts AS (SELECT fp, min(id) AS first, count(*) AS n FROM core GROUP BY fp)"""


def _rule(code: str, record: str, source: str, wrong: str, message: str = "''", severity: str = "error") -> str:
    return f"SELECT '{severity}' AS severity, '{code}' AS code, ({record})::VARCHAR AS record_id, {message} AS message FROM {source} WHERE {wrong}"


@query(
    f"WITH {_VIEW} "
    + " UNION ALL ".join(
        [
            _rule("institution_missing", "i", "d", "inst = '' OR source IS NULL OR source = ''"),
            _rule("eligible_metadata_missing", "i", "d", "eligible AND (i % 53 = 0 OR i % 59 = 0 OR i % 61 = 0 OR coalesce(inst, '') = '' OR coalesce(source, '') = '')"),
            _rule("eligible_split_invalid", "i", "d", "eligible AND split = 'excluded'"),
            _rule("eligible_quality_invalid", "i", "d", "eligible AND i % 37 = 0"),
            _rule("eligible_too_short", "i", "d", "eligible AND length(text) < 5000"),
            _rule("language_invalid", "i", "d", "eligible AND i % 41 = 0"),
            _rule("document_type_invalid", "i", "d", "i % 43 = 0"),
            _rule("domain_missing", "i", "d", "i % 47 = 0"),
            _rule("core_eligibility_invalid", "i", "d", "i % 2 = 0 AND NOT (eligible AND prov = 'high_confidence_human')"),
            "SELECT 'error', 'group_split_leak', grp::VARCHAR, min(split) || ',' || max(split) FROM d WHERE split <> 'excluded' GROUP BY grp HAVING min(split) <> max(split)",
            "SELECT 'error', 'duplicate_chunk_id', id, count(*) || ' rows' FROM c GROUP BY id HAVING count(*) > 1",
            _rule("chunk_document_missing", "id", "c", "NOT known"),
            _rule("chunk_split_mismatch", "id", "c", "known AND csplit <> split"),
            _rule("chunk_group_mismatch", "id", "c", "known AND cgrp <> grp"),
            _rule("core_provenance", "id", "c", "known AND subset = 'core_human' AND prov <> 'high_confidence_human'"),
            _rule("core_token_bound", "id", "t", "known AND subset = 'core_human' AND NOT (tokens BETWEEN 128 AND 512 OR (tail AND tokens < 128))"),
            _rule("duplicate_core_chunk", "id", "core JOIN firsts USING (fp)", "n > 1 AND id <> first", "first"),
            _rule("core_document_ineligible", "id", "c", "known AND subset = 'core_human' AND i % 2 <> 0"),
            _rule("recent_chunk_invalid", "id", "c", "known AND subset = 'recent_or_uncertain' AND NOT (eligible AND prov <> 'high_confidence_human')"),
            _rule("exclusion_reason_missing", "id", "c", "known AND subset = 'excluded' AND eligible AND i % 13 = 0"),
            _rule("source_span_mismatch", "id", "c", "known AND (i % 19 = 0 OR len // 2 < 1) AND NOT (i % 19 = 0 AND 1 < len // 2 AND substr(text, 2, len // 2 - 1) = half)"),
            _rule("crosses_sections", "id", "c", "known AND i % 73 = 0"),
            "SELECT 'error', 'count_mismatch', 'chunks', (SELECT count(*) FROM d) || ' declared ' || count(DISTINCT id) || ' found' FROM c HAVING count(DISTINCT id) <> (SELECT count(*) FROM d)",
        ]
    )
)
def training_view_rules(spark, sf_dir):
    return C.validate(_view(spark, sf_dir), C.training_view_checks())


def _records(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Turns as counterfactual records (user H, assistant P, else G) and their conversations as parents."""
    turns = table(spark, sf_dir, "conversations")
    k = F.col("conv_id").cast("long")
    n = k * 10 + F.col("turn")
    kind = F.when(F.col("role") == "user", "H").when(F.col("role") == "assistant", "P").otherwise("G")
    sentences = F.transform(F.split(T.filled(F.col("text")), r"\. "), lambda s, j: F.struct((j + F.when((n % 17 == 0) & (j > 0), 1).otherwise(0)).alias("ordinal"), s.alias("text")))
    records = turns.select(
        F.when(n % 29 == 0, "r-1").when(n % 37 == 0, "").otherwise(F.concat(F.lit("r"), n.cast("string"))).alias("record_id"), F.concat(F.lit("p"), k.cast("string")).alias("source_passage_id"),
        F.when(n % 13 == 0, "dev").otherwise("train").alias("split"), kind.alias("label_type"), F.when(n % 19 == 0, 7).when(kind == "H", 0).when(kind == "P", 1).otherwise(2).alias("label_id"),
        F.when(n % 23 == 0, " \n").otherwise(F.col("text")).alias("text"), T.approx_tokens(F.col("text")).alias("approx_tokens"), F.when(n % 31 == 0, F.slice(sentences, 1, 0)).otherwise(sentences).alias("sentences"),
        F.when(n % 3 == 0, "light").otherwise("heavy").alias("intervention_type"), F.concat(F.lit("g"), (n % 4).cast("string")).alias("generator_family"),
    )
    parents = turns.where(F.col("conv_id") % 11 != 0).select(F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("passage_id"), F.lit("train").alias("split")).distinct()
    return records, parents


_RECORDS = r"""n AS (SELECT *, conv_id::BIGINT * 10 + turn AS n FROM conversations),
r AS (SELECT CASE WHEN n % 29 = 0 THEN 'r-1' WHEN n % 37 = 0 THEN '' ELSE 'r' || n END AS id, conv_id, 'p' || conv_id AS parent, n, CASE WHEN n % 13 = 0 THEN 'dev' ELSE 'train' END AS split,
 CASE role WHEN 'user' THEN 'H' WHEN 'assistant' THEN 'P' ELSE 'G' END AS label, CASE WHEN n % 23 = 0 THEN '' ELSE coalesce(text, '') END AS text, greatest(1, ceil(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 1.18))::BIGINT AS tokens,
 len(string_split(coalesce(text, ''), '. ')) AS parts, CASE WHEN n % 3 = 0 THEN 'light' ELSE 'heavy' END AS intervention, 'g' || n % 4 AS generator FROM n)"""


@query(
    f"WITH {_RECORDS} "
    + " UNION ALL ".join(
        [
            _rule("record_id_missing", "parent", "r", "id = ''"),
            "SELECT 'error', 'duplicate_record_id', id, count(*) || ' rows' FROM r WHERE id <> '' GROUP BY id HAVING count(*) > 1",
            _rule("split_mismatch", "id", "r", "conv_id % 11 <> 0 AND split <> 'train'"),
            _rule("parent_missing", "id", "r", "conv_id % 11 = 0", severity="warning"),
            _rule("label_mismatch", "id", "r", "n % 19 = 0"),
            _rule("text_empty", "id", "r", r"regexp_matches(text, '^\s*$')"),
            _rule("short_text", "id", "r", "tokens < 30", severity="warning"),
            _rule("sentences_empty", "id", "r", "n % 31 = 0"),
            _rule("ordinal_sequence", "id", "r", "n % 31 <> 0 AND n % 17 = 0 AND parts > 1"),
        ]
    )
)
def counterfactual_rules(spark, sf_dir):
    records, parents = _records(spark, sf_dir)
    return C.validate({"records": records, "parents": parents}, C.counterfactual_checks())


@query(
    f"WITH {_RECORDS} SELECT dim, value, count(*) AS n FROM (SELECT unnest(['split', 'label', 'intervention', 'generator']) AS dim, unnest([split, label, intervention, generator]) AS value FROM r) GROUP BY ALL"
)
def counterfactual_rollup(spark, sf_dir):
    """Counts by split, label, intervention and generator in one pass."""
    records, _ = _records(spark, sf_dir)
    dims = {"split": "split", "label": "label_type", "intervention": "intervention_type", "generator": "generator_family"}
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for d, c in dims.items())))
    return records.select(pairs.alias("p")).groupBy("p.dim", "p.value").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS k, list_transform(ls, lambda x: length(x) + 1) AS sizes FROM l),
o AS (SELECT *, coalesce(list_sum(sizes[1:k - 1]), 0)::BIGINT + CASE WHEN (doc_id + k) % 17 = 0 THEN 1 ELSE 0 END AS st FROM u WHERE line <> '')
SELECT 'error' AS severity, 'source_span_invalid' AS code, doc_id || ':0:' || st AS record_id, '' AS message FROM o WHERE doc_id % 41 = 0 OR st + length(line) > length(text) OR substr(text, st + 1, length(line)) <> line""")
def page_span_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), T.filled(F.col("text")).alias("raw_text"), F.lit(0).alias("page_index"))
    lines = docs.select("document_id", "page_index", F.posexplode(F.split("raw_text", "\n", -1)).alias("k", "text"), F.split("raw_text", "\n", -1).alias("ls"))
    before = F.aggregate(F.slice("ls", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + F.char_length(x) + 1)
    moved = F.when((F.col("document_id") + F.col("k") + 1) % 17 == 0, 1).otherwise(0)
    lines = lines.where("text <> ''").withColumn("start", before + moved).withColumn("end", F.col("start") + F.char_length("text"))
    return C.wrong_page_spans(docs.where("document_id % 41 <> 0"), lines)


@query("""WITH d AS (SELECT doc_id AS i, CASE WHEN doc_id % 13 = 0 THEN '../' || doc_id ELSE 'pdf/' || doc_id END AS path, CASE WHEN doc_id % 11 = 0 THEN '' ELSE sha256(coalesce(text, '')) END AS sha FROM documents)
SELECT 'error' AS severity, CASE WHEN sha = '' THEN 'source_pdf_checksum_missing' WHEN i % 13 = 0 THEN 'source_pdf_path_unsafe' WHEN i % 7 = 0 THEN 'source_pdf_missing' ELSE 'source_pdf_checksum_mismatch' END AS code, i::VARCHAR AS record_id, '' AS message FROM d WHERE i % 11 = 0 OR i % 13 = 0 OR i % 7 = 0 OR i % 17 = 0
UNION ALL SELECT 'error', 'required_artifact_missing', 'pdf/' || doc_id, '' FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT 'error', 'count_mismatch', 'labels', (SELECT count(*) + 1 FROM labels) || ' declared ' || (SELECT count(*) FROM labels) || ' found'""")
def artifact_rules(spark, sf_dir):
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", T.filled(F.col("text")).alias("text"))
    path = F.concat(F.lit("pdf/"), i.cast("string"))
    files = docs.where(i % 7 != 0).select(path.alias("path"), F.sha2(F.when(i % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    sources = docs.select(i.alias("document_id"), F.when(i % 13 == 0, F.concat(F.lit("../"), i.cast("string"))).otherwise(path).alias("source_path"), F.when(i % 11 == 0, "").otherwise(F.sha2("text", 256)).alias("source_sha256"))
    labels, n = table(spark, sf_dir, "labels"), (F.count(F.lit(1)) + 1).alias("n")
    wanted = [labels.agg(F.lit("labels").alias("name"), n), docs.agg(F.lit("documents").alias("name"), F.count(F.lit(1)).alias("n"))]
    counts = C.count_differs(reduce(DataFrame.unionByName, wanted), {"labels": labels, "documents": docs})
    return C.source_files_differ(sources, files).unionByName(C.missing_artifacts(files, docs.select(path.alias("path")))).unionByName(counts)
