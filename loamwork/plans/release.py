"""Queries of release steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates as G
from ..operators import release as R
from ..operators import units as U
from .corpus import UNITS
from .registry import query, table
from .sequences import HEADING_SQL, _heading


@query("""WITH n AS (SELECT source, count(*) AS n, count(*) FILTER (trim(coalesce(text, ''), ' ') <> '' AND lang = 'en') AS a FROM documents GROUP BY source)
SELECT source, n, round(100 * n / (SELECT count(*) FROM documents), 1) AS share, round(100 * a / n, 1) AS abstract_share FROM n""")
def merge_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("lang") == "en", F.col("text")).alias("abstract"), F.lit(None).alias("keywords"))
    return R.merge_statistics(docs, "source", "abstract", "keywords")


@query("""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) AS r FROM documents) WHERE r <= 5""")
def stratified_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return R.seeded_sample(docs, ["lang"], "doc_id", 5).select("doc_id", "lang", "source")


@query("""SELECT conv_id, turn, CASE WHEN role <> 'system' THEN count(*) FILTER (role <> 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 1 END AS active_ordinal FROM conversations""")
def active_ordinals(spark, sf_dir):
    return R.active_ordinals(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") != "system").select("conv_id", "turn", "active_ordinal")


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM f GROUP BY conv_id""")
def ordered_distinct_roles(spark, sf_dir):
    got = R.ordered_distinct(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return got.select("conv_id", F.array_join("role", ",").alias("roles"))


@query("""SELECT doc_id, coalesce(CASE WHEN label > 4 THEN 'high' WHEN label <= 4 THEN 'low' END, 'unknown') AS topic FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def topic_lookup(spark, sf_dir):
    topics = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") > 4, "high").otherwise("low").alias("topic"))
    return R.with_lookup(table(spark, sf_dir, "documents").select("doc_id"), topics, "doc_id", "topic", "unknown")


@query(f"""WITH {UNITS}, h AS (SELECT *, {HEADING_SQL} AS h FROM u), f AS (SELECT *, coalesce(sum(CASE WHEN h THEN 0 ELSE length(line) END) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING), 0) AS f FROM h),
s AS (SELECT *, min(CASE WHEN h AND f >= 300 THEN ordinal END) OVER (PARTITION BY doc_id) AS st FROM f)
SELECT lang, coalesce(CASE WHEN ordinal <= coalesce(st, -1) THEN 'before_main_content' WHEN h THEN 'content_type_heading' WHEN length(line) < 30 OR len(regexp_extract_all(line, '\\p{{L}}')) < 15 THEN 'too_short_or_nonlinguistic' END, 'selected') AS reason, count(*) AS n FROM s GROUP BY ALL""")
def paragraph_selection(spark, sf_dir):
    units = U.lines(table(spark, sf_dir, "documents"), "lang")
    start = U.body_start(units, _heading(F.col("line")), least=300)
    units = units.withColumn("kind", F.when(_heading(F.col("line")), "heading").otherwise("prose"))
    return R.selected_paragraphs(units, start).groupBy("lang", F.coalesce("reason", F.lit("selected")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, lang, quality AS tier, len(regexp_extract_all(coalesce(text, ''), '\\p{L}'))::INT AS alpha_chars FROM documents JOIN labels USING (doc_id) WHERE length(coalesce(text, '')) < 400""")
def ocr_review_queue(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.lit(0).alias("page"), F.col("text").alias("raw_text"), (F.char_length(T.filled(F.col("text"))) < 400).alias("needs_ocr"))
    meta = docs.select("doc_id", F.col("lang").alias("path")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("tier")), "doc_id")
    return R.review_queue(pages, meta).select("doc_id", F.col("path").alias("lang"), "tier", "alpha_chars")


@query("""SELECT 'kept' AS side, count(*) AS n FROM documents WHERE doc_id % 10 = 0 OR doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'rejected', count(*) FROM documents WHERE doc_id % 10 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def file_sync(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    key = F.when(F.col("doc_id") % 10 != 0, F.col("doc_id").cast("string"))
    kept, rejected = R.synced(docs, key, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("f")), "f")
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return count(kept, "kept").unionByName(count(rejected, "rejected"))


@query("""SELECT d.doc_id, coalesce(CASE WHEN e.label < 5 THEN 'frozen' || e.label END, CASE WHEN l.quality = 1 THEN 'old' END, 'new' || d.doc_id) AS group_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def identity_carry_over(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    frozen = table(spark, sf_dir, "embeddings").where("label < 5").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("frozen"), "label").alias("group_id"))
    old = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("old").alias("group_id"))
    return R.carried_identity(docs, frozen, old, "doc_id", {"group_id": F.concat(F.lit("new"), "doc_id")})


@query("""SELECT doc_id, lang || '/' || source AS canonical, CASE WHEN l.doc_id IS NOT NULL THEN quality || '/' || toxic END AS snapshot FROM documents LEFT JOIN labels l USING (doc_id)""".replace("l.doc_id IS NOT NULL", "quality IS NOT NULL"))
def metadata_manifest(spark, sf_dir):
    got = R.metadata_manifest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", ["lang", "source"], ["quality", "toxic"])
    return got.select("doc_id", F.concat_ws("/", "canonical.lang", "canonical.source").alias("canonical"), F.when(F.col("repository_snapshot").isNotNull(), F.concat_ws("/", "repository_snapshot.quality", "repository_snapshot.toxic")).alias("snapshot"))


@query(f"""WITH {UNITS}, o AS (SELECT *, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM u),
g AS (SELECT doc_id, (ordinal // 5)::INT AS paragraph_id, min(st) AS start, max(st + length(line)) AS "end" FROM o GROUP BY ALL)
SELECT doc_id, paragraph_id, start, "end", sha256(substr(array_to_string(ls, chr(10) || chr(10)), (start + 1)::INT, ("end" - start)::INT)) AS text_sha256 FROM g JOIN u0 USING (doc_id)""")
def paragraph_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    units = U.with_offsets(U.lines(docs)).withColumn("paragraph_id", F.floor(F.col("ordinal") / 5).cast("int"))
    whole = docs.select("doc_id", F.array_join(U.lines_of(F.col("text")), "\n\n").alias("text"))
    return R.rolled_up(units, whole).select("doc_id", "paragraph_id", "start", "end", "text_sha256")


@query("""SELECT doc_id, 'institution_' || substr(sha256(lower(source)), 1, 12) AS institution, CASE WHEN doc_id % 11 = 0 THEN 'unknown_year' WHEN 1995 + doc_id % 30 <= 2022 THEN 'high_confidence_human' ELSE 'recent_provenance_uncertain' END AS provenance FROM documents""")
def institution_and_provenance(spark, sf_dir):
    year = F.when(F.col("doc_id") % 11 != 0, 1995 + F.col("doc_id") % 30)
    return table(spark, sf_dir, "documents").select("doc_id", R.institution(F.col("source")).alias("institution"), R.provenance_status(year).alias("provenance"))
