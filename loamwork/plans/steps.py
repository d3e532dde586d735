"""Queries of small steps: look-ups, samples, reports, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..operators import joins as J
from ..operators import reports as R
from ..operators import steps as S
from ..operators import units as U
from ..sources import files
from .corpus import UNITS
from .registry import query, table


@query(f"""WITH {UNITS}, o AS (SELECT doc_id, ordinal AS span, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, length(line) AS n FROM u),
t AS (SELECT doc_id, unnest(range(0, n_chars, 300)) AS start FROM documents)
SELECT t.doc_id, (t.start // 300)::BIGINT AS token, span FROM t JOIN o ON o.doc_id = t.doc_id AND t.start + 350 > char_start AND t.start < char_start + n WHERE n > 0""")
def interval_overlaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    spans = U.with_offsets(U.lines(docs)).select("doc_id", F.col("ordinal").alias("span"), F.col("start").cast("long").alias("char_start"), F.col("end").cast("long").alias("char_end"))
    starts = docs.where("n_chars > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars").cast("long") - 1, F.lit(300).cast("long"))).alias("start"))
    tokens = starts.select("doc_id", F.floor(F.col("start") / 300).alias("token"), "start", (F.col("start") + 350).alias("end"))
    return S.overlaps(tokens, spans, "doc_id").select("doc_id", "token", "span")


@query("""SELECT o.l_orderkey, o.l_linenumber, o.l_partkey, o.l_suppkey, p.l_quantity AS quantity FROM lineitem o LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey, min(l_quantity) AS l_quantity FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY ALL) p
 ON o.l_orderkey = p.l_orderkey AND o.l_linenumber = p.l_linenumber AND o.l_partkey = p.l_partkey""")
def composite_lookup(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    known = items.where("l_suppkey % 5 <> 0").withColumnRenamed("l_quantity", "quantity")
    return S.looked_up(items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), known, ["l_orderkey", "l_linenumber", "l_partkey"], ["quantity"])


@query("""SELECT conv_id, turn, CASE WHEN p.doc_id IS NULL THEN 'warning' ELSE 'error' END AS severity FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS toxic FROM conversations) c
 LEFT JOIN labels p ON p.doc_id = c.conv_id WHERE p.doc_id IS NULL OR p.toxic IS DISTINCT FROM c.toxic""")
def inherited_values(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.when(F.col("turn") % 3 == 0, 1).otherwise(0).alias("toxic"))
    return J.inherited(turns, table(spark, sf_dir, "labels"), "doc_id", "toxic").select(F.col("doc_id").alias("conv_id"), "turn", "severity")


@query("""SELECT page_id, CASE WHEN host <> '' THEN min(page_id) OVER (PARTITION BY host) END AS owner FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM pages)""")
def row_owners(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1)
    return files.owners(table(spark, sf_dir, "pages").select("page_id", F.nullif(host, F.lit("")).alias("host")), "host", "page_id").select("page_id", "owner")


@query("""SELECT conv_id, turn, quality AS source_id FROM conversations JOIN labels ON doc_id = conv_id WHERE toxic = 0""")
def source_lineage(spark, sf_dir):
    accepted = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("conv_id"), F.col("quality").alias("source_id"))
    return S.with_lineage(table(spark, sf_dir, "conversations"), accepted, "conv_id", "source_id").select("conv_id", "turn", "source_id")


@query("""SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean, median(n_chars)::DOUBLE AS median FROM documents GROUP BY source""")
def review_card(spark, sf_dir):
    return S.review_card(table(spark, sf_dir, "documents"), "source", "n_chars")


@query("""SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT sum(n_chars)::BIGINT FROM documents) AS chars, (SELECT count(*) FROM conversations) AS n_turns, (SELECT sum(toxic)::BIGINT FROM labels) AS toxic, (SELECT count(*) FROM labels) AS n_labels""")
def release_totals(spark, sf_dir):
    tables = {"documents": table(spark, sf_dir, "documents"), "turns": table(spark, sf_dir, "conversations"), "labels": table(spark, sf_dir, "labels")}
    return S.totals(tables, chars=("documents", F.col("n_chars")), toxic=("labels", F.col("toxic")))


@query("""SELECT count(*) AS processed, count(*) FILTER (l.doc_id IS NULL) AS generated, count(*) FILTER (l.doc_id IS NOT NULL) AS skipped_existing FROM documents d LEFT JOIN labels l USING (doc_id)""")
def generation_stats(spark, sf_dir):
    return S.generation_stats(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) <= 7""")
def head_of_each(spark, sf_dir):
    return S.head_of_each(table(spark, sf_dir, "documents"), "lang", ["n_chars", "doc_id"], 7).select("doc_id", "lang")


@query("""SELECT doc_id, n_chars FROM documents QUALIFY (row_number() OVER (ORDER BY doc_id) - 1) % 60 = 0 AND row_number() OVER (ORDER BY doc_id) - 1 < 60 * 15""")
def systematic_sample(spark, sf_dir):
    return S.every_nth(table(spark, sf_dir, "documents"), "doc_id", 60, 15).select("doc_id", "n_chars")


@query("""SELECT lang, doc_id, source FROM documents ORDER BY lang DESC, lower(source), doc_id LIMIT 25""")
def limited_sort(spark, sf_dir):
    order = [F.col("lang").desc(), F.lower("source"), F.col("doc_id")]
    return S.first_rows(table(spark, sf_dir, "documents").select("lang", "doc_id", "source"), order, 25)


@query("""SELECT conv_id, arg_max(text, (length(text), -turn)) AS text FROM conversations GROUP BY conv_id""")
def longest_candidate(spark, sf_dir):
    return S.longest(table(spark, sf_dir, "conversations"), "conv_id", "text", "turn").select("conv_id", "text")


@query("""SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)""")
def not_subset(spark, sf_dir):
    return S.not_subset(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("n_chars > 500"), "doc_id")


@query("""SELECT doc_id, 'document' AS role, lang, NULL::INT AS quality FROM documents UNION ALL SELECT doc_id, 'label', NULL, quality FROM labels""")
def role_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("role"), "lang")
    return J.union_all(docs, table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("role"), F.col("quality").cast("int").alias("quality")))


@query("""SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (CASE WHEN l.toxic = 1 THEN 'de' ELSE d.lang END) = d.lang)""")
def resumed_work(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    done = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "de").otherwise(F.col("lang")).alias("lang"))
    return D.without_done(docs, done, ["doc_id", "lang"])


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)""")
def uncompleted_tasks(spark, sf_dir):
    log = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("interrupted"))
    return S.without_completed(table(spark, sf_dir, "documents").select("doc_id"), log, "doc_id", "interrupted")


@query("""SELECT doc_id, CASE WHEN r > 1 THEN source || '~' || r ELSE source END AS source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)""")
def repaired_ids(spark, sf_dir):
    return D.unique_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", [F.col("doc_id")])


@query("""WITH a AS (SELECT doc_id, list_sort([lower(source), lang]) AS names, lang AS title, 1990 + doc_id % 30 AS year FROM documents)
SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN sha256(title || '|' || names[1] || ';' || names[2] || '|' || year) END AS fingerprint FROM a""")
def metadata_fingerprints(spark, sf_dir):
    year = F.when(F.col("doc_id") % 9 != 0, 1990 + F.col("doc_id") % 30)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", D.metadata_fingerprint(F.col("lang"), F.array("source", "lang"), year).alias("fingerprint"))


@query("""WITH known AS (SELECT DISTINCT lower(source) AS a FROM documents WHERE doc_id % 40 = 0) SELECT doc_id FROM documents WHERE lower(source) NOT IN (SELECT a FROM known) AND ('x' || doc_id % 50) NOT IN (SELECT a FROM known)""")
def unknown_authors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.upper("source"), F.concat(F.lit("X"), (F.col("doc_id") % 50).cast("string"))).alias("authors"), "source")
    known = docs.where("doc_id % 40 = 0").select("source")
    return D.known_authors(docs, "authors", known, "source").select("doc_id")


@query("""SELECT count(*) FILTER (n_chars < 400) AS short, count(*) FILTER (coalesce(text, '') ~ '(?s).*[0-9]{4}.*') AS digits, count(*) FILTER (lang = 'en') AS english, count(*) AS "rows" FROM documents""")
def quality_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    t = T.filled(F.col("text"))
    return R.quality_flags(docs, short=F.col("n_chars") < 400, digits=t.rlike("[0-9]{4}"), english=F.col("lang") == "en")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def prune_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.md5(T.filled(F.col("text"))).alias("digest"))
    active = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return J.guarded_prune(active, docs, "doc_id", "digest").select("doc_id", "source")


@query("""SELECT lang, n_chars FROM documents""")
def projected_columns(spark, sf_dir):
    return files.projected(table(spark, sf_dir, "documents"), ["lang", "absent", "n_chars"])
