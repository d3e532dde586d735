"""Queries on duplicates of documents and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..sources.html import title_of
from .registry import query, table


#: Composed, case-folded (of the letters whose folding isn't their lower case the tables have ß), collapsed.
FOLDED = """trim(regexp_replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '[\\s\\x0B\\x1C-\\x1F\\x{0085}\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g'))"""


@query(f"""WITH f AS (SELECT doc_id, sha256({FOLDED}) AS fingerprint FROM documents)
SELECT doc_id, fingerprint, min(doc_id) OVER w AS owner, count(*) OVER w AS group_size, doc_id <> min(doc_id) OVER w AS is_duplicate FROM f WINDOW w AS (PARTITION BY fingerprint)""")
def doc_fingerprint_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return D.by_fingerprint(docs, T.fingerprint(F.col("text")), "doc_id").select("doc_id", "fingerprint", "owner", "group_size", "is_duplicate")


TITLE_SQL = "trim(regexp_replace(regexp_replace(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


#: One row after the other: a row is kept unless its host or its title is that of a kept one.
@query(f"""WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY page_id) AS r, page_id, url_key, title FROM (SELECT page_id, regexp_replace(url, '[0-9]+', '', 'g') AS url_key, {TITLE_SQL} AS title FROM pages)),
g AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS ids, []::VARCHAR[] AS titles, NULL::BIGINT AS page_id, '' AS title, false AS kept
 UNION ALL SELECT t.r, CASE WHEN ok THEN list_append(ids, t.url_key) ELSE ids END, CASE WHEN ok AND t.title <> '' THEN list_append(titles, t.title) ELSE titles END, t.page_id, t.title, ok
 FROM (SELECT g.r AS before, ids, titles, n.*, NOT (n.url_key <> '' AND list_contains(ids, n.url_key)) AND NOT (n.title <> '' AND list_contains(titles, n.title)) AS ok FROM g JOIN t n ON n.r = g.r + 1) t)
SELECT page_id, title FROM g WHERE kept""")
def first_wins_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[0-9]+", "").alias("url_key"), T.title_key(title_of(F.col("html"))).alias("title"))
    return D.first_wins(pages, [F.col("url_key"), F.col("title")], [F.col("page_id")]).select("page_id", "title")


#: All pairs of all titles, by brute force.
@query(f"""WITH t AS (SELECT page_id, {TITLE_SQL} AS core FROM pages), c AS (SELECT core, min(page_id) AS id FROM t WHERE core <> '' GROUP BY core), w AS (SELECT *, list_distinct(string_split(core, ' ')) AS ws FROM c),
p AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) AS j,
 least(length(a.core), length(b.core)) AS s, greatest(length(a.core), length(b.core)) AS l, contains(a.core, b.core) OR contains(b.core, a.core) AS held FROM w a JOIN w b ON a.core < b.core),
r AS (SELECT a, b, CASE WHEN s >= 20 AND held AND s / l >= 0.82 THEN 'inside' WHEN l - s <= l * 0.3 AND j >= 0.80 THEN 'jaccard' END AS rule, round(j, 4) AS jaccard FROM p)
SELECT * FROM r WHERE rule IS NOT NULL UNION ALL SELECT id, page_id, 'equal', 1.0 FROM t JOIN c USING (core) WHERE page_id <> id""")
def near_title_pairs(spark, sf_dir):
    """The rules of fuzzy_pairs that SQL can express; fuzzy_title_pairs has the sequence rule as well."""
    titles = table(spark, sf_dir, "pages").select("page_id", T.title_key(title_of(F.col("html"))).alias("core"))
    return D.fuzzy_pairs(titles, "page_id", "core", loose=None)


@query()
def fuzzy_title_pairs(spark, sf_dir):
    titles = table(spark, sf_dir, "pages").select("page_id", T.title_key(title_of(F.col("html"))).alias("core"))
    return D.fuzzy_pairs(titles, "page_id", "core")


@query()
def near_duplicate_groups(spark, sf_dir):
    return D.near_groups(table(spark, sf_dir, "documents"))


@query(f"""WITH d AS (SELECT doc_id, lang, substr(coalesce(text, ''), 1, strpos(coalesce(text, '') || chr(10), chr(10)) - 1) AS text FROM documents), f AS (SELECT doc_id, sha256({FOLDED}) AS fp, lang FROM d)
SELECT lang, count(*) AS n, count(DISTINCT fp) AS n_titles, count(*) - count(DISTINCT fp) AS repeated FROM f GROUP BY lang""")
def first_line_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fp = T.fingerprint(F.substring_index(T.filled(F.col("text")), "\n", 1))
    per = docs.select("lang", fp.alias("fp")).groupBy("lang", "fp").count()
    return per.groupBy("lang").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_titles"), (F.sum("count") - F.count(F.lit(1))).alias("repeated"))
