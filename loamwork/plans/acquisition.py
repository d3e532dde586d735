"""Queries over crawled pages: fields, URLs, identity, gates and metadata precedence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import gates as G
from ..sources import html as H
from .registry import query, table

TITLE = "regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)"
HEAD = "regexp_extract(coalesce(html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1)"


@query(f"""SELECT page_id, CASE WHEN {TITLE} <> '' THEN {TITLE} ELSE {HEAD} END AS title, len(list_distinct(regexp_extract_all(coalesce(html, ''), '(?is)<a[^>]*\\bhref=["'']([^"'']*)["'']', 1)))::INT AS n_links,
 len(regexp_extract_all(coalesce(html, ''), '(?i)<p[ >]'))::INT AS n_paragraphs FROM pages""")
def html_fields(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", H.title_of(h).alias("title"), F.size(H.hrefs(h)).alias("n_links"), F.regexp_count(F.coalesce(h, F.lit("")), F.lit("(?i)<p[ >]")).alias("n_paragraphs")
    )


@query("""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS v FROM pages)
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(v, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS text_sha256 FROM t""")
def html_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(H.visible(F.col("html")), 256).alias("text_sha256"))


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages""")
def url_fields(spark, sf_dir):
    parts = H.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", *(parts[p].alias(p) for p in ("scheme", "host", "path")))


@query("""SELECT page_id, 'page_' || substr(sha256(coalesce(url, 'None') || chr(31) || page_id), 1, 20) AS stable_id, lower(list_extract(string_split_regex(url, '[/\\\\]'), -1)) AS file_key,
 CASE WHEN regexp_matches(regexp_replace(list_extract(string_split_regex(url, '[/\\\\]'), -1), '\\.[^.]*$', ''), '^[A-Za-z][A-Za-z0-9-]*_[^_]+') THEN lower(regexp_extract(list_extract(string_split_regex(url, '[/\\\\]'), -1), '^([A-Za-z][A-Za-z0-9-]*)_', 1)) || '_'
  || regexp_extract(regexp_replace(list_extract(string_split_regex(url, '[/\\\\]'), -1), '\\.[^.]*$', ''), '^[A-Za-z][A-Za-z0-9-]*_([^_]+)', 1)
  WHEN regexp_matches(list_extract(string_split_regex(url, '[/\\\\]'), -1), '^[0-9]') THEN 'ou_' || regexp_extract(list_extract(string_split_regex(url, '[/\\\\]'), -1), '^([0-9]+)', 1) END AS logical_id FROM pages""")
def canonical_ids(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", ids.stable_id("page", url, F.col("page_id")).alias("stable_id"), ids.file_key(url).alias("file_key"), ids.logical_id(url).alias("logical_id")
    )


@query("""WITH m AS (SELECT page_id, strlen(coalesce(html, '')) AS b, len(regexp_extract_all(coalesce(html, ''), '<p')) AS pages, length(coalesce(html, '')) AS chars, len(regexp_extract_all(coalesce(html, ''), '<a')) AS fonts FROM pages)
SELECT CASE WHEN b < 614400 THEN 'too_small' WHEN b > 36700160 THEN 'too_large' WHEN fonts < 2 THEN 'scanned' WHEN pages < 35 THEN 'too_few_pages' WHEN chars < 20000 THEN 'too_little_text' ELSE 'accepted' END AS reason, count(*) AS n FROM
 (SELECT page_id, b * 1024 AS b, pages, chars, fonts FROM m) GROUP BY 1""")
def pdf_gate_reasons(spark, sf_dir):
    """Pages stand for files: kilobytes for bytes, paragraphs for pages, links for fonts."""
    h = F.coalesce("html", F.lit(""))
    count = lambda p: F.regexp_count(h, F.lit(p))
    reason = G.pdf_reason(F.octet_length(h) * 1024, count("<p"), F.char_length(h), count("<a"), F.lit("%PDF-1.5"))
    return table(spark, sf_dir, "pages").groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH m AS (SELECT page_id, nullif({TITLE}, '') AS official, nullif({HEAD}, '') AS cover, nullif(regexp_extract(url, '://([^/:]+)', 1), '') AS host, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 2000 + page_id % 25 END AS y FROM pages)
SELECT page_id, coalesce(official, cover) AS title, CASE WHEN official IS NOT NULL THEN 'official' WHEN cover IS NOT NULL THEN 'cover' ELSE 'missing' END AS title_source, y::INT AS year,
 CASE WHEN y IS NULL THEN 'missing' ELSE 'official' END AS year_source, round(((coalesce(official, cover) IS NOT NULL)::INT + (y IS NOT NULL)::INT + (host IS NOT NULL)::INT) / 3, 4) AS confidence,
 array_to_string(list_filter([CASE WHEN coalesce(official, cover) IS NULL THEN 'missing_title' END, CASE WHEN y IS NULL THEN 'missing_year' END, CASE WHEN y > 2022 THEN 'late' END], lambda x: x IS NOT NULL), ',') AS flags FROM m""")
def metadata_precedence(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    official = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    cover = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    host = F.regexp_extract("url", "://([^/:]+)", 1)
    year = F.when(F.col("page_id") % 4 != 0, 2000 + F.col("page_id") % 25).cast("int")
    values, origin = G.precedence({"title": [("official", official), ("cover", cover)], "year": [("official", year)], "institution": [("official", host)]})
    given = sum((v.isNotNull().cast("int") for v in values.values()), F.lit(0))
    flags = G.review_flags(missing_title=values["title"].isNull(), missing_year=values["year"].isNull(), late=values["year"] > 2022)
    return table(spark, sf_dir, "pages").select(
        "page_id", values["title"].alias("title"), origin["title"].alias("title_source"), values["year"].alias("year"), origin["year"].alias("year_source"),
        F.round(given / 3, 4).alias("confidence"), F.array_join(flags, ",").alias("flags"),
    )


@query(f"""SELECT y AS bucket, count(*) AS n FROM (SELECT CASE WHEN y IS NULL THEN 'unknown' WHEN y <= 2010 THEN 'pre_2011' WHEN y <= 2015 THEN '2011_2015' WHEN y <= 2019 THEN '2016_2019' WHEN y <= 2021 THEN '2020_2021' WHEN y = 2022 THEN '2022' ELSE '2023_plus' END AS y
 FROM (SELECT TRY_CAST(nullif(regexp_extract(coalesce(html, ''), '(?:^|[^0-9\\p{{L}}_])((?:19|20)[0-9]{{2}})(?:$|[^0-9\\p{{L}}_])', 1), '') AS INT) AS y FROM pages)) GROUP BY 1""")
def year_buckets(spark, sf_dir):
    year = T.first_year(F.col("html"))
    return table(spark, sf_dir, "pages").groupBy(G.year_bucket(year).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
