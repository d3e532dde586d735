"""Queries over documents: tokens, splits, gates, topics, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import hash_split
from ..functions.ranking import order_statistics, ranked
from ..operators import gates as G
from ..operators.reports import counters, curation_summary, term_totals
from ..operators.topics import classified, it_topic, TOPICS
from ..operators.units import lines, lines_of
from .registry import query, table

SEED = "loam-split-1"
TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"
BUCKET = "CASE WHEN n < 64 THEN '<64' WHEN n < 128 THEN '64-127' WHEN n < 256 THEN '128-255' WHEN n <= 512 THEN '256-512' ELSE '>512' END"
UNIT = f"(('0x' || substr(sha256('{SEED}:' || doc_id), 1, 16))::UBIGINT / 18446744073709551616.0::DOUBLE)"
SPLIT = f"CASE WHEN {UNIT} < 0.70 THEN 'train' WHEN {UNIT} < 0.85 THEN 'dev' ELSE 'test' END"
LINES = "SELECT doc_id, lang, source, trim(unnest(string_split(coalesce(text, ''), chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents"
#: Trimmed lines that aren't blank, with ordinals from 0.
UNITS = """u0 AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ls FROM documents),
u AS (SELECT doc_id, lang, source, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::INT AS ordinal FROM u0)"""


@query(f"""SELECT doc_id, {TOKENS}::BIGINT AS raw_tokens, greatest(1, ceil({TOKENS} * 1.18))::BIGINT AS approx_tokens,
 len(regexp_extract_all(coalesce(text, ''), '[^\\s]+'))::BIGINT AS space_tokens FROM documents""")
def token_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.raw_tokens(t).cast("long").alias("raw_tokens"), T.approx_tokens(t).alias("approx_tokens"), T.space_tokens(t).cast("long").alias("space_tokens")
    )


@query(f"SELECT {BUCKET} AS bucket, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM (SELECT {TOKENS} AS n FROM documents) GROUP BY 1")
def token_histogram(spark, sf_dir):
    n = T.raw_tokens(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(n.alias("n"))
    return docs.groupBy(T.token_bucket(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("long").alias("n_tokens"))


@query(f"""WITH n AS (SELECT lang, {TOKENS} AS v FROM documents),
s AS (SELECT lang, list_sort(list(v)) AS a FROM n GROUP BY lang)
SELECT lang, len(a)::BIGINT AS n, a[1]::INT AS min, a[len(a)]::INT AS max, round(list_avg(a), 4) AS mean,
 a[1 + len(a) // 2]::INT AS median, a[1 + floor(len(a) * 0.1)::INT]::INT AS p10, a[1 + floor(len(a) * 0.9)::INT]::INT AS p90 FROM s""")
def length_percentiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", T.raw_tokens(F.col("text")).alias("v"))
    return order_statistics(docs, ["lang"], "v", {"median": 0.5, "p10": 0.1, "p90": 0.9})


@query(f"SELECT doc_id, {SPLIT} AS split FROM documents")
def hash_split_assignment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hash_split(F.col("doc_id"), SEED).alias("split"))


@query(f"""SELECT split, lang, bucket, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM
 (SELECT {SPLIT} AS split, lang, {BUCKET} AS bucket, n FROM (SELECT *, {TOKENS} AS n FROM documents)) GROUP BY ALL""")
def split_distribution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", T.raw_tokens(F.col("text")).alias("n"))
    docs = docs.select(hash_split(F.col("doc_id"), SEED).alias("split"), "lang", T.token_bucket(F.col("n")).alias("bucket"), "n")
    return docs.groupBy("split", "lang", "bucket").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("long").alias("n_tokens"))


@query("""WITH k AS (SELECT doc_id, lang, source, sha256('loam-strata:(' || coalesce(lang, '') || ',' || coalesce(source, '') || '):' || doc_id) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h) AS rank, count(*) OVER (PARTITION BY lang, source) AS n FROM k),
c AS (SELECT *, round_even(0.70 * n, 0)::INT AS tr, round_even(0.15 * n, 0)::INT AS dv FROM r)
SELECT doc_id, lang, source, CASE WHEN n < 7 THEN CASE WHEN ('0x' || substr(h, 1, 16))::UBIGINT / 18446744073709551616.0::DOUBLE < 0.70 THEN 'train'
 WHEN ('0x' || substr(h, 1, 16))::UBIGINT / 18446744073709551616.0::DOUBLE < 0.85 THEN 'dev' ELSE 'test' END
 WHEN rank <= tr THEN 'train' WHEN rank <= tr + dv THEN 'dev' ELSE 'test' END AS split FROM c""")
def stratified_split(spark, sf_dir):
    name = F.concat(F.lit("loam-strata:("), F.coalesce("lang", F.lit("")), F.lit(","), F.coalesce("source", F.lit("")), F.lit("):"), F.col("doc_id").cast("string"))
    keyed = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.sha2(name, 256).alias("h"))
    sizes = keyed.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    r = ranked(keyed, ["lang", "source"], "h", "rank").join(sizes, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    at = F.conv(F.substring("h", 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)
    tr, dv = (F.rint((F.col("n") * F.lit(share).cast("decimal(2,2)")).cast("double")) for share in ("0.70", "0.15"))  # 0.70 * 45 is 31.5, as a double less
    split = G.first_of([((F.col("n") < 7) & (at < 0.70), "train"), ((F.col("n") < 7) & (at < 0.85), "dev"), (F.col("n") < 7, "test"), (F.col("rank") <= tr, "train"), (F.col("rank") <= tr + dv, "dev")], "test")
    return r.select("doc_id", "lang", "source", split.alias("split"))


@query("""WITH m AS (SELECT doc_id, greatest(length(coalesce(text, '')), 1) AS n, len(regexp_extract_all(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]')) AS c,
 len(regexp_extract_all(coalesce(text, ''), '\\p{S}')) AS s, len(regexp_extract_all(coalesce(text, ''), '[\\p{Co}\\x{FFFD}]')) AS p FROM documents)
SELECT doc_id, c::BIGINT AS control_chars, s::BIGINT AS symbol_chars, p::BIGINT AS private_chars, round(c / n, 6) AS control_ratio, round(s / n, 6) AS symbol_ratio,
 CASE WHEN round(c / n, 6) > 0.002 OR round(s / n, 6) > 0.02 THEN 'corrupted_text_encoding' END AS reason FROM m""")
def text_integrity(spark, sf_dir):
    m = T.integrity(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in m.items()), G.integrity_gate(F.col("text")).alias("reason"))


@query("""WITH m AS (SELECT doc_id, length(coalesce(text, '')) AS n, len(regexp_extract_all(coalesce(text, ''), '\\p{L}')) AS a,
 len(regexp_extract_all(coalesce(text, ''), '[\\x{FFFD}□]')) AS g, quality FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, a / greatest(n, 1) AS ar, g / greatest(n, 1) AS gr FROM m)
SELECT doc_id, round(100 * (0.42e0 + 0.30e0 * least(1e0, n / 2000) + 0.24e0 * least(1e0, ar / 0.65e0) + 0.04e0 * (1e0 - least(1e0, gr * 50))), 4) AS score,
 CASE WHEN quality = 0 THEN 'quarantine' WHEN n >= 1000 AND ar >= 0.55 AND gr <= 0.002 THEN 'gold' WHEN n >= 300 AND ar >= 0.45 AND gr <= 0.01 THEN 'silver' ELSE 'quarantine' END AS tier FROM r""")
def quality_tier(spark, sf_dir):
    t = T.filled(F.col("text"))
    n = F.char_length(t)
    alpha = F.regexp_count(t, F.lit(r"\p{L}")) / F.greatest(n, F.lit(1))
    garbage = F.regexp_count(t, F.lit("[�□]")) / F.greatest(n, F.lit(1))
    docs = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"), alpha.alias("a"), garbage.alias("g"))
    docs = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    n, a, g = F.col("n"), F.col("a"), F.col("g")
    score = 100 * (0.42 + 0.30 * F.least(F.lit(1.0), n / 2000) + 0.24 * F.least(F.lit(1.0), a / 0.65) + 0.04 * (1.0 - F.least(F.lit(1.0), g * 50)))
    tier = G.first_of([(F.col("quality") == 0, "quarantine"), ((n >= 1000) & (a >= 0.55) & (g <= 0.002), "gold"), ((n >= 300) & (a >= 0.45) & (g <= 0.01), "silver")], "quarantine")
    return docs.select("doc_id", F.round(score, 4).alias("score"), tier.alias("tier"))


@query(f"""WITH {UNITS}, c AS (SELECT *, greatest(length(line), 1) AS n, len(regexp_extract_all(line, '\\p{{L}}')) AS a, len(regexp_extract_all(line, '[^\\p{{L}}\\p{{N}}\\s]')) AS s,
 len(regexp_extract_all(line, '(?i)[{{}};]{{2,}}|</?[a-z][^>]*>')) + len(list_filter(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w) IN ('class','def','function','public','private','return','import','select','insert','update'))) AS code FROM u)
SELECT lang, CASE WHEN code >= 2 THEN 'code' WHEN regexp_matches(line, '\\|.*\\||\\t.*\\t') THEN 'table' WHEN length(line) > 20 AND s / n > 0.22 AND a / n < 0.45 THEN 'formula' ELSE 'prose' END AS content_type,
 count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM c GROUP BY ALL""")
def content_types(spark, sf_dir):
    units = lines(table(spark, sf_dir, "documents"), "lang")
    typed = units.select("doc_id", "lang", G.content_type(F.col("line")).alias("content_type"))
    per_doc = typed.groupBy("lang", "content_type", "doc_id").count()
    return per_doc.groupBy("lang", "content_type").agg(F.sum("count").alias("n_lines"), F.count(F.lit(1)).alias("n_docs"))


@query("""SELECT doc_id, CASE WHEN source IN ('src1', 'src7') THEN 'excluded_institution_' || source WHEN y IS NULL THEN 'unknown_year' WHEN y > 2022 THEN 'post_cutoff_year'
 WHEN quality IS NULL AND lang <> 'en' THEN 'missing_metadata:lang,quality' WHEN quality = 0 THEN 'quality_quarantine' WHEN n_chars < 200 THEN 'not_eligible' WHEN lang <> 'en' THEN 'not_core' END AS reason
 FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1995 + doc_id % 30 END AS y FROM documents LEFT JOIN labels USING (doc_id))""")
def release_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    year = F.when(F.col("doc_id") % 11 == 0, None).otherwise(1995 + F.col("doc_id") % 30)
    absent = F.col("quality").isNull() & (F.col("lang") != "en")
    missing = F.when(absent, F.array(F.lit("quality"), F.lit("lang"))).otherwise(F.array().cast("array<string>"))
    tier = F.when(F.col("quality") == 0, "quarantine").otherwise("gold")
    eligible = ~absent & (tier == "gold") & (F.col("n_chars") >= 200)
    reason = G.release_reason(F.col("source"), year, eligible, missing, tier, F.lit(False), F.col("lang") == "en", ["src1", "src7"])
    return docs.select("doc_id", reason.alias("reason"))


#: Stand-in topics for the invented prose of the test tables; the real lists are operators.topics.TOPICS.
STAND_IN = {"alpha": ["the", "and", "with"], "beta": ["der", "und", "einer"], "gamma": ["les", "des", "une"], "delta": ["que", "los", "para"]}


def _topic_sql() -> str:
    words = " + ".join
    count = lambda k: f"len(list_filter(ws, lambda w: w = '{k}'))"
    scores = ", ".join(f"{words(count(k) for k in ks)} AS {t}" for t, ks in STAND_IN.items())
    names = list(STAND_IN)
    best = f"greatest({', '.join(names)})"
    total = " + ".join(names)
    pick = " ".join(f"WHEN {t} = {best} THEN '{t}'" for t in names)
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents), s AS (SELECT doc_id, {scores} FROM w)
SELECT doc_id, CASE {pick} END AS topic, CASE WHEN {total} = 0 THEN 0.5 ELSE round({best} / ({total}), 4) END AS confidence, {best}::INT AS best_score FROM s"""


@query(_topic_sql())
def keyword_topics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classified(docs, [(F.col("text"), 1)], STAND_IN).select("doc_id", "topic", "confidence", "best_score")


@query()
def computing_topics(spark, sf_dir):
    """The Vietnamese topic lists over whole texts; no language of the test tables uses them, so all fall back."""
    docs = table(spark, sf_dir, "documents")
    return classified(docs, [(F.col("text"), 1)], TOPICS, F.lit("")).groupBy("topic").agg(F.count(F.lit(1)).alias("n_docs"))


@query("""WITH w AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS f, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS ws FROM documents),
m AS (SELECT *, list_filter(['the', 'onthe', 'error', 'apache', 'license'], lambda k: list_contains(ws, k)) AS hits, contains(t, 'token =') AS bad FROM w)
SELECT doc_id, CASE WHEN contains(f, 'src12') THEN true WHEN len(hits) = 0 THEN false WHEN bad THEN contains(t, 'copyright') ELSE true END AS accepted,
 CASE WHEN contains(f, 'src12') THEN 'faculty:src12' WHEN len(hits) = 0 OR (bad AND NOT contains(t, 'copyright')) THEN '' ELSE array_to_string(hits, ',') END AS tags FROM m""")
def topic_filter_tags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = it_topic(F.col("text"), F.col("text"), F.lit(None), F.col("source"), faculties=["src12"], wanted=["the", "onthe", "error", "apache", "license"], unwanted=["token ="], overrides=["copyright"])
    return docs.select("doc_id", got.alias("r")).select("doc_id", F.col("r.accepted").alias("accepted"), F.array_join("r.tags", ",").alias("tags"))


@query("""SELECT dim, value, n FROM (SELECT CASE WHEN GROUPING(lang) = 0 THEN 'lang' WHEN GROUPING(source) = 0 THEN 'source' WHEN GROUPING(quality) = 0 THEN 'quality' ELSE 'toxic' END AS dim,
 coalesce(lang, source, quality, toxic, 'unknown') AS value, count(*) AS n FROM (SELECT lang, source, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM documents LEFT JOIN labels USING (doc_id))
 GROUP BY GROUPING SETS ((lang), (source), (quality), (toxic)))""")
def counter_grouping_sets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return counters(docs, ["lang", "source", "quality", "toxic"])


@query(f"""SELECT lang, count(*) AS input, count(*) FILTER (n >= 64) AS eligible, count(*) FILTER (n < 64) AS short, sum(n) FILTER (n >= 64)::BIGINT AS eligible_tokens,
 round(100.0 * count(*) FILTER (n >= 64) / count(*), 2) AS eligible_share FROM (SELECT lang, {TOKENS} AS n FROM documents) GROUP BY lang""")
def curation_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", T.raw_tokens(F.col("text")).alias("n"))
    return curation_summary(docs, "lang", F.col("n"), 64)


@query("""SELECT keyword, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}]{4,}')) AS keyword FROM documents)
 GROUP BY keyword ORDER BY n DESC, keyword LIMIT 25""")
def topk_keywords(spark, sf_dir):
    return term_totals(table(spark, sf_dir, "documents"), r"[\p{L}]{4,}", "keyword").orderBy(F.desc("n"), "keyword").limit(25)


@query(f"""SELECT doc_id, len(ls)::INT AS n_lines, length(array_to_string(ls, chr(10) || chr(10)))::INT AS n_chars, sha256(array_to_string(ls, chr(10) || chr(10))) AS text_sha256 FROM (WITH {UNITS} SELECT doc_id, ls FROM u0)""")
def rebuilt_texts(spark, sf_dir):
    ls = lines_of(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", ls.alias("ls"), F.array_join(ls, "\n\n").alias("t"))
    return docs.select("doc_id", F.size("ls").alias("n_lines"), F.char_length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


@query("""SELECT doc_id, CASE WHEN vi >= 0.025 AND en >= 0.025 THEN 'mixed' WHEN vi >= 0.025 THEN 'vi' WHEN en >= 0.025 THEN 'en' ELSE 'mixed' END AS language FROM (SELECT doc_id,
 (len(list_filter(ws, lambda w: regexp_matches(w, '[MARKS]'))) + 2 * len(list_filter(ws, lambda w: w IN ('và','của','trong','được','các','nghiên','kết','hệ','một','những')))) / greatest(len(ws), 1) AS vi,
 len(list_filter(ws, lambda w: w IN ('the','of','and','in','to','is','for','this'))) / greatest(len(ws), 1) AS en FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+') AS ws FROM documents))""".replace("MARKS", "".join(T.MARKED.values())))
def detected_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.language(F.col("text")).alias("language"))
