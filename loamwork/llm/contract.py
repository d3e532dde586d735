"""The queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: A-Z to a-z in DuckDB.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {}


def op4_best_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(documents(spark, sf_dir), n_shards=24)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


ORACLES["op6_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
c AS (SELECT key, min(doc_id) AS first_id, count(DISTINCT doc_id) AS n FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n >= 2 AND doc_id <> first_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (n IS NULL OR n < 2 OR doc_id = first_id), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir), keep="largest")


ORACLES["op7_exact_dedup"] = f"""
WITH n AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body)"""


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(documents(spark, sf_dir), shingle=3, distance=3, bits=64, seed=42)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import decode_documents, encode_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return decode_documents(encoded, path).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), out="score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


#: Target weights of op1_mix: the domain follows from the number in a source's name.
DOMAINS = ["web", "books", "code", "forums"]
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "code": 2, "forums": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def mix_levels(source: str = "row.source", lang: str = "row.lang") -> dict:
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % len(DOMAINS)
    domain = F.get(F.array(*map(F.lit, DOMAINS)), number)
    return {"domain": domain, "lang": F.col(lang), "source": F.col(source)}


def mix_weights() -> dict:
    from .mixing import weight_of

    return {"domain": weight_of("domain", DOMAIN_WEIGHTS), "lang": weight_of("lang", LANG_WEIGHTS), "source": F.lit(1)}


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    got = mixed(documents(spark, sf_dir), mix_levels("source", "lang"), mix_weights(), budget_per_mille=800, max_epochs=4)
    return got.select(F.col("row.doc_id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "copies")


def _mix_sql() -> str:
    def fill(name: str, path: list[str], up: str, weight: str) -> str:
        above = path[:-1]
        on = " AND ".join(f"n.{c} IS NOT DISTINCT FROM u.{c}" for c in above) or "true"
        part = f"PARTITION BY {', '.join(above)} " if above else ""
        return f"""
{name}n AS (SELECT n.*, u.alloc AS budget FROM (SELECT {', '.join(path)}, sum(cap)::BIGINT AS cap, {weight} AS weight FROM leaves GROUP BY {', '.join(path)}) n JOIN {up} u ON {on}),
{name}r AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS remaining
  FROM {name}n WINDOW o AS ({part}ORDER BY cap / weight, {path[-1]} NULLS FIRST)),
{name}f AS (SELECT *, cap * remaining <= (budget - before) * weight AS isfull FROM {name}r),
{name}s AS (SELECT *, (budget - coalesce(sum(cap) FILTER (isfull) OVER ({part}), 0))::BIGINT AS rest,
  coalesce(sum(weight) FILTER (NOT isfull) OVER ({part}), 0)::BIGINT AS shares FROM {name}f),
{name} AS (SELECT {', '.join(path)}, CASE WHEN isfull THEN cap ELSE ((shares - remaining + weight) * rest) // shares - ((shares - remaining) * rest) // shares END AS alloc FROM {name}s)"""

    case = lambda c, given: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in given.items()) + " ELSE 1 END"
    same = "d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source"
    return f"""
WITH d AS (SELECT doc_id, lang, source, {DOMAINS}[1 + coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT), 0) % {len(DOMAINS)}] AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 4 AS cap FROM d GROUP BY ALL),
top AS (SELECT least(sum(tokens)::BIGINT * 800 // 1000, sum(cap)::BIGINT) AS alloc FROM leaves),
{fill('lva', ['domain'], 'top', case('domain', DOMAIN_WEIGHTS))},
{fill('lvb', ['domain', 'lang'], 'lva', case('lang', LANG_WEIGHTS))},
{fill('lvc', ['domain', 'lang', 'source'], 'lvb', '1')},
plan AS (SELECT d.*, alloc // tokens AS epochs, alloc % tokens AS rest FROM leaves d JOIN lvc p ON {same} WHERE tokens > 0),
placed AS (SELECT d.*, p.epochs, p.rest, md5('1:' || coalesce(p.epochs, 0) || ':' || coalesce(d.doc_id::VARCHAR, '')) AS place FROM d LEFT JOIN plan p ON {same}),
sums AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE UNBOUNDED PRECEDING), 0)
  - sum(n_tokens) OVER (PARTITION BY domain, lang, source, place) AS before FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, coalesce(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END, 0) AS copies FROM sums"""


ORACLES["op1_mix"] = _mix_sql()


def op2_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of audio: each vector of `embeddings` stands for a recording, its values for notes."""
    from .chroma import aligned, fingerprints, melody

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return aligned(fingerprints(vectors, "vec_id", "embedding", decode=melody), F.col("id") % 50 == 0)


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(documents(spark, sf_dir), within=True).select("doc_id", "unit", "start", "end", "n_words", "kept_in")
