"""Queries of skeletons, prompts, records and hybrid sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counterfactual as C
from ..operators.units import lines_of
from .registry import query, table


@query("""SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> ''))::INT AS n_lines FROM documents""")
def line_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")).alias("n_lines"))


@query()
def skeletons(spark, sf_dir):
    got = C.skeleton(table(spark, sf_dir, "documents"), "doc_id")
    return got.select(
        "source_passage_id", "target_length_bucket", "target_tokens", "target_sentences",
        F.size("key_entities").alias("n_entities"), F.size("core_assertions").alias("n_assertions"), F.array_join("numeric_constraints", "|").alias("figures"),
    )


@query("""SELECT doc_id, substr(sha256('You are an academic editor.' || chr(10) || 'Topic: ' || lang || chr(10) || chr(10) || 'P-LIGHT: correct spelling and punctuation only; keep every sentence and its order.' || chr(10) || chr(10)
 || '--- TEXT ---' || chr(10) || trim(coalesce(text, ''), ' ') || chr(10) || '--- END ---'), 1, 16) AS prompt_hash FROM documents""")
def prompt_hashes(spark, sf_dir):
    user = C.polish_prompt(F.coalesce("text", F.lit("")), "p_light", F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", C.prompt_hash(F.lit(C.SYSTEM["polish"]), user).alias("prompt_hash"))


@query()
def mock_counterfactuals(spark, sf_dir):
    plan = C.work_plan(table(spark, sf_dir, "documents"), "doc_id", "text", F.col("lang"))
    got = C.packaged(plan.withColumn("answer", C.mock_answer(F.col("prompt"))), "source_passage_id", "answer", "label")
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("tokens").alias("n_tokens"))


@query()
def hybrid_sequences(spark, sf_dir):
    pool = lines_of(F.col("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.struct("turn", pool.alias("ls")).alias("x"))
    of = lambda role: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("x")))), lambda x: x["ls"]))
    pools = turns.groupBy("conv_id").agg(of("user").alias("h"), of("system").alias("p"), of("assistant").alias("g"))
    return C.hybrids(pools, "conv_id", "h", "p", "g").select("id", "recipe", "label_sequence", "r_g", "r_ai")


@query("""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS h, count(*) FILTER (role = 'assistant') AS g, count(*) FILTER (role = 'system') AS p, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS h_text FROM conversations GROUP BY conv_id)
SELECT conv_id, h, p, g, length(coalesce(h_text, ''))::INT AS h_chars FROM c""")
def cogrouped_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text"))))
    got = turns.groupBy("conv_id").agg(*(F.count_if(F.col("role") == r).alias(k) for k, r in (("h", "user"), ("p", "system"), ("g", "assistant"))), ordered.alias("u"))
    return got.select("conv_id", "h", "p", "g", F.char_length(F.array_join(F.transform("u", lambda x: x["text"]), " ")).alias("h_chars"))


@query()
def consensus_subspace_energy(spark, sf_dir):
    """Differences of vectors whose ids are neighbours stand for pairs of a human and a generated text."""
    v = table(spark, sf_dir, "embeddings")
    pairs = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("h")).join(v.select("vec_id", F.col("embedding").alias("g")), "vec_id")
    return C.subspace_energy(pairs, "h", "g")
