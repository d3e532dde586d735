"""Queries of integrity constraints, over tables with planted violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import hash_split
from ..operators import constraints as C
from ..operators import units as U
from .corpus import SEED, SPLIT, UNITS
from .registry import query, table


@query(f"""WITH s AS (SELECT doc_id % 97 AS g, CASE WHEN doc_id % 97 < 40 THEN CASE WHEN doc_id % 97 % 10 < 7 THEN 'train' ELSE 'dev' END ELSE {SPLIT} END AS split FROM documents)
SELECT 'error' AS severity, 'group_split_leak' AS code, g::VARCHAR AS record_id, min(split) || ',' || max(split) AS message FROM s GROUP BY g HAVING min(split) <> max(split)""")
def group_split_leak(spark, sf_dir):
    group = F.col("doc_id") % 97
    own = F.when(group % 10 < 7, "train").otherwise("dev")
    docs = table(spark, sf_dir, "documents").select(group.alias("g"), F.when(group < 40, own).otherwise(hash_split(F.col("doc_id"), SEED)).alias("split"))
    return C.divided_groups(docs, "g", "split")


@query("""WITH p AS (SELECT vec_id, unnest([vec_id, CASE WHEN vec_id % 50 = 0 THEN vec_id + 1 ELSE vec_id END]) AS id FROM embeddings WHERE vec_id % 7 <> 0), u AS (SELECT id, count(DISTINCT vec_id) AS n FROM p GROUP BY id)
SELECT 'error' AS severity, 'sentence_usage' AS code, vec_id::VARCHAR AS record_id, coalesce(n, 0) || ' uses' AS message FROM embeddings LEFT JOIN u ON id = vec_id WHERE coalesce(n, 0) <> 1""")
def usage_multiplicity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    arrays = v.where("vec_id % 7 <> 0").select(F.array_distinct(F.array("vec_id", F.when(F.col("vec_id") % 50 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id")))).alias("ids"))
    return C.unused_or_shared(arrays, "ids", v, "vec_id")


@query(f"""WITH {UNITS}, o AS (SELECT *, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM u),
w AS (SELECT doc_id, array_to_string(ls, chr(10) || chr(10)) AS body FROM u0)
SELECT 'error' AS severity, 'normalized_offset_mismatch' AS code, doc_id || ':' || ordinal AS record_id, '' AS message FROM o JOIN w USING (doc_id)
 WHERE substr(body, (st + CASE WHEN ordinal % 13 = 5 THEN 1 ELSE 0 END + 1)::INT, length(line)) <> line""")
def offset_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = U.with_offsets(U.lines(docs)).withColumn("id", F.concat_ws(":", "doc_id", "ordinal"))
    moved = F.when(F.col("ordinal") % 13 == 5, 1).otherwise(0)
    parts = parts.withColumn("start", F.col("start") + moved).withColumn("end", F.col("end") + moved)
    whole = docs.select("doc_id", F.array_join(U.lines_of(F.col("text")), "\n\n").alias("body"))
    return C.wrong_slices(parts, whole, "doc_id", "body", "start", "end", "line", "id")


@query("""SELECT 'error' AS severity, 'text_checksum' AS code, doc_id::VARCHAR AS record_id, CASE WHEN doc_id % 31 = 0 THEN 'missing' ELSE 'mismatch' END AS message FROM documents WHERE doc_id % 31 = 0 OR doc_id % 17 = 0""")
def checksum_mismatch(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    digest = F.when(F.col("doc_id") % 31 == 0, None).when(F.col("doc_id") % 17 == 0, F.sha2(F.concat(text, F.lit("!")), 256)).otherwise(F.sha2(text, 256))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", digest.alias("digest"))
    return C.digest_differs(docs, "text", "digest", "text_checksum", "doc_id")


@query("""SELECT 'warning' AS severity, 'parent_missing' AS code, doc_id::VARCHAR AS record_id, '' AS message FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0)
 UNION ALL SELECT 'error', 'duplicate_turn', conv_id::VARCHAR, count(*) || ' rows' FROM conversations GROUP BY conv_id HAVING count(*) > 1
 UNION ALL SELECT 'error', 'too_short', doc_id::VARCHAR, '' FROM documents WHERE NOT (n_chars >= 100)""")
def validation_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    checks = {
        "parent_missing": lambda t: C.orphans(t["labels"], "doc_id", t["documents"].where("doc_id % 9 <> 0"), "parent_missing", "doc_id", "warning"),
        "duplicate_turn": lambda t: C.repeated(t["turns"], "conv_id", "duplicate_turn"),
        "too_short": lambda t: C.broken(t["documents"], F.col("n_chars") >= 100, "too_short", "doc_id"),
    }
    return C.validate({"documents": docs, "labels": table(spark, sf_dir, "labels"), "turns": table(spark, sf_dir, "conversations")}, checks)
