"""Queries of joins, merges, set operations and reports over the star schema and the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import reports as R
from .registry import query, table


@query("""WITH crawled AS (SELECT c_custkey AS record, c_custkey % 5 <> 0 AS has_pdf, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'o' || c_custkey END AS path, 'o' || (c_custkey + 1) AS backup FROM customer),
files AS (SELECT 'o' || o_custkey AS path, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'quarantine' END AS outcome FROM orders),
pick AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY CASE WHEN outcome = 'accepted' THEN 0 ELSE 1 END, o_orderkey) = 1)
SELECT record, coalesce(a.o_orderkey, b.o_orderkey) AS file, CASE WHEN NOT has_pdf AND coalesce(a.path, b.path) IS NULL THEN 'metadata_only' WHEN coalesce(a.path, b.path) IS NULL THEN 'pdf_missing_from_local'
 WHEN coalesce(a.outcome, b.outcome) <> 'accepted' THEN 'pdf_present_not_accepted' ELSE 'pdf_present' END AS status FROM crawled c LEFT JOIN pick a ON c.path = a.path LEFT JOIN pick b ON c.backup = b.path""")
def inventory_status_join(spark, sf_dir):
    key = F.col("c_custkey")
    crawled = table(spark, sf_dir, "customer").select(key.alias("record"), (key % 5 != 0).alias("has_pdf"), F.when(key % 3 != 0, F.concat(F.lit("o"), key)).alias("path"), F.concat(F.lit("o"), key + 1).alias("backup"))
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_custkey").alias("name"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("quarantine").alias("outcome"))
    met = J.by_first_key(crawled, "record", ["path", "backup"], files, "name", F.col("outcome") == "accepted", F.col("o_orderkey"))
    status = J.inventory_status(F.col("has_pdf"), F.col("file.name"), F.col("file.outcome"))
    return met.select("record", F.col("file.o_orderkey").alias("file"), status.alias("status"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unmatched_left_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
def active_semi_join(spark, sf_dir):
    active = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    return lines.join(active, "l_orderkey", "left_semi").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""SELECT d.doc_id, coalesce(l.toxic, 0) AS toxic, coalesce(l.quality, d.n_chars % 2)::BIGINT AS quality, coalesce(CASE WHEN e.label > 4 THEN 'high' END, d.lang) AS kind
 FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def multi_left_coalesce(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 2).alias("parity"), F.lit(0).alias("zero"))
    tables = {"labels": table(spark, sf_dir, "labels"), "vectors": table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") > 4, "high").alias("kind"))}
    return J.coalesced(docs, "doc_id", tables, {"toxic": ["labels.toxic", "base.zero"], "quality": ["labels.quality", "base.parity"], "kind": ["vectors.kind", "base.lang"]})


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS event_type, arg_max(props, event_id) FILTER (value > 50 AND props <> '') AS props FROM events GROUP BY user_id""")
def field_merge_last_nonempty(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), F.when(F.col("value") > 50, F.col("props")).alias("props"))
    return J.last_non_empty(events, "user_id", "event_id", ["event_type", "props"])


@query("""SELECT id, side FROM (SELECT doc_id AS id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
 SELECT vec_id, 'unexpected' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) WHERE side = 'missing' OR id >= 0""")
def set_differences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    missing = J.symmetric_difference(docs, labels, "id").where("side = 'missing'")
    return missing.unionByName(J.symmetric_difference(docs, vectors, "id").where("side = 'unexpected'"))


@query("""SELECT 'lines_orders' AS pair, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS missing,
 (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS unexpected""")
def set_equality(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return J.symmetric_difference(lines, orders, "k").agg(
        F.lit("lines_orders").alias("pair"), F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "unexpected").alias("unexpected")
    )


@query("""SELECT year(o_orderdate) AS year, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 5""")
def latest_years(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("year")).limit(5)


@query("""WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, count(*) AS n FROM events WHERE event_id % 3 = 0 AND event_type <> 'error' GROUP BY 1)
SELECT event_type, coalesce(a.n, 0) AS now, coalesce(b.n, 0) AS before, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM a FULL JOIN b USING (event_type)""")
def counter_delta(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "event_id")
    now = events.where("event_id % 2 = 0").groupBy("event_type").count()
    before = events.where("event_id % 3 = 0 AND event_type <> 'error'").groupBy("event_type").count()
    return R.delta(now, before, "event_type", "count")


@query("""WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1), b AS (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT event_type, coalesce(a.n, 0) AS now, coalesce(b.n, 0) AS before, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM a FULL JOIN b USING (event_type)""")
def counter_delta_by_time(spark, sf_dir):
    events, late = table(spark, sf_dir, "events").select("event_type", "ts"), F.col("ts") >= "2024-01-16"
    return R.delta(events.where(late).groupBy("event_type").count(), events.where(~late).groupBy("event_type").count(), "event_type", "count")


@query("""WITH s AS (SELECT doc_id, 'documents_' || CASE WHEN quality = 0 THEN 'excluded' WHEN quality = 1 THEN 'active' ELSE 'reviewed' END AS what FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT conv_id, 'turns_' || CASE WHEN role = 'system' THEN 'excluded' WHEN role = 'user' THEN 'active' ELSE 'reviewed' END FROM conversations)
SELECT doc_id, count(*) FILTER (what = 'documents_excluded') AS documents_excluded, count(*) FILTER (what = 'documents_reviewed') AS documents_reviewed, count(*) FILTER (what = 'documents_active') AS documents_active,
 count(*) FILTER (what = 'turns_excluded') AS turns_excluded, count(*) FILTER (what = 'turns_reviewed') AS turns_reviewed, count(*) FILTER (what = 'turns_active') AS turns_active FROM s GROUP BY doc_id""")
def state_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.select("doc_id", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("excluded"), F.col("quality").isNull().alias("reviewed"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("active"))
    role = F.col("role")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (role == "system").alias("excluded"), (role == "assistant").alias("reviewed"), (role == "user").alias("active"))
    return R.state_report({"documents": docs, "turns": turns}, "doc_id", ["excluded", "reviewed", "active"])


@query("""WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ws FROM benchmark), d AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ws FROM documents),
bs AS (SELECT DISTINCT item_id, array_to_string(ws[i : i + 3], ' ') AS s FROM b, range(1, len(ws) - 2) t(i) WHERE len(ws) >= 4), ds AS (SELECT DISTINCT array_to_string(ws[i : i + 3], ' ') AS s FROM d, range(1, len(ws) - 2) t(i) WHERE len(ws) >= 4)
SELECT item_id, count(*) AS shingles, count(ds.s) AS found, round(count(ds.s) / count(*), 4) AS share, count(ds.s) / count(*) >= 0.5 AS verbatim FROM bs LEFT JOIN ds USING (s) GROUP BY item_id""")
def provenance_probe(spark, sf_dir):
    return J.provenance(table(spark, sf_dir, "benchmark"), "item_id", "text", table(spark, sf_dir, "documents"), "text")


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS role FROM conversations WHERE turn < 4 AND role <> 'system' GROUP BY conv_id""")
def gathered_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    wanted = turns.select("conv_id").distinct().withColumn("ids", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.col("conv_id") * 1000 + t))
    got = J.gather(wanted, "ids", turns.where("role <> 'system'"), "id", "conv_id", "role")
    return got.select("conv_id", F.array_join("role", ",").alias("role"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS role FROM conversations GROUP BY conv_id""")
def all_gathered_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.struct("conv_id", "turn").alias("id"))
    wanted = turns.groupBy("conv_id").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    got = J.gather(wanted, "ids", turns.drop("conv_id"), "id", "conv_id", "role")
    return got.select("conv_id", F.array_join("role", ",").alias("role"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def nation_revenue(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = lines.join(orders, "l_orderkey").join(customers, "c_custkey").join(nations, "n_nationkey")
    return joined.groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
