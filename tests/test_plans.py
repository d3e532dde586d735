"""Plans: scans read only what a query uses, filters reach the scan, and nothing is joined without a key."""

import re

import pytest

from loamwork.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = registry.queries()[name](spark, SF)
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def columns(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*)>", text)]


@pytest.mark.parametrize(
    "name,most",
    [
        ("token_counts", {"doc_id", "text"}),
        ("split_distribution", {"doc_id", "text", "lang"}),
        ("gaps_islands", {"conv_id", "turn", "role"}),
        ("active_semi_join", {"l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "o_orderkey", "o_orderstatus"}),
        ("nation_revenue", {"l_orderkey", "l_extendedprice", "l_discount", "o_orderkey", "o_custkey", "c_custkey", "c_nationkey", "n_nationkey", "n_name"}),
        ("field_merge_last_nonempty", {"event_id", "user_id", "event_type", "value", "props"}),
    ],
)
def test_scans_are_pruned(spark, name, most):
    for read in columns(plan(spark, name)):
        assert read <= most


def test_filters_reach_the_scan(spark):
    assert re.search(r"PushedFilters: \[.*EqualTo\(o_orderstatus,F\)", plan(spark, "active_semi_join"))


@pytest.mark.parametrize("name", ["token_counts", "text_integrity", "hash_split_assignment", "consecutive_dedup", "rebuilt_texts", "url_fields"])
def test_row_local_queries_do_not_shuffle(spark, name):
    text = plan(spark, name)
    assert "Exchange" not in text and "Python" not in text


@pytest.mark.parametrize("name", ["inventory_status_join", "multi_left_coalesce", "provenance_probe", "fuzzy_title_pairs", "gathered_turns", "line_fingerprint_dedup", "set_differences"])
def test_joins_have_keys(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_hybrid_sequences_take_all_lines_and_gathering_all_turns(spark, tmp_path):
    text = lambda c: "\n".join(f"{c} line {i}" for i in range(30))
    rows = [(i, t, r, text(r)) for i in range(40) for t, r in enumerate(["user", "assistant"] * 3 + ["system"])]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [r for r in registry.queries()["hybrid_sequences"](spark, str(tmp_path)).collect() if r.recipe == "h_g_h"]
    assert got and all(r.label_sequence.count("H") == 90 and r.label_sequence.count("G") == 45 for r in got)
    turns = registry.queries()["all_gathered_turns"](spark, str(tmp_path)).collect()
    assert len(turns) == 40 and all(r.role == ",".join(["user", "assistant"] * 3 + ["system"]) for r in turns)
