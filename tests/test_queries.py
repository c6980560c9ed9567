"""The registered queries as a whole, and the shape of their plans."""

import pytest

import __spark_entry__ as entry_point

NO_PAIRWISE = ["or_link", "resolve_names", "mention_edges", "claim_source", "bm25_topk", "entity_lookup", "loe_lookup", "dense_topk"]


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PAIRWISE)
def test_no_pairwise_joins(spark, small, name):
    text = plan(entry_point.queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark, small):
    text = plan(entry_point.queries()["kg_counts"](spark, small))
    assert "l_extendedprice" not in text and "p_retailprice" not in text


def test_top_k_is_cut_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(entry_point.queries()["sorted_limit"](spark, small))


def test_search_plans(spark, small):
    """The corpus is tokenised once: the search itself reads the index."""
    text = plan(entry_point.queries()["hybrid_rrf"](spark, small))
    assert "documents.parquet" not in text and "regexp_extract_all" not in text


def test_contract(spark):
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(entry_point.QUERIES) - set(entry_point.ORACLES) == {"chunk_recursive", "sql_functions"}
    df = entry_point.entry(spark)
    assert df.count() > 0


def test_events_read_windows_that_were_dealt(spark, small):
    """Text and timeline are two steps: the windows of the texts are written and spread before they are taken apart."""
    frame = entry_point.queries()["catalyst_events"](spark, small)
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in text and "lineitem" not in text and "unboundedfollowing" not in text
