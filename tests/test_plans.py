"""What physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from oreflow.operators import match, report
from oreflow.plans import analogue
from oreflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: These run a stream or fit a model before they give a plan.
EAGER = {"q_fan_out", "q_enriched_stream", "q_windowed_counts", "q_features_program", "q_publish_program", "q_geolocate_program", "q_upload_program", "q_first_seen_stream", "q_stream_counts", "q_host_penalty", "q_outliers", "q_principal_components"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pairs_of_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(report.sites_by_control(analogue.hits(spark, SF), analogue.controls(spark, SF), 5.0))
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_discount:double,l_tax:double" in text
    near = plan(QUERIES["q_search_control"](spark, SF))
    assert "l_orderkey" in near and "l_extendedprice" not in near


def test_control_hits_shuffle_once_for_their_group(spark):
    text = plan(analogue.hits(spark, SF).groupBy("control_url").agg(F.max("ast_dist")))
    assert text.count("Exchange hashpartitioning(control_url") == 1


def test_range_join_is_an_equi_join(spark):
    a, b = spark.range(10).selectExpr("id i", "double(id) x"), spark.range(10).selectExpr("id j", "double(id) y")
    text = plan(match.range_join(a, b, "x", "y", 2.0))
    assert "NestedLoop" not in text and "Join" in text


def test_control_hits_deal_rows_once(spark):
    text = plan(report.control_hits(analogue.hits(spark, SF)))
    assert "Aggregate" not in text and text.count("Exchange") == 1  # the written groups, and their sort
