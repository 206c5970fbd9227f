"""Lines and orders where orders are too large to be sent to every task."""

import pytest

from offerlake.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = "g15_grid_cells a34_confidence_means g4_padded_unions d1_split_candidates d2_name_similarity g3_box_union w2_later_repeats v14_repeats g19_boxes_for_missing".split()


@pytest.fixture(scope="module")
def unsent(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return other


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_lines_are_not_sorted_to_meet_orders(spark, unsent, name):
    """F9, F16, F18 to F21, F24 to F26: one task sorted millions of lines, and merged partitions made it so."""
    run = catalog.QUERIES[name][0]
    large = run(unsent, SF)
    text = plan(large)
    assert "SortMergeJoin [l_orderkey" not in text and "ShuffledHashJoin [l_orderkey" in text and "REPARTITION_BY_NUM" in text
    assert sorted(map(repr, large.collect())) == sorted(map(repr, run(spark, SF).collect()))


def test_small_orders_are_sent(spark):
    assert "REPARTITION_BY_NUM" not in plan(catalog.QUERIES["g15_grid_cells"][0](spark, SF))


def test_missing_boxes_are_placed_in_one_pass(unsent):
    text = plan(catalog.QUERIES["g19_boxes_for_missing"][0](unsent, SF))
    assert text.count("/lineitem.parquet]") == 1 and text.count("Window [") == 1  # lines were read twice and joined by page
