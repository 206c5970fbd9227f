"""Queries by leaflet where parts are too large to be sent to every task."""

import re

import pytest

from offerlake.plans import catalog

SF = "/root/testdata/sf0.001"
#: Query -> how often rows are dealt: lines by part and by leaflet, parts, and orders where offers are read.
DEALT = {"g13_hybrid_regions": 3, "d8_reconcile": 4, "d3_merged": 4, "j15_exclusive_match": 4, "g17_position_match": 4, "j15_g16_matched_regions": 4}


@pytest.fixture(scope="module")
def unsent(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "500")  # the texts' three rows are still sent
    return other


def final(df):
    """The plan as it ran, in which an exchange that is used again stands once."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", DEALT)
def test_lines_are_read_and_dealt_once(spark, unsent, name):
    """Round 4, F1 to F6: each side, and each use of it, read lines again, and sorted and moved them by leaflet, part and leaflet again."""
    run = catalog.QUERIES[name][0]
    large = run(unsent, SF)
    rows = sorted(map(repr, large.collect()))
    plan = final(large)
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1
    assert len(re.findall(r"(?<!, )Exchange hashpartitioning", plan)) == DEALT[name]
    assert rows == sorted(map(repr, run(spark, SF).collect()))


@pytest.mark.parametrize("name", ["texts", "regions", "offers"])
def test_lines_are_not_sorted_to_meet_parts(unsent, name):
    from offerlake.sources.tables import Tables

    plan = Tables(unsent, SF).by_leaflet(name)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [l_partkey" in plan and "SortMergeJoin" not in plan


def offer(spark, *rows):
    """Offers (id, page, top, changes) of one leaflet."""
    plain = "leaflet_id long, brand string, product_code string, category string, currency string, units string, product_name string, regular_price double, discounted_price double, discount_percentage double, quantity long, confidence double, category_confidence double, brand_confidence double, bbox_x long, bbox_y long, bbox_width long, bbox_height long, flags string, id string, page_number long"
    base = {"leaflet_id": 1, "product_name": "milk", "regular_price": 2.0, "quantity": 1, "confidence": 0.5, "bbox_x": 0, "bbox_width": 10, "bbox_height": 150, "flags": "partial_product,continues_on_next_page,continued_from_previous"}
    return spark.createDataFrame([base | {"id": i, "page_number": page, "bbox_y": top} | more for i, page, top, more in rows], plain)


def test_a_page_meets_the_next_page_alone(spark):
    from offerlake.operators import reconcile as r

    df = offer(spark, ("a", 1, 840, {}), ("b", 3, 0, {}), ("c", 4, 0, {}), ("d", None, 840, {}), ("e", 4, 840, {}), ("f", 3, 500, {}), ("g", None, 0, {}), ("h", 7, 0, {"leaflet_id": 2}))
    assert sorted((x.first_id, x.second_id) for x in r.split_candidates(df, 1000).collect()) == [("a", "b")]


def test_what_equals_a_part_goes_with_it(spark):
    from offerlake.operators import reconcile as r

    df = offer(spark, ("a", 1, 840, {}), ("a2", 1, 840, {}), ("b", 2, 0, {}), ("n", 1, 840, {"product_name": "juice", "flags": ""}), ("c", 1, 300, {"product_name": "bread"}))
    for dealt in (False, True):
        assert sorted(x.id for x in r.reconciled(df, 1000, dealt=dealt).collect()) == ["a+b", "c", "n"]


def test_every_product_of_an_id_is_merged(spark):
    from offerlake.operators import reconcile as r

    df = offer(spark, ("a", 1, 840, {}), ("a", 1, 840, {"discounted_price": 1.0}), ("b", 2, 0, {}), ("b", 2, 0, {"flags": ""}), ("c", 3, 0, {}))
    pairs = r.split_candidates(df, 1000).where(f"points >= {r.MERGE_POINTS}").select("first_id", "second_id")
    assert sorted(map(repr, r.split_merged(df, 1000).collect())) == sorted(map(repr, r.merged(df, pairs).collect()))
    assert r.split_merged(df, 1000).count() == 4 * pairs.count() > 4
