"""Matching, clusters, merged boxes and dividers on small sheets, case by case."""

import numpy as np
import pytest

from offerlake.operators import geometry as g
from offerlake.operators import matching as m
from offerlake.operators import regions as r
from offerlake.plans import catalog

PRODUCT = "leaflet_id int, page_number int, id string, product_name string, brand string, product_code string, regular_price double, discounted_price double, quantity int, units string, bbox_x long, bbox_y long, bbox_width long, bbox_height long, region string"
REGION = "leaflet_id int, region int, text string, bbox_x long, bbox_y long, bbox_width long, bbox_height long, id string"
TEXTS = "leaflet_id int, id string, text string, bbox_x long, bbox_y long, bbox_width long, bbox_height long, kind string"


def product(spark, *rows, box=(0, 0, 100, 100)):
    fill = lambda r: (1, 1, r["id"], r.get("name", ""), r.get("brand"), r.get("code"), r.get("price"), r.get("off"), r.get("n"), r.get("units"), *(r["box"] if "box" in r else box), "x")
    return spark.createDataFrame([fill(r) for r in rows], PRODUCT)


def regions(spark, *rows, leaflet=1):
    return spark.createDataFrame([(leaflet, i, t, *b, "x") for i, (t, b) in enumerate(rows)], REGION)


@pytest.mark.parametrize(
    ("row", "text", "score"),
    [
        ({"code": "SKU-12"}, "sku 12 akcija", 0.6),  # blanks and dashes do not count
        ({"code": "X"}, "x", None),  # short codes do not count
        ({"price": 12.5}, "samo 12,50 eur", 0.4),
        ({"price": 12.5}, "samo 125", 0.4),  # without its point
        ({"price": 99.0, "off": 10.0}, "99,00", None),  # the reduced price is looked for
        ({"price": 99.0, "off": 0.0}, "99,00", 0.4),  # zero is none
        ({"name": "Dark Rye Bread"}, "rye bread", 0.8 * 2 / 3),
        ({"name": "Dark Rye Bread", "brand": "Ovens"}, "dark ryebread", 0.8),  # parts of over three letters as substrings: dark and bread
        ({"name": "Milk", "n": 2, "units": "L"}, "milk 2 l", 0.9),
        ({"name": "Milk", "n": 0, "units": "L"}, "milk 0l", 0.8),
        ({"name": None, "code": None}, "anything", None),
    ],
)
def test_text_points(spark, row, text, score):
    found = m.by_text(product(spark, {"id": "a", **row}), regions(spark, (text, (0, 0, 1, 1))), "leaflet_id").collect()
    assert [x.score for x in found] == ([] if score is None else [pytest.approx(score)])


def test_a_taken_region_is_closed(spark):
    goods = product(spark, {"id": "a", "name": "red rod"}, {"id": "b", "name": "red rod"}, {"id": "c", "name": "red rod"}, {"id": "d", "name": "blue gear"})
    sheet = regions(spark, ("red", (0, 0, 9, 9)), ("red rod", (0, 0, 9, 9)), ("red rod and more", (0, 0, 9, 9)), (None, (0, 0, 9, 9)))
    found = {x.turn.id: (x.region, x.score) for x in m.by_text(goods, sheet, "leaflet_id").collect()}
    assert found == {"a": (1, 0.8), "b": (2, 0.8), "c": (0, pytest.approx(0.4))}


def test_places_then_reading_order(spark):
    goods = product(spark, {"id": "a", "box": (0, 0, 100, 100)}, {"id": "b", "box": (10, 0, 100, 100)}, {"id": "c", "box": (None,) * 4}, {"id": "d", "box": (900, 900, 5, 5)}, {"id": "e", "box": (900, 900, 5, 5)})
    sheet = regions(spark, ("", (0, 0, 100, 100)), ("", (300, 210, 50, 50)), ("", (100, 200, 50, 50)), ("", (0, 600, 50, 50)))
    found = {x.turn.id: (x.region, x.score, x.source) for x in m.by_place(goods, sheet, "leaflet_id").collect()}
    assert found == {
        "a": (0, 0.85, "visual_iou_match"), "b": (2, 0.5, "visual_position_match"), "c": (1, 0.5, "visual_position_match"), "d": (3, 0.5, "visual_position_match"),
    }
    all_found = {x.id: x.source for x in m.match_regions(goods, sheet, "leaflet_id").collect()}
    assert all_found["e"] == "no_match"
    texted = m.match_regions(product(spark, {"id": "a", "name": "rod"}, {"id": "b", "name": "gear"}), regions(spark, ("rod", (0, 0, 9, 9))), "leaflet_id").collect()
    assert {x.id: x.source for x in texted} == {"a": "ocr_text_match", "b": "vlm_estimated"}
    assert [x.source for x in m.match_regions(goods, regions(spark, ("", (0, 0, 1, 1)), leaflet=2), "leaflet_id").collect()] == [None] * 5


def boxes(spark, *rows):
    return spark.createDataFrame([(1, str(i), t, *b, "x") for i, (t, b) in enumerate(rows)], TEXTS)


def ranges(spark, *rows, width=1000, height=1000):
    (row,) = g.layout(boxes(spark, *[("", b) for b in rows]), width, height, "leaflet_id").collect()
    return [tuple(x) for x in row["columns"]], [tuple(x) for x in row["rows"]]


def test_layout(spark):
    even = [(0, 500), (500, 1000)]
    assert ranges(spark, (0, 0, 990, 990)) == (even, [(0, 1000)])  # one gap: even columns; 990 is over 150
    assert ranges(spark, (0, 0, 100, 990), (140, 0, 900, 990))[0] == [(0, 1000)]  # none is wide enough
    assert ranges(spark, (0, 0, 990, 990), width=1700)[0] == [(0, 425), (425, 850), (850, 1275), (1275, 1700)]
    # edges alone are sorted, so a gap may lie within a box
    assert ranges(spark, (0, 0, 200, 200), (300, 300, 200, 100), (600, 450, 200, 300)) == ([(800, 1000)], [(740, 1000)])
    assert ranges(spark, *[(x, 0, 30, 9) for x in range(0, 200, 30)], *[(x, 0, 30, 9) for x in range(400, 700, 30)], (900, 0, 30, 9))[0] == [(0, 210), (400, 700)]


def test_rows_take_their_padding_from_the_gaps(spark):
    assert ranges(spark, *[(0, y, 9, 40) for y in (0, 40, 80, 120, 160, 300, 340)])[1] == [(0, 210), (290, 1000)]
    assert ranges(spark, (0, 960, 990, 1), (0, 1005, 990, 20))[1] == [(0, 971)]  # the last is too low
    assert ranges(spark, (0, 10, 9, 50), (0, 110, 9, 50), height=100)[1] == [(0, 100)]  # none is high enough


def test_price_clusters(spark):
    sheet = boxes(
        spark, ("Milk", (0, 0, 100, 20)), ("1,99", (0, 30, 40, 20)), ("500 g", (0, 45, 40, 20)), ("Bread", (200, 100, 100, 20)), ("2,99", (200, 130, 40, 20)), ("Far away", (900, 900, 50, 20)), ("Cheese", (210, 125, 90, 20)),
        ("lost", (None,) * 4),
    )
    found = [[b.text for b in x.boxes] for x in r.price_clusters(sheet, "leaflet_id").orderBy("cluster").collect()]
    assert found == [["1,99", "Milk", "500 g"], ["2,99", "Cheese", "Bread"]]
    one = [[b.text for b in x.boxes] for x in r.price_clusters(sheet.where("text <> '2,99'"), "leaflet_id").collect()]
    assert one == [["Milk", "1,99", "500 g", "Bread", "Cheese", "Far away"]]


def test_clusters_by_nearness_look_again_after_growing(spark):
    sheet = boxes(spark, ("a", (0, 0, 50, 50)), ("c", (150, 10, 50, 50)), ("b", (70, 20, 50, 50)), ("d", (1000, 0, 50, 50)), ("flat", (0, 101, 900, 5)))
    found = [[b.text for b in x.boxes] for x in r.near_clusters(sheet, "leaflet_id").orderBy("cluster").collect()]
    assert found == [["a", "b", "c"], ["d"], ["flat"]]  # c is near only once b has joined; with flat it would be too long


def test_merged_boxes(spark):
    sheet = boxes(spark, ("", (0, 0, 100, 100)), ("", (20, 0, 100, 100)), ("", (40, 0, 100, 100)), ("", (500, 0, 10, 10)))
    as_rows = lambda df: sorted((x.first, x.n, x.bbox_x, x.bbox_width) for x in df.collect())
    assert as_rows(r.overlap_merged(sheet, "leaflet_id")) == [("0", 2, 0, 120), ("2", 1, 40, 100), ("3", 1, 500, 10)]  # the first box is compared
    assert as_rows(r.near_merged(sheet, "leaflet_id", distance=0)) == [("0", 3, 0, 140), ("3", 1, 500, 10)]
    assert as_rows(r.near_merged(sheet, "leaflet_id", distance=360)) == [("0", 4, 0, 510)]
    assert r.near_merged(sheet.limit(0), "leaflet_id").collect() == []


def divided(spark, profile, expected, spacing):
    df = spark.createDataFrame([(1, profile)], "leaflet_id int, profile array<int>")
    return [x.at_step for x in r.dividers(df, expected, spacing, "leaflet_id").orderBy("divider").collect()]


def test_dividers(spark):
    flat = [0] * 100
    assert divided(spark, flat[:2], 5, 0.1) == [0, 1] and divided(spark, flat, 1, 0.1) == [0, 99]
    peaked = list(flat)
    for at, high in ((30, 9), (34, 8), (70, 5)):
        peaked[at] = high
    # sums over three make plateaus; the first place of the brightest counts, 34 is too near
    assert divided(spark, peaked, 4, 0.1) == [0, 29, 69, 99]
    assert divided(spark, peaked, 3, 0.1) == [0, 29, 99]
    assert divided(spark, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], 9, 0.9) == [0, 2, 4, 6, 9]  # halves the last of the widest until none is four wide
    boxes_df = boxes(spark, ("", (0, 0, 35, 10)), ("", (20, 0, 15, 10)), ("", (95, 0, 900, 10)))
    assert r.covered(boxes_df, "bbox_x", "bbox_width", 100, 10, "leaflet_id").first().profile == [235, 235, 215, 215, 255, 255, 255, 255, 255, 235]


def test_profiles_divide_alike_alone_and_side_by_side():
    rows = np.random.default_rng(3).integers(0, 256, (40, 100))
    assert r._divided(rows, 5, 0.125) == [r._divided(rows[i : i + 1], 5, 0.125)[0] for i in range(40)]
    assert r._divided(rows[:2, :2], 5, 0.1) == [[0, 1]] * 2


def test_what_is_gathered_of_a_sheet_does_not_grow_with_its_boxes(spark):
    many = boxes(spark, *[("", (10 * (i % 3), 0, 5, 10)) for i in range(3000)], ("", (2000, 0, 5, 10)))
    found = r.covered(many, "bbox_x", "bbox_width", 100, 10, "leaflet_id")
    assert found.first().profile == [0, 0, 0] + [255] * 7
    assert [f.dataType.simpleString() for f in found.schema] == ["int", "array<smallint>"]
    assert r.covered(many.where("bbox_x = 2000"), "bbox_x", "bbox_width", 100, 10, "leaflet_id").first().profile == [255] * 10


def exchanges(df):
    """How often rows move by their keys; what is sent whole to all tasks or to one does not count."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sheets_move_once(spark):
    df = catalog.QUERIES["g13_hybrid_regions"][0](spark, "/root/testdata/sf0.001")
    assert 0 < exchanges(df) <= 3  # lines of texts, and those of regions for sizes and for cards, which are the same


@pytest.mark.parametrize("name", ["g17_position_match", "j15_g16_matched_regions"])
def test_sheets_are_matched_where_they_are(spark, name):
    df = catalog.QUERIES[name][0](spark, "/root/testdata/sf0.001")
    assert 0 < exchanges(df) <= 2 * (1 + ("j15" in name))  # lines of offers and of regions, which j15 reads again for its pairs


def test_the_same_turn_or_region_is_matched_once(spark):
    goods = product(spark, {"id": "a", "box": (500, 0, 10, 10)}, {"id": "a", "box": (0, 0, 100, 100)}, {"id": "b", "box": (0, 0, 100, 100)})
    sheet = regions(spark, ("", (0, 0, 100, 100)), ("", (2000, 0, 10, 10)))
    twice = sheet.unionByName(sheet.where("region = 0").selectExpr("leaflet_id", "region", "text", "bbox_x + 1 as bbox_x", "bbox_y", "bbox_width", "bbox_height", "id"))
    found = sorted((x.turn.id, x.region, x.source) for x in m.by_place(goods, twice, "leaflet_id").collect())
    assert found == [("a", 0, "visual_iou_match"), ("b", 1, "visual_position_match")]


@pytest.mark.parametrize("name", ["g10_price_clusters", "g11_text_regions", "g12_near_regions"])
def test_texts_move_once(spark, name):
    df = catalog.QUERIES[name][0](spark, "/root/testdata/sf0.001")
    assert 0 < exchanges(df) <= 2 + (name == "g11_text_regions")  # F8, F13, F15, F17: lines, for the layout and for the cells; g11 numbers its regions last
