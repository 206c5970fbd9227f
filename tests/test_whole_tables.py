"""Pairs, places and greedy choices by plain loops, over leaflets of large ids."""

import collections

import pytest
from pyspark.sql import functions as F

from offerlake.plans import catalog
from offerlake.sources.tables import Tables

SOURCES = {"approved": 0, "auto_approved": 1, "pending": 2, "needs_correction": 3, "rejected": 4}
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """(folder, products by page): the first 60 leaflets, their ids from 10,000 on."""
    path = str(tmp_path_factory.mktemp("far"))
    for name, id_col in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("part", None)):
        table = spark.read.parquet(f"{SF}/{name}.parquet")
        if id_col:
            table = table.where(F.col(id_col) < 60).withColumn(id_col, F.col(id_col) + 10_000)
        table.write.parquet(f"{path}/{name}.parquet")
    pages = collections.defaultdict(list)
    for r in Tables(spark, path).products.collect():
        pages[r.leaflet_id, r.page_number].append(r)
    return path, pages


def rows(spark, name, path):
    return catalog.QUERIES[name][0](spark, path)


def overlap(a, b):
    w = min(a.bbox_x + a.bbox_width, b.bbox_x + b.bbox_width) - max(a.bbox_x, b.bbox_x)
    h = min(a.bbox_y + a.bbox_height, b.bbox_y + b.bbox_height) - max(a.bbox_y, b.bbox_y)
    shared = max(0, w) * max(0, h)
    return w >= 0 and h >= 0, shared / (a.bbox_width * a.bbox_height + b.bbox_width * b.bbox_height - shared)


def test_iou(spark, far):
    expected = {}
    for page in far[1].values():
        for a in page:
            for b in page:
                meet, share = overlap(a, b)
                if a.id < b.id and meet:
                    expected[a.id, b.id] = pytest.approx(share)
    got = rows(spark, "g2_iou", far[0]).collect()
    assert expected and len(got) == len(expected) and {(r.first_id, r.second_id): r.iou for r in got} == expected


def test_greedy_boxes(spark, far):
    expected = []
    for page in far[1].values():
        kept = []
        for a in sorted(page, key=lambda r: (SOURCES[r.review_status], r.id)):
            if all(overlap(a, b)[1] <= 0.5 for b in kept):
                kept.append(a)
        expected += [a.id for a in kept]
    assert expected and sorted(r.id for r in rows(spark, "g14_greedy_boxes", far[0]).collect()) == sorted(expected)


def test_pages_of_leaflets(spark, far):
    expected = collections.defaultdict(set)
    for leaflet, page in far[1]:
        expected[leaflet].add(str(page))
    got = {r.leaflet_id: r.pages for r in rows(spark, "j16_pages_of_leaflet", far[0]).collect()}
    assert got and got == {k: ",".join(sorted(v)) for k, v in expected.items()}


def test_reading_order(spark, far):
    expected = []
    for page in far[1].values():
        expected += [(r.id, i) for i, r in enumerate(sorted(page, key=lambda r: (r.bbox_y // 100, r.bbox_x, r.id)), 1)]
    assert expected and sorted((r.id, r.place) for r in rows(spark, "s9_reading_order", far[0]).collect()) == sorted(expected)
