"""Regions of a sheet built from the boxes on it: merged boxes, clusters of texts around prices, clusters by nearness, dividers.

A sheet's boxes are few, and each step depends on those before, so a sheet is one row with an array. Built-in functions fold it
where one pass does; clusters, which look at all boxes at each step, are small Python functions over Arrow batches of sheets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .geometry import BOX, LEAST_HEIGHT, LEAST_WIDTH, PADDING, cells_by_ranges, distinct_of, held_part, layout

# Fixed values.
NEAR, MERGE_DISTANCE, MOST_ASPECT, IMAGE_PART = 50, 50, 3.0, 0.8
BESIDE, FARTHEST = 30, 100
SIDES = ("left", "top", "right", "bottom")


def _sides(b: Column) -> dict[str, Column]:
    return {"left": b["bbox_x"], "top": b["bbox_y"], "right": b["bbox_x"] + b["bbox_width"], "bottom": b["bbox_y"] + b["bbox_height"]}


def _around(a: Column, b: dict[str, Column]) -> dict[str, Column]:
    return {k: (F.least if k in ("left", "top") else F.greatest)(a[k], b[k]) for k in SIDES}


def _struct(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _changed(items: Column, at: Column, new: Callable[[Column], Column]) -> Column:
    """The array with its entry `at` (from 1) replaced."""
    return F.transform(items, lambda x, i: F.when(i + 1 == at, new(x)).otherwise(x))


def _box(c: str | Column) -> list[Column]:
    side = (lambda k: F.col(f"{c}.{k}")) if isinstance(c, str) else (lambda k: c[k])
    return [side("left").alias("bbox_x"), side("top").alias("bbox_y"), (side("right") - side("left")).alias("bbox_width"), (side("bottom") - side("top")).alias("bbox_height")]


def _merging(boxes: Column, joins: Callable[[Column, Column], Column]) -> Column:
    """The regions of an array of boxes (id, BOX): in its order, each box joins the first region that it fits and widens it, or
    begins one.

    Going region by region over the boxes that are left gives the same: whether a box fits a region depends on the region's
    own boxes before it alone.
    """
    first = lambda b: _struct(first=b["id"], n=F.lit(1).cast("long"), seed=_struct(**_sides(b)), **_sides(b))

    def step(kept: Column, b: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda r: joins(r, _struct(**_sides(b)))), True)
        wider = lambda r: _struct(first=r["first"], n=r["n"] + 1, seed=r["seed"], **_around(r, _sides(b)))
        return F.when(at > 0, _changed(kept, at, wider)).otherwise(F.array_append(kept, first(b)))

    return F.aggregate(boxes, F.slice(F.transform(boxes, first), 1, 0), step)


def _merged(boxes: DataFrame, order: tuple[str, ...], joins: Callable[[Column, Column], Column], *by: str) -> DataFrame:
    """(by, first, n, box, nth): regions of each group's boxes, which come in the given order."""
    entry = F.struct(*order, F.struct("id", *BOX).alias("b"))
    sheets = boxes.where("bbox_x is not null").groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("boxes"))
    made = sheets.select(*by, F.posexplode(_merging(F.col("boxes.b"), joins)).alias("nth", "r"))
    return made.select(*by, "r.first", "r.n", *_box("r"), "nth")


def _overlap(a: Column, b: Column) -> Column:
    side = lambda low, high: F.greatest(F.lit(0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    size = lambda x: (x["right"] - x["left"]) * (x["bottom"] - x["top"])
    shared = (side("left", "right") * side("top", "bottom")).cast("double")
    return F.when(shared > 0, shared / (size(a) + size(b) - shared)).otherwise(F.lit(0.0))


def overlap_merged(boxes: DataFrame, *by: str, least: float = 0.5) -> DataFrame:
    """Regions of boxes (by, id, BOX) in order of id: a box joins the first region whose first box it overlaps by more than
    `least`, and the region becomes the box around all of its own. Equal ids and boxes are boxes of their own."""
    return _merged(boxes, ("id",), lambda region, b: _overlap(region["seed"], b) > least, *by)


def _within(distance: int) -> Callable[[Column, Column], Column]:
    gap = lambda a, b, low, high: F.greatest(a[low], b[low]) - F.least(a[high], b[high])
    return lambda a, b: (gap(a, b, "left", "right") <= distance) & (gap(a, b, "top", "bottom") <= distance)


def near_merged(boxes: DataFrame, *by: str, distance: int = MERGE_DISTANCE) -> DataFrame:
    """Regions of boxes from top to bottom, then left to right: a box joins the first region that is at most `distance` away in
    both directions as far as the region has grown by then."""
    return _merged(boxes, ("bbox_y", "bbox_x", "id"), _within(distance), *by)


# clusters around prices
class _Cluster:
    """Boxes and the sides around them."""

    def __init__(self, box: dict):
        self.boxes, self.sides = [box], box["sides"]

    def add(self, box: dict) -> None:
        (a, b, c, d), (e, f, g, h) = self.sides, box["sides"]
        self.boxes.append(box)
        self.sides = min(a, e), min(b, f), max(c, g), max(d, h)


def _middle(sides: tuple) -> tuple[float, float]:
    return (sides[0] + sides[2]) / 2, (sides[1] + sides[3]) / 2


def _price_clusters(boxes: list[dict]) -> list[list[dict]]:
    """Clusters of one cell's boxes, which come from the top left; see price_clusters."""
    prices = [b for b in boxes if b["kind"] == "price"]
    if len(prices) < 2:
        return [boxes]
    names, others = [b for b in boxes if b["kind"] == "name"], [b for b in boxes if b["kind"] not in ("price", "name")]
    clusters = []
    for price in prices:
        cluster = _Cluster(price)
        above = [n for n in names if n["bbox_y"] <= price["sides"][3]]
        if above:
            name = min(above, key=lambda n: abs(n["bbox_y"] - price["bbox_y"]))
            cluster.add(name)
            names.remove(name)
        top, bottom = cluster.sides[1] - BESIDE, cluster.sides[3] + BESIDE
        beside = [o for o in others if top <= _middle(o["sides"])[1] <= bottom]
        others = [o for o in others if not top <= _middle(o["sides"])[1] <= bottom]
        for other in beside:
            cluster.add(other)
        clusters.append(cluster)
    left = {id(b) for b in (*names, *others)}
    for box in boxes:
        if id(box) in left:
            x, y = _middle(box["sides"])
            far = [((x - cx) ** 2 + (y - cy) ** 2) ** 0.5 for cx, cy in (_middle(c.sides) for c in clusters)]
            if min(far) < FARTHEST:
                clusters[far.index(min(far))].add(box)
    return [c.boxes for c in clusters]


def _each_sheet(batches: Iterator[pa.RecordBatch], clusters: Callable[[list[dict]], list[list[dict]]]) -> Iterator[pa.RecordBatch]:
    """Places of the boxes in each cluster, from 0, beside what else the batch has of a sheet; its last column is boxes."""
    for batch in batches:
        made, begin, lists = [], 0, batch.column("boxes")
        flat = lists.flatten()
        kinds = flat.field("kind").to_pylist() if flat.type.get_field_index("kind") >= 0 else repeat(None)
        every = [{"bbox_y": y, "kind": kind, "sides": (x, y, x + w, y + h)} for x, y, w, h, kind in zip(*(flat.field(c).to_pylist() for c in BOX), kinds)]
        for n in lists.value_lengths().to_pylist():
            boxes = every[begin : begin + n]
            for at, b in enumerate(boxes):
                b["at"] = at
            made.append([[b["at"] for b in cluster] for cluster in clusters(boxes)])
            begin += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.list_(pa.int32())))], [*batch.schema.names, "clusters"])


def _clusters_of(boxes: DataFrame, entry: list[Column], clusters: Callable[[list[dict]], list[list[dict]]], *by: str, same: tuple[str, ...] = ()) -> DataFrame:
    """(by, cluster, boxes, same, begins) of each group's boxes that have a place, as structs of entry in their order of BOX's y and x
    and id; same are columns that are the same for a whole group, begins is where it begins."""
    entry = F.struct("bbox_y", "bbox_x", "id", "bbox_width", "bbox_height", *entry)
    sheets = boxes.where("bbox_x is not null").groupBy(*by).agg(*[F.first(c).alias(c) for c in same], F.array_sort(F.collect_list(entry)).alias("boxes"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sheets.schema) + ", clusters array<array<int>>"
    made = sheets.mapInArrow(partial(_each_sheet, clusters=clusters), schema).select(*by, *same, "boxes", F.posexplode("clusters").alias("cluster", "places"))
    begins = F.struct(*[F.get("boxes", F.lit(0))[c].alias(c) for c in ("bbox_y", "bbox_x", "id")]).alias("begins")
    return made.select(*by, "cluster", F.transform("places", lambda i: F.get("boxes", i)).alias("boxes"), *same, begins)


def with_kinds(texts: DataFrame) -> DataFrame:
    """texts plus box_kind; made before texts are joined to anything, so that it is compiled and not made where they are gathered."""
    return texts.withColumn("box_kind", t.box_kind(F.col("text")))


def _around_prices(texts: DataFrame, *by: str, same: tuple[str, ...] = ()) -> DataFrame:
    kind = F.col("box_kind") if "box_kind" in texts.columns else t.box_kind(F.col("text"))
    return _clusters_of(texts, [F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind")], _price_clusters, *by, same=same)


def price_clusters(texts: DataFrame, *by: str) -> DataFrame:
    """(by, cluster, boxes): the boxes (id, text, kind, BOX) of each cell in clusters, from 0; texts may come with_kinds.

    A cell with one price or none is one cluster. Else each price, from the top, takes the nearest name that is not below it and
    not taken, then the units, discounts and others whose middle lies at most BESIDE above or below both; what is left joins the
    cluster with the nearest middle, as far as it has grown by then, if that is under FARTHEST away, and is dropped otherwise.
    Equal distances go to the upper, then left box, and to the first cluster. Boxes without a place are left out.
    """
    return _around_prices(texts, *by).select(*by, "cluster", "boxes")


def text_regions(texts: DataFrame, width: int, height: int, *by: str) -> DataFrame:
    """Product regions of each sheet's texts: (by, column, row, cluster, BOX, n, text, has_price, has_name, place).

    Texts go to the cells of the sheet's columns and rows, and there into price_clusters. A region is the box around a cluster,
    wider by PADDING, cut to its cell and sheet; those under LEAST_WIDTH or LEAST_HEIGHT go; the rest reach up by IMAGE_PART of
    the texts' height, for the picture, within the cell. place counts from 1 in rows of 100 points, from left to right.
    """
    cells = cells_by_ranges(with_kinds(texts), layout(texts, width, height, *by), *by)
    cell = (*by, "column", "row")
    cells = cells.withColumns({"across": F.get("columns", "column"), "down": F.get("rows", "row")})
    kinds = lambda kind: F.exists("boxes", lambda b: b["kind"] == kind)
    lit = lambda n: F.lit(n).cast("long")
    made = _around_prices(cells, *cell, same=("across", "down")).select(
        *cell, "cluster", "begins", "across", "down", *_sides_of("boxes"), *_said("boxes"), kinds("price").alias("has_price"), kinds("name").alias("has_name"),
    )
    for low_side, high_side, size, ranges, name in (("l", "r", width, "across", "x"), ("t", "b", height, "down", "y")):
        begin = F.greatest(lit(0), F.col(low_side) - PADDING, F.col(f"{ranges}.start"))
        long = F.col(high_side) - F.col(low_side) + 2 * PADDING
        made = made.withColumn(name, begin)
        long = F.when(F.col(name) + long > F.col(f"{ranges}.stop"), F.col(f"{ranges}.stop") - F.col(name)).otherwise(long)
        made = made.withColumn(f"{name}_long", F.least(long, lit(size) - F.col(name)))
    made = made.where((F.col("x_long") >= LEAST_WIDTH) & (F.col("y_long") >= LEAST_HEIGHT))
    above = F.greatest(F.col("down.start"), F.col("y") - F.floor((F.col("b") - F.col("t")) * IMAGE_PART))
    made = made.withColumn("above", above).withColumns({"bbox_x": F.col("x"), "bbox_y": F.col("above"), "bbox_width": F.col("x_long"), "bbox_height": F.col("y_long") + F.col("y") - F.col("above")})
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.floor(F.col("bbox_y") / 100), "bbox_x", "begins", "cluster"))
    return made.select(*cell, "cluster", *BOX, "n", "text", "has_price", "has_name", place.alias("place"))


# visual regions and texts together
# Gaps between centres that part columns and rows, least and most sizes of a card as parts of what a sheet suggests.
CARD_GAPS, CARD_LEAST, CARD_PART, CARD_AREA = (0.15, 0.10), (200, 250), 0.35, 2.5
SHEET_PARTS, CARD_TIMES, LEAST_SHARE, CARD_PADDING = (0.40, 0.90, 0.60), 2.0, 0.1, 15
SOURCES = ("hybrid", "visual_only", "grid_fallback")


def card_sizes(visual: DataFrame, width: int, height: int, *by: str) -> DataFrame:
    """(by, least_wide, least_high, most_wide, most_high, most_area): what a product's card may measure on each sheet, from the
    columns and rows that its regions' centres make, and their median size; a third by a quarter of the sheet under two regions."""
    middles = lambda p, s: F.array_sort(F.collect_list(F.col(p) + F.col(s) / 2))
    sheets = visual.groupBy(*by).agg(
        middles("bbox_x", "bbox_width").alias("xs"), middles("bbox_y", "bbox_height").alias("ys"), F.median("bbox_width").alias("mw"), F.median("bbox_height").alias("mh"), F.count("*").alias("n")
    )
    jumps = lambda a, least: F.size(F.filter(F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda x, y: y - x), lambda gap: gap > least))
    columns, rows = F.least(F.lit(6), jumps("xs", width * CARD_GAPS[0]) + 1), F.least(F.lit(8), jumps("ys", height * CARD_GAPS[1]) + 1)
    few = F.col("n") < 2
    wide = F.when(few, F.lit(width / 3)).otherwise(F.greatest("mw", F.lit(float(width)) / columns * 0.6))
    high = F.when(few, F.lit(height / 4)).otherwise(F.greatest("mh", F.lit(float(height)) / rows * 0.6))
    sheets = sheets.select(*by, wide.alias("w"), high.alias("h"))
    floor = lambda c, least: F.greatest(F.lit(least), F.floor(F.col(c) * CARD_PART).cast("int"))
    return sheets.select(
        *by, floor("w", CARD_LEAST[0]).alias("least_wide"), floor("h", CARD_LEAST[1]).alias("least_high"), F.least(F.lit(width * SHEET_PARTS[1]), F.col("w") * CARD_TIMES).alias("most_wide"),
        F.least(F.lit(height * SHEET_PARTS[2]), F.col("h") * CARD_TIMES).alias("most_high"), F.least(F.lit(width * height * SHEET_PARTS[0]), F.col("w") * F.col("h") * CARD_AREA).alias("most_area"),
    )


def cards(visual: DataFrame, sizes: DataFrame, *by: str) -> DataFrame:
    """sizes plus cards, each sheet's array of (kind, place, b): visual regions (by, id, BOX) of a card's size, in order of id
    (kind 0), then those that near small ones make together (kind 1), in the order in which they begin."""
    entry = F.struct("bbox_y", "bbox_x", "id", "bbox_width", "bbox_height")
    sheets = visual.where("bbox_x is not null").groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_found")).join(sizes, list(by))
    large = lambda b: (b["bbox_width"] * b["bbox_height"] > F.col("most_area")) | (b["bbox_width"] > F.col("most_wide")) | (b["bbox_height"] > F.col("most_high"))
    small = lambda b: (b["bbox_width"] < F.col("least_wide")) | (b["bbox_height"] < F.col("least_high"))
    card = lambda kind: lambda b, place: F.struct(F.lit(kind).alias("kind"), (place if kind else place + 1).alias("place"), F.struct(*[b[k].alias(k) for k in BOX]).alias("b"))
    by_id = F.array_sort(F.transform(F.filter("_found", lambda b: ~large(b) & ~small(b)), lambda b: F.struct(b["id"].alias("id"), b.alias("box"))))
    sheets = sheets.withColumns({"_whole": by_id["box"], "_near": _merging(F.filter("_found", lambda b: ~large(b) & small(b)), _within(MERGE_DISTANCE))})
    near = F.filter(F.transform("_near", lambda r: F.struct(*_box(r))), lambda b: ~large(b) & ~small(b))
    return sheets.withColumn("cards", F.concat(F.transform("_whole", card(0)), F.transform(near, card(1)))).drop("_found", "_whole", "_near")


def _sides_within(low: Column, high: Column, padding: int, size: int) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), low - padding), F.least(F.lit(float(size)), high + padding)


def hybrid_regions(texts: DataFrame, visual: DataFrame, width: int, height: int, *by: str) -> DataFrame:
    """Product regions of sheets that have texts and visual regions: (by, source, BOX, n, text, has_price, has_name, place).

    A text goes to the card that holds the largest part of it, over LEAST_SHARE, the first among equals. A card grows by its texts
    that are near enough, by PADDING, and is cut, around its middle, to a card's most; cards without texts are visual_only; texts
    without a card are gathered by cells of the least card's size. Of regions that overlap by more than half the first stays, in
    order of SOURCES. place counts in rows of 100 points from left to right. Sizes are truncated to whole points.

    A sheet's cards are an array beside each of its texts, and steps group or sort by sheet, so that tables that lie by sheet do not
    move again.
    """
    visual = visual.where("bbox_x is not null")
    sheets = cards(visual, card_sizes(visual, width, height, *by), *by)
    boxes = texts.where("bbox_x is not null").select(*by, "text", F.struct("bbox_y", "bbox_x", "id").alias("at"), F.struct(*BOX).alias("a"))
    boxes = boxes.join(sheets, list(by)).withColumns({"text": F.coalesce("text", F.lit("")), "box_kind": t.box_kind(F.col("text"))})
    held = F.transform("cards", lambda c: F.struct((-held_part(F.col("a"), c["b"])).alias("cost"), c["kind"].alias("kind"), c["place"].alias("place"), c["b"].alias("b")))
    told = boxes.withColumn("card", F.array_min(F.filter(held, lambda c: c["cost"] < -LEAST_SHARE)))

    mid = lambda c, p, s: F.col(f"{c}.{p}") + F.col(f"{c}.{s}") / 2
    told = told.withColumns({"b": F.col("card.b"), "kind": F.col("card.kind"), "place": F.col("card.place")})
    loose = F.col("kind").isNull()
    near = (F.abs(mid("a", "bbox_x", "bbox_width") - mid("b", "bbox_x", "bbox_width")) <= F.col("most_wide") / 2) & (F.abs(mid("a", "bbox_y", "bbox_height") - mid("b", "bbox_y", "bbox_height")) <= F.col("most_high") / 2)
    columns, rows = F.greatest(F.lit(1), F.floor(F.lit(width) / F.col("least_wide"))), F.greatest(F.lit(1), F.floor(F.lit(height) / F.col("least_high")))
    cell = lambda p, s, n, size: F.when(loose, F.least(n - 1, F.floor(mid("a", p, s) / (F.lit(float(size)) / n))))
    told = told.withColumns({"column": cell("bbox_x", "bbox_width", columns, width), "row": cell("bbox_y", "bbox_height", rows, height)})
    side = lambda f, edge: f(F.when(loose | near, F.expr(edge)))
    made = told.groupBy(*by, "kind", "place", "column", "row").agg(
        side(F.min, "a.bbox_x").alias("l"), side(F.min, "a.bbox_y").alias("t"), side(F.max, "a.bbox_x + a.bbox_width").alias("r"), side(F.max, "a.bbox_y + a.bbox_height").alias("low"),
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("texts"), F.bool_or(F.col("box_kind") == "price").alias("has_price"), F.bool_or(F.col("box_kind") == "name").alias("has_name"), F.min("at").alias("begins"),
        *[F.first(c).alias(c) for c in ("b", "cards", "least_wide", "least_high", "most_wide", "most_high")],
    )
    places = {}
    for low, high, at, long, least, most, size in (("l", "r", "bbox_x", "bbox_width", "least_wide", "most_wide", width), ("t", "low", "bbox_y", "bbox_height", "least_high", "most_high", height)):
        b0, b1 = _sides_within(F.least(f"b.{at}", low), F.greatest(F.expr(f"b.{at} + b.{long}"), high), PADDING, size)
        more = F.greatest(F.lit(0.0), (F.col(least) - (F.col(high) - F.col(low))) / 2)
        c0, c1 = _sides_within(F.greatest(F.lit(0.0), F.col(low) - more), F.least(F.lit(float(size)), F.col(high) + more), CARD_PADDING, size)
        begin = b0 + F.greatest(F.lit(0.0), b1 - b0 - F.col(most)) / 2
        places |= {at: F.when(loose, c0).otherwise(begin), long: F.when(loose, c1 - c0).otherwise(F.least(b1 - b0, most))}
    said = F.array_join(F.transform("texts", lambda e: e["text"]), " ")
    own = F.struct(F.when(loose, 2).otherwise(0).alias("source"), F.col("begins"), F.coalesce("kind", F.lit(0)).alias("kind"), F.coalesce("place", F.lit(0)).alias("place"))
    region = F.struct(own.alias("id"), *[F.floor(c).cast("long").alias(k) for k, c in places.items()], "n", said.alias("text"), "has_price", "has_name")
    whole = made.groupBy(*by).agg(F.collect_list(region).alias("regions"), F.first("cards").alias("cards"))

    none = F.struct(F.lit(0).cast("long").alias("bbox_y"), F.lit(0).cast("long").alias("bbox_x"), F.lit(None).cast("string").alias("id"))
    used = lambda c: F.exists("regions", lambda r: (r["id"]["source"] == 0) & (r["id"]["kind"] == c["kind"]) & (r["id"]["place"] == c["place"]))
    alone = lambda c: F.struct(
        F.struct(F.lit(1).alias("source"), none.alias("begins"), c["kind"].alias("kind"), c["place"].alias("place")).alias("id"), *[c["b"][k].cast("long").alias(k) for k in places],
        F.lit(0).cast("long").alias("n"), F.lit("").alias("text"), F.lit(False).alias("has_price"), F.lit(False).alias("has_name"),
    )
    every = F.concat("regions", F.transform(F.filter("cards", lambda c: ~used(c)), alone))
    kept = whole.select(*by, F.array_sort(every).alias("every")).select(*by, distinct_of(F.col("every"), 0.5).alias("kept"))
    placed = F.array_sort(F.transform("kept", lambda r: F.struct(F.floor(r["bbox_y"] / 100).alias("line"), r["bbox_x"].alias("x"), r["id"].alias("id"), r.alias("r"))))
    out = kept.select(*by, F.posexplode(placed["r"]).alias("nth", "r"))
    return out.select(*by, F.get(F.array(*map(F.lit, SOURCES)), F.col("r.id.source")).alias("source"), *[F.col(f"r.{c}") for c in (*BOX, "n", "text", "has_price", "has_name")], (F.col("nth") + 1).alias("place"))


# clusters by nearness
def _near_clusters(boxes: list[dict]) -> list[list[dict]]:
    """From the first box that is left, sweeps over the others: a box joins if it is near the cluster as it was when the sweep
    began, and the cluster with it stays compact; until a sweep adds none."""
    left, clusters = list(boxes), []
    while left:
        cluster, more = _Cluster(left[0]), True
        left = left[1:]
        while more:
            rest, (x0, y0, x1, y1) = [], cluster.sides
            for box in left:
                a, b, c, d = box["sides"]
                l, t_, r, low = cluster.sides
                wide, high = max(r, c) - min(l, a), max(low, d) - min(t_, b)
                near = a <= x1 + NEAR and c >= x0 - NEAR and b <= y1 + NEAR and d >= y0 - NEAR
                if near and wide and high and max(wide / high, high / wide) <= MOST_ASPECT:
                    cluster.add(box)
                else:
                    rest.append(box)
            left, more = rest, len(rest) < len(left)
        clusters.append(cluster.boxes)
    return clusters


def near_clusters(boxes: DataFrame, *by: str) -> DataFrame:
    """(by, cluster, boxes) of boxes (id, text, BOX) without prices to gather around: clusters by nearness that are at most
    MOST_ASPECT times as long as wide, from the upper left on, in the order of joining. Boxes without a place are left out."""
    return _clusters_of(boxes, [F.coalesce("text", F.lit("")).alias("text")], _near_clusters, *by).select(*by, "cluster", "boxes")


def _sides_of(boxes: str) -> list[Column]:
    """Left, top, right and bottom of an array of boxes."""
    low = lambda k: F.array_min(F.transform(boxes, lambda b: b[k]))
    high = lambda k, s: F.array_max(F.transform(boxes, lambda b: b[k] + b[s]))
    return [low("bbox_x").alias("l"), low("bbox_y").alias("t"), high("bbox_x", "bbox_width").alias("r"), high("bbox_y", "bbox_height").alias("b")]


def _said(boxes: str) -> list[Column]:
    return [F.size(boxes).cast("long").alias("n"), F.array_join(F.transform(boxes, lambda b: b["text"]), " ").alias("text")]


def near_regions(texts: DataFrame, width: int, height: int, *by: str) -> DataFrame:
    """The boxes around near_clusters, wider by PADDING within the sheet, without those under the least size: (by, cluster, BOX,
    n, text)."""
    made = near_clusters(texts, *by).select(*by, "cluster", *_sides_of("boxes"), *_said("boxes"))
    zero = F.lit(0).cast("long")
    left, top = F.greatest(zero, F.col("l") - PADDING), F.greatest(zero, F.col("t") - PADDING)
    wide = F.least(F.col("r") - F.col("l") + 2 * PADDING, F.lit(width) - left)
    high = F.least(F.col("b") - F.col("t") + 2 * PADDING, F.lit(height) - top)
    made = made.select(*by, "cluster", left.alias("bbox_x"), top.alias("bbox_y"), wide.alias("bbox_width"), high.alias("bbox_height"), "n", "text")
    return made.where((F.col("bbox_width") >= LEAST_WIDTH) & (F.col("bbox_height") >= LEAST_HEIGHT))


# dividers
def _divided(profiles: np.ndarray, expected: int, spacing: float) -> list[list[int]]:
    """Places where profiles of one length, a row each, divide; see dividers. Each step is taken for all rows at once."""
    rows, n = profiles.shape
    if n < 3 or expected < 2:
        return [[0, n - 1]] * rows
    apart, kernel = max(3, int(n * spacing)), max(3, n // 80)
    reach, left = max(3, apart // 3), (kernel - 1) - (kernel - 1) // 2
    sums = np.zeros((rows, n + kernel), np.int64)
    np.cumsum(np.pad(profiles, ((0, 0), (left, kernel - 1 - left))), axis=1, out=sums[:, 1:])
    smooth = sums[:, kernel:] - sums[:, :-kernel]
    tops = smooth.copy()
    for by in range(1, reach + 1):
        np.maximum(tops[:, by:], smooth[:, :-by], out=tops[:, by:])
        np.maximum(tops[:, :-by], smooth[:, by:], out=tops[:, :-by])
    free = smooth >= tops  # peaks that are far enough from all taken before
    free[:, 0] = free[:, -1] = False
    places = np.full((rows, expected), n, np.int64)
    places[:, 0], places[:, 1] = 0, n - 1
    taken, steps, each = np.full(rows, 2), np.arange(n), np.arange(rows)
    free &= (steps >= apart) & (n - 1 - steps >= apart)
    lowest = np.iinfo(np.int64).min
    for k in range(2, expected):
        at = np.where(free, smooth, lowest).argmax(1)
        some = free[each, at]
        if not some.any():
            break
        places[some, k] = at[some]
        taken += some
        free &= np.abs(steps - at[:, None]) >= apart
    places.sort(axis=1)
    for _ in range(2, expected):
        gaps = np.where(np.arange(1, expected) < taken[:, None], places[:, 1:] - places[:, :-1], -1)
        i = expected - 2 - gaps[:, ::-1].argmax(1)
        wide = gaps[each, i]
        more = (taken < expected) & (wide >= 4)
        if not more.any():
            break
        places[more, taken[more]] = (places[each, i] + wide // 2)[more]
        taken += more
        places.sort(axis=1)
    return [p[:k] for p, k in zip(places.tolist(), taken.tolist())]


def _profiles(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their profiles as one array) for each length among a column's profiles."""
    sizes, values = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, values[begins[rows, None] + np.arange(n)]


def _each_profile(batches: Iterator[pa.RecordBatch], expected: int, spacing: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [None] * len(batch)
        for rows, profiles in _profiles(batch.column("profile")):
            for row, places in zip(rows.tolist(), _divided(profiles, expected, spacing)):
                made[row] = places
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.int32()))], [*batch.schema.names[:-1], "places"])


def dividers(profiles: DataFrame, expected: int, spacing: float, *by: str) -> DataFrame:
    """(by, divider, at_step) of profiles (by, profile: an array of whole numbers, bright between products): `expected` places
    that divide it, the ends included, numbered from 0.

    The profile is summed over windows of an eightieth of it, three at least; local maxima are taken from the brightest on, the
    first among equals, if they are `spacing` (a part of the length) from all taken before; then the largest gap, the last
    among equals, is halved until there are enough or none is four wide. Profiles under three long give their ends.
    """
    rows = profiles.select(*by, "profile")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by) + ", places array<int>"
    made = rows.mapInArrow(partial(_each_profile, expected=expected, spacing=spacing), schema)
    return made.select(*by, F.posexplode("places").alias("divider", "at_step"))


def _each_coverage(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[pa.RecordBatch]:
    """Profiles of the ranges (begin, end, n) of each sheet, the last column, which are added up as differences."""
    for batch in batches:
        ranges = batch.column("ranges")
        begin, end, n = (ranges.flatten().field(k).to_numpy(zero_copy_only=False) for k in ("begin", "end", "n"))
        row = np.repeat(np.arange(len(batch)), ranges.value_lengths().to_numpy(zero_copy_only=False)) * (steps + 1)
        changes = np.bincount(row + begin, n, len(batch) * (steps + 1)) - np.bincount(row + end + 1, n, len(batch) * (steps + 1))
        over = changes.astype(np.int64).reshape(-1, steps + 1)[:, :steps].cumsum(axis=1)
        profiles = np.maximum(0, 255 - 20 * over).astype(np.int16)
        made = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * steps), pa.array(profiles.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], "profile"])


def covered(boxes: DataFrame, place: str, size: str, length: int, step: int, *by: str) -> DataFrame:
    """(by, profile): how few of a sheet's boxes lie over each step of one direction: 255 less 20 for each, 0 at least.

    A box counts once at each step that it reaches. Boxes are counted by sheet and range of steps, so that what is gathered of a
    sheet is bounded by its steps and not by its boxes."""
    steps = length // step
    reach = lambda at: F.greatest(F.lit(0), F.least(F.lit(steps - 1), at)).cast("int")
    inside = (F.col(place) < length) & (F.col(place) + F.col(size) > 0)
    begin, end = reach(F.floor(F.col(place) / step)), reach(F.ceil((F.col(place) + F.col(size)) / step) - 1)
    counts = boxes.where("bbox_x is not null").select(*by, F.when(inside, begin).alias("begin"), F.when(inside, end).alias("end")).groupBy(*by, "begin", "end").agg(F.count("*").alias("n"))
    sheets = counts.groupBy(*by).agg(F.collect_list(F.when(F.col("begin").isNotNull() & (F.col("end") >= F.col("begin")), F.struct("begin", "end", "n"))).alias("ranges"))
    schema = ", ".join(f"`{c}` {sheets.schema[c].dataType.simpleString()}" for c in by) + ", profile array<smallint>"
    return sheets.mapInArrow(partial(_each_coverage, steps=steps), schema)


# even grids
#: Grids to look for (columns, rows), the grid where none is even, how uneven its cells may be, and their least size.
GRID_HINTS, PLAIN_GRID, MOST_UNEVEN, LEAST_CELL = ((3, 4), (3, 5), (4, 5), (4, 6)), (3, 5), 2.5, (100, 120)


def _even(places: list[int], least: int) -> int:
    """How many of the cells between places are large enough, if their sizes are like each other; else 0."""
    sizes = [b - a for a, b in zip(places, places[1:]) if b - a >= least]
    return len(sizes) if sizes and max(sizes) <= MOST_UNEVEN * min(sizes) else 0


def _even_grids(across: np.ndarray, down: np.ndarray, step: int) -> list[tuple[int, int, list[int], list[int]]]:
    """For each row of both the first hinted grid whose cells are of like sizes, else the plain one: columns, rows, and the places
    of their dividers. A number of parts that several hints share is divided once."""
    cut = {}
    for way, profiles, parts, least in (("x", across, {c for c, _ in GRID_HINTS}, LEAST_CELL[0]), ("y", down, {r for _, r in GRID_HINTS}, LEAST_CELL[1])):
        length = profiles.shape[1] * step
        for n in parts:
            places = [[at * step for at in row] for row in _divided(profiles, n + 1, 0.5 / n)]
            cut[way, n] = [(row, _even(row, max(least, length // 20))) for row in places]
    n, m = PLAIN_GRID
    plain = (n, m, [i * (across.shape[1] * step // n) for i in range(n + 1)], [i * (down.shape[1] * step // m) for i in range(m + 1)])
    made = []
    for k in range(len(across)):
        tried = ((c, r, *cut["x", c][k], *cut["y", r][k]) for c, r in GRID_HINTS)
        made.append(next(((c, r, xs, ys) for c, r, xs, wide, ys, high in tried if wide * high >= 2), plain))
    return made


def even_grids(across: DataFrame, down: DataFrame, step: int, *by: str) -> DataFrame:
    """(by, columns, rows, xs, ys) of sheets with profiles (by, profile) in both directions: the first of GRID_HINTS whose dividers
    cut cells that are large enough, two at least, and whose widths and heights each differ by a factor of MOST_UNEVEN at the
    most; else PLAIN_GRID with equal cells."""
    both = across.select(*by, F.col("profile").alias("across")).join(down.select(*by, F.col("profile").alias("down")), list(by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None] * len(batch)
            for rows, wide in _profiles(batch.column("across")):
                for own, high in _profiles(batch.column("down").take(pa.array(rows))):
                    for row, grid in zip(rows[own].tolist(), _even_grids(wide[own], high, step)):
                        made[row] = grid
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = [pa.array([r[i] for r in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], [*batch.schema.names[:-2], "columns", "rows", "xs", "ys"])

    schema = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in by) + ", columns int, rows int, xs array<int>, ys array<int>"
    return both.mapInArrow(run, schema)
