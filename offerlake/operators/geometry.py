"""Boxes on pages: unions, overlaps, grids, columns, and a greedy choice of distinct boxes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("bbox_x", "bbox_y", "bbox_width", "bbox_height")


def intersection(a: str, b: str) -> Column:
    """Area that two structs of BOX share."""
    side = lambda p, s: F.greatest(F.lit(0), F.least(F.col(f"{a}.{p}") + F.col(f"{a}.{s}"), F.col(f"{b}.{p}") + F.col(f"{b}.{s}")) - F.greatest(F.col(f"{a}.{p}"), F.col(f"{b}.{p}")))
    return side("bbox_x", "bbox_width") * side("bbox_y", "bbox_height")


def area(a: str) -> Column:
    return F.col(f"{a}.bbox_width") * F.col(f"{a}.bbox_height")


def iou(a: str, b: str) -> Column:
    shared = intersection(a, b)
    return F.when(shared == 0, 0.0).otherwise(shared.cast("double") / (area(a) + area(b) - shared).cast("double"))


def pair_iou(pairs: DataFrame, boxes: DataFrame, id_col: str = "id") -> DataFrame:
    """pairs (first_id, second_id) plus iou."""
    own = lambda i, n: boxes.select(F.col(id_col).alias(i), F.struct(*BOX).alias(n))
    return pairs.join(own("first_id", "a"), "first_id").join(own("second_id", "b"), "second_id").withColumn("iou", iou("a", "b")).drop("a", "b")


def union_of_boxes(boxes: DataFrame, *by: str) -> DataFrame:
    x, y, w, h = map(F.col, BOX)
    return boxes.groupBy(*by).agg(F.min(x).alias("bbox_x"), F.min(y).alias("bbox_y"), (F.max(x + w) - F.min(x)).alias("bbox_width"), (F.max(y + h) - F.min(y)).alias("bbox_height"))


def scaled_union(boxes: DataFrame, across: float, down: float, *by: str) -> DataFrame:
    """The box around each group's boxes, scaled to another size of the page: places and lengths are cut to whole points, places
    are 0 at least and lengths 1."""
    whole = lambda c, scale, least: F.greatest(F.lit(least).cast("long"), (F.col(c).cast("double") * scale).cast("long")).alias(c)
    return union_of_boxes(boxes, *by).select(*by, whole("bbox_x", across, 0), whole("bbox_y", down, 0), whole("bbox_width", across, 1), whole("bbox_height", down, 1))


def grid_cells(boxes: DataFrame, width: int, height: int, columns: int, rows: int) -> DataFrame:
    """boxes plus cell: where the centre lies in an equal grid, row by row from 0."""
    x, y, w, h = map(F.col, BOX)
    place = lambda p, s, n, size: F.least(F.lit(n - 1), F.floor((p + s / 2) * n / size))
    return boxes.withColumn("cell", (place(y, h, rows, height) * columns + place(x, w, columns, width)).cast("int"))


def grid(spark, width: int, height: int, columns: int, rows: int, margin: int) -> DataFrame:
    """The cells of an equal grid, each less a margin on every side."""
    cells = spark.range(columns * rows).withColumnRenamed("id", "cell")
    w, h = width // columns, height // rows
    at = lambda n, size: n * size + margin
    return cells.select((F.col("cell") + 1).alias("cell"), at(F.col("cell") % columns, w).alias("bbox_x"), at(F.floor(F.col("cell") / columns), h).alias("bbox_y"), F.lit(w - 2 * margin).alias("bbox_width"), F.lit(h - 2 * margin).alias("bbox_height"))


def equal_grids(boxes: DataFrame, columns: int, rows: int, margin: int, *by: str) -> DataFrame:
    """(by, cell, BOX): the equal grid of each group's sheet, which reaches as far as its boxes do; cells count from 1."""
    sheets = boxes.where("bbox_x is not null").groupBy(*by).agg(F.max(F.expr("bbox_x + bbox_width")).alias("w"), F.max(F.expr("bbox_y + bbox_height")).alias("h"))
    sheets = sheets.select(*by, F.expr(f"w div {columns}").alias("w"), F.expr(f"h div {rows}").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(columns * rows - 1))).alias("k"))
    at = lambda place, size: (F.expr(place).cast("long") * F.col(size) + margin).cast("long")
    return sheets.select(*by, (F.col("k") + 1).alias("cell"), at(f"k % {columns}", "w").alias("bbox_x"), at(f"k div {columns}", "h").alias("bbox_y"), (F.col("w") - 2 * margin).alias("bbox_width"), (F.col("h") - 2 * margin).alias("bbox_height"))


def image_quality(sharpness: Column, brightness: Column, contrast: Column, complete: Column) -> Column:
    """A weighted score of four from 0 to 1; 0.7 is enough."""
    return sharpness * 0.3 + brightness * 0.2 + contrast * 0.2 + complete * 0.3


def _shared(a: Column, b: Column) -> Column:
    side = lambda p, s: F.greatest(F.lit(0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    return side("bbox_x", "bbox_width") * side("bbox_y", "bbox_height")


def held_part(a: Column, b: Column) -> Column:
    """The part of struct a that lies in struct b."""
    size = a["bbox_width"] * a["bbox_height"]
    return F.when(size > 0, _shared(a, b).cast("double") / size.cast("double")).otherwise(0.0)


def distinct_of(boxes: Column, least: float) -> Column:
    """Those of an array of boxes that overlap none kept before by more than `least`, in the array's order."""
    size = lambda x: x["bbox_width"] * x["bbox_height"]
    overlap = lambda a, b: _shared(a, b).cast("double") / (size(a) + size(b) - _shared(a, b)).cast("double")
    add = lambda kept, b: F.when(F.exists(kept, lambda k: overlap(k, b) > least), kept).otherwise(F.array_append(kept, b))
    return F.aggregate(boxes, F.slice(boxes, 1, 0), add)


def greedy_distinct(boxes: DataFrame, least: float, *by: str) -> DataFrame:
    """(by, id): boxes in order of their source's priority (column source, then id), each kept if it
    overlaps none kept before on its page by more than `least`. A page is a small group, and each choice depends on those
    before, so a page's boxes are one list, which is folded."""
    by = by or ("leaflet_id", "page_number")
    pages = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("source", "id", *BOX))).alias("boxes"))
    return pages.select(*by, F.explode(F.transform(distinct_of(F.col("boxes"), least), lambda b: b["id"])).alias("id"))


def centre_inside(a: str, b: str) -> Column:
    """The centre of box a lies in box b, its edges included."""
    mid = lambda p, s: F.col(f"{a}.{p}") + F.col(f"{a}.{s}") / 2
    inside = lambda p, s: mid(p, s).between(F.col(f"{b}.{p}"), F.col(f"{b}.{p}") + F.col(f"{b}.{s}"))
    return inside("bbox_x", "bbox_width") & inside("bbox_y", "bbox_height")


def containment(a: str, b: str) -> Column:
    """The part of box a that lies in box b."""
    return F.when(area(a) > 0, intersection(a, b).cast("double") / area(a).cast("double")).otherwise(0.0)


def padded_union(boxes: DataFrame, padding: int, width: int, height: int, *by: str) -> DataFrame:
    """The box around each group's boxes, wider by a padding within the page, 50 points at least."""
    around = union_of_boxes(boxes, *by)
    x, y, w, h = map(F.col, BOX)
    left, top = F.greatest(F.lit(0), x - padding), F.greatest(F.lit(0), y - padding)
    right, low = F.least(F.lit(width), x + w + padding), F.least(F.lit(height), y + h + padding)
    return around.select(*by, left.alias("bbox_x"), top.alias("bbox_y"), F.greatest(right - left, F.lit(50)).alias("bbox_width"), F.greatest(low - top, F.lit(50)).alias("bbox_height"))


def fixed_box(width: int, height: int) -> list[Column]:
    """The box moved on to the page, widened to a card's least size, and cut to the page, in this order; null without one."""
    x, y, w, h = map(F.col, BOX)
    place = lambda p, size: F.when(p < 0, 0).when(p >= size, size - 100).otherwise(p)
    x, y = place(x, width), place(y, height)
    side = lambda p, s, size, least: F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(max(least, size // 10))), F.lit(size) - p))
    return [x.alias("bbox_x"), y.alias("bbox_y"), side(x, w, width, 150).alias("bbox_width"), side(y, h, height, 200).alias("bbox_height")]


def even_cells(boxes: DataFrame, *by: str, most: float = 2.5) -> DataFrame:
    """For each group whether its boxes' widths and heights differ by a factor of `most` at the most."""
    ratio = lambda c: F.max(c).cast("double") / F.greatest(F.min(c), F.lit(1)).cast("double")
    return boxes.groupBy(*by).agg(((ratio("bbox_width") <= most) & (ratio("bbox_height") <= most)).alias("even"))


def _gaps(edges: Column, least: int) -> Column:
    """The gaps over `least` between neighbours of a sorted array, each with where it begins and ends."""
    n = F.size(edges)
    pairs = F.zip_with(F.slice(edges, F.lit(1), n - 1), F.slice(edges, F.lit(2), n - 1), lambda a, b: F.struct((a - b).alias("cost"), a.alias("at"), b.alias("next")))
    return F.filter(pairs, lambda g: -g["cost"] > least)


def _between(gaps: Column, size: int, least: int, padding: int = 0) -> Column:
    """What lies between gaps that are in order, over `least` wide, the padding taken from the gaps; the whole size without any."""
    whole, long = F.lit(size).cast("long"), lambda x: x.cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(gaps, lambda g: long(g["next"] - padding)))
    stops = F.concat(F.transform(gaps, lambda g: F.struct(long(g["at"]).alias("at"), F.lit(padding).alias("pad"))), F.array(F.struct(whole.alias("at"), F.lit(0).alias("pad"))))
    wide = F.filter(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop"))), lambda r: r["stop"]["at"] - r["start"] > least)
    made = F.transform(wide, lambda r: F.struct(r["start"].alias("start"), (r["stop"]["at"] + r["stop"]["pad"]).alias("stop")))
    return F.when(F.size(made) > 0, made).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("start"), whole.alias("stop"))))


# Least gaps, least sizes of a product, the padding, how many gaps bound columns, a column's usual width.
COLUMN_GAP, ROW_GAP, LEAST_WIDTH, LEAST_HEIGHT, PADDING, MOST_GAPS, USUAL_WIDTH = 30, 40, 120, 150, 10, 5, 400


def layout(boxes: DataFrame, width: int, height: int, *by: str) -> DataFrame:
    """(by, columns, rows) of each group of boxes: arrays of (start, stop).

    Columns lie between the five largest gaps over COLUMN_GAP of the sorted left and right edges; with fewer than two such gaps
    the width is cut evenly, into a part for each USUAL_WIDTH, from two to six. Rows lie between all gaps over ROW_GAP, each
    wider by PADDING towards the gap, and are the whole height without any. What is not over LEAST_WIDTH or LEAST_HEIGHT goes.
    A group is a sheet with a few boxes, so that its edges are one array; null boxes have no edges.
    """
    edges = lambda p, s: F.array_sort(F.flatten(F.collect_list(F.array(F.col(p), F.col(p) + F.col(s)))))
    sheets = boxes.where("bbox_x is not null").groupBy(*by).agg(edges("bbox_x", "bbox_width").alias("across"), edges("bbox_y", "bbox_height").alias("down"))
    gaps = _gaps(F.col("across"), COLUMN_GAP)
    largest = F.array_sort(F.slice(F.array_sort(gaps), 1, MOST_GAPS), lambda a, b: F.when(a["at"] < b["at"], -1).otherwise(1))
    n = max(2, min(6, width // USUAL_WIDTH))
    even = F.array(*[F.struct(F.lit(int(i * width / n)).cast("long").alias("start"), F.lit(int((i + 1) * width / n)).cast("long").alias("stop")) for i in range(n)])
    columns = F.when(F.size(gaps) < 2, even).otherwise(_between(largest, width, LEAST_WIDTH))
    return sheets.select(*by, columns.alias("columns"), _between(_gaps(F.col("down"), ROW_GAP), height, LEAST_HEIGHT, PADDING).alias("rows"))


def boxes_for_missing(products: DataFrame, width: int, height: int) -> DataFrame:
    """products without a box get a cell of an equal grid by their place on the page. It has as many columns as the centres
    of the page's boxes take tenths of its width, or without any box about the root of 1.2 a product, from 2 to 4."""
    page = Window.partitionBy("leaflet_id", "page_number").orderBy("id")
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tenth = F.floor(F.floor(F.col("bbox_x") + F.col("bbox_width") / 2) / max(1, width // 10))
    # one order of the page's products serves their places and what is counted over all of them
    counts = F.size(F.collect_set(tenth).over(whole)).cast("long").alias("tenths"), F.count("*").over(whole).alias("n")
    placed = products.select("id", "bbox_x", (F.row_number().over(page) - 1).alias("place"), *counts).where("bbox_x is null")
    columns = F.when(F.col("tenths") > 0, F.col("tenths")).otherwise(F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.sqrt(F.col("n") * F.lit(1.2).cast("double"))))))
    made = placed.withColumn("columns", columns).withColumn("rows", F.greatest(F.lit(2), F.ceil(F.col("n") / F.col("columns"))))
    w, h = F.floor(F.lit(width) / F.col("columns")), F.floor(F.lit(height) / F.col("rows"))
    return made.select("id", ((F.col("place") % F.col("columns")) * w + 20).alias("bbox_x"), (F.floor(F.col("place") / F.col("columns")) * h + 20).alias("bbox_y"), (w - 40).alias("bbox_width"), (h - 40).alias("bbox_height"))


def similar_texts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs plus similarity: matching blocks of characters, longest first, as a share of both texts."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("similarity", ratio(a, b))


def cells_by_ranges(boxes: DataFrame, sheets: DataFrame, *by: str) -> DataFrame:
    """boxes plus column and row, and the sheet's columns and rows: the place, from 0, of the first range that holds the box's
    centre, its end excluded; 0 where none does."""
    x, y, w, h = map(F.col, BOX)
    holds = lambda middle: lambda r: (r["start"] <= middle) & (middle < r["stop"])
    place = lambda ranges, middle: F.coalesce(F.greatest(F.lit(0), F.array_position(F.transform(ranges, holds(middle)), True) - 1), F.lit(0)).cast("int")
    return boxes.join(sheets, list(by), "left").withColumns({"column": place("columns", x + w / 2), "row": place("rows", y + h / 2)})


def best_region(texts: DataFrame, regions: DataFrame, *by: str, least: float = 0.1) -> DataFrame:
    """texts (id, boxes) plus region: the one of the same group that shares the largest part of the text's box, the smaller
    number among equals; null if none shares more than `least`."""
    own = regions.select(*by, "region", F.struct(*BOX).alias("_b"))
    pairs = texts.select(*by, "id", F.struct(*BOX).alias("_a")).join(own, list(by)).withColumn("part", containment("_a", "_b")).where(F.col("part") > least)
    best = pairs.groupBy("id").agg(F.max_by("region", F.struct("part", -F.col("region"))).alias("region"))
    return texts.join(best, "id", "left")


def hinted_box(hint: Column, index: Column, total: Column, width: int, height: int, least: int = 100) -> list[Column]:
    """The box of a cell that words like "top left" or "second row" name, in a grid of three columns and three rows or more;
    without a hint, the cell of the product's place on the page. Without any word the hint names the first cell."""
    has = lambda word: F.contains(F.lower(hint), F.lit(word))
    rows = F.greatest(F.lit(3), F.ceil(total / 3))
    nth = F.when(has("second"), 1).when(has("third"), 2)
    column = F.when(~has("row"), nth)
    column = F.coalesce(column, F.when(has("left"), 0).when(has("center") | has("middle"), 1).when(has("right"), 2), F.lit(0))
    row = F.coalesce(F.when(has("row"), nth), F.when(has("top"), 0).when(has("bottom"), rows - 1).when(has("middle"), F.floor(rows / 2)), F.lit(0))
    unnamed = hint.isNull() | (hint == "")
    column, row = F.when(unnamed, index % 3).otherwise(column), F.when(unnamed, F.floor(index / 3)).otherwise(row)
    wide, high = F.lit(width // 3), F.floor(F.lit(height) / rows)
    made = column * wide + 20, row * high + 20, F.greatest(F.lit(least), wide - 40), F.greatest(F.lit(least), high - 40)
    return [c.cast("long").alias(n) for c, n in zip(made, BOX, strict=True)]
