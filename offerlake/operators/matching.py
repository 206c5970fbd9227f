"""Products matched to the regions of their page, each region to one product: by text, then by place.

A page is a sheet of paper, so its products and regions are few. Pairs by text are made where both sides meet by page, are scored
and thinned out in the same task, and only what passes is gathered to a page's list, which is folded in the products' order. For
places, a page's boxes are one row, and the pages of an Arrow batch take turns side by side; no pairs are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import BOX

# What each sign of a match is worth, and the least sum that counts.
CODE, PRICE, TEXT, QUANTITY, LEAST_TEXT = 0.6, 0.4, 0.8, 0.1, 0.35
CENTRE, LEAST_PLACE, MOST_PLACE, BY_ORDER = 0.3, 0.05, 0.85, 0.5
#: Reading order: rows are this part of the mean distance of the regions' tops apart, and ROW_LEAST at least.
ROW_PART, ROW_LEAST, ROW_ALONE = 0.4, 50, 300
#: What of a product is looked for in a text.
READ = ("product_name", "brand", "product_code", "regular_price", "discounted_price", "quantity", "units")


def exclusive_picks(candidates: DataFrame, *by: str) -> DataFrame:
    """(by, picks) of candidates (by, turn, region, score): an array of (turn, region, score) where, in order of turn, each takes the
    region of its highest score that none before it took, the first region among equals. Each turn has one region at most, and
    each region one turn."""
    wish = F.struct("turn", (-F.col("score")).alias("cost"), "region")
    pages = candidates.groupBy(*by).agg(F.array_sort(F.collect_list(wish)).alias("wishes"))
    closed = lambda picks, w: F.exists(picks, lambda p: (p["turn"] == w["turn"]) | (p["region"] == w["region"]))
    picks = F.aggregate("wishes", F.slice("wishes", 1, 0), lambda picks, w: F.when(closed(picks, w), picks).otherwise(F.array_append(picks, w)))
    return pages.select(*by, F.transform(picks, lambda p: F.struct(p["turn"].alias("turn"), p["region"].alias("region"), (-p["cost"]).alias("score"))).alias("picks"))


def _words(text: Column, longer: int) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > longer)


def price_texts(price: Column) -> list[Column]:
    """How a price can stand in a text: as it is, with a comma, without a point, with two digits."""
    plain, fixed = price.cast("string"), F.format_string("%.2f", price)
    swap = lambda t, to: F.replace(t, F.lit("."), F.lit(to))
    return [plain, swap(plain, ","), swap(plain, ""), fixed, swap(fixed, ",")]


def signs(products: DataFrame) -> list[Column]:
    """What is looked for in texts, for products with the columns READ; made once for each product and not for each pair."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    code, name = low("product_code"), low("product_name")
    price = F.coalesce(F.nullif(F.col("discounted_price"), F.lit(0.0)), F.nullif(F.col("regular_price"), F.lit(0.0)))
    amount, unit = F.col("quantity").cast("string"), low("units")
    sized = (F.col("quantity") != 0) & (unit != "")
    return [
        F.when(F.length(code) >= 3, _bare(code)).alias("code"), F.when(price.isNotNull(), F.array(*price_texts(price))).alias("prices"),
        F.array_distinct(_words(F.trim(F.concat(low("brand"), F.lit(" "), name)), 2)).alias("words"), F.when(F.length(name) > 3, _words(name, 3)).alias("parts"),
        F.when(sized, F.array(F.concat(amount, unit), F.concat(amount, F.lit(" "), unit))).alias("sizes"),
    ]


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s\-]", "")


def text_score() -> Column:
    """What a region's text (region_text, and what is made of it) says for a product with signs."""
    has = lambda t: F.contains(F.col("region_text"), t)
    points = lambda worth, holds: F.when(holds, F.lit(worth)).otherwise(F.lit(0.0))
    either = lambda array, n: F.coalesce(*[F.nullif(has(F.get(array, F.lit(i))), F.lit(False)) for i in range(n)], F.lit(False))
    shared = F.size(F.array_intersect("words", "region_words")) / F.greatest(F.size("words"), F.lit(1))
    found = F.when(F.col("parts").isNotNull(), F.size(F.filter("parts", has)) / F.greatest(F.size("parts"), F.lit(1))).otherwise(F.lit(0.0))
    return points(CODE, F.contains("region_bare", "code")) + points(PRICE, either("prices", 5)) + F.greatest(shared, found) * TEXT + points(QUANTITY, either("sizes", 2))


def _text_picks(products: DataFrame, regions: DataFrame, order: tuple[str, ...], *by: str) -> DataFrame:
    text = F.col("region_text")
    texts = regions.select(*by, "region", F.lower(F.coalesce("text", F.lit(""))).alias("region_text")).where("trim(region_text) <> ''").select("*", _bare(text).alias("region_bare"), _words(text, 2).alias("region_words"))
    read = products.select(*by, F.struct(*order).alias("turn"), *signs(products))
    pairs = read.join(texts, list(by)).select(*by, "turn", "region", text_score().alias("score"))
    return exclusive_picks(pairs.where(F.col("score") >= LEAST_TEXT), *by)


def by_text(products: DataFrame, regions: DataFrame, *by: str, order: tuple[str, ...] = ("page_number", "id")) -> DataFrame:
    """(by, turn, region, score) of products whose text points are LEAST_TEXT or more; turn is a struct of the order's columns.

    regions have by, region (their order), text. Null texts are empty. Pages without products or regions have no row.
    """
    return _text_picks(products, regions, order, *by).select(*by, F.inline("picks"))


def _boxes(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sheets, sides of BOX as doubles, NaN for null) of the entries of all lists."""
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy()), [flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in BOX]


def _numbered(sheets: np.ndarray, keys: list[pa.Array]) -> np.ndarray:
    """Numbers from 0 over all entries, the same for neighbours on one sheet that have the same keys."""
    same = sheets[1:] == sheets[:-1]
    for k in keys:
        same &= pc.fill_null(pc.equal(k[1:], k[:-1]), False).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(~same)]) if len(sheets) else np.zeros(0, np.int64)


def _within_sheets(sheets: np.ndarray) -> np.ndarray:
    """Places from 0 on each sheet, of entries in order of sheets."""
    return np.arange(len(sheets)) - np.searchsorted(sheets, sheets)


def _place_scores(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Overlap, plus CENTRE where the centre of a lies in b; NaN or 0 without a place."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    shared = np.maximum(0, np.minimum(ax + aw, bx + bw) - np.maximum(ax, bx)) * np.maximum(0, np.minimum(ay + ah, by + bh) - np.maximum(ay, by))
    with np.errstate(divide="ignore", invalid="ignore"):
        iou = np.where(shared == 0, 0.0, shared / (aw * ah + bw * bh - shared))
    x, y = ax + aw / 2, ay + ah / 2
    return iou + np.where((x >= bx) & (x <= bx + bw) & (y >= by) & (y <= by + bh), CENTRE, 0.0)


def _reading_order(sheets: np.ndarray, boxes: list[np.ndarray], n: int) -> np.ndarray:
    """Entries of n sheets in order of their rows' tops, then from left to right; see by_place."""
    x, top = boxes[0], boxes[1]
    known = ~np.isnan(top)
    low, high, tops = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n)
    np.minimum.at(low, sheets[known], top[known])
    np.maximum.at(high, sheets[known], top[known])
    np.add.at(tops, np.unique(np.stack([sheets[known], top[known]]), axis=1)[0].astype(int), 1)
    apart = np.where(tops > 0, high - low, 0.0) / np.maximum(1, tops - 1) * ROW_PART
    gap = np.where(np.bincount(sheets, minlength=n) > 1, np.maximum(float(ROW_LEAST), apart), float(ROW_ALONE))
    first = lambda v: np.where(np.isnan(v), -np.inf, v)
    return np.lexsort((first(x), first(np.floor(top / gap[sheets])), sheets))


def _each_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Picks of each sheet beside what else the batch has of it; its last columns are turns and regions, in their orders."""
    for batch in batches:
        n, turns, regions = len(batch), batch.column("turns"), batch.column("regions")
        (ts, tbox), (rs, rbox) = _boxes(turns), _boxes(regions)
        turn, region = turns.flatten().field("turn"), regions.flatten().field("region")
        tno, rno = _numbered(ts, [turn.field(i) for i in range(turn.type.num_fields)]), _numbered(rs, [region])
        nth = tno - tno[np.searchsorted(ts, ts)] if len(ts) else tno  # the turn on its sheet
        starts, counts = np.searchsorted(rs, np.arange(n)), np.bincount(rs, minlength=n)
        taken, served = np.zeros(len(rs), bool), np.zeros(len(ts), bool)  # by number of region, of turn
        order = np.argsort(nth, kind="stable")
        picks = []
        for rows in np.split(order, np.flatnonzero(np.diff(nth[order])) + 1):
            rows = rows[~np.isnan(tbox[0][rows])]
            each = counts[ts[rows]]
            left = np.repeat(rows, each)
            right = np.repeat(starts[ts[rows]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            score = _place_scores([c[left] for c in tbox], [c[right] for c in rbox])
            ok = np.flatnonzero((score > LEAST_PLACE) & ~taken[rno[right]])
            ok = ok[np.lexsort((right[ok], -score[ok], ts[left[ok]]))]
            sheet = ts[left[ok]]
            ok = ok[np.concatenate([[True], sheet[1:] != sheet[:-1]])] if len(ok) else ok
            taken[rno[right[ok]]] = served[tno[left[ok]]] = True
            picks.append((left[ok], right[ok], np.minimum(score[ok], MOST_PLACE), np.full(len(ok), False)))
        still, free = np.flatnonzero(~served[tno]), _reading_order(rs, rbox, n)
        free = free[~taken[rno[free]]]
        first, many, k = np.searchsorted(rs[free], np.arange(n)), np.bincount(rs[free], minlength=n), _within_sheets(ts[still])
        fits = k < many[ts[still]]
        picks.append((still[fits], free[first[ts[still[fits]]] + k[fits]], np.full(fits.sum(), BY_ORDER), np.full(fits.sum(), True)))
        left, right, score, later = map(np.concatenate, zip(*picks))
        at = np.argsort(ts[left], kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(ts[left], minlength=n))]).astype(np.int32)
        made = [turn.take(pa.array(left[at])), region.take(pa.array(right[at])), pa.array(score[at]), pa.array(later[at])]
        made = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(made, ["turn", "region", "score", "later"]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], made], [*batch.schema.names[:-2], "picks"])


def _turns(products: DataFrame, order: tuple[str, ...], *by: str) -> DataFrame:
    return products.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("turn"), *BOX))).alias("turns"))


def _places(sheets: DataFrame, *keep: str) -> DataFrame:
    """(keep, picks) of sheets with turns and regions: picks are (turn, region, score, source)."""
    rows = sheets.select(*keep, "turns", "regions")
    kind = lambda c, f: rows.schema[c].dataType.elementType[f].dataType.simpleString()
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + f", picks array<struct<turn:{kind('turns', 'turn')},region:{kind('regions', 'region')},score:double,later:boolean>>"
    source = lambda p: F.when(p["later"], "visual_position_match").otherwise("visual_iou_match")
    named = F.transform("picks", lambda p: F.struct(p["turn"].alias("turn"), p["region"].alias("region"), p["score"].alias("score"), source(p).alias("source")))
    return rows.mapInArrow(_each_place, schema).select(*keep, named.alias("picks"))


def by_place(products: DataFrame, regions: DataFrame, *by: str, order: tuple[str, ...] = ("page_number", "id")) -> DataFrame:
    """(by, turn, region, score, source) of products and regions with boxes, in two passes: overlap plus CENTRE where the
    product's centre lies in the region, over LEAST_PLACE, in the products' order; then those that are left, of both, one by one,
    the regions in reading order. Products without a box take part in the second pass only."""
    boxes = regions.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("region", *BOX))).alias("regions"))
    return _places(_turns(products, order, *by).join(boxes, list(by)), *by).select(*by, F.inline("picks"))


def match_regions(products: DataFrame, regions: DataFrame, *by: str, order: tuple[str, ...] = ("page_number", "id")) -> DataFrame:
    """products (order's columns and by) with region, score and source: by text where a page's regions have any, then by place
    among what text left over. Products that stay without a region are no_match on pages without text, vlm_estimated on those
    with text, and null on pages without regions."""
    told = _text_picks(products, regions, order, *by).withColumnRenamed("picks", "told")
    boxes = regions.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("region", *BOX))).alias("regions"), F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "").alias("has_text"))
    sheets = _turns(products, order, *by).join(boxes, list(by), "left").join(told, list(by), "left")
    rest = lambda c, k: F.filter(c, lambda e: ~F.coalesce(F.exists("told", lambda p: p[k] == e[k]), F.lit(False)))
    sheets = sheets.withColumns({"all": F.transform("turns", lambda e: e["turn"]), "turns": rest("turns", "turn"), "regions": rest("regions", "region")})
    placed = _places(sheets, *by, "all", "told", "has_text")
    heard = F.transform("told", lambda p: F.struct(p["turn"].alias("turn"), p["region"].alias("region"), p["score"].alias("score"), F.lit("ocr_text_match").alias("source")))
    found = placed.withColumn("found", F.when(F.col("told").isNull(), F.col("picks")).otherwise(F.concat(heard, "picks")))
    own = found.select(*by, F.explode("all").alias("turn"), "found", "has_text").select(*by, "turn", "has_text", F.explode_outer(F.filter("found", lambda p: p["turn"] == F.col("turn"))).alias("p"))
    none = F.when(F.col("has_text"), "vlm_estimated").when(F.col("has_text").isNotNull(), "no_match")
    return own.select(*by, "turn.*", "p.region", "p.score", F.coalesce("p.source", none).alias("source"))
