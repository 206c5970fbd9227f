"""Cleaning and merging of a document's extracted products. Input order is (page_number, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compared_name, key_words, spaced

# Words without weight in a name, and beginnings of section headers.
LIGHT_WORDS = ("the", "a", "an", "and", "or", "for", "with")
HEADER_STARTS = ("vsi izdelki", "vse ", "vsi ", "izbrani izdelki", "all products", "selected products", "svi proizvodi", "svi artikli", "izabrani proizvodi")


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if one holds the other, else shared words over all words plus 0.1 for each that has weight."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    p, q = (F.array_distinct(F.split(spaced(n), " ")) for n in (x, y))
    both = F.array_intersect(p, q)
    weighty = F.size(F.array_except(both, F.array(*map(F.lit, LIGHT_WORDS))))
    overlap = F.least(F.lit(1.0), F.size(both) / F.size(F.array_union(p, q)) + weighty * 0.1)
    score = F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.9).otherwise(overlap)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(score)


def flag_list(flags: Column) -> Column:
    """Flags as an array, from an array or from a text with commas."""
    return F.array_remove(F.split(F.coalesce(flags, F.lit("")), ","), "")


def falsy(column: str) -> Column:
    """A value, with 0 and the empty text as missing."""
    return F.nullif(F.col(column), F.lit("")) if column in TEXTS else F.nullif(F.col(column), F.lit(0))


TEXTS = ("brand", "product_code", "product_name", "category", "currency", "units")
NUMBERS = ("regular_price", "discounted_price", "discount_percentage", "quantity")
SPLIT_FLAGS = ("partial_product", "continues_on_next_page", "continued_from_previous")
MERGE_POINTS = 75


def _ends_low(page_height: int) -> Column:
    return F.col("bbox_y") + F.col("bbox_height") > page_height - page_height * 0.1


def _begins_high(page_height: int) -> Column:
    return F.col("bbox_y") < page_height * 0.1


def _split_pairs(products: DataFrame, page_height: int, least: int) -> DataFrame:
    """(leaflet_id, a, b, points): the pairs of split_candidates, with both products as structs."""
    # a page is a row with what may be parts at its two ends, beside the next page's: products are read once and move by document alone
    own, page = F.struct(*products.columns), F.col("page_number")
    ends = {"lows": page.isNotNull() & _ends_low(page_height), "highs": _begins_high(page_height)}
    pages = products.groupBy("leaflet_id", "page_number").agg(*[F.collect_list(F.when(c, own)).alias(n) for n, c in ends.items()])
    after = F.lead("highs").over(Window.partitionBy("leaflet_id").orderBy("page_number"))
    pages = pages.select("leaflet_id", "lows", after.alias("highs")).where((F.size("lows") > 0) & (F.size("highs") > 0))
    pairs = pages.select("leaflet_id", "highs", F.explode("lows").alias("a")).select("leaflet_id", "a", F.explode("highs").alias("b"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    flagged = lambda side, flag: F.array_contains(flag_list(side("flags")), flag)
    brand = lambda side: F.nullif(F.lower(F.trim(side("brand"))), F.lit(""))
    points = (
        F.when(name_similarity(a("product_name"), b("product_name")) > 0.7, 30).otherwise(0) + F.when(a("discounted_price").isNull() != b("discounted_price").isNull(), 20).otherwise(0)
        + F.when(brand(a) == brand(b), 15).when(brand(a).isNull() != brand(b).isNull(), 10).otherwise(0) + F.when(F.abs(a("bbox_x") - b("bbox_x")) < 50, 15).otherwise(0)
        + F.when(flagged(a, "partial_product") | flagged(b, "partial_product"), 20).otherwise(0)
        + F.when(flagged(a, "continues_on_next_page"), 25).otherwise(0) + F.when(flagged(b, "continued_from_previous"), 25).otherwise(0)
    )
    return pairs.select("leaflet_id", "a", "b", F.least(F.lit(100), points).alias("points")).where(F.col("points") > least)


def split_candidates(products: DataFrame, page_height: int, least: int = 50) -> DataFrame:
    """Pairs (first, second, points of 100) of a product that ends in the lowest tenth of a page and one that begins in
    the highest of the document's next page, whatever its number; products without a box are in none. Pages meet their
    next page alone, so that never all pairs of a document are made."""
    columns = ["leaflet_id", "page_number", "id", "product_name", "brand", "discounted_price", "bbox_x", "bbox_y", "bbox_height", "flags"]
    return _split_pairs(products.select(*columns), page_height, least).select("a.leaflet_id", "a.page_number", F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"), "points")


def merged(products: DataFrame, pairs: DataFrame) -> DataFrame:
    """One product for each pair (first_id, second_id): the first's values where it has any (0 and empty texts are none),
    boxes joined with heights added (the one there is, if a part has none), the mean of both confidences, each field's higher one (0
    is none), flags of both but those of splitting."""
    a, b = (products.select(F.col("id").alias(f"{n}_id"), F.struct(*products.columns).alias(s)) for n, s in (("first", "a"), ("second", "b")))
    return _merged(pairs.join(a, "first_id").join(b, "second_id").select("a", "b"), products.columns)


def split_merged(products: DataFrame, page_height: int) -> DataFrame:
    """merged() of the split_candidates of MERGE_POINTS or more. Products of one id are of one document, so that products are looked
    up among those of the few documents that have pairs."""
    pairs = _split_pairs(products, page_height, MERGE_POINTS - 1).groupBy("leaflet_id").agg(F.collect_list(F.struct(F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"))).alias("pairs"))
    sheets = products.join(pairs.hint("shuffle_hash"), "leaflet_id").groupBy("leaflet_id").agg(F.first("pairs").alias("pairs"), F.collect_list(F.struct(*products.columns)).alias("all"))
    with_id = lambda c: F.explode(F.filter("all", lambda p: p["id"] == F.col(f"pair.{c}")))
    both = sheets.select("all", F.explode("pairs").alias("pair")).select("all", "pair", with_id("first_id").alias("a")).select("a", with_id("second_id").alias("b"))
    return _merged(both, products.columns)


def _merged(both: DataFrame, columns: list[str]) -> DataFrame:
    """merged() of pairs of products as structs a and b of the columns named."""
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    empty = lambda c: F.lit("" if c in TEXTS else 0)
    either = {c: F.coalesce(F.nullif(x(c), empty(c)), y(c)) for c in (*TEXTS, *NUMBERS)}
    named, next_ = x("product_name"), y("product_name")
    goes_on = (next_ != "") & (next_ != named) & ~F.lower(next_).startswith(F.substring(F.lower(named), 1, 10))
    either["product_name"] = F.when(goes_on, F.trim(F.concat(named, F.lit(" "), next_))).otherwise(named)
    one, two = F.nullif(x("confidence"), F.lit(0)).cast("double"), F.nullif(y("confidence"), F.lit(0)).cast("double")
    right = F.greatest(x("bbox_x") + x("bbox_width"), y("bbox_x") + y("bbox_width"))
    left = F.least(x("bbox_x"), y("bbox_x"))
    higher = lambda c: F.nullif(F.greatest(F.coalesce(x(c), F.lit(0)), F.coalesce(y(c), F.lit(0))), F.lit(0))
    fields = {c: higher(c) for c in columns if c.endswith("_confidence") and c != "category_confidence"}
    box = lambda joined, c: F.when(x("bbox_x").isNull() | y("bbox_x").isNull(), F.coalesce(x(c), y(c))).otherwise(joined).alias(c)
    flags = F.array_except(F.array_union(flag_list(x("flags")), flag_list(y("flags"))), F.array(*map(F.lit, SPLIT_FLAGS)))
    made = either | fields | {
        "id": F.concat(x("id"), F.lit("+"), y("id")), "confidence": F.coalesce((one + two) / 2, one, two), "category_confidence": F.greatest(x("category_confidence"), y("category_confidence")),
        "bbox_x": box(left, "bbox_x"), "bbox_y": box(x("bbox_y"), "bbox_y"), "bbox_width": box(right - left, "bbox_width"), "bbox_height": box(x("bbox_height") + y("bbox_height"), "bbox_height"), "flags": F.array_join(F.array_sort(F.array_append(flags, "merged_from_split")), ","),
    }
    made |= {c: F.col(c) for c in both.columns if c in columns}  # what both have in common, by which they may lie
    return both.select(*[(made[c] if c in made else x(c)).alias(c) for c in columns])


def reconciled(products: DataFrame, page_height: int, dealt: bool = False) -> DataFrame:
    """Splits merged and put after the rest (a product may be part of several), then the best on each page, the first
    in each cell, and the clean-up, in this order. With a part go all products of its page that are equal to it in everything but
    their id. Ties follow page and id, merged products last. dealt: products lie by document already, and do not move again."""
    own = products.withColumn("confidence", F.col("confidence").cast("double"))
    pairs = _split_pairs(own, page_height, MERGE_POINTS - 1)
    rest = [c for c in own.columns if c != "id"]
    value = lambda p=None: F.struct(*[F.col(c if p is None else f"{p}.{c}").alias(c) for c in rest])
    # by document, as products lie: what goes is few beside them, and is looked up as they come
    gone = pairs.groupBy("leaflet_id").agg(F.flatten(F.collect_list(F.array(value("a"), value("b")))).alias("_gone"))
    stays = ~F.coalesce(F.array_contains("_gone", value()), F.lit(False))
    near = own.join(gone.hint("shuffle_hash"), "leaflet_id", "left").where(stays)
    late = lambda df, k: df.select(*own.columns, F.lit(k).alias("_late"))
    every = late(near, 0).unionByName(late(_merged(pairs, own.columns), 1))
    # by document, in which both choices below find what they compare: products move once for both
    every = every if dealt else every.repartition("leaflet_id")
    order = ("_late", "page_number", "id")
    return sanitized(first_in_cell(best_on_page(every, *order), *order)).drop("_late")


def offer_price() -> Column:
    return F.coalesce(falsy("discounted_price"), falsy("regular_price"), F.lit(0.0))


def best_on_page(products: DataFrame, *order: str) -> DataFrame:
    """Of equal names and prices on a page the most confident stays, a code counting as 1 more; the first of equals."""
    coded = F.when(falsy("product_code").isNotNull(), 1).otherwise(0) if "product_code" in products.columns else F.lit(0)
    same = Window.partitionBy("leaflet_id", "page_number", spaced(F.lower("product_name")), offer_price()).orderBy((F.col("confidence").cast("double") + coded).desc(), *(order or ("id",)))
    return products.withColumn("_rank", F.row_number().over(same)).where("_rank = 1").drop("_rank")


def first_in_cell(products: DataFrame, *order: str) -> DataFrame:
    """The first of equal names (50 characters) and prices in a cell of 50 by 50 points; without a box, on a page."""
    boxless = F.when(F.col("bbox_x").isNull(), F.col("page_number"))
    same = Window.partitionBy("leaflet_id", F.substring(F.trim(F.lower("product_name")), 1, 50), offer_price(), F.floor(F.col("bbox_x") / 50), F.floor(F.col("bbox_y") / 50), boxless).orderBy(*(order or ("page_number", "id")))
    return products.withColumn("_rank", F.row_number().over(same)).where("_rank = 1").drop("_rank")


def sanitized(products: DataFrame) -> DataFrame:
    """Five steps in order: a lone reduced price is the regular one; a missing regular price follows from the discount;
    so does one that equals the reduced; a discount more than 5 off its prices is recomputed; headers go."""
    regular, reduced, off = F.col("regular_price"), F.col("discounted_price"), F.col("discount_percentage")
    lone = regular.isNull() & reduced.isNotNull() & F.coalesce(off == 0, F.lit(True))
    out = products.withColumn("_lone", lone).withColumn("regular_price", F.when(F.col("_lone"), reduced).otherwise(regular))
    out = out.withColumn("discounted_price", F.when(F.col("_lone"), None).otherwise(reduced)).drop("_lone")
    before = F.bround(reduced / (1 - off / 100), 2)
    inside = (off > 0) & (off < 100)
    out = out.withColumn("regular_price", F.when(regular.isNull() & reduced.isNotNull() & inside, before).otherwise(regular))
    equal = F.coalesce((regular == reduced) & (off > 0), F.lit(False))
    out = out.withColumn("_clear", equal & (off >= 100)).withColumn("regular_price", F.when(equal & (off < 100), before).otherwise(regular))
    out = out.withColumn("discounted_price", F.when(F.col("_clear"), None).otherwise(reduced)).withColumn("discount_percentage", F.when(F.col("_clear"), None).otherwise(off)).drop("_clear")
    real = (regular - reduced) / regular * 100
    out = out.withColumn("discount_percentage", F.when((regular > 0) & (regular > reduced) & (F.abs(off - real) > 5), real).otherwise(off))
    name = F.trim("product_name")
    header = ((name == F.upper(name)) & (F.length(name) > 5)) | F.lower(name).rlike("^(" + "|".join(HEADER_STARTS) + ")")
    return out.where(~(regular.isNull() & reduced.isNull() & header))


def new_only(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """fresh without what existing has in the same document: by equal or equally normalised names, half of the fewer key
    words shared, or the same first word and a price within a tenth."""
    price = F.coalesce(F.nullif("discounted_price", F.lit(0.0)), "regular_price", F.lit(0.0))
    made = lambda df: df.withColumn("_name", F.lower("product_name")).withColumn("_norm", compared_name(F.col("product_name"), F.col("brand"))).withColumn("_words", key_words(F.col("_norm"))).withColumn("_price", price)
    a, b = made(fresh).alias("a"), made(existing).select("leaflet_id", "_name", "_norm", "_words", "_price").alias("b")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    shared, fewer = F.size(F.array_intersect(x("_words"), y("_words"))), F.least(F.size(x("_words")), F.size(y("_words")))
    first = lambda c: F.element_at(F.split(c, " "), 1)
    near = (F.abs(x("_price") - y("_price")) < 0.1 * F.greatest(x("_price"), y("_price"))) & (x("_price") > 0) & (y("_price") > 0)
    same = (x("_name") == y("_name")) | ((x("_norm") == y("_norm")) & (x("_norm") != "")) | ((fewer > 0) & (shared >= 0.5 * fewer)) | ((first(x("_norm")) == first(y("_norm"))) & (F.length(first(x("_norm"))) > 3) & near)
    return a.join(b, (x("leaflet_id") == y("leaflet_id")) & same, "left_anti").drop("_name", "_norm", "_words", "_price")


def later_repeats(products: DataFrame) -> DataFrame:
    """(id, first_id): products whose name (50 characters) and reduced price an earlier one of the document has."""
    same = Window.partitionBy("leaflet_id", F.substring(F.trim(F.lower("product_name")), 1, 50), "discounted_price").orderBy("page_number", "id")
    return products.select("id", F.first("id").over(same).alias("first_id"), F.row_number().over(same).alias("_nth")).where("_nth > 1").drop("_nth")


def overlapping(products: DataFrame, order: str = "id") -> DataFrame:
    """Pairs of products of a page whose boxes meet; touching counts. Joined by page, then by inequality."""
    own = products.select("leaflet_id", "page_number", order, "bbox_x", "bbox_y", "bbox_width", "bbox_height")
    a, b = own.alias("a"), own.alias("b")
    meets = lambda p, s: (F.col(f"a.{p}") <= F.col(f"b.{p}") + F.col(f"b.{s}")) & (F.col(f"b.{p}") <= F.col(f"a.{p}") + F.col(f"a.{s}"))
    on = (F.col("a.leaflet_id") == F.col("b.leaflet_id")) & (F.col("a.page_number") == F.col("b.page_number")) & (F.col(f"a.{order}") < F.col(f"b.{order}"))
    return a.join(b, on & meets("bbox_x", "bbox_width") & meets("bbox_y", "bbox_height")).select("a.leaflet_id", "a.page_number", F.col(f"a.{order}").alias("first_id"), F.col(f"b.{order}").alias("second_id"))
