"""Validation of extracted products: errors, warnings, approval and priority as Columns of one projection."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least and largest price by currency.
PRICE_RANGES = {
    "EUR": (0.01, 10000), "USD": (0.01, 10000), "GBP": (0.01, 10000), "CHF": (0.01, 10000), "PLN": (0.01, 50000), "CZK": (0.10, 500000),
    "SEK": (0.10, 100000), "NOK": (0.10, 100000), "DKK": (0.10, 100000), "HUF": (1, 5000000), "RON": (0.10, 50000), "BGN": (0.10, 20000),
    "HRK": (0.10, 100000), "RSD": (1, 1000000), "BAM": (0.10, 50000), "MKD": (1, 500000), "ALL": (1, 1000000),
}
OTHER_RANGE = (0.01, 1000000)
PLACEHOLDER_CODES = ("n/a", "na", "none", "null", "-", "---")
# Flags that are warnings.
CRITICAL_FLAGS = ("price_unclear", "prices_swapped", "multiple_prices", "product_name_unclear", "CATEGORY_LOW_CONFIDENCE")
BOUNDS = tuple(f"bbox_{x}" for x in ("x", "y", "width", "height"))


def _bounds(k: int) -> Column:
    """Least (0) or largest (1) price by currency: a literal map, as a branch for each currency makes the compiled method
    too large for the JVM's own compiler."""
    return F.create_map(*[F.lit(x) for code, bounds in PRICE_RANGES.items() for x in (code, float(bounds[k]))])


def price_error(price: Column, currency: Column) -> Column:
    low, high = (F.coalesce(F.try_element_at(_bounds(k), currency), F.lit(float(OTHER_RANGE[k]))) for k in (0, 1))
    return F.coalesce(~price.between(low, high), F.lit(False))


def _with_ranges(products: DataFrame, money: Column) -> DataFrame:
    """products plus _low and _high, their currency's prices: a join with the list of currencies."""
    rows = products.sparkSession.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in PRICE_RANGES.items()], "_code string, _low double, _high double")
    either = lambda c, k: F.coalesce(c, F.lit(float(OTHER_RANGE[k]))).alias(c)
    return products.withColumn("_money", money).join(F.broadcast(rows), F.col("_money") == F.col("_code"), "left").select(*[f"`{c}`" for c in products.columns], either("_low", 0), either("_high", 1))


def _outside(price: Column) -> Column:
    return F.coalesce(~price.between(F.col("_low"), F.col("_high")), F.lit(False))


def discount_state(regular: Column, discounted: Column, stated: Column) -> Column:
    """error, warning or null."""
    real = (regular - discounted) / regular * 100
    both = regular.isNotNull() & discounted.isNotNull() & (regular > 0)
    return F.when(regular < discounted, "error").when(both & (F.abs(stated - real) > 2), "warning").when(both & (real > 90), "warning")


def code_warning(code: Column) -> Column:
    own = F.trim(code)
    return F.coalesce((F.length(own) < 3) | (F.length(own) > 30) | F.lower(own).isin(*PLACEHOLDER_CODES), F.lit(False))


def name_error(name: Column) -> Column:
    own = F.trim(F.coalesce(name, F.lit("")))
    odd = own.rlike(r"^[\d\s.]+$") | own.rlike(r"(?U)^[^\w\s]+$") | F.lower(own).rlike("^(test|sample|dummy|placeholder)")
    return (F.length(own) < 2) | (F.length(own) > 500) | odd


def box_error(page_width: Column, page_height: Column) -> Column:
    x, y, w, h = map(F.col, BOUNDS)
    return F.coalesce((x < 0) | (y < 0) | (w < 50) | (h < 50) | (x + w > page_width) | (y + h > page_height), F.lit(False))


def _list(*conditions: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in conditions]), lambda x: x.isNotNull())


def _count(*conditions: tuple[str, Column]) -> Column:
    """How many hold. The filter keeps a projection with many conditions out of whole-stage methods, which the JVM would not compile
    at this size (over 8,000 bytes): outside, Spark splits the conditions into small methods."""
    return F.size(F.filter(F.array(*[c for _, c in conditions]), lambda x: x))


def validated(products: DataFrame, currency: str = "EUR", page: tuple[int, int] = (2480, 3508), lists: bool = False) -> DataFrame:
    """products plus n_errors, n_warnings, is_valid, auto_approve and priority; with lists, also what the errors and
    warnings are."""
    have = set(products.columns)
    col = lambda c, kind="double": F.col(c) if c in have else F.lit(None).cast(kind)
    regular, reduced, confidence = F.col("regular_price"), F.col("discounted_price"), F.col("confidence").cast("double")
    money = F.coalesce(F.col("currency"), F.lit(currency)) if "currency" in have else F.lit(currency)
    state = F.col("_state")
    kind = dict(products.dtypes)
    flag_column = next((c for c in ("uncertainty_flags", "flags") if c in have), None)
    given = F.array().cast("array<string>") if flag_column is None else F.col(flag_column) if kind[flag_column].startswith("array") else F.array_remove(F.split(F.col(flag_column), ","), "")
    given = F.coalesce(given, F.array().cast("array<string>"))
    quantity, category = col("quantity"), col("category_confidence").cast("double")
    weak = F.coalesce(category < 0.8, F.lit(False))
    flags = F.when(weak & ~F.array_contains(given, "CATEGORY_LOW_CONFIDENCE"), F.array_append(given, "CATEGORY_LOW_CONFIDENCE")).otherwise(given) if {"category_confidence"} & have else given
    weak_fields = reduce(or_, (F.coalesce(F.col(f"{c}_confidence").cast("double") < 0.7, F.lit(False)) for c in ("brand", "product_name", "discounted_price") if f"{c}_confidence" in have), F.lit(False))
    errors = (
        ("regular_price", _outside(regular)), ("discounted_price", _outside(reduced)), ("discount", state == "error"), ("quantity", (quantity <= 0) | (quantity > 10000)),
        ("bounding_box", box_error(*map(F.lit, page)) if set(BOUNDS) <= have else F.lit(False)), ("product_name", name_error(F.col("product_name"))),
    )
    known = [flag for flag in CRITICAL_FLAGS if flag_column or flag == CRITICAL_FLAGS[-1]]
    warnings = (
        ("discount", state == "warning"), ("product_code", code_warning(col("product_code", "string"))), ("no_price", regular.isNull() & reduced.isNull()), ("confidence", confidence < 0.5),
        ("field_confidence", weak_fields), ("category", weak),
    )
    n_warnings = _count(*warnings) + F.size(F.array_intersect("_flags", F.array(*map(F.lit, known))))
    if lists:
        warnings += tuple((flag, F.array_contains("_flags", flag)) for flag in known)
    made = products.withColumns({"_flags": flags, "_state": discount_state(regular, reduced, F.col("discount_percentage"))})
    made = made.select("*", n_warnings.alias("n_warnings"), F.size("_flags").alias("_n_flags"), *([_list(*warnings).alias("warnings")] if lists else []))
    made = _with_ranges(made, money)
    listed = [_list(*errors).alias("errors"), "warnings"] if lists else []
    made = made.select(*[f"`{c}`" for c in products.columns], _count(*errors).alias("n_errors"), "n_warnings", "_n_flags", *listed)
    approve = (F.col("n_errors") == 0) & (F.col("n_warnings") == 0) & (confidence >= 0.9) & F.coalesce(category >= 0.8, F.lit(True))
    brand = F.nullif(F.trim("brand"), F.lit(""))
    points = (
        F.col("n_errors") * 20 + F.col("n_warnings") * 5 + F.when(confidence < 0.7, 30).when(confidence < 0.85, 15).otherwise(0) + F.col("_n_flags") * 5
        + F.when(reduced.isNull(), 10).otherwise(0) + F.when(brand.isNull(), 5).otherwise(0) + F.when(weak, 10).otherwise(0)
    )
    return made.withColumns({"is_valid": F.col("n_errors") == 0, "auto_approve": approve, "priority": F.least(F.lit(100), points)}).drop("_n_flags")


def low_fields(have: set[str], strict: bool = False) -> Column:
    """The fields whose confidence is below what review asks for."""
    fields = ("brand", "product_name", "quantity", "regular_price", "discounted_price", "discount_percentage", "product_code")
    return _list(*((c, F.col(f"{c}_confidence").cast("double") < (0.75 if strict else 0.7)) for c in fields if f"{c}_confidence" in have))


def routed(rows: DataFrame, strict: bool = False) -> DataFrame:
    """rows (confidence, n_errors, n_warnings, image_score, critical, n_flagged) plus effective, path, path_priority and
    seconds. n_flagged, where there is such a column, counts fields flagged by errors, flags and low confidence, before
    equal ones are merged; else the errors count."""
    enough, quick = (0.95, 0.85) if strict else (0.9, 0.75)
    errors, warnings, image = F.col("n_errors"), F.col("n_warnings"), F.col("image_score")
    base = F.col("confidence").cast("double") - F.least(F.lit(0.2), errors * 0.05) - F.least(F.lit(0.1), warnings * 0.02)
    mixed = F.when(image.isNotNull(), base * 0.8 + image * 0.2).otherwise(base)
    made = rows.withColumn("effective", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)))
    eff = F.col("effective")
    first = F.col("critical") | (errors >= 3)
    auto = (eff >= enough) & (errors == 0) & (warnings <= 1) & F.coalesce(image >= 0.7, F.lit(True))
    fast = (eff >= quick) & (errors <= 1) & (warnings <= 3)
    path = F.when(first, "priority_review").when(errors >= 5, "rejected").when(auto, "auto_approve").when(fast, "quick_review").otherwise("detailed_review")
    slow = F.floor(50 + errors * 5 + warnings * 2 + (1 - eff) * 30)
    points = F.when(first, F.least(F.lit(100), 70 + errors * 10)).when(auto, 0).when(fast, F.floor(30 + (1 - eff) * 40)).otherwise(F.least(F.lit(100), slow))
    made = made.withColumn("path", path).withColumn("path_priority", points.cast("int"))
    seconds = reduce(lambda out, x: F.when(F.col("path") == x[0], x[1]).otherwise(out), (("quick_review", 5), ("detailed_review", 30), ("priority_review", 60)), F.lit(0))
    return made.withColumn("seconds", seconds + 3 * (F.col("n_flagged") if "n_flagged" in rows.columns else errors))


def review_rates(routed_rows: DataFrame) -> DataFrame:
    """(path, n, share, auto_rate, mean_priority) for each path; no rows for no decisions."""
    by = routed_rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("path_priority").alias("points"))
    total = by.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("path") == "auto_approve", F.col("n")).otherwise(0)).alias("auto"), F.sum("points").alias("all_points"))
    ratio = lambda a: F.col(a).cast("double") / F.col("total").cast("double")
    return by.join(F.broadcast(total)).select("path", "n", ratio("n").alias("share"), ratio("auto").alias("auto_rate"), ratio("all_points").alias("mean_priority"))
