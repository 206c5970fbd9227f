"""Columns that parse and normalise extracted fields."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size tokens, marketing words, and words that carry no meaning in names.
SIZE_TOKENS = (r"\b\d+\s*(g|kg|ml|l|cl|kom|pack|pcs)\b", r"\b\d+[.,]\d+\s*(g|kg|ml|l)\b")
MARKETING_WORDS = r"\b(to!|toi|više vrsta|razne vrste)\b"
NOISE_WORDS = ("the", "and", "ili", "sa", "od", "za")
# Currency signs.
CURRENCY_SIGNS = {"€": "EUR", "$": "USD", "£": "GBP", "CHF": "CHF", "ZŁ": "PLN", "KČ": "CZK", "KR": "SEK", "FT": "HUF", "LEI": "RON"}


def number(text: Column) -> Column:
    """A double, or null if the text is none."""
    return text.try_cast("double")


def cleaned(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def spaced(text: Column) -> Column:
    """Words one space apart."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compared_name(name: Column, brand: Column) -> Column:
    """A name without sizes, brand and marketing words, lower-cased."""
    out = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    for pattern in SIZE_TOKENS:
        out = F.regexp_replace(out, "(?U)" + pattern, "")
    own = F.trim(F.lower(F.coalesce(brand, F.lit(""))))
    out = F.when(own == "", out).otherwise(F.replace(out, own, F.lit("")))
    return spaced(F.regexp_replace(out, "(?U)" + MARKETING_WORDS, ""))


def key_words(name: Column) -> Column:
    words = F.filter(F.split(name, " "), lambda w: F.length(w) > 2)
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, NOISE_WORDS))))


def discount(regular: Column, discounted: Column) -> Column:
    """Percent off, null unless both prices say so."""
    return F.when((regular > 0) & (regular > discounted), (regular - discounted) / regular * 100)


def currency_code(text: Column) -> Column:
    up = F.upper(F.trim(text))
    signs = F.create_map(*[F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair])
    return F.coalesce(F.try_element_at(signs, up), up)


def token_cost(inputs: Column, outputs: Column, input_price: Column, output_price: Column) -> Column:
    """Cost of a call, prices for a million tokens; 3 and 15 where they are missing."""
    million = F.lit(1_000_000).cast("decimal(10,0)")
    price = lambda p, d: F.coalesce(p, F.lit(d)).cast("decimal(10,4)")
    return ((inputs.cast("decimal(12,0)") * price(input_price, 3) + outputs.cast("decimal(12,0)") * price(output_price, 15)) / million).cast("decimal(20,8)")


def model_json(text: Column, schema: str) -> Column:
    """A model's answer as a struct: the whole text, else what a fence marked json holds, else any fence, else the outermost braces."""
    tries = (text, F.regexp_extract(text, r"(?s)```json\s*(.*?)```", 1), F.regexp_extract(text, r"(?s)```\s*(.*?)```", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    valid = lambda t: F.try_parse_json(F.nullif(F.trim(t), F.lit(""))).isNotNull()
    out = F.lit(None)
    for t in reversed(tries):
        out = F.when(valid(t), t).otherwise(out)
    return F.from_json(out, schema)


def natural_key(name: Column) -> Column:
    """Sorts page2 before page10: each run of digits is padded to twelve."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def image_place(size: Column, mode: str, has_cdn: bool) -> Column:
    """Where an image is kept: files for archives, the row for small ones, else the network if there is one."""
    if mode == "archive":
        return F.lit("file")
    return F.when(size < 200_000, "base64").otherwise("cdn" if has_cdn else "file")


def swapped_prices(regular: Column, discounted: Column) -> tuple[Column, Column, Column]:
    """(regular, discounted, swapped): the larger price is the regular one."""
    wrong = F.coalesce(regular < discounted, F.lit(False))
    return F.when(wrong, discounted).otherwise(regular), F.when(wrong, regular).otherwise(discounted), wrong


def parsed_confidence(text: Column) -> Column:
    """0.8 where the model gives none, no number, or 0."""
    return F.coalesce(F.nullif(number(text), F.lit(0.0)), F.lit(0.8))


def plain_text(text: Column) -> Column:
    """Recognised text for comparing: lower case, one space, no signs but those of prices."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " ")), r"(?U)[^\p{L}\p{N}_\s€$£.,]", "")


def mentions_price(text: Column, price: Column) -> Column:
    """Whether a text has the price with a comma or a point, or as a whole number beside a sign or word of money."""
    dotted = F.format_string("%.2f", price)
    money = reduce(or_, (text.contains(sign) for sign in ("€", "$", "£", "EUR", "cena", "price")))
    whole = (price == F.floor(price)) & text.contains(F.floor(price).cast("string")) & money
    return F.coalesce(text.contains(F.replace(dotted, F.lit("."), F.lit(","))) | text.contains(dotted) | whole, F.lit(False))


# What prices, discounts and units look like, and words of discounts.
PRICE_LOOKS = r"(?i)^(\d+[.,]\d{2}|[€$£]\s*\d+[.,]\d{2}|\d+[.,]\d{2}\s*[€$£]|\d+[.,]\d{2}\s*(EUR|kn|rsd|din)|\d{1,3}|\d+[.,]-)$|[⁰¹²³⁴⁵⁶⁷⁸⁹]"
DISCOUNT_LOOKS = r"(?i)^-?\d+\s*%$|^\d+\+\d+$|^CENEJE\s*\d*\s*%?"
DISCOUNT_WORDS = ("AKCIJA", "AKTION", "SALE", "POPUST", "SNIŽENJE", "PONUDA", "PROMO", "SPECIAL", "GRATIS", "FREE", "MEGA", "SUPER", "TOP", "CENEJE", "CENA", "UGODNO", "RASPRODAJA", "OUTLET", "NOVO", "ODLIČNA", "KAKOVOST")
UNIT_LOOKS = r"^(\d+\s*(g|kg|ml|l|cl|dl)$|\d+[.,]\d+\s*(g|kg|ml|l)$|per\s*(kg|l|100g|100ml)$|\d+\s*(kos|pcs|kom|st|ks)$|\d+\s*x\s*\d+|cca\.?\s*\d+|pakirano|\d+\s*cm$)"


def box_kind(text: Column) -> Column:
    """price, discount, unit, name or other, the first that fits."""
    own = F.trim(F.coalesce(text, F.lit("")))
    reduced = own.rlike(DISCOUNT_LOOKS) | F.upper(own).rlike("|".join(DISCOUNT_WORDS))
    named = (F.length(own) >= 4) & own.rlike(r"\p{L}")
    return F.when(own.rlike(PRICE_LOOKS), "price").when(reduced, "discount").when(F.lower(own).rlike(UNIT_LOOKS), "unit").when(named, "name").otherwise("other")


def recorded_cost(tokens: Column, price: Column) -> Column:
    """A part of a call's cost as it is kept: six digits, half to even."""
    return F.bround(tokens.cast("decimal(12,0)") * price.cast("decimal(10,4)") * F.lit(0.000001).cast("decimal(7,6)"), 6).cast("decimal(18,6)")


# Free-form error names and their categories.
ERROR_CATEGORIES = {
    "budget_exceeded": "budget_limit", "budget_limit": "budget_limit", "api_error": "provider_error", "provider_error": "provider_error", "rate_limit": "rate_limit", "rate_limited": "rate_limit",
    "authentication": "authentication", "auth_error": "authentication", "network": "network", "network_error": "network", "timeout": "timeout", "timeout_error": "timeout",
    "validation": "validation", "validation_error": "validation", "unexpected_error": "system_error", "system_error": "system_error",
}


def error_category(text: Column) -> Column:
    """The category of an error's name, system_error for unknown names, null for none."""
    names = F.create_map(*[F.lit(x) for pair in ERROR_CATEGORIES.items() for x in pair])
    return F.when(text.isNotNull(), F.coalesce(F.try_element_at(names, F.lower(text)), F.lit("system_error")))


def third_price(regular: Column, discounted: Column, percent: Column) -> tuple[Column, Column, Column]:
    """(regular, discounted, percent) with the one that is missing computed from the other two."""
    from_prices = F.when((regular > 0) & discounted.isNotNull(), (regular - discounted) / regular * 100)
    return F.coalesce(regular, F.when(percent < 100, discounted / (1 - percent / 100))), F.coalesce(discounted, regular * (1 - percent / 100)), F.coalesce(percent, from_prices)


def size_label(n_bytes: Column) -> Column:
    n = n_bytes.cast("double")
    shown = lambda x, unit: F.concat(F.format_string("%.1f", F.bround(x, 1)), F.lit(unit))
    return F.when(n < 1024, shown(n, " B")).when(n < 1024**2, shown(n / 1024, " KB")).when(n < 1024**3, shown(n / 1024**2, " MB")).otherwise(shown(n / 1024**3, " GB"))


def parsed_product(answer: Column) -> dict[str, Column]:
    """What a model's answer for one product gives, from its JSON, parsed once before (try_parse_json): name, region_numbers (numbers cut to whole ones, anything else
    left out; empty unless it is a list), alternatives (texts as names without confidence, objects as they are, anything else left
    out; null if there are none or no list) and confidence (0.8 where it is missing, 0 or no number). name is null where
    the answer has none, and such answers are dropped by the caller."""
    part = lambda path, kind: F.try_variant_get(answer, path, kind)
    kinds = lambda path: F.transform(part(path, "array<variant>"), lambda v: F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")))
    numbers = F.filter(kinds("$.region_numbers"), lambda e: e["kind"].isin("BIGINT", "DOUBLE", "FLOAT") | e["kind"].startswith("DECIMAL("))
    listed = F.filter(kinds("$.category_alternatives"), lambda e: (e["kind"] == "STRING") | e["kind"].startswith("OBJECT<"))
    name = lambda e: F.when(e["kind"] == "STRING", F.try_variant_get(e["v"], "$", "string")).otherwise(F.try_variant_get(e["v"], "$.name", "string"))
    own = lambda e: F.struct(name(e).alias("name"), F.when(e["kind"] != "STRING", F.try_variant_get(e["v"], "$.confidence", "double")).alias("confidence"))
    alternatives = F.transform(listed, own)
    return {
        "name": F.when(F.trim(part("$.product_name", "string")) != "", part("$.product_name", "string")),
        "region_numbers": F.coalesce(F.transform(numbers, lambda e: F.try_variant_get(e["v"], "$", "double").cast("long")), F.array().cast("array<long>")),
        "alternatives": F.when(F.size(alternatives) > 0, alternatives),
        "confidence": parsed_confidence(part("$.confidence_score", "string")),
    }
