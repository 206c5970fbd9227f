"""Queries over offers as extraction gives them (missing values, flags, gaps in pages): rules, reconciling, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as g
from ..operators import reconcile as r
from ..operators import rules as v
from .dashboards import CNT, add

PAGE = (900, 1000)
# SQL of the same rules; {0} stands for a table's alias
FLAGS = "list_filter(string_split({0}.flags, ','), lambda f: f <> '')"
BRAND = "NULLIF(lower(trim({0}.brand)), '')"
WORDS = "list_distinct(string_split(trim(regexp_replace(trim(lower({0}.product_name)), '\\s+', ' ', 'g')), ' '))"
BOTH = f"list_intersect({WORDS.format('a')}, {WORDS.format('b')})"
ALIKE = f"""CASE WHEN COALESCE(a.product_name, '') = '' OR COALESCE(b.product_name, '') = '' THEN 0.0 WHEN trim(lower(a.product_name)) = trim(lower(b.product_name)) THEN 1.0
    WHEN contains(trim(lower(a.product_name)), trim(lower(b.product_name))) OR contains(trim(lower(b.product_name)), trim(lower(a.product_name))) THEN 0.9
    ELSE LEAST(1.0, CAST(length({BOTH}) AS DOUBLE) / length(list_distinct(list_concat({WORDS.format('a')}, {WORDS.format('b')}))) + length(list_filter({BOTH}, lambda w: w NOT IN ({", ".join(repr(w) for w in r.LIGHT_WORDS)}))) * CAST(0.1 AS DOUBLE)) END"""
HAS = lambda side, flag: f"list_contains({FLAGS.format(side)}, '{flag}')"
PAIRS = f""", placed AS (SELECT *, dense_rank() OVER (PARTITION BY leaflet_id ORDER BY page_number) AS place FROM offers),
    pairs AS (SELECT a.leaflet_id, a.page_number, a.id AS first_id, b.id AS second_id, CAST(LEAST(100, CASE WHEN {ALIKE} > 0.7 THEN 30 ELSE 0 END + CASE WHEN (a.discounted_price IS NULL) <> (b.discounted_price IS NULL) THEN 20 ELSE 0 END
    + CASE WHEN {BRAND.format("a")} = {BRAND.format("b")} THEN 15 WHEN ({BRAND.format("a")} IS NULL) <> ({BRAND.format("b")} IS NULL) THEN 10 ELSE 0 END + CASE WHEN abs(a.bbox_x - b.bbox_x) < 50 THEN 15 ELSE 0 END
    + CASE WHEN {HAS("a", "partial_product")} OR {HAS("b", "partial_product")} THEN 20 ELSE 0 END + CASE WHEN {HAS("a", "continues_on_next_page")} THEN 25 ELSE 0 END + CASE WHEN {HAS("b", "continued_from_previous")} THEN 25 ELSE 0 END) AS INT) AS points
    FROM placed a JOIN placed b ON a.leaflet_id = b.leaflet_id AND a.place + 1 = b.place WHERE a.bbox_y + a.bbox_height > 900 AND b.bbox_y < 100) """


def _either(column: str) -> str:
    return f"COALESCE(NULLIF(a.{column}, {repr('') if column in r.TEXTS else 0}), b.{column}) AS {column}"


GOES_ON = "b.product_name <> '' AND b.product_name <> a.product_name AND NOT starts_with(lower(b.product_name), substring(lower(a.product_name), 1, 10))"
MERGED = f""", chosen AS (SELECT * FROM pairs WHERE points >= {r.MERGE_POINTS}), merged AS (SELECT concat(a.id, '+', b.id) AS id, a.leaflet_id, a.page_number, CASE WHEN {GOES_ON} THEN trim(concat(a.product_name, ' ', b.product_name)) ELSE a.product_name END AS product_name,
    {", ".join(_either(c) for c in (*r.TEXTS, *r.NUMBERS) if c != "product_name")}, COALESCE((CAST(NULLIF(a.confidence, 0) AS DOUBLE) + CAST(NULLIF(b.confidence, 0) AS DOUBLE)) / 2, CAST(NULLIF(a.confidence, 0) AS DOUBLE), CAST(NULLIF(b.confidence, 0) AS DOUBLE)) AS confidence,
    CASE WHEN a.category_confidence IS NULL THEN b.category_confidence WHEN b.category_confidence IS NULL THEN a.category_confidence ELSE GREATEST(a.category_confidence, b.category_confidence) END AS category_confidence, NULLIF(GREATEST(COALESCE(a.brand_confidence, 0), COALESCE(b.brand_confidence, 0)), 0) AS brand_confidence,
    LEAST(a.bbox_x, b.bbox_x) AS bbox_x, a.bbox_y, GREATEST(a.bbox_x + a.bbox_width, b.bbox_x + b.bbox_width) - LEAST(a.bbox_x, b.bbox_x) AS bbox_width, a.bbox_height + b.bbox_height AS bbox_height,
    array_to_string(list_sort(list_append(list_filter(list_distinct(list_concat({FLAGS.format("a")}, {FLAGS.format("b")})), lambda f: f NOT IN ({", ".join(repr(f) for f in r.SPLIT_FLAGS)})), 'merged_from_split')), ',') AS flags
    FROM chosen JOIN placed a ON a.id = first_id JOIN placed b ON b.id = second_id) """
OUT = "id leaflet_id page_number product_name brand product_code category currency units regular_price discounted_price discount_percentage quantity confidence category_confidence brand_confidence bbox_x bbox_y bbox_width bbox_height flags".split()
COLUMNS = ", ".join(OUT)
PRICE = "COALESCE(NULLIF(discounted_price, 0), NULLIF(regular_price, 0), 0)"
SPACED = "trim(regexp_replace(lower(product_name), '\\s+', ' ', 'g'))"
BEST = f"PARTITION BY leaflet_id, page_number, {SPACED}, {PRICE} ORDER BY CAST(confidence AS DOUBLE) + CASE WHEN NULLIF(product_code, '') IS NOT NULL THEN 1 ELSE 0 END DESC"
CELL = f"PARTITION BY leaflet_id, substring(trim(lower(product_name)), 1, 50), {PRICE}, floor(bbox_x / 50), floor(bbox_y / 50), CASE WHEN bbox_x IS NULL THEN page_number END"


def clean(table: str) -> str:
    """The five steps of the clean-up, as subqueries over a table."""
    out = f"SELECT * REPLACE (CASE WHEN regular_price IS NULL AND discounted_price IS NOT NULL AND COALESCE(discount_percentage = 0, TRUE) THEN NULL ELSE discounted_price END AS discounted_price, CASE WHEN regular_price IS NULL AND COALESCE(discount_percentage = 0, TRUE) THEN discounted_price ELSE regular_price END AS regular_price) FROM {table}"
    before = "round_even(discounted_price / (1 - discount_percentage / 100), 2)"
    out = f"SELECT * REPLACE (CASE WHEN regular_price IS NULL AND discount_percentage > 0 AND discount_percentage < 100 THEN {before} ELSE regular_price END AS regular_price) FROM ({out})"
    equal = "COALESCE(regular_price = discounted_price AND discount_percentage > 0, FALSE)"
    out = f"""SELECT * REPLACE (CASE WHEN {equal} AND discount_percentage < 100 THEN {before} ELSE regular_price END AS regular_price, CASE WHEN {equal} AND discount_percentage >= 100 THEN NULL ELSE discounted_price END AS discounted_price,
        CASE WHEN {equal} AND discount_percentage >= 100 THEN NULL ELSE discount_percentage END AS discount_percentage) FROM ({out})"""
    real = "(regular_price - discounted_price) / regular_price * 100"
    out = f"SELECT * REPLACE (CASE WHEN regular_price > 0 AND regular_price > discounted_price AND abs(discount_percentage - {real}) > 5 THEN {real} ELSE discount_percentage END AS discount_percentage) FROM ({out})"
    starts = " OR ".join(f"starts_with(lower(trim(product_name)), '{w}')" for w in r.HEADER_STARTS)
    return f"SELECT * FROM ({out}) WHERE NOT (regular_price IS NULL AND discounted_price IS NULL AND ((trim(product_name) = upper(trim(product_name)) AND length(trim(product_name)) > 5) OR {starts}))"


add("d1_split_candidates", "offers", lambda x: r.split_candidates(x.offers, 1000), PAIRS + "SELECT * FROM pairs WHERE points > 50")
add(
    "d2_name_similarity", "offers", lambda x: r.split_candidates(x.offers, 1000, -1).join(x.offers.select(F.col("id").alias("first_id"), F.col("product_name").alias("a")), "first_id").join(x.offers.select(F.col("id").alias("second_id"), F.col("product_name").alias("b")), "second_id").select("first_id", "second_id", r.name_similarity(F.col("a"), F.col("b")).alias("similarity")),
    PAIRS + f"SELECT first_id, second_id, CAST({ALIKE} AS DOUBLE) AS similarity FROM pairs JOIN placed a ON a.id = first_id JOIN placed b ON b.id = second_id",
)
add("d3_merged", "offers", lambda x: r.split_merged(x.by_leaflet("offers").select(OUT), 1000), PAIRS + MERGED + f"SELECT {COLUMNS} FROM merged")
add("d5_best_on_page", "offers", lambda x: r.best_on_page(x.offers).select("id"), f"SELECT id FROM (SELECT id, row_number() OVER ({BEST}, id) AS k FROM offers) WHERE k = 1")
add("d6_first_in_cell", "offers", lambda x: r.first_in_cell(x.offers).select("id"), f"SELECT id FROM (SELECT id, row_number() OVER ({CELL} ORDER BY page_number, id) AS k FROM offers) WHERE k = 1")
add("d7_sanitize", "offers", lambda x: r.sanitized(x.offers).select("id", "regular_price", "discounted_price", "discount_percentage"), f"SELECT id, regular_price, discounted_price, discount_percentage FROM ({clean('offers')})")
add(
    "d8_reconcile", "offers", lambda x: r.reconciled(x.by_leaflet("offers").select(OUT), 1000, dealt=True),
    PAIRS + MERGED + f""", every AS (SELECT {", ".join(c if c != "confidence" else "CAST(confidence AS DOUBLE) AS confidence" for c in OUT)}, 0 AS late FROM offers WHERE concat_ws('|', {", ".join(f"COALESCE(CAST({c} AS VARCHAR), '~')" for c in OUT if c != "id")}) NOT IN (SELECT concat_ws('|', {", ".join(f"COALESCE(CAST({c} AS VARCHAR), '~')" for c in OUT if c != "id")}) FROM offers WHERE id IN (SELECT first_id FROM chosen UNION ALL SELECT second_id FROM chosen)) UNION ALL SELECT {COLUMNS}, 1 AS late FROM merged),
    best AS (SELECT * FROM (SELECT *, row_number() OVER ({BEST}, late, page_number, id) AS k FROM every) WHERE k = 1), cells AS (SELECT * FROM (SELECT * REPLACE (row_number() OVER ({CELL} ORDER BY late, page_number, id) AS k) FROM best) WHERE k = 1)
    SELECT {COLUMNS} FROM ({clean("cells")})""",
)

MONEY = "COALESCE(currency, 'EUR')"
LOW = f"CASE {MONEY} " + " ".join(f"WHEN '{c}' THEN {lo}" for c, (lo, _) in v.PRICE_RANGES.items()) + f" ELSE {v.OTHER_RANGE[0]} END"
HIGH = f"CASE {MONEY} " + " ".join(f"WHEN '{c}' THEN {hi}" for c, (_, hi) in v.PRICE_RANGES.items()) + f" ELSE {v.OTHER_RANGE[1]} END"
REAL = "(regular_price - discounted_price) / regular_price * 100"
bit = lambda condition: f"CASE WHEN {condition} THEN 1 ELSE 0 END"
OFF = f"regular_price IS NOT NULL AND discounted_price IS NOT NULL AND regular_price > 0 AND NOT regular_price < discounted_price AND (COALESCE(abs(discount_percentage - {REAL}) > 2, FALSE) OR {REAL} > 90)"
ERRORS = {
    "price": f"{bit(f'regular_price < {LOW} OR regular_price > {HIGH}')} + {bit(f'discounted_price < {LOW} OR discounted_price > {HIGH}')}", "discount": bit("regular_price < discounted_price"), "quantity": bit("quantity <= 0 OR quantity > 10000"),
    "box": bit(f"bbox_x < 0 OR bbox_y < 0 OR bbox_width < 50 OR bbox_height < 50 OR bbox_x + bbox_width > {PAGE[0]} OR bbox_y + bbox_height > {PAGE[1]}"),
    "name": bit("length(trim(product_name)) < 2 OR length(trim(product_name)) > 500 OR regexp_matches(trim(product_name), '^[\\d\\s.]+$') OR regexp_matches(lower(trim(product_name)), '^(test|sample|dummy|placeholder)')"),
}
WEAK = "COALESCE(category_confidence < 0.8, FALSE)"
ALL_FLAGS = f"CASE WHEN {WEAK} AND NOT list_contains({FLAGS.format('offers')}, 'CATEGORY_LOW_CONFIDENCE') THEN list_append({FLAGS.format('offers')}, 'CATEGORY_LOW_CONFIDENCE') ELSE {FLAGS.format('offers')} END"
WARNINGS = {
    "discount": bit(OFF), "code": bit(f"length(trim(product_code)) < 3 OR length(trim(product_code)) > 30 OR lower(trim(product_code)) IN ({', '.join(repr(c) for c in v.PLACEHOLDER_CODES)})"),
    "no_price": bit("regular_price IS NULL AND discounted_price IS NULL"), "confidence": f"{bit('confidence < 0.5')} + {bit('brand_confidence < 0.7')}", "category": bit(WEAK),
    "flags": f"length(list_intersect(all_flags, [{', '.join(repr(f) for f in v.CRITICAL_FLAGS)}]))",
}
JUDGED = f""", flagged AS (SELECT *, {ALL_FLAGS} AS all_flags FROM offers), counted AS (SELECT *, CAST({" + ".join(ERRORS.values())} AS INT) AS n_errors, CAST({" + ".join(WARNINGS.values())} AS INT) AS n_warnings FROM flagged) """
PRIORITY = f"""CAST(LEAST(100, n_errors * 20 + n_warnings * 5 + CASE WHEN confidence < 0.7 THEN 30 WHEN confidence < 0.85 THEN 15 ELSE 0 END + length(all_flags) * 5 + {bit("discounted_price IS NULL")} * 10 + {bit("NULLIF(trim(brand), '') IS NULL")} * 5 + {bit(WEAK)} * 10) AS INT)"""
add(
    "v1_v12_validate", "offers", lambda x: v.validated(x.offers, page=PAGE).select("id", "n_errors", "n_warnings", "is_valid", "auto_approve", "priority"),
    JUDGED + f"SELECT id, n_errors, n_warnings, n_errors = 0 AS is_valid, n_errors = 0 AND n_warnings = 0 AND confidence >= 0.9 AND COALESCE(category_confidence >= 0.8, TRUE) AS auto_approve, {PRIORITY} AS priority FROM counted",
)
for name, column, condition, sql in (
    ("v1_price", "price", lambda: v.price_error(F.col("regular_price"), F.coalesce("currency", F.lit("EUR"))).cast("int") + v.price_error(F.col("discounted_price"), F.coalesce("currency", F.lit("EUR"))).cast("int"), ERRORS["price"]),
    ("v2_discount", "state", lambda: v.discount_state(F.col("regular_price"), F.col("discounted_price"), F.col("discount_percentage")), f"CASE WHEN regular_price < discounted_price THEN 'error' WHEN {OFF} THEN 'warning' END"),
    ("v4_box", "wrong", lambda: v.box_error(*map(F.lit, PAGE)), ERRORS["box"] + " = 1"),
    ("v5_code", "weak", lambda: v.code_warning(F.col("product_code")), WARNINGS["code"] + " = 1"),
    ("v6_name", "wrong", lambda: v.name_error(F.col("product_name")), ERRORS["name"] + " = 1"),
):
    add(name, "offers", lambda x, column=column, condition=condition: x.offers.select("id", condition().alias(column)), f"SELECT id, {sql} AS {column} FROM offers")
add(
    "v3_v8_to_v11_lists", "offers", lambda x: v.validated(x.offers, page=PAGE, lists=True).select("id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings")),
    JUDGED.replace("counted AS", "unused AS") + f"""SELECT id, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in (("regular_price", f"regular_price < {LOW} OR regular_price > {HIGH}"), ("discounted_price", f"discounted_price < {LOW} OR discounted_price > {HIGH}"), ("discount", "regular_price < discounted_price"), ("quantity", "quantity <= 0 OR quantity > 10000"), ("bounding_box", ERRORS["box"] + " = 1"), ("product_name", ERRORS["name"] + " = 1")))}], lambda e: e IS NOT NULL), ',') AS errors,
    array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in (("discount", OFF), ("product_code", WARNINGS["code"] + " = 1"), ("no_price", "regular_price IS NULL AND discounted_price IS NULL"), ("confidence", "confidence < 0.5"), ("field_confidence", "brand_confidence < 0.7"), ("category", WEAK), *((f, f"list_contains(all_flags, '{f}')") for f in v.CRITICAL_FLAGS)))}], lambda e: e IS NOT NULL), ',') AS warnings FROM flagged""",
)
KEY14 = "PARTITION BY leaflet_id, substring(trim(lower(product_name)), 1, 50), discounted_price ORDER BY page_number, id"
add(
    "v14_repeats", "offers", lambda x: r.later_repeats(x.offers), f"SELECT id, first_id FROM (SELECT id, row_number() OVER w AS k, first_value(id) OVER w AS first_id FROM offers WINDOW w AS ({KEY14})) WHERE k > 1",
)

# routing
CRITICAL = f"length(list_intersect({FLAGS.format('counted')}, ['price_unclear', 'partial_product'])) > 0"
EFF = "GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), (CAST(confidence AS DOUBLE) - LEAST(CAST(0.2 AS DOUBLE), n_errors * CAST(0.05 AS DOUBLE)) - LEAST(CAST(0.1 AS DOUBLE), n_warnings * CAST(0.02 AS DOUBLE))) * CAST(0.8 AS DOUBLE) + CAST(brand_confidence AS DOUBLE) * CAST(0.2 AS DOUBLE)))"
PLAIN_EFF = EFF.replace(" * CAST(0.8 AS DOUBLE) + CAST(brand_confidence AS DOUBLE) * CAST(0.2 AS DOUBLE)", "")


def _decided(x, strict: bool = False):
    judged = v.validated(x.offers, page=PAGE)
    flags = r.flag_list(F.col("flags"))
    low = v.low_fields(set(judged.columns), strict)
    critical = F.arrays_overlap(flags, F.array(F.lit("price_unclear"), F.lit("partial_product")))
    return v.routed(judged.select("id", "confidence", "n_errors", "n_warnings", F.col("brand_confidence").cast("double").alias("image_score"), critical.alias("critical"), (F.col("n_errors") + F.size(flags) + F.size(low)).alias("n_flagged")), strict)


def _decided_sql(strict: bool) -> str:
    enough, quick, low = (0.95, 0.85, 0.75) if strict else (0.9, 0.75, 0.7)
    return JUDGED + f""", effective AS (SELECT *, CASE WHEN brand_confidence IS NULL THEN {PLAIN_EFF} ELSE {EFF} END AS eff, {CRITICAL} OR n_errors >= 3 AS first FROM counted),
    decided AS (SELECT *, CASE WHEN first THEN 'priority_review' WHEN eff >= {enough} AND n_errors = 0 AND n_warnings <= 1 AND COALESCE(brand_confidence >= 0.7, TRUE) THEN 'auto_approve' WHEN eff >= {quick} AND n_errors <= 1 AND n_warnings <= 3 THEN 'quick_review' ELSE 'detailed_review' END AS path,
    n_errors + length({FLAGS.format("effective")}) + {bit(f"brand_confidence < {low}")} AS n_flagged FROM effective),
    routed AS (SELECT id, path, CAST(CASE path WHEN 'priority_review' THEN LEAST(100, 70 + n_errors * 10) WHEN 'auto_approve' THEN 0 WHEN 'quick_review' THEN floor(30 + (1 - eff) * 40) ELSE LEAST(100, floor(50 + n_errors * 5 + n_warnings * 2 + (1 - eff) * 30)) END AS INT) AS path_priority,
    CAST(CASE path WHEN 'quick_review' THEN 5 WHEN 'detailed_review' THEN 30 WHEN 'priority_review' THEN 60 ELSE 0 END + 3 * n_flagged AS INT) AS seconds FROM decided) """


for name, strict in (("route_products", False), ("route_products_strict", True)):
    add(name, "offers", lambda x, strict=strict: _decided(x, strict).select("id", "path", "path_priority", F.col("seconds").cast("int").alias("seconds")), _decided_sql(strict) + "SELECT * FROM routed")
add(
    "a35_review_rates", "offers", lambda x: v.review_rates(_decided(x)),
    _decided_sql(False) + f"""SELECT path, n, CAST(n AS DOUBLE) / CAST(SUM(n) OVER () AS DOUBLE) AS share, CAST(SUM(CASE WHEN path = 'auto_approve' THEN n ELSE 0 END) OVER () AS DOUBLE) / CAST(SUM(n) OVER () AS DOUBLE) AS auto_rate, CAST(SUM(points) OVER () AS DOUBLE) / CAST(SUM(n) OVER () AS DOUBLE) AS mean_priority
    FROM (SELECT path, {CNT} AS n, SUM(path_priority) AS points FROM routed GROUP BY path)""",
)
GREEDY = """, ordered AS (SELECT id, leaflet_id, page_number, [bbox_x, bbox_y, bbox_width, bbox_height] AS box, row_number() OVER (PARTITION BY leaflet_id, page_number ORDER BY CASE review_status WHEN 'approved' THEN 0 WHEN 'auto_approved' THEN 1 WHEN 'pending' THEN 2 WHEN 'needs_correction' THEN 3 ELSE 4 END, id) AS i FROM products),
    walked AS (SELECT id, leaflet_id, page_number, i, [box] AS kept, TRUE AS stays FROM ordered WHERE i = 1
    UNION ALL SELECT o.id, o.leaflet_id, o.page_number, o.i, CASE WHEN length(list_filter(w.kept, lambda k: 2 * GREATEST(0, LEAST(k[1] + k[3], o.box[1] + o.box[3]) - GREATEST(k[1], o.box[1])) * GREATEST(0, LEAST(k[2] + k[4], o.box[2] + o.box[4]) - GREATEST(k[2], o.box[2])) > k[3] * k[4] + o.box[3] * o.box[4] - GREATEST(0, LEAST(k[1] + k[3], o.box[1] + o.box[3]) - GREATEST(k[1], o.box[1])) * GREATEST(0, LEAST(k[2] + k[4], o.box[2] + o.box[4]) - GREATEST(k[2], o.box[2])))) = 0
    THEN list_append(w.kept, o.box) ELSE w.kept END, length(list_filter(w.kept, lambda k: 2 * GREATEST(0, LEAST(k[1] + k[3], o.box[1] + o.box[3]) - GREATEST(k[1], o.box[1])) * GREATEST(0, LEAST(k[2] + k[4], o.box[2] + o.box[4]) - GREATEST(k[2], o.box[2])) > k[3] * k[4] + o.box[3] * o.box[4] - GREATEST(0, LEAST(k[1] + k[3], o.box[1] + o.box[3]) - GREATEST(k[1], o.box[1])) * GREATEST(0, LEAST(k[2] + k[4], o.box[2] + o.box[4]) - GREATEST(k[2], o.box[2])))) = 0
    FROM walked w JOIN ordered o ON o.leaflet_id = w.leaflet_id AND o.page_number = w.page_number AND o.i = w.i + 1) SELECT id FROM walked WHERE stays"""
add("g14_greedy_boxes", "products", lambda x: g.greedy_distinct(x.products.withColumn("source", F.expr("CASE review_status WHEN 'approved' THEN 0 WHEN 'auto_approved' THEN 1 WHEN 'pending' THEN 2 WHEN 'needs_correction' THEN 3 ELSE 4 END")), 0.5).select("id"), GREEDY)
