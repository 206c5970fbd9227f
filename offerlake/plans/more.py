"""More queries over text functions, geometry and exports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as f
from ..operators import geometry as g
from ..operators import predicates as p
from ..operators import reconcile as r
from ..operators import sorting as s
from ..sources import sinks
from .dashboards import CNT, PERIOD, add, period
from .offers import FLAGS, GOES_ON  # noqa: F401

# text
TEXT = "CASE l_orderkey % 12 WHEN 0 THEN concat(CAST(l_partkey AS STRING), ',99 EUR') WHEN 1 THEN '1⁹⁹' WHEN 2 THEN concat('-', CAST(l_linenumber AS STRING), ' %') WHEN 3 THEN 'mega popust' WHEN 4 THEN '500 g' WHEN 5 THEN '6 x 200' WHEN 6 THEN ' Špar  Šljiva! ' WHEN 7 THEN 'abc' WHEN 8 THEN concat(CAST(l_partkey AS STRING), ' cena') WHEN 9 THEN 'per kg' WHEN 10 THEN NULL ELSE l_shipmode_text END"
TEXT = TEXT.replace("l_shipmode_text", "concat('Item ', CAST(l_suppkey AS STRING), '.50 €')")


def boxes(x):
    return x.spark.sql(f"SELECT DISTINCT l_orderkey AS k, l_partkey AS n, {TEXT} AS t FROM {{l}}", l=x.raw("lineitem"))


BOXES = f"(SELECT DISTINCT l_orderkey AS k, l_partkey AS n, {TEXT} AS t FROM lineitem)"
WORDS = ", ".join(f"'{w}'" for w in f.DISCOUNT_WORDS)
add("n1_numbers", "", lambda x: boxes(x).select("k", "n", "t", f.number(F.regexp_replace("t", ",.*", "")).alias("v")), f"SELECT k, n, t, TRY_CAST(regexp_replace(t, ',.*', '') AS DOUBLE) AS v FROM {BOXES}")
add("n2_cleaned", "offers", lambda x: x.offers.select("id", f.cleaned(F.col("brand")).alias("brand"), f.cleaned(F.col("product_name")).alias("name")), "SELECT id, NULLIF(trim(brand), '') AS brand, NULLIF(trim(product_name), '') AS name FROM offers")
add(
    "n4_swapped_prices", "offers", lambda x: x.offers.select("id", *[c.alias(n) for n, c in zip(("regular", "reduced", "swapped"), f.swapped_prices(F.col("regular_price"), F.col("discounted_price")), strict=True)], f.discount(F.col("regular_price"), F.col("discounted_price")).alias("off")),
    "SELECT id, CASE WHEN regular_price < discounted_price THEN discounted_price ELSE regular_price END AS regular, CASE WHEN regular_price < discounted_price THEN regular_price ELSE discounted_price END AS reduced, COALESCE(regular_price < discounted_price, FALSE) AS swapped, CASE WHEN regular_price > 0 AND regular_price > discounted_price THEN (regular_price - discounted_price) / regular_price * 100 END AS off FROM offers",
)
add("n5_parsed_confidence", "offers", lambda x: x.offers.where("coalesce(product_name, '') <> ''").select("id", f.parsed_confidence(F.col("confidence").cast("string")).alias("confidence")), "SELECT id, COALESCE(NULLIF(CAST(confidence AS DOUBLE), 0), 0.8) AS confidence FROM offers WHERE COALESCE(product_name, '') <> ''")
FIX = lambda p, size: f"CASE WHEN {p} < 0 THEN 0 WHEN {p} >= {size} THEN {size} - 100 ELSE {p} END"
add(
    "n6_fixed_boxes", "offers", lambda x: x.offers.withColumns({"bbox_x": F.col("bbox_x") * 3 - 100, "bbox_y": F.col("bbox_y") * 3 - 100}).select("id", *g.fixed_box(1800, 2400)),
    f"SELECT id, {FIX('x', 1800)} AS bbox_x, {FIX('y', 2400)} AS bbox_y, LEAST(GREATEST(bbox_width, 180), 1800 - {FIX('x', 1800)}) AS bbox_width, LEAST(GREATEST(bbox_height, 240), 2400 - {FIX('y', 2400)}) AS bbox_height FROM (SELECT *, bbox_x * 3 - 100 AS x, bbox_y * 3 - 100 AS y FROM offers WHERE bbox_x IS NOT NULL) UNION ALL SELECT id, NULL, NULL, NULL, NULL FROM offers WHERE bbox_x IS NULL",
)
SIZES = "regexp_replace(regexp_replace(trim(lower(product_name)), '\\b\\d+\\s*(g|kg|ml|l|cl|kom|pack|pcs)\\b', '', 'g'), '\\b\\d+[.,]\\d+\\s*(g|kg|ml|l)\\b', '', 'g')"
NORM = f"trim(regexp_replace(CASE WHEN COALESCE(trim(lower(brand)), '') = '' THEN {SIZES} ELSE replace({SIZES}, trim(lower(brand)), '') END, '\\s+', ' ', 'g'))"
add("n7_compared_names", "offers", lambda x: x.offers.select("id", f.compared_name(F.col("product_name"), F.col("brand")).alias("name")), f"SELECT id, {NORM} AS name FROM offers")
add("n9_plain_text", "", lambda x: boxes(x).select("k", "n", f.plain_text(F.col("t")).alias("t")), f"SELECT k, n, regexp_replace(trim(regexp_replace(lower(t), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\s€$£.,]', '', 'g') AS t FROM {BOXES}")
add(
    "n11_price_texts", "", lambda x: boxes(x).select("k", "n", f.mentions_price(F.col("t"), F.col("n").cast("double")).alias("whole"), f.mentions_price(F.col("t"), F.col("n") + F.lit(0.99).cast("double")).alias("cents")),
    f"SELECT k, n, COALESCE(contains(t, concat(CAST(n AS STRING), ',00')) OR contains(t, concat(CAST(n AS STRING), '.00')) OR (contains(t, CAST(n AS STRING)) AND regexp_matches(t, '€|\\$|£|EUR|cena|price')), FALSE) AS whole, COALESCE(contains(t, concat(CAST(n AS STRING), ',99')) OR contains(t, concat(CAST(n AS STRING), '.99')), FALSE) AS cents FROM {BOXES}",
)
add("n12_currency_codes", "offers", lambda x: x.offers.select("id", f.currency_code(F.when(F.col("currency") == "XYZ", " kč").when(F.col("currency") == "RSD", "€").otherwise(F.col("currency"))).alias("code")), "SELECT id, CASE WHEN currency = 'XYZ' THEN 'CZK' WHEN currency = 'RSD' THEN 'EUR' ELSE currency END AS code FROM offers")
LOOKS = lambda pattern: pattern.replace("'", "''")
add(
    "n13_box_kinds", "", lambda x: boxes(x).select("k", "n", f.box_kind(F.col("t")).alias("kind")),
    f"SELECT k, n, CASE WHEN regexp_matches(t, '{LOOKS(f.PRICE_LOOKS)}') THEN 'price' WHEN regexp_matches(t, '{LOOKS(f.DISCOUNT_LOOKS)}') OR length(list_filter([{WORDS}], lambda w: contains(upper(t), w))) > 0 THEN 'discount' WHEN regexp_matches(lower(t), '{LOOKS(f.UNIT_LOOKS)}') THEN 'unit' WHEN length(t) >= 4 AND regexp_matches(t, '\\p{{L}}') THEN 'name' ELSE 'other' END AS kind FROM (SELECT k, n, trim(COALESCE(t, '')) AS t FROM {BOXES})",
)
add(
    "n15_recorded_costs", "costs", lambda x: x.costs.select("leaflet_id", f.recorded_cost(F.col("input_tokens"), F.lit(3.15)).alias("input_cost"), f.recorded_cost(F.col("output_tokens"), F.lit(15.5)).alias("output_cost")),
    "SELECT leaflet_id, CAST(round_even(CAST(input_tokens * 315 AS DECIMAL(12,0)) * CAST(0.00000001 AS DECIMAL(9,8)), 6) AS DECIMAL(18,6)) AS input_cost, CAST(round_even(CAST(output_tokens * 155 AS DECIMAL(12,0)) * CAST(0.0000001 AS DECIMAL(9,8)), 6) AS DECIMAL(18,6)) AS output_cost FROM costs",
)
add(
    "n16_product_flags", "offers", lambda x: x.offers.select("id", F.coalesce(F.col("discounted_price") < F.col("regular_price"), F.lit(False)).alias("has_discount"), f.discount(F.col("regular_price"), F.col("discounted_price")).alias("calculated"), F.col("state").isin("N").alias("needs_review")),
    "SELECT id, COALESCE(discounted_price < regular_price, FALSE) AS has_discount, CASE WHEN regular_price > 0 AND regular_price > discounted_price THEN (regular_price - discounted_price) / regular_price * 100 END AS calculated, state = 'N' AS needs_review FROM offers",
)
RAW = """concat('{"product_name": ', CASE WHEN product_name = '' THEN 'null' ELSE concat('"', product_name, '"') END, ', "region_numbers": ', CASE quantity % 4 WHEN 0 THEN '[1, 2.7, "3", null, -4.5]' WHEN 1 THEN '"none"' WHEN 2 THEN '[]' ELSE concat('[', CAST(quantity AS STRING), ']') END,
    ', "category_alternatives": ', CASE page_number % 4 WHEN 0 THEN '["Dairy", {"name": "Bakery", "confidence": 0.25}, 7, {"confidence": 1}]' WHEN 1 THEN '"Dairy"' WHEN 2 THEN '[3, null]' ELSE 'null' END, ', "confidence_score": ', CASE page_number % 3 WHEN 0 THEN '0' WHEN 1 THEN '"0.55"' ELSE '0.9' END, '}')"""
ANSWERS = {"region_numbers": "array_join(transform(region_numbers, n -> CAST(n AS STRING)), ',')", "alternatives": "array_join(transform(alternatives, a -> concat(coalesce(a.name, '?'), ':', coalesce(CAST(a.confidence AS STRING), '-'))), ',')"}
add(
    "n5_parsed_products", "offers", lambda x: x.offers.select("id", F.try_parse_json(F.expr(RAW)).alias("answer")).where("trim(try_variant_get(answer, '$.product_name', 'string')) <> ''").select("id", *[c.alias(n) for n, c in f.parsed_product(F.col("answer")).items()]).withColumns({n: F.expr(e) for n, e in ANSWERS.items()}),
    f"""SELECT id, json_extract_string(j, '$.product_name') AS name, COALESCE(array_to_string(list_transform(list_filter(json_extract(j, '$.region_numbers[*]'), lambda v: json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE')), lambda v: CAST(CAST(trunc(CAST(v AS DOUBLE)) AS BIGINT) AS VARCHAR)), ','), '') AS region_numbers,
    CASE WHEN len(alts) > 0 THEN array_to_string(list_transform(alts, lambda v: concat(CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE COALESCE(json_extract_string(v, '$.name'), '?') END, ':', CASE WHEN json_type(v) = 'OBJECT' THEN COALESCE(CAST(CAST(json_extract_string(v, '$.confidence') AS DOUBLE) AS VARCHAR), '-') ELSE '-' END)), ',') END AS alternatives,
    COALESCE(NULLIF(TRY_CAST(json_extract_string(j, '$.confidence_score') AS DOUBLE), 0), 0.8) AS confidence FROM (SELECT id, j, list_filter(json_extract(j, '$.category_alternatives[*]'), lambda v: json_type(v) IN ('VARCHAR', 'OBJECT')) AS alts FROM (SELECT id, {RAW} AS j FROM offers)) WHERE trim(json_extract_string(j, '$.product_name')) <> ''""",
)
NAMES = list(f.ERROR_CATEGORIES)
add(
    "n17_error_categories", "audit", lambda x: x.audit.select("id", f.error_category(F.when(F.col("id") % 20 < len(NAMES), F.upper(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("id") % 20 + 1).cast("int")))).when(F.col("id") % 20 == 17, "odd")).alias("category")),
    f"SELECT id, CASE id % 20 {' '.join(f'''WHEN {i} THEN '{c}' ''' for i, c in enumerate(f.ERROR_CATEGORIES.values()))} WHEN 17 THEN 'system_error' END AS category FROM audit".replace("WHEN 16 THEN", "WHEN 99 THEN"),
)
add(
    "n18_third_price", "offers", lambda x: x.offers.select("id", *[c.alias(n) for n, c in zip(("regular", "reduced", "off"), f.third_price(F.col("regular_price"), F.col("discounted_price"), F.col("discount_percentage")), strict=True)]),
    "SELECT id, COALESCE(regular_price, CASE WHEN discount_percentage < 100 THEN discounted_price / (1 - discount_percentage / 100) END) AS regular, COALESCE(discounted_price, regular_price * (1 - discount_percentage / 100)) AS reduced, COALESCE(discount_percentage, CASE WHEN regular_price > 0 THEN (regular_price - discounted_price) / regular_price * 100 END) AS off FROM offers",
)
add(
    "n20_first_uploads", "", lambda x: x.raw("documents").select("doc_id", "source", F.sha2("text", 256).alias("digest")).withColumn("k", F.row_number().over(Window.partitionBy("source", "digest").orderBy("doc_id"))).where("k = 1").select("doc_id", "digest"),
    "SELECT doc_id, digest FROM (SELECT doc_id, digest, row_number() OVER (PARTITION BY source, digest ORDER BY doc_id) AS k FROM (SELECT doc_id, source, sha256(text) AS digest FROM documents)) WHERE k = 1",
)
add("n22_cut_texts", "", lambda x: x.raw("conversations").select("conv_id", "turn", F.substring("text", 1, 100).alias("head")), "SELECT conv_id, turn, substring(text, 1, 100) AS head FROM conversations")
add(
    "src6_answers", "", lambda x: x.raw("events").select("event_id", f.model_json(F.expr("CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('text ```json ', props, ' ``` more') WHEN 2 THEN concat('``` ', props, ' ```') WHEN 3 THEN concat('so: ', props, ' end') ELSE 'nothing' END"), "k int").alias("x")).select("event_id", "x.k"),
    "SELECT event_id, CASE WHEN event_id % 5 < 4 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events",
)

# geometry
PAIR = "FROM products a JOIN products b ON a.leaflet_id = b.leaflet_id AND a.page_number = b.page_number AND a.id <> b.id"
MEET = "GREATEST(0, LEAST(a.bbox_x + a.bbox_width, b.bbox_x + b.bbox_width) - GREATEST(a.bbox_x, b.bbox_x)) * GREATEST(0, LEAST(a.bbox_y + a.bbox_height, b.bbox_y + b.bbox_height) - GREATEST(a.bbox_y, b.bbox_y))"


def same_page(x):
    own = x.products.select("leaflet_id", "page_number", "id", F.struct(*g.BOX).alias("a"))
    return own.join(own.select("leaflet_id", "page_number", F.col("id").alias("other"), F.col("a").alias("b")), ["leaflet_id", "page_number"]).where("id <> other")


add("g1_box_facts", "products", lambda x: same_page(x).select("id", "other", g.area("a").alias("area"), g.centre_inside("a", "b").alias("inside")), f"SELECT a.id, b.id AS other, a.bbox_width * a.bbox_height AS area, a.bbox_x + a.bbox_width / 2 BETWEEN b.bbox_x AND b.bbox_x + b.bbox_width AND a.bbox_y + a.bbox_height / 2 BETWEEN b.bbox_y AND b.bbox_y + b.bbox_height AS inside {PAIR}")
add("g2_containment", "products", lambda x: same_page(x).select("id", "other", g.containment("a", "b").alias("part")), f"SELECT a.id, b.id AS other, CAST({MEET} AS DOUBLE) / CAST(a.bbox_width * a.bbox_height AS DOUBLE) AS part {PAIR}")
add(
    "g4_padded_unions", "offers", lambda x: g.padded_union(x.offers.where("bbox_x is not null"), 10, *(900, 1000), "leaflet_id", "brand"),
    """SELECT leaflet_id, brand, l AS bbox_x, t AS bbox_y, GREATEST(r - l, 50) AS bbox_width, GREATEST(b - t, 50) AS bbox_height FROM (SELECT leaflet_id, brand, GREATEST(0, MIN(bbox_x) - 10) AS l, GREATEST(0, MIN(bbox_y) - 10) AS t, LEAST(900, MAX(bbox_x + bbox_width) + 10) AS r, LEAST(1000, MAX(bbox_y + bbox_height) + 10) AS b FROM offers WHERE bbox_x IS NOT NULL GROUP BY 1, 2)""",
)
add(
    "g3_scaled_unions", "products", lambda x: g.scaled_union(x.products.withColumn("bbox_x", F.col("bbox_x") - 60), 2.48, 0.35, "leaflet_id"),
    "SELECT leaflet_id, GREATEST(0, CAST(trunc(CAST(l AS DOUBLE) * CAST(2.48 AS DOUBLE)) AS BIGINT)) AS bbox_x, GREATEST(0, CAST(trunc(CAST(t AS DOUBLE) * CAST(0.35 AS DOUBLE)) AS BIGINT)) AS bbox_y, GREATEST(1, CAST(trunc(CAST(r - l AS DOUBLE) * CAST(2.48 AS DOUBLE)) AS BIGINT)) AS bbox_width, GREATEST(1, CAST(trunc(CAST(b - t AS DOUBLE) * CAST(0.35 AS DOUBLE)) AS BIGINT)) AS bbox_height FROM (SELECT leaflet_id, MIN(bbox_x - 60) AS l, MIN(bbox_y) AS t, MAX(bbox_x - 60 + bbox_width) AS r, MAX(bbox_y + bbox_height) AS b FROM products GROUP BY 1)",
)
add("g5_equal_grid", "", lambda x: g.grid(x.spark, 2480, 3508, 3, 5, 5), "SELECT i + 1 AS cell, i % 3 * 826 + 5 AS bbox_x, i // 3 * 701 + 5 AS bbox_y, CAST(816 AS INT) AS bbox_width, CAST(691 AS INT) AS bbox_height FROM range(15) r(i)")
add(
    "g5_equal_grids", "texts", lambda x: g.equal_grids(x.texts, 3, 5, 5, "leaflet_id"),
    "SELECT leaflet_id, CAST(k + 1 AS INT) AS cell, k % 3 * w + 5 AS bbox_x, k // 3 * h + 5 AS bbox_y, w - 10 AS bbox_width, h - 10 AS bbox_height FROM (SELECT leaflet_id, MAX(bbox_x + bbox_width) // 3 AS w, MAX(bbox_y + bbox_height) // 5 AS h, unnest(range(15)) AS k FROM texts WHERE bbox_x IS NOT NULL GROUP BY 1)",
)
add("g6_even_cells", "products", lambda x: g.even_cells(x.products, "leaflet_id"), "SELECT leaflet_id, CAST(MAX(bbox_width) AS DOUBLE) / GREATEST(MIN(bbox_width), 1) <= 2.5 AND CAST(MAX(bbox_height) AS DOUBLE) / GREATEST(MIN(bbox_height), 1) <= 2.5 AS even FROM products GROUP BY 1")
add(
    "g15_grid_texts", "products", lambda x: g.grid_cells(x.products, 900, 1000, 3, 5).groupBy("leaflet_id", "page_number", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bbox_y", "bbox_x", "id", "product_name"))), lambda b: b["product_name"]), " ").alias("text")),
    """SELECT leaflet_id, page_number, CAST(LEAST(4, floor((bbox_y + bbox_height / 2) * 5 / 1000)) * 3 + LEAST(2, floor((bbox_x + bbox_width / 2) * 3 / 900)) AS INT) AS cell, string_agg(product_name, ' ' ORDER BY bbox_y, bbox_x, id) AS text FROM products GROUP BY 1, 2, 3""",
)
add(
    "g19_boxes_for_missing", "offers", lambda x: g.boxes_for_missing(x.offers, 2480, 3508),
    """, placed AS (SELECT *, row_number() OVER (PARTITION BY leaflet_id, page_number ORDER BY id) - 1 AS place FROM offers),
    pages AS (SELECT leaflet_id, page_number, COUNT(DISTINCT floor(floor(bbox_x + bbox_width / 2) / 248)) AS tenths, COUNT(*) AS n FROM offers GROUP BY 1, 2),
    laid AS (SELECT *, CAST(CASE WHEN tenths > 0 THEN tenths ELSE GREATEST(2, LEAST(4, floor(sqrt(n * CAST(1.2 AS DOUBLE))))) END AS BIGINT) AS cols FROM pages), sized AS (SELECT *, CAST(GREATEST(2, ceil(n / cols)) AS BIGINT) AS nrows FROM laid)
    SELECT id, place % cols * (2480 // cols) + 20 AS bbox_x, place // cols * (3508 // nrows) + 20 AS bbox_y, 2480 // cols - 40 AS bbox_width, 3508 // nrows - 40 AS bbox_height FROM placed JOIN sized USING (leaflet_id, page_number) WHERE bbox_x IS NULL""",
)
add(
    "g20_image_scores", "offers", lambda x: x.offers.select("id", g.image_quality(*[F.col(c).cast("double") for c in ("confidence", "category_confidence", "brand_confidence", "confidence")]).alias("quality")).withColumn("accepted", F.col("quality") >= 0.7),
    "SELECT id, q AS quality, q >= 0.7 AS accepted FROM (SELECT id, CAST(confidence AS DOUBLE) * CAST(0.3 AS DOUBLE) + CAST(category_confidence AS DOUBLE) * CAST(0.2 AS DOUBLE) + CAST(brand_confidence AS DOUBLE) * CAST(0.2 AS DOUBLE) + CAST(confidence AS DOUBLE) * CAST(0.3 AS DOUBLE) AS q FROM offers)",
)
add("a43_median_sizes", "products", lambda x: x.products.groupBy("leaflet_id").agg(F.median("bbox_width").alias("width"), F.median("bbox_height").alias("height")), "SELECT leaflet_id, median(bbox_width) AS width, median(bbox_height) AS height FROM products GROUP BY 1")

# exports
FIELD = lambda c: f"COALESCE(CAST(NULLIF({c}, 0) AS VARCHAR), '')"
add("snk1_leaflet_csv", "offers", lambda x: sinks.leaflet_rows(x.offers, "EUR", codes=True, boxes=True, validation=True), f"""SELECT CAST(leaflet_id AS VARCHAR) AS "Leaflet_ID", page_number AS "Page", COALESCE(brand, '') AS "Brand", COALESCE(product_code, '') AS "Product_Code", product_name AS "Product_Name", {FIELD("quantity")} AS "Quantity", COALESCE(units, '') AS "Units",
    NULLIF(regular_price, 0) AS "Regular_Price", NULLIF(discounted_price, 0) AS "Discounted_Price", NULLIF(discount_percentage, 0) AS "Discount_Percentage", COALESCE(NULLIF(currency, ''), 'EUR') AS "Currency", id AS "Product_ID", '' AS "Promotional_Info", COALESCE(category, '') AS "Category",
    bbox_x AS "BoundingBox_X", bbox_y AS "BoundingBox_Y", bbox_width AS "BoundingBox_Width", bbox_height AS "BoundingBox_Height", state AS "Review_Status", CASE WHEN validation_passed THEN 'True' ELSE 'False' END AS "Validation_Passed" FROM offers""")  # fmt: skip
ITEM = lambda alias: f"{{'page_number': {alias}.page_number, 'id': {alias}.id, 'product_name': {alias}.product_name}}"
add("snk2_leaflet_json", "products leaflets", lambda x: sinks.documents(x.products, x.leaflets), f"SELECT l.id, CAST(to_json({{'id': l.id, 'status': status, 'retailer': retailer, 'n_products': COALESCE(n, 0), 'products': COALESCE(products, [])}}) AS VARCHAR) AS json FROM leaflets l LEFT JOIN (SELECT leaflet_id, {CNT} AS n, list({ITEM('p')} ORDER BY page_number, p.id) AS products FROM products p GROUP BY 1) ON leaflet_id = l.id")
add("snk3_summary_sheet", "products leaflets", lambda x: sinks.summary_sheet(x.products, x.leaflets), f"SELECT l.id, status, retailer, page_count, COALESCE(n, 0) AS products, COALESCE(reduced, 0) AS reduced FROM leaflets l LEFT JOIN (SELECT leaflet_id, {CNT} AS n, CAST(COUNT(discounted_price) AS BIGINT) AS reduced FROM products GROUP BY 1) ON leaflet_id = l.id")
add("snk3_statistics_sheet", "products", lambda x: sinks.statistics_sheet(x.products), f"SELECT leaflet_id, page_number, {CNT} AS n FROM products GROUP BY 1, 2")
add(
    "snk3_products_sheet", "offers", lambda x: sinks.products_sheet(x.offers, "EUR"),
    f"""SELECT leaflet_id, id, page_number AS "Page", COALESCE(brand, '') AS "Brand", COALESCE(product_code, '') AS "Product Code", product_name AS "Product Name", NULLIF(quantity, 0) AS "Quantity", COALESCE(units, '') AS "Units", NULLIF(regular_price, 0) AS "Regular Price", NULLIF(discounted_price, 0) AS "Discounted Price", NULLIF(discount_percentage, 0) AS "Discount %",
    COALESCE(NULLIF(currency, ''), 'EUR') AS "Currency", '' AS "Product ID", '' AS "Promotional Info", COALESCE(category, '') AS "Category", printf('%.1f%%', COALESCE(CAST(confidence AS DOUBLE), 0) * 100) AS "Confidence", COALESCE(state, '') AS "Status", CASE WHEN validation_passed THEN 'Yes' ELSE 'No' END AS "Validated" FROM offers""",
)
add(
    "snk3_brands_sheet", "offers", lambda x: sinks.brands_sheet(x.offers),
    f"SELECT leaflet_id, brand, n, CAST(k AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY leaflet_id ORDER BY n DESC, page, first) AS k FROM (SELECT leaflet_id, COALESCE(NULLIF(brand, ''), 'Unknown') AS brand, {CNT} AS n, MIN(page_number) AS page, arg_min(id, (page_number, id)) AS first FROM offers GROUP BY 1, 2)) WHERE k <= 10",
)
add("snk5_product_json", "offers", lambda x: sinks.json_lines(x.offers), "SELECT id, CAST(to_json({'id': id, 'leaflet_id': leaflet_id, 'page': page_number, 'brand': brand, 'name': product_name, 'code': product_code, 'currency': currency}) AS VARCHAR) AS json FROM offers")
add("snk7_audit_export", "audit", lambda x: sinks.audit_export(x.audit), "SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, event_type, status, CAST(organization_id AS VARCHAR) AS organization_id, CAST(user_id AS VARCHAR) AS user_id, CAST(cost AS VARCHAR) AS cost FROM audit ORDER BY audit.created_at DESC, id LIMIT 10000")
add(
    "snk8_bulk_export", "products", lambda x: sinks.bulk(x.products, [5, 7, 99_999_999, 11]), f"SELECT v.leaflet_id, COALESCE(n, 0) AS products, CASE WHEN n IS NULL THEN 'not found' END AS error FROM (VALUES (5), (7), (99999999), (11)) v(leaflet_id) LEFT JOIN (SELECT leaflet_id, {CNT} AS n FROM products GROUP BY 1) p ON p.leaflet_id = v.leaflet_id",
)
add(
    "snk9_usage_csv", "audit organizations", lambda x: sinks.usage_rows(x.audit, x.organizations),
    f"SELECT COALESCE(name, 'Unknown') AS organization, CAST(usage_date AS VARCHAR) AS day, {CNT} AS requests, CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(SUM(cost) AS VARCHAR) AS cost FROM audit LEFT JOIN organizations o ON o.id = organization_id GROUP BY 1, 2",
)
for kind, per_row in sinks.ROW_BYTES.items():
    size = "n * {0}"
    add(
        f"snk12_{kind}_sizes", "products", lambda x, kind=kind: x.products.groupBy("leaflet_id").agg((F.count("*") * 1000).alias("n")).select("leaflet_id", *[f.size_label(sinks.estimated_bytes(F.col("n"), kind, images)).alias(images) for images in sinks.IMAGES]),
        "SELECT leaflet_id, " + ", ".join(f"CASE WHEN n * {b} < 1024 THEN printf('%.1f B', CAST(n * {b} AS DOUBLE)) WHEN n * {b} < 1048576 THEN printf('%.1f KB', n * {b} / 1024.0) WHEN n * {b} < 1073741824 THEN printf('%.1f MB', CAST(n * {b} AS DOUBLE) / 1048576) ELSE printf('%.1f GB', CAST(n * {b} AS DOUBLE) / 1073741824) END AS {i}" for i, b in zip(sinks.IMAGES, per_row, strict=True)) + f" FROM (SELECT leaflet_id, {CNT} * 1000 AS n FROM products GROUP BY 1)",
    )

# orders and filters
add("s3_export_order", "products", lambda x: s.numbered(x.products.select("id", "created_at"), s.key("created_at", "desc"), s.key("id", "desc")).select("id", "place"), "SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM products")
add("s4_page_order", "products", lambda x: x.products.select("id", F.row_number().over(Window.partitionBy("leaflet_id").orderBy("page_number", "bbox_y", "id")).alias("place")), "SELECT id, CAST(row_number() OVER (PARTITION BY leaflet_id ORDER BY page_number, bbox_y, id) AS INT) AS place FROM products")
add("s8_queue", "products", lambda x: s.top(x.products, 50, "review_priority", "id").select("id", (100 - F.col("review_priority")).alias("score")), "SELECT id, 100 - review_priority AS score FROM products ORDER BY score, id LIMIT 50")
add("s10_client_sort", "", lambda x: s.client_numbered(boxes(x), "t", "k", "n").select("k", "n", "place"), f"SELECT k, n, row_number() OVER (ORDER BY TRY_CAST(t AS DOUBLE) IS NULL, TRY_CAST(t AS DOUBLE), COALESCE(t, ''), k, n) AS place FROM {BOXES}")
add("p5_by_human_id", "products leaflets", lambda x: p.by_human_id(x.products, x.leaflets.withColumn("leaflet_id", F.concat(F.lit("LEAF_"), "id")), "LEAF_7").select("id"), "SELECT id FROM products WHERE leaflet_id IN (SELECT id FROM leaflets WHERE concat('LEAF_', CAST(id AS STRING)) = 'LEAF_7')")
add("p8_json_search", "", lambda x: x.raw("events").where(p.contains_any("Click", "event_type") | F.col("props").ilike("%: 42}%")).select("event_id"), "SELECT event_id FROM events WHERE event_type ILIKE '%Click%' OR props ILIKE '%: 42}%'")
add("p14_product_search", "offers", lambda x: x.offers.where(p.contains_any("sku-1", "product_name", "brand", "product_code")).select("id"), "SELECT id FROM offers WHERE product_name ILIKE '%sku-1%' OR brand ILIKE '%sku-1%' OR product_code ILIKE '%sku-1%'")
LEVEL = "CASE WHEN id % 3 = 0 THEN 'warning' ELSE status END"
add(
    "p10_preferences_after_paging", "audit", lambda x: p.preferred(x.audit.orderBy(F.desc("created_at"), "id").limit(100).withColumn("level", F.expr(LEVEL)), "event_type", ["click", "signup"], "level").select("id"),
    f"SELECT id FROM (SELECT *, {LEVEL} AS level FROM (SELECT * FROM audit ORDER BY created_at DESC, id LIMIT 100)) WHERE event_type IN ('click', 'signup') AND level <> 'success'",
)
add("p11_export_modes", "products", lambda x: p.export_scope(x.products, "filtered", organization_id=4, review_status=["approved"]).agg(F.count("*").alias("filtered")).crossJoin(p.export_scope(x.products, "all").agg(F.count("*").alias("everything"))), f"SELECT (SELECT {CNT} FROM products WHERE organization_id = 4 AND review_status = 'approved') AS filtered, (SELECT {CNT} FROM products) AS everything")
for op, value, sql in (("equals", "cold rod", "product_name = 'cold rod'"), ("ends_with", "Bolt", "ends_with(lower(product_name), 'bolt')"), ("less_than", "c", "product_name < 'c'"), ("in", ["cold rod", "red rod"], "product_name IN ('cold rod', 'red rod')")):
    add(f"p12_{op}", "products", lambda x, op=op, value=value: x.products.where(p.client_filters([("product_name", op, value)])).select("id"), f"SELECT id FROM products WHERE {sql}")
add("p9_live_messages", "audit", lambda x: x.audit.where(p.live("created_at", F.to_timestamp_ntz(F.lit("2024-01-20")), F.col("id") % 3 == 0, F.col("id") % 5 == 0)).select("id"), "SELECT id FROM audit WHERE created_at > TIMESTAMP '2024-01-20' AND id % 3 <> 0 AND id % 5 <> 0")


SIDE = "GREATEST(0, LEAST(a.bbox_{0} + a.bbox_{1}, b.bbox_{0} + b.bbox_{1}) - GREATEST(a.bbox_{0}, b.bbox_{0}))"
add(
    "g13_best_region", "products",
    lambda x: g.best_region(x.products, g.union_of_boxes(x.products.where("review_priority > 50"), "leaflet_id", "page_number").withColumn("region", F.col("page_number")).drop("page_number"), "leaflet_id").select("id", "region"),
    f""", regions AS (SELECT leaflet_id, page_number AS region, MIN(bbox_x) AS bbox_x, MIN(bbox_y) AS bbox_y, MAX(bbox_x + bbox_width) - MIN(bbox_x) AS bbox_width, MAX(bbox_y + bbox_height) - MIN(bbox_y) AS bbox_height FROM products WHERE review_priority > 50 GROUP BY 1, 2),
    parts AS (SELECT a.id, region, CAST({SIDE.format('x', 'width')} * {SIDE.format('y', 'height')} AS DOUBLE) / CAST(a.bbox_width * a.bbox_height AS DOUBLE) AS part FROM products a JOIN regions b USING (leaflet_id)),
    best AS (SELECT id, region FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part DESC, region) AS k FROM parts WHERE part > 0.1) WHERE k = 1) SELECT id, region FROM products LEFT JOIN best USING (id)""",
)
HINTS = "CASE leaflet_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Top left' WHEN 2 THEN 'bottom right' WHEN 3 THEN 'middle' WHEN 4 THEN 'second row, left' WHEN 5 THEN 'Third' WHEN 6 THEN '' WHEN 7 THEN 'bottom center' ELSE 'page' END"
HAS = lambda word: f"contains(lower(hint), '{word}')"
add(
    "g18_hinted_boxes", "products",
    lambda x: x.products.select("id", F.expr(HINTS).alias("hint"), (F.row_number().over(Window.partitionBy("leaflet_id").orderBy("page_number", "id")) - 1).alias("place"), F.count("*").over(Window.partitionBy("leaflet_id")).alias("n")).select("id", *g.hinted_box(F.col("hint"), F.col("place"), F.col("n"), 2480, 3508)),
    f""", placed AS (SELECT id, {HINTS} AS hint, row_number() OVER (PARTITION BY leaflet_id ORDER BY page_number, id) - 1 AS place, GREATEST(3, (COUNT(*) OVER (PARTITION BY leaflet_id) + 2) // 3) AS nrows FROM products),
    named AS (SELECT *, CASE WHEN COALESCE(hint, '') = '' THEN place % 3 WHEN {HAS('second')} AND NOT {HAS('row')} THEN 1 WHEN {HAS('third')} AND NOT {HAS('row')} THEN 2 WHEN {HAS('left')} THEN 0 WHEN {HAS('center')} OR {HAS('middle')} THEN 1 WHEN {HAS('right')} THEN 2 ELSE 0 END AS c,
    CASE WHEN COALESCE(hint, '') = '' THEN place // 3 WHEN {HAS('second')} AND {HAS('row')} THEN 1 WHEN {HAS('third')} AND {HAS('row')} THEN 2 WHEN {HAS('top')} THEN 0 WHEN {HAS('bottom')} THEN nrows - 1 WHEN {HAS('middle')} THEN nrows // 2 ELSE 0 END AS r FROM placed)
    SELECT id, CAST(c * 826 + 20 AS BIGINT) AS bbox_x, CAST(r * (3508 // nrows) + 20 AS BIGINT) AS bbox_y, CAST(GREATEST(100, 826 - 40) AS BIGINT) AS bbox_width, CAST(GREATEST(100, 3508 // nrows - 40) AS BIGINT) AS bbox_height FROM named""",
)
