"""Queries over text functions, rules, reconciling, routing and geometry, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as f
from ..operators import geometry as g
from ..operators import reconcile as r
from .dashboards import CNT, add



PRICE = "COALESCE(NULLIF(discounted_price, 0), regular_price, 0)"
NAME = "trim(regexp_replace(lower(product_name), '\\s+', ' ', 'g'))"

add("n3_discount", "products", lambda x: x.products.select("id", f.discount(F.col("regular_price"), F.col("discounted_price")).alias("off")), "SELECT id, CASE WHEN regular_price > 0 AND regular_price > discounted_price THEN (regular_price - discounted_price) / regular_price * 100 END AS off FROM products")
add(
    "n8_key_words", "products", lambda x: x.products.select(F.explode(f.key_words(f.compared_name(F.col("product_name"), F.col("brand")))).alias("word")).groupBy("word").agg(F.count("*").alias("n")),
    f"SELECT word, {CNT} AS n FROM (SELECT unnest(list_distinct(list_filter(string_split({NAME}, ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'ili', 'sa', 'od', 'za')))) AS word FROM products) GROUP BY word",
)
add(
    "n14_token_cost", "costs", lambda x: x.costs.select("leaflet_id", f.token_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(None).cast("double"), F.lit(12.5)).alias("cost")),
    "SELECT leaflet_id, CAST(CAST(input_tokens * 30 + output_tokens * 125 AS DECIMAL(18,0)) * CAST(0.0000001 AS DECIMAL(8,7)) AS DECIMAL(20,8)) AS cost FROM costs",
)
add("n21_image_place", "products", lambda x: x.products.select("id", f.image_place(F.col("bbox_width") * F.col("bbox_height") * 8, "row", True).alias("place")), "SELECT id, CASE WHEN bbox_width * bbox_height * 8 < 200000 THEN 'base64' ELSE 'cdn' END AS place FROM products")
add("src3_natural_order", "products", lambda x: x.products.select(f.natural_key(F.concat(F.lit("Page"), "page_number", F.lit("_"), "leaflet_id", F.lit(".png"))).alias("k")).distinct(), "SELECT DISTINCT concat('page', lpad(CAST(page_number AS STRING), 12, '0'), '_', lpad(CAST(leaflet_id AS STRING), 12, '0'), '.png') AS k FROM products")
SPLIT = "list_distinct(string_split(lower({0}.product_name), ' '))"
add(
    "j13_overlapping_boxes", "products", lambda x: r.overlapping(x.products),
    """SELECT a.leaflet_id, a.page_number, a.id AS first_id, b.id AS second_id FROM products a JOIN products b ON a.leaflet_id = b.leaflet_id AND a.page_number = b.page_number AND a.id < b.id
    WHERE a.bbox_x <= b.bbox_x + b.bbox_width AND b.bbox_x <= a.bbox_x + a.bbox_width AND a.bbox_y <= b.bbox_y + b.bbox_height AND b.bbox_y <= a.bbox_y + a.bbox_height""",
)
add(
    "j14_new_only", "products", lambda x: r.new_only(x.products.where("page_number > 3"), x.products.where("page_number <= 3")).select("id"),
    f"""SELECT id FROM products a WHERE page_number > 3 AND NOT EXISTS (SELECT 1 FROM products b WHERE b.leaflet_id = a.leaflet_id AND b.page_number <= 3 AND (lower(a.product_name) = lower(b.product_name)
    OR length(list_intersect({SPLIT.format("a")}, {SPLIT.format("b")})) >= 0.5 * LEAST(length({SPLIT.format("a")}), length({SPLIT.format("b")}))))""",
)
add(
    "g2_iou", "products", lambda x: g.pair_iou(r.overlapping(x.products), x.products).select("first_id", "second_id", "iou"),
    """SELECT first_id, second_id, CASE WHEN i = 0 THEN 0.0 ELSE CAST(i AS DOUBLE) / CAST(s - i AS DOUBLE) END AS iou FROM (SELECT a.id AS first_id, b.id AS second_id, a.bbox_width * a.bbox_height + b.bbox_width * b.bbox_height AS s,
    GREATEST(0, LEAST(a.bbox_x + a.bbox_width, b.bbox_x + b.bbox_width) - GREATEST(a.bbox_x, b.bbox_x)) * GREATEST(0, LEAST(a.bbox_y + a.bbox_height, b.bbox_y + b.bbox_height) - GREATEST(a.bbox_y, b.bbox_y)) AS i
    FROM products a JOIN products b ON a.leaflet_id = b.leaflet_id AND a.page_number = b.page_number AND a.id < b.id WHERE a.bbox_x <= b.bbox_x + b.bbox_width AND b.bbox_x <= a.bbox_x + a.bbox_width AND a.bbox_y <= b.bbox_y + b.bbox_height AND b.bbox_y <= a.bbox_y + a.bbox_height)""",
)
add(
    "g3_box_union", "products", lambda x: g.union_of_boxes(x.products, "leaflet_id", "page_number"),
    """SELECT leaflet_id, page_number, MIN(bbox_x) AS bbox_x, MIN(bbox_y) AS bbox_y, MAX(bbox_x + bbox_width) - MIN(bbox_x) AS bbox_width, MAX(bbox_y + bbox_height) - MIN(bbox_y) AS bbox_height FROM products GROUP BY 1, 2""",
)
add(
    "g15_grid_cells", "products", lambda x: g.grid_cells(x.products, 900, 1000, 3, 5).groupBy("leaflet_id", "page_number", "cell").agg(F.count("*").alias("n")),
    f"""SELECT leaflet_id, page_number, CAST(LEAST(4, floor((bbox_y + bbox_height / 2) * 5 / 1000)) * 3 + LEAST(2, floor((bbox_x + bbox_width / 2) * 3 / 900)) AS INT) AS cell, {CNT} AS n FROM products GROUP BY 1, 2, 3""",
)
