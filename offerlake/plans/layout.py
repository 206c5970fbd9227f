"""Queries over the layout of a leaflet's sheet: products matched to regions, texts clustered, boxes merged, dividers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as f
from ..operators import geometry as g
from ..operators import matching as m
from ..operators import regions as r
from .dashboards import add
from .more import LOOKS, WORDS

LOW = "lower(COALESCE({0}, ''))"
BARE = "regexp_replace({0}, '[\\s\\-]', '', 'g')"
SHOWN = "COALESCE(NULLIF(discounted_price, 0), NULLIF(regular_price, 0))"
FIXED = f"CAST(CAST(round(CAST({SHOWN} AS DECIMAL(18, 9)), 2) AS DECIMAL(18, 2)) AS VARCHAR)"
LONGER = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: length(w) > {1})"
SEARCHED = f"list_distinct({LONGER.format("trim(concat(brand_low, ' ', name_low))", 2)})"
PRICED = " OR ".join(f"contains(read, {t})" for t in (f"CAST({SHOWN} AS VARCHAR)", f"replace(CAST({SHOWN} AS VARCHAR), '.', ',')", f"replace(CAST({SHOWN} AS VARCHAR), '.', '')", FIXED, f"replace({FIXED}, '.', ',')"))
POINTS = f"""CASE WHEN length(code_low) >= 3 AND contains({BARE.format("read")}, {BARE.format("code_low")}) THEN CAST(0.6 AS DOUBLE) ELSE 0 END + CASE WHEN {PRICED} THEN CAST(0.4 AS DOUBLE) ELSE 0 END
    + GREATEST(CAST(length(list_intersect({SEARCHED}, {LONGER.format("read", 2)})) AS DOUBLE) / GREATEST(length({SEARCHED}), 1), CASE WHEN length(name_low) > 3 THEN CAST(length(list_filter({LONGER.format("name_low", 3)}, lambda w: contains(read, w))) AS DOUBLE) / GREATEST(length({LONGER.format("name_low", 3)}), 1) ELSE 0 END) * CAST(0.8 AS DOUBLE)
    + CASE WHEN quantity <> 0 AND unit_low <> '' AND (contains(read, concat(CAST(quantity AS VARCHAR), unit_low)) OR contains(read, concat(CAST(quantity AS VARCHAR), ' ', unit_low))) THEN CAST(0.1 AS DOUBLE) ELSE 0 END"""


def _walk(name: str, pairs: str) -> str:
    """Picks of each leaflet, product after product; pairs has leaflet_id, page_number, id, region, score."""
    return f"""{name}_turns AS (SELECT *, row_number() OVER (PARTITION BY leaflet_id ORDER BY page_number, id) AS k FROM (SELECT leaflet_id, page_number, id, list({{'region': region, 'score': score}} ORDER BY score DESC, region) AS wishes FROM {pairs} GROUP BY 1, 2, 3)),
    {name}_walk AS (SELECT leaflet_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS STRUCT(region VARCHAR, score DOUBLE)) AS pick FROM {name}_turns WHERE k = 1
    UNION ALL SELECT leaflet_id, k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.region) END, id, pick FROM (SELECT w.leaflet_id, t.k, taken, t.id, list_filter(wishes, lambda x: NOT list_contains(taken, x.region))[1] AS pick FROM {name}_walk w JOIN {name}_turns t ON t.leaflet_id = w.leaflet_id AND t.k = w.k + 1)),
    {name} AS (SELECT leaflet_id, id, pick.region AS region, pick.score AS score FROM {name}_walk WHERE pick IS NOT NULL)"""


def _placed(products: str, regions: str) -> str:
    """Both passes by place, as subqueries."""
    side = "GREATEST(0, LEAST(a.bbox_{0} + a.bbox_{1}, b.bbox_{0} + b.bbox_{1}) - GREATEST(a.bbox_{0}, b.bbox_{0}))"
    both = f"CAST({side.format('x', 'width')} * {side.format('y', 'height')} AS DOUBLE)"
    inside = "a.bbox_x + a.bbox_width / 2 BETWEEN b.bbox_x AND b.bbox_x + b.bbox_width AND a.bbox_y + a.bbox_height / 2 BETWEEN b.bbox_y AND b.bbox_y + b.bbox_height"
    return f"""met AS (SELECT a.leaflet_id, page_number, id, region, {both} / (a.bbox_width * a.bbox_height + b.bbox_width * b.bbox_height - {both}) + CASE WHEN {inside} THEN CAST(0.3 AS DOUBLE) ELSE 0 END AS score FROM {products} a JOIN {regions} b USING (leaflet_id)),
    near AS (SELECT * FROM met WHERE score > 0.05), {_walk("placed", "near")},
    gaps AS (SELECT leaflet_id, CASE WHEN COUNT(*) > 1 THEN GREATEST(CAST(50 AS DOUBLE), CAST(MAX(bbox_y) - MIN(bbox_y) AS DOUBLE) / GREATEST(1, COUNT(DISTINCT bbox_y) - 1) * CAST(0.4 AS DOUBLE)) ELSE 300 END AS gap FROM {regions} GROUP BY 1),
    rest_regions AS (SELECT leaflet_id, region, row_number() OVER (PARTITION BY leaflet_id ORDER BY floor(bbox_y / gap), bbox_x, region) AS k FROM {regions} JOIN gaps USING (leaflet_id) WHERE region NOT IN (SELECT region FROM placed)),
    rest_products AS (SELECT leaflet_id, id, row_number() OVER (PARTITION BY leaflet_id ORDER BY page_number, id) AS k FROM {products} WHERE id NOT IN (SELECT id FROM placed)),
    by_place AS (SELECT leaflet_id, id, region, LEAST(score, CAST(0.85 AS DOUBLE)) AS score, 'visual_iou_match' AS source FROM placed UNION ALL SELECT p.leaflet_id, id, region, CAST(0.5 AS DOUBLE), 'visual_position_match' FROM rest_products p JOIN rest_regions USING (leaflet_id, k))"""


SHEETS = f""", sheets AS (SELECT DISTINCT * FROM regions), goods AS (SELECT DISTINCT * FROM offers),
    pairs AS (SELECT p.leaflet_id, page_number, p.id, region, {LOW.format("text")} AS read, {LOW.format("product_code")} AS code_low, {LOW.format("product_name")} AS name_low, {LOW.format("brand")} AS brand_low, {LOW.format("units")} AS unit_low, discounted_price, regular_price, quantity FROM goods p JOIN sheets r USING (leaflet_id) WHERE trim(COALESCE(text, '')) <> ''),
    told AS (SELECT * FROM (SELECT *, {POINTS} AS score FROM pairs) WHERE score >= 0.35), {_walk("texted", "told")}"""


def _sheets(x):
    return [df.distinct() for df in x.gathered("offers", "regions")]


add("j15_exclusive_match", "offers regions", lambda x: m.by_text(*_sheets(x), "leaflet_id").select("leaflet_id", F.col("turn.id").alias("id"), "region", "score"), SHEETS + " SELECT * FROM texted")
add("g17_position_match", "offers regions", lambda x: m.by_place(*_sheets(x), "leaflet_id").select("leaflet_id", F.col("turn.id").alias("id"), "region", "score", "source"), f", sheets AS (SELECT DISTINCT * FROM regions), goods AS (SELECT DISTINCT * FROM offers), {_placed('goods', 'sheets')} SELECT * FROM by_place")
add(
    "j15_g16_matched_regions", "offers regions", lambda x: m.match_regions(*_sheets(x), "leaflet_id").select("id", "region", "score", "source"),
    SHEETS + f""", free AS (SELECT * FROM sheets WHERE region NOT IN (SELECT region FROM texted)), still AS (SELECT * FROM goods WHERE id NOT IN (SELECT id FROM texted)), {_placed('still', 'free')},
    pages AS (SELECT leaflet_id, bool_or(trim(COALESCE(text, '')) <> '') AS has_text FROM sheets GROUP BY 1), every AS (SELECT *, 'ocr_text_match' AS source FROM texted UNION ALL SELECT * FROM by_place)
    SELECT p.id, region, score, COALESCE(source, CASE WHEN has_text THEN 'vlm_estimated' WHEN has_text IS NOT NULL THEN 'no_match' END) AS source FROM goods p LEFT JOIN every e ON e.id = p.id LEFT JOIN pages g ON g.leaflet_id = p.leaflet_id""",
)

# columns, rows and cells: the sheet's width and height are 1,000
def _edges(place: str, size: str) -> str:
    return f"list_sort(flatten(list([{place}, {place} + {size}])))"


def _gaps(edges: str, least: int) -> str:
    return f"list_filter(list_transform(range(1, len({edges})), lambda i: {{'cost': {edges}[i] - {edges}[i + 1], 'at': {edges}[i], 'next': {edges}[i + 1]}}), lambda g: -g.cost > {least})"


def _between(gaps: str, size: int, least: int, padding: int = 0) -> str:
    found = f"""list_filter(list_transform(range(1, len({gaps}) + 2), lambda i: {{'start': CASE WHEN i = 1 THEN 0 ELSE {gaps}[i - 1].next - {padding} END, 'stop': CASE WHEN i > len({gaps}) THEN {size} ELSE {gaps}[i].at END, 'pad': CASE WHEN i > len({gaps}) THEN 0 ELSE {padding} END}}), lambda r: r.stop - r.start > {least})"""
    made = f"list_transform({found}, lambda r: {{'start': CAST(r.start AS BIGINT), 'stop': CAST(r.stop + r.pad AS BIGINT)}})"
    return f"CASE WHEN len({made}) > 0 THEN {made} ELSE [{{'start': CAST(0 AS BIGINT), 'stop': CAST({size} AS BIGINT)}}] END"


def _sheets_sql(table: str) -> str:
    return f"""edges AS (SELECT leaflet_id, {_edges('bbox_x', 'bbox_width')} AS across, {_edges('bbox_y', 'bbox_height')} AS down FROM {table} WHERE bbox_x IS NOT NULL GROUP BY 1),
    gaps AS (SELECT leaflet_id, {_gaps('across', 30)} AS a, {_gaps('down', 40)} AS d FROM edges), largest AS (SELECT leaflet_id, len(a) AS n, list_sort(list_transform(list_sort(a)[1:5], lambda g: {{'at': g.at, 'next': g.next}})) AS a, d FROM gaps),
    laid AS (SELECT leaflet_id, CASE WHEN n < 2 THEN [{{'start': CAST(0 AS BIGINT), 'stop': CAST(500 AS BIGINT)}}, {{'start': CAST(500 AS BIGINT), 'stop': CAST(1000 AS BIGINT)}}] ELSE {_between('a', 1000, 120)} END AS columns, {_between('d', 1000, 150, 10)} AS nrows FROM largest)"""


PLACE = "CAST(COALESCE(list_position(list_transform({0}, lambda r: r.start <= {1} AND {1} < r.stop), TRUE) - 1, 0) AS INT)"
CELLS = f"SELECT p.*, columns, nrows, {PLACE.format('columns', 'p.bbox_x + p.bbox_width / 2')} AS at_column, {PLACE.format('nrows', 'p.bbox_y + p.bbox_height / 2')} AS at_row FROM {{0}} p LEFT JOIN laid USING (leaflet_id)"


for _name, _column in (("columns", "columns"), ("rows", "nrows")):
    add(
        f"g8_{_name}_by_gaps", "products", lambda x, name=_name: g.layout(x.products, 1000, 1000, "leaflet_id").select("leaflet_id", F.explode(name).alias("r")).select("leaflet_id", "r.*"),
        f", {_sheets_sql('products')} SELECT leaflet_id, r.start, r.stop FROM (SELECT leaflet_id, unnest({_column}) AS r FROM laid)",
    )
add(
    "g9_cells_by_ranges", "products", lambda x: g.cells_by_ranges(x.products, g.layout(x.products, 1000, 1000, "leaflet_id"), "leaflet_id").select("id", F.col("column").alias("at_column"), F.col("row").alias("at_row")),
    f", {_sheets_sql('products')} SELECT id, at_column, at_row FROM ({CELLS.format('products')})",
)


# boxes that grow: box after box, the regions so far are the state
def _grown(order: str, joins: str) -> str:
    """joins speaks of a region g (own sides l, t, r, b, those of its first box sl to sb) and the sides l, t, r, b of a box."""
    return f""", numbered AS (SELECT leaflet_id, id, bbox_x AS l, bbox_y AS t, bbox_x + bbox_width AS r, bbox_y + bbox_height AS b, row_number() OVER (PARTITION BY leaflet_id ORDER BY {order}) AS k FROM products),
    walk AS (SELECT leaflet_id, k, [{{'first': id, 'n': CAST(1 AS BIGINT), 'sl': l, 'st': t, 'sr': r, 'sb': b, 'l': l, 't': t, 'r': r, 'b': b}}] AS kept FROM numbered WHERE k = 1 UNION ALL
    SELECT leaflet_id, k, CASE WHEN spot IS NULL THEN list_append(kept, {{'first': id, 'n': CAST(1 AS BIGINT), 'sl': l, 'st': t, 'sr': r, 'sb': b, 'l': l, 't': t, 'r': r, 'b': b}})
    ELSE list_transform(kept, lambda g, i: CASE WHEN i = spot THEN {{'first': g.first, 'n': g.n + 1, 'sl': g.sl, 'st': g.st, 'sr': g.sr, 'sb': g.sb, 'l': LEAST(g.l, l), 't': LEAST(g.t, t), 'r': GREATEST(g.r, r), 'b': GREATEST(g.b, b)}} ELSE g END) END AS kept
    FROM (SELECT w.leaflet_id, n.k, kept, n.id, n.l, n.t, n.r, n.b, list_position(list_transform(kept, lambda g: {joins}), TRUE) AS spot FROM walk w JOIN numbered n ON n.leaflet_id = w.leaflet_id AND n.k = w.k + 1)),
    ended AS (SELECT w.leaflet_id, unnest(kept) AS g FROM walk w JOIN (SELECT leaflet_id, MAX(k) AS k FROM numbered GROUP BY 1) USING (leaflet_id, k))
    SELECT leaflet_id, g.first AS first, g.n AS n, g.l AS bbox_x, g.t AS bbox_y, g.r - g.l AS bbox_width, g.b - g.t AS bbox_height FROM ended"""


SHARED = "CAST(GREATEST(0, LEAST(g.sr, n.r) - GREATEST(g.sl, n.l)) * GREATEST(0, LEAST(g.sb, n.b) - GREATEST(g.st, n.t)) AS DOUBLE)"
add("g22_overlap_merged", "products", lambda x: r.overlap_merged(x.products, "leaflet_id").drop("nth"), _grown("id", f"{SHARED} / ((g.sr - g.sl) * (g.sb - g.st) + (n.r - n.l) * (n.b - n.t) - {SHARED}) > 0.5"))
add("g14_near_merged", "products", lambda x: r.near_merged(x.products, "leaflet_id").drop("nth"), _grown("bbox_y, bbox_x, id", "GREATEST(g.l, n.l) - LEAST(g.r, n.r) <= 50 AND GREATEST(g.t, n.t) - LEAST(g.b, n.b) <= 50"))


# clusters around prices: price after price, then what is left, box after box
KIND = f"CASE WHEN regexp_matches(t, '{LOOKS(f.PRICE_LOOKS)}') THEN 'price' WHEN regexp_matches(t, '{LOOKS(f.DISCOUNT_LOOKS)}') OR length(list_filter([{WORDS}], lambda w: contains(upper(t), w))) > 0 THEN 'discount' WHEN regexp_matches(lower(t), '{LOOKS(f.UNIT_LOOKS)}') THEN 'unit' WHEN length(t) >= 4 AND regexp_matches(t, '\\p{{L}}') THEN 'name' ELSE 'other' END"
CELL = "leaflet_id, at_column, at_row"
WIDER = "{{'members': list_append(g.members, {0}.no), 'l': LEAST(g.l, {0}.l), 't': LEAST(g.t, {0}.t), 'r': GREATEST(g.r, {0}.r), 'b': GREATEST(g.b, {0}.b)}}"
CLUSTERS = f""", {_sheets_sql('texts')}, celled AS (SELECT *, {KIND} AS kind, row_number() OVER (PARTITION BY {CELL} ORDER BY bbox_y, bbox_x, id) AS no FROM (SELECT *, trim(COALESCE(text, '')) AS t FROM ({CELLS.format('texts')}) WHERE bbox_x IS NOT NULL)),
    boxed AS (SELECT {CELL}, list({{'no': no, 'id': id, 'text': COALESCE(text, ''), 'kind': kind, 'l': bbox_x, 't': bbox_y, 'r': bbox_x + bbox_width, 'b': bbox_y + bbox_height}} ORDER BY no) AS boxes, any_value(columns)[at_column + 1] AS across, any_value(nrows)[at_row + 1] AS down FROM celled GROUP BY {CELL}),
    many AS (SELECT *, list_filter(boxes, lambda x: x.kind = 'price') AS prices FROM boxed WHERE len(list_filter(boxes, lambda x: x.kind = 'price')) > 1),
    priced AS (SELECT {CELL}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST([] AS STRUCT(members BIGINT[], l BIGINT, t BIGINT, r BIGINT, b BIGINT)[]) AS clusters FROM many
    UNION ALL SELECT {CELL}, k + 1, list_concat(used, members), list_append(clusters, {{'members': members, 'l': list_min(list_transform(members, lambda i: boxes[i].l)), 't': list_min(list_transform(members, lambda i: boxes[i].t)), 'r': list_max(list_transform(members, lambda i: boxes[i].r)), 'b': list_max(list_transform(members, lambda i: boxes[i].b))}})
    FROM (SELECT *, list_concat(core, list_transform(list_filter(boxes, lambda x: x.kind NOT IN ('price', 'name') AND NOT list_contains(used, x.no) AND (x.t + x.b) / 2 BETWEEN list_min(list_transform(core, lambda i: boxes[i].t)) - 30 AND list_max(list_transform(core, lambda i: boxes[i].b)) + 30), lambda x: x.no)) AS members
    FROM (SELECT *, CASE WHEN near IS NULL THEN [price.no] ELSE [price.no, near.no] END AS core FROM (SELECT *, list_sort(list_transform(list_filter(boxes, lambda x: x.kind = 'name' AND NOT list_contains(used, x.no) AND x.t <= price.b), lambda x: {{'far': abs(x.t - price.t), 'no': x.no}}))[1] AS near
    FROM (SELECT p.*, boxes, prices[k + 1] AS price FROM priced p JOIN many USING ({CELL}) WHERE k < len(prices)))))),
    rests AS (SELECT {CELL}, clusters, list_filter(boxes, lambda x: NOT list_contains(used, x.no)) AS rest FROM priced JOIN many USING ({CELL}) WHERE k = len(prices)),
    joined AS (SELECT {CELL}, CAST(0 AS BIGINT) AS k, rest, clusters FROM rests UNION ALL
    SELECT {CELL}, k + 1, rest, CASE WHEN near.far < 100 THEN list_transform(clusters, lambda g, i: CASE WHEN i = near.no THEN {WIDER.format('x')} ELSE g END) ELSE clusters END
    FROM (SELECT *, list_sort(list_transform(clusters, lambda g, i: {{'far': sqrt(((x.l + x.r) / 2 - (g.l + g.r) / 2) * ((x.l + x.r) / 2 - (g.l + g.r) / 2) + ((x.t + x.b) / 2 - (g.t + g.b) / 2) * ((x.t + x.b) / 2 - (g.t + g.b) / 2)), 'no': i}}))[1] AS near FROM (SELECT *, rest[k + 1] AS x FROM joined WHERE k < len(rest)))),
    lists AS (SELECT {CELL}, list_transform(clusters, lambda g: g.members) AS lists FROM joined WHERE k = len(rest) UNION ALL SELECT {CELL}, [list_transform(boxes, lambda x: x.no)] FROM boxed WHERE len(list_filter(boxes, lambda x: x.kind = 'price')) < 2),
    grouped AS (SELECT {CELL}, i - 1 AS cluster, list_transform(lists[i], lambda no: boxes[no]) AS own, across, down FROM (SELECT *, unnest(range(1, len(lists) + 1)) AS i FROM lists) JOIN boxed USING ({CELL}))"""
REGIONS = f""", sides AS (SELECT *, list_min(list_transform(own, lambda x: x.l)) AS l, list_min(list_transform(own, lambda x: x.t)) AS t, list_max(list_transform(own, lambda x: x.r)) AS r, list_max(list_transform(own, lambda x: x.b)) AS b FROM grouped),
    cut AS (SELECT *, GREATEST(0, l - 10, across.start) AS x, GREATEST(0, t - 10, down.start) AS y FROM sides),
    long AS (SELECT *, LEAST(1000 - x, CASE WHEN x + r - l + 20 > across.stop THEN across.stop - x ELSE r - l + 20 END) AS w, LEAST(1000 - y, CASE WHEN y + b - t + 20 > down.stop THEN down.stop - y ELSE b - t + 20 END) AS h FROM cut),
    high AS (SELECT *, GREATEST(down.start, y - CAST(floor((b - t) * CAST(0.8 AS DOUBLE)) AS BIGINT)) AS above FROM long WHERE w >= 120 AND h >= 150),
    firsts AS (SELECT {CELL}, boxes[1].t AS ft, boxes[1].l AS fl, boxes[1].id AS fid FROM boxed)
    SELECT leaflet_id, at_column, at_row, CAST(cluster AS INT) AS cluster, x AS bbox_x, above AS bbox_y, w AS bbox_width, h + y - above AS bbox_height, CAST(len(own) AS BIGINT) AS n, array_to_string(list_transform(own, lambda box: box.text), ' ') AS text, len(list_filter(own, lambda box: box.kind = 'price')) > 0 AS has_price, len(list_filter(own, lambda box: box.kind = 'name')) > 0 AS has_name,
    CAST(row_number() OVER (PARTITION BY leaflet_id ORDER BY floor(above / 100), x, ft, fl, fid, cluster) AS INT) AS place FROM high JOIN firsts USING ({CELL})"""


def _cells(x):
    texts = x.by_leaflet("texts")
    return g.cells_by_ranges(r.with_kinds(texts), g.layout(texts, 1000, 1000, "leaflet_id"), "leaflet_id").withColumnsRenamed({"column": "at_column", "row": "at_row"})


add(
    "g10_price_clusters", "texts", lambda x: r.price_clusters(_cells(x), "leaflet_id", "at_column", "at_row").withColumn("boxes", F.array_join(F.transform("boxes", lambda b: b["id"]), ",")).withColumnRenamed("boxes", "ids"),
    CLUSTERS + f" SELECT {CELL}, CAST(cluster AS INT) AS cluster, array_to_string(list_transform(own, lambda x: x.id), ',') AS ids FROM grouped",
)
add("g11_text_regions", "texts", lambda x: r.text_regions(x.by_leaflet("texts"), 1000, 1000, "leaflet_id").withColumnsRenamed({"column": "at_column", "row": "at_row"}), CLUSTERS + REGIONS)


# clusters by nearness: a row of the walk is one box tested, the start of another sweep, or a cluster that is done
NEAREST = f""", ordered AS (SELECT leaflet_id, list({{'id': id, 'text': COALESCE(text, ''), 'l': bbox_x, 't': bbox_y, 'r': bbox_x + bbox_width, 'b': bbox_y + bbox_height}} ORDER BY bbox_y, bbox_x, id) AS boxes FROM texts WHERE bbox_x IS NOT NULL GROUP BY 1),
    walk AS (SELECT leaflet_id, CAST(0 AS BIGINT) AS cluster, FALSE AS done, FALSE AS more, boxes[1] AS sweep, boxes[1] AS grown, [boxes[1]] AS members, boxes[2:] AS todo, boxes[1:0] AS kept, boxes[1:0] AS ended FROM ordered
    UNION ALL SELECT leaflet_id, CASE WHEN step = 'next' THEN cluster + 1 ELSE cluster END, step = 'end', CASE step WHEN 'test' THEN more OR fits ELSE FALSE END,
    CASE step WHEN 'test' THEN sweep WHEN 'sweep' THEN grown ELSE kept[1] END, CASE WHEN step = 'test' AND fits THEN wider WHEN step = 'next' THEN kept[1] ELSE grown END,
    CASE WHEN step = 'test' AND fits THEN list_append(members, todo[1]) WHEN step = 'next' THEN [kept[1]] ELSE members END, CASE step WHEN 'test' THEN todo[2:] WHEN 'sweep' THEN kept WHEN 'next' THEN kept[2:] ELSE todo END,
    CASE WHEN step = 'test' AND NOT fits THEN list_append(kept, todo[1]) WHEN step = 'test' THEN kept ELSE kept[1:0] END, CASE WHEN step IN ('next', 'end') THEN members ELSE kept[1:0] END
    FROM (SELECT *, CASE WHEN len(todo) > 0 THEN 'test' WHEN more AND len(kept) > 0 THEN 'sweep' WHEN len(kept) > 0 THEN 'next' ELSE 'end' END AS step,
    COALESCE(todo[1].l <= sweep.r + 50 AND todo[1].r >= sweep.l - 50 AND todo[1].t <= sweep.b + 50 AND todo[1].b >= sweep.t - 50 AND wider.r > wider.l AND wider.b > wider.t AND GREATEST((wider.r - wider.l) / (wider.b - wider.t), (wider.b - wider.t) / (wider.r - wider.l)) <= 3, FALSE) AS fits
    FROM (SELECT *, {{'id': grown.id, 'text': grown.text, 'l': LEAST(grown.l, todo[1].l), 't': LEAST(grown.t, todo[1].t), 'r': GREATEST(grown.r, todo[1].r), 'b': GREATEST(grown.b, todo[1].b)}} AS wider FROM walk WHERE NOT done))),
    clusters AS (SELECT leaflet_id, CASE WHEN done THEN cluster ELSE cluster - 1 END AS cluster, ended FROM walk WHERE len(ended) > 0)"""
add("g12_near_clusters", "texts", lambda x: r.near_clusters(x.by_leaflet("texts"), "leaflet_id").select("leaflet_id", "cluster", F.array_join(F.transform("boxes", lambda b: b["id"]), ",").alias("ids")), NEAREST + " SELECT leaflet_id, CAST(cluster AS INT) AS cluster, array_to_string(list_transform(ended, lambda box: box.id), ',') AS ids FROM clusters")
add(
    "g12_near_regions", "texts", lambda x: r.near_regions(x.by_leaflet("texts"), 1000, 1000, "leaflet_id"),
    NEAREST + """, sides AS (SELECT leaflet_id, cluster, ended, list_min(list_transform(ended, lambda box: box.l)) AS l, list_min(list_transform(ended, lambda box: box.t)) AS t, list_max(list_transform(ended, lambda box: box.r)) AS r, list_max(list_transform(ended, lambda box: box.b)) AS b FROM clusters)
    SELECT * FROM (SELECT leaflet_id, CAST(cluster AS INT) AS cluster, GREATEST(0, l - 10) AS bbox_x, GREATEST(0, t - 10) AS bbox_y, LEAST(r - l + 20, 1000 - GREATEST(0, l - 10)) AS bbox_width, LEAST(b - t + 20, 1000 - GREATEST(0, t - 10)) AS bbox_height, CAST(len(ended) AS BIGINT) AS n,
    array_to_string(list_transform(ended, lambda box: box.text), ' ') AS text FROM sides) WHERE bbox_width >= 120 AND bbox_height >= 150""",
)


# dividers: 100 steps of ten points; parts hinted, so that dividers are one more and half a part apart
def _dividers_sql(place: str, size: str, parts: int) -> str:
    apart = max(3, int(100 * (0.5 / parts)))
    window = max(3, apart // 3)
    return f""", spans AS (SELECT leaflet_id, list({{'a': {place}, 'b': {place} + {size}}}) AS spans FROM texts WHERE bbox_x IS NOT NULL GROUP BY 1),
    profiles AS (SELECT leaflet_id, list_transform(range(100), lambda i: GREATEST(0, 255 - 20 * len(list_filter(spans, lambda s: s.a < (i + 1) * 10 AND s.b > i * 10)))) AS p FROM spans),
    smoothed AS (SELECT leaflet_id, list_transform(range(1, 101), lambda i: list_sum(p[GREATEST(1, i - 1):LEAST(100, i + 1)])) AS s FROM profiles),
    ranked AS (SELECT leaflet_id, list_sort(list_transform(list_filter(range(2, 100), lambda i: s[i] >= list_max(s[GREATEST(1, i - {window}):LEAST(100, i + {window})])), lambda i: {{'dark': -s[i], 'spot': i - 1}})) AS peaks FROM smoothed),
    chosen AS (SELECT leaflet_id, peaks, CAST(1 AS BIGINT) AS k, [CAST(0 AS BIGINT), CAST(99 AS BIGINT)] AS taken FROM ranked UNION ALL
    SELECT leaflet_id, peaks, k + 1, CASE WHEN len(taken) <= {parts} AND len(list_filter(taken, lambda x: abs(x - peaks[k].spot) < {apart})) = 0 THEN list_append(taken, peaks[k].spot) ELSE taken END FROM chosen WHERE k <= len(peaks)),
    filled AS (SELECT leaflet_id, list_sort(taken) AS places FROM chosen WHERE k = len(peaks) + 1 UNION ALL
    SELECT leaflet_id, list_sort(list_append(places, CAST(widest.since + widest.wide // 2 AS BIGINT))) FROM (SELECT *, list_reverse_sort(list_transform(range(1, len(places)), lambda i: {{'wide': places[i + 1] - places[i], 'since': places[i]}}))[1] AS widest FROM filled WHERE len(places) <= {parts}) WHERE widest.wide >= 4),
    most AS (SELECT leaflet_id, arg_max(places, len(places)) AS places FROM filled GROUP BY 1)
    SELECT leaflet_id, CAST(i - 1 AS INT) AS divider, CAST(places[i] AS INT) AS at_step FROM (SELECT *, unnest(range(1, len(places) + 1)) AS i FROM most)"""


for _name, _place, _size, _parts in (("rows", "bbox_y", "bbox_height", 4), ("columns", "bbox_x", "bbox_width", 3)):
    add(
        f"g7_{_name}_dividers", "texts",
        lambda x, place=_place, size=_size, parts=_parts: r.dividers(r.covered(x.texts, place, size, 1000, 10, "leaflet_id"), parts + 1, 0.5 / parts, "leaflet_id"),
        _dividers_sql(_place, _size, _parts),
    )


# visual regions with texts: sizes of cards, cards, texts to cards, what is left to cells, and of overlapping regions the first
def _num(text: str) -> str:
    """Plain decimals are doubles."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"CAST(\1 AS DOUBLE)", text)


CARD = "{'first': id, 'l': l, 't': t, 'r': r, 'b': b}"
SMALL = f"""small AS (SELECT leaflet_id, v.id, bbox_x AS l, bbox_y AS t, bbox_x + bbox_width AS r, bbox_y + bbox_height AS b, row_number() OVER (PARTITION BY leaflet_id ORDER BY bbox_y, bbox_x, v.id) AS k FROM fit v WHERE NOT large AND small),
    near AS (SELECT leaflet_id, k, [{CARD}] AS kept FROM small WHERE k = 1 UNION ALL SELECT leaflet_id, k, CASE WHEN spot IS NULL THEN list_append(kept, {CARD}) ELSE list_transform(kept, lambda g, i: CASE WHEN i = spot THEN {{'first': g.first, 'l': LEAST(g.l, l), 't': LEAST(g.t, t), 'r': GREATEST(g.r, r), 'b': GREATEST(g.b, b)}} ELSE g END) END
    FROM (SELECT w.leaflet_id, n.k, kept, n.id, n.l, n.t, n.r, n.b, list_position(list_transform(kept, lambda g: GREATEST(g.l, n.l) - LEAST(g.r, n.r) <= 50 AND GREATEST(g.t, n.t) - LEAST(g.b, n.b) <= 50), TRUE) AS spot FROM near w JOIN small n ON n.leaflet_id = w.leaflet_id AND n.k = w.k + 1)),
    made AS (SELECT leaflet_id, i - 1 AS place, kept[i] AS g FROM (SELECT w.leaflet_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM near w JOIN (SELECT leaflet_id, MAX(k) AS k FROM small GROUP BY 1) USING (leaflet_id, k)))"""
SIDE2 = "GREATEST(0, LEAST(a.{1}, b.{1}) - GREATEST(a.{0}, b.{0}))"
HYBRID = _num(f""", visual AS (SELECT DISTINCT leaflet_id, region AS id, bbox_x, bbox_y, bbox_width * 2 AS bbox_width, bbox_height * 2 AS bbox_height FROM regions),
    mids AS (SELECT leaflet_id, list_sort(list(bbox_x + bbox_width / 2)) AS xs, list_sort(list(bbox_y + bbox_height / 2)) AS ys, median(bbox_width) AS mw, median(bbox_height) AS mh, COUNT(*) AS n FROM visual GROUP BY 1),
    expected AS (SELECT leaflet_id, CASE WHEN n < 2 THEN 1000.0 / 3 ELSE GREATEST(mw, 1000.0 / LEAST(6, len(list_filter(range(1, len(xs)), lambda i: xs[i + 1] - xs[i] > 150)) + 1) * 0.6) END AS w, CASE WHEN n < 2 THEN 1000.0 / 4 ELSE GREATEST(mh, 1000.0 / LEAST(8, len(list_filter(range(1, len(ys)), lambda i: ys[i + 1] - ys[i] > 100)) + 1) * 0.6) END AS h FROM mids),
    sizes AS (SELECT leaflet_id, GREATEST(200, CAST(floor(w * 0.35) AS BIGINT)) AS lw, GREATEST(250, CAST(floor(h * 0.35) AS BIGINT)) AS lh, LEAST(900.0, w * 2) AS mw, LEAST(600.0, h * 2) AS mh, LEAST(400000.0, w * h * 2.5) AS ma FROM expected),
    fit AS (SELECT v.*, bbox_width * bbox_height > ma OR bbox_width > mw OR bbox_height > mh AS large, bbox_width < lw OR bbox_height < lh AS small FROM visual v JOIN sizes USING (leaflet_id)), {SMALL},
    cards AS (SELECT leaflet_id, 0 AS kind, row_number() OVER (PARTITION BY leaflet_id ORDER BY id) AS place, bbox_x AS l, bbox_y AS t, bbox_x + bbox_width AS r, bbox_y + bbox_height AS b FROM fit WHERE NOT large AND NOT small
    UNION ALL SELECT leaflet_id, 1, place, g.l, g.t, g.r, g.b FROM made JOIN sizes USING (leaflet_id) WHERE g.r - g.l >= lw AND g.b - g.t >= lh AND g.r - g.l <= mw AND g.b - g.t <= mh AND (g.r - g.l) * (g.b - g.t) <= ma),
    boxes AS (SELECT leaflet_id, id, said, bbox_x AS l, bbox_y AS t, bbox_x + bbox_width AS r, bbox_y + bbox_height AS b, {KIND} AS box_kind, lw, lh, mw, mh FROM (SELECT *, COALESCE(text, '') AS said, trim(COALESCE(text, '')) AS t FROM texts WHERE bbox_x IS NOT NULL) JOIN sizes USING (leaflet_id)),
    parts AS (SELECT a.leaflet_id, a.id, b.kind, b.place, b.l, b.t, b.r, b.b, CAST({SIDE2.format('l', 'r')} * {SIDE2.format('t', 'b')} AS DOUBLE) / CAST((a.r - a.l) * (a.b - a.t) AS DOUBLE) AS part FROM boxes a JOIN cards b USING (leaflet_id)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leaflet_id, id ORDER BY part DESC, kind, place) AS nth FROM parts WHERE part > 0.1) WHERE nth = 1),
    told AS (SELECT a.*, kind, place, c.l AS cl, c.t AS ct, c.r AS cr, c.b AS cb, c.id IS NOT NULL AS has_card FROM boxes a LEFT JOIN best c ON c.leaflet_id = a.leaflet_id AND c.id = a.id),
    close AS (SELECT *, abs((l + r) / 2 - (cl + cr) / 2) <= mw / 2 AND abs((t + b) / 2 - (ct + cb) / 2) <= mh / 2 AS near_card FROM told WHERE has_card),
    gathered AS (SELECT leaflet_id, kind, place, LEAST(cl, MIN(CASE WHEN near_card THEN l END)) AS l, LEAST(ct, MIN(CASE WHEN near_card THEN t END)) AS t, GREATEST(cr, MAX(CASE WHEN near_card THEN r END)) AS r, GREATEST(cb, MAX(CASE WHEN near_card THEN b END)) AS b, mw, mh, {{0}} FROM close GROUP BY leaflet_id, kind, place, cl, ct, cr, cb, mw, mh),
    padded AS (SELECT *, CAST(GREATEST(0, l - 10) AS DOUBLE) AS x0, CAST(LEAST(1000, r + 10) AS DOUBLE) AS x1, CAST(GREATEST(0, t - 10) AS DOUBLE) AS y0, CAST(LEAST(1000, b + 10) AS DOUBLE) AS y1 FROM gathered),
    celled AS (SELECT *, LEAST(GREATEST(1, 1000 // lw) - 1, floor((l + r) / 2 / (1000.0 / GREATEST(1, 1000 // lw)))) AS col, LEAST(GREATEST(1, 1000 // lh) - 1, floor((t + b) / 2 / (1000.0 / GREATEST(1, 1000 // lh)))) AS line FROM told WHERE NOT has_card),
    loose AS (SELECT leaflet_id, MIN(l) AS l, MIN(t) AS t, MAX(r) AS r, MAX(b) AS b, lw, lh, {{0}} FROM celled GROUP BY leaflet_id, col, line, lw, lh),
    wider AS (SELECT *, GREATEST(0.0, (lw - (r - l)) / 2) AS dx, GREATEST(0.0, (lh - (b - t)) / 2) AS dy FROM loose),
    spread AS (SELECT *, GREATEST(0.0, GREATEST(0.0, l - dx) - 15) AS x0, LEAST(1000.0, LEAST(1000.0, r + dx) + 15) AS x1, GREATEST(0.0, GREATEST(0.0, t - dy) - 15) AS y0, LEAST(1000.0, LEAST(1000.0, b + dy) + 15) AS y1 FROM wider),
    every AS (SELECT leaflet_id, 0 AS s, kind, place, x0 + GREATEST(0.0, x1 - x0 - mw) / 2 AS x, y0 + GREATEST(0.0, y1 - y0 - mh) / 2 AS y, LEAST(x1 - x0, mw) AS w, LEAST(y1 - y0, mh) AS h, n, said, has_price, has_name, begins FROM padded
    UNION ALL SELECT leaflet_id, 1, kind, place, l, t, r - l, b - t, 0, '', FALSE, FALSE, {{{{'t': CAST(0 AS BIGINT), 'l': CAST(0 AS BIGINT), 'id': ''}}}} FROM cards c WHERE leaflet_id IN (SELECT leaflet_id FROM boxes) AND NOT EXISTS (SELECT 1 FROM best q WHERE q.leaflet_id = c.leaflet_id AND q.kind = c.kind AND q.place = c.place)
    UNION ALL SELECT leaflet_id, 2, 0, 0, x0, y0, x1 - x0, y1 - y0, n, said, has_price, has_name, begins FROM spread),
    whole AS (SELECT * REPLACE (CAST(floor(x) AS BIGINT) AS x, CAST(floor(y) AS BIGINT) AS y, CAST(floor(w) AS BIGINT) AS w, CAST(floor(h) AS BIGINT) AS h), row_number() OVER (PARTITION BY leaflet_id ORDER BY s, begins.t, begins.l, begins.id, kind, place) AS k FROM every),
    chosen AS (SELECT leaflet_id, k, [{{{{'x': x, 'y': y, 'w': w, 'h': h}}}}] AS kept, TRUE AS stays FROM whole WHERE k = 1 UNION ALL SELECT leaflet_id, k, CASE WHEN apart THEN list_append(kept, {{{{'x': x, 'y': y, 'w': w, 'h': h}}}}) ELSE kept END, apart
    FROM (SELECT w.*, c.kept, len(list_filter(c.kept, lambda g: {{1}} > 0.5)) = 0 AS apart FROM chosen c JOIN whole w ON w.leaflet_id = c.leaflet_id AND w.k = c.k + 1))
    SELECT leaflet_id, ['hybrid', 'visual_only', 'grid_fallback'][s + 1] AS source, x AS bbox_x, y AS bbox_y, w AS bbox_width, h AS bbox_height, n, said AS text, has_price, has_name, CAST(row_number() OVER (PARTITION BY leaflet_id ORDER BY floor(y / 100), x, k) AS INT) AS place FROM whole JOIN chosen USING (leaflet_id, k) WHERE stays""")
TOLD = "CAST(COUNT(*) AS BIGINT) AS n, string_agg(said, ' ' ORDER BY t, l, id) AS said, bool_or(box_kind = 'price') AS has_price, bool_or(box_kind = 'name') AS has_name, MIN({'t': t, 'l': l, 'id': id}) AS begins"
MEET2 = "CAST(GREATEST(0, LEAST(g.x + g.w, w.x + w.w) - GREATEST(g.x, w.x)) * GREATEST(0, LEAST(g.y + g.h, w.y + w.h) - GREATEST(g.y, w.y)) AS DOUBLE)"


def _texts_and_visual(x):
    texts, regions = x.gathered("texts", "regions")
    visual = regions.select("leaflet_id", F.col("region").alias("id"), "bbox_x", "bbox_y", *[(F.col(c) * 2).alias(c) for c in ("bbox_width", "bbox_height")])
    return texts, visual.distinct()


add(
    "g13_hybrid_regions", "texts regions",
    lambda x: r.hybrid_regions(*_texts_and_visual(x), 1000, 1000, "leaflet_id"),
    HYBRID.replace("{0}", TOLD).replace("{1}", f"{MEET2} / (g.w * g.h + w.w * w.h - {MEET2})").replace("{{", "{").replace("}}", "}"),
)


# even grids: dividers of both directions for each number of parts at once
EVEN = """, spans AS (SELECT leaflet_id, 'x' AS way, list({'a': bbox_x, 'b': bbox_x + bbox_width}) AS spans FROM texts WHERE bbox_x IS NOT NULL GROUP BY 1 UNION ALL SELECT leaflet_id, 'y', list({'a': bbox_y, 'b': bbox_y + bbox_height}) FROM texts WHERE bbox_x IS NOT NULL GROUP BY 1),
    profiles AS (SELECT leaflet_id, way, list_transform(range(100), lambda i: GREATEST(0, 255 - 20 * len(list_filter(spans, lambda s: s.a < (i + 1) * 10 AND s.b > i * 10)))) AS p FROM spans),
    smoothed AS (SELECT leaflet_id, way, list_transform(range(1, 101), lambda i: list_sum(p[GREATEST(1, i - 1):LEAST(100, i + 1)])) AS s FROM profiles),
    wanted AS (SELECT *, GREATEST(3, apart // 3) AS near FROM (VALUES ('x', 3, 16), ('x', 4, 12), ('y', 4, 12), ('y', 5, 10), ('y', 6, 8)) v(way, parts, apart)),
    ranked AS (SELECT leaflet_id, way, parts, apart, list_sort(list_transform(list_filter(range(2, 100), lambda i: s[i] >= list_max(s[GREATEST(1, i - near):LEAST(100, i + near)])), lambda i: {'dark': -s[i], 'spot': i - 1})) AS peaks FROM smoothed JOIN wanted USING (way)),
    chosen AS (SELECT leaflet_id, way, parts, apart, peaks, CAST(1 AS BIGINT) AS k, [CAST(0 AS BIGINT), CAST(99 AS BIGINT)] AS taken FROM ranked UNION ALL
    SELECT leaflet_id, way, parts, apart, peaks, k + 1, CASE WHEN len(taken) <= parts AND len(list_filter(taken, lambda x: abs(x - peaks[k].spot) < apart)) = 0 THEN list_append(taken, peaks[k].spot) ELSE taken END FROM chosen WHERE k <= len(peaks)),
    filled AS (SELECT leaflet_id, way, parts, list_sort(taken) AS places FROM chosen WHERE k = len(peaks) + 1 UNION ALL
    SELECT leaflet_id, way, parts, list_sort(list_append(places, CAST(widest.since + widest.wide // 2 AS BIGINT))) FROM (SELECT *, list_reverse_sort(list_transform(range(1, len(places)), lambda i: {'wide': places[i + 1] - places[i], 'since': places[i]}))[1] AS widest FROM filled WHERE len(places) <= parts) WHERE widest.wide >= 4),
    cut AS (SELECT leaflet_id, way, parts, list_transform(arg_max(places, len(places)), lambda x: x * 10) AS places FROM filled GROUP BY 1, 2, 3),
    sized AS (SELECT *, list_filter(list_transform(range(1, len(places)), lambda i: places[i + 1] - places[i]), lambda w: w >= CASE WHEN way = 'x' THEN 100 ELSE 120 END) AS sizes FROM cut),
    tried AS (SELECT x.leaflet_id, h.nth, h.c, h.r, x.places AS xs, y.places AS ys, len(x.sizes) * len(y.sizes) >= 2 AND list_max(x.sizes) <= 2.5 * list_min(x.sizes) AND list_max(y.sizes) <= 2.5 * list_min(y.sizes) AS even
    FROM (VALUES (1, 3, 4), (2, 3, 5), (3, 4, 5), (4, 4, 6)) h(nth, c, r) JOIN sized x ON x.way = 'x' AND x.parts = h.c JOIN sized y ON y.way = 'y' AND y.parts = h.r AND y.leaflet_id = x.leaflet_id),
    first_even AS (SELECT leaflet_id, arg_min({'c': c, 'r': r, 'xs': xs, 'ys': ys}, nth) AS g FROM tried WHERE even GROUP BY 1)
    SELECT l.leaflet_id, CAST(COALESCE(g.c, 3) AS INT) AS columns, CAST(COALESCE(g.r, 5) AS INT) AS nrows, COALESCE(array_to_string(g.xs, ','), '0,333,666,999') AS xs, COALESCE(array_to_string(g.ys, ','), '0,200,400,600,800,1000') AS ys FROM (SELECT DISTINCT leaflet_id FROM cut) l LEFT JOIN first_even USING (leaflet_id)"""


def _even_grids(x):
    across, down = (r.covered(x.texts, place, size, 1000, 10, "leaflet_id") for place, size in (("bbox_x", "bbox_width"), ("bbox_y", "bbox_height")))
    return r.even_grids(across, down, 10, "leaflet_id").select("leaflet_id", "columns", F.col("rows").alias("nrows"), *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("xs", "ys")])


add("g6_even_grids", "texts", _even_grids, EVEN)
