"""Queries over archives, stored objects and whole documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import archives, exports, files
from ..sources.shared import new_folder
from .dashboards import CNT, add

# Archives of 500 documents of a source at most, with hidden files, other systems' notes, and a file that is no image.
NAMES = "CASE doc_id % 50 WHEN 0 THEN concat('__MACOSX/page', CAST(doc_id AS STRING), '.jpg') WHEN 1 THEN concat('scan/.page', CAST(doc_id AS STRING), '.jpg') WHEN 2 THEN concat('scan/page', CAST(doc_id AS STRING), '.txt') WHEN 3 THEN concat('scan/Page', CAST(doc_id AS STRING), '.PNG') ELSE concat('scan/page', CAST(doc_id AS STRING), '.jpg') END"
FILES = f"SELECT concat(source, '-', CAST({{0}} AS STRING), '.zip') AS archive, {NAMES} AS name, doc_id, text FROM documents"


def _archived(x) -> str:
    path = new_folder(x.spark, "archives")
    rows = x.spark.sql(FILES.format("doc_id DIV 10000").replace("FROM documents", "FROM {d}"), d=x.raw("documents"))
    archives.write_archives(rows.select("archive", "name", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data")), path).write.format("noop").mode("overwrite").save()
    return path


PAGES = f"SELECT archive, name, CAST(row_number() OVER (PARTITION BY archive ORDER BY doc_id) AS INT) AS page, CAST(octet_length(encode(COALESCE(text, ''))) AS BIGINT) AS size, sha256(COALESCE(text, '')) AS digest FROM ({FILES.format('doc_id // 10000')}) WHERE doc_id % 50 > 2"
add("src3_archived_pages", "", lambda x: archives.pages(x.spark, _archived(x)).select("archive", "name", "page", "size", F.sha2("data", 256).alias("digest")), PAGES)
add("src3_pages_by_prefix", "", lambda x: archives.pages(x.spark, _archived(x)).where(F.col("name").startswith("scan/page1") & (F.col("size") > 100)).select("archive", "name", "page"), f"SELECT archive, name, page FROM ({PAGES}) WHERE starts_with(name, 'scan/page1') AND size > 100")


def _removed(x):
    """Archives by name, and which of them are left when those whose name begins with src1 are deleted."""
    path = _archived(x)
    own = lambda: files.listed(x.spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    noted = new_folder(x.spark, "names")
    own().write.parquet(noted)
    gone = files.remove(x.spark, [r.path for r in files.listed(x.spark, path, "src1").select("path").toLocalIterator()])
    return x.spark.read.parquet(noted).join(own().withColumn("kept", F.lit(True)), "name", "left").select("name", F.coalesce("kept", F.lit(False)).alias("kept"), F.lit(gone).cast("long").alias("removed"))


add(
    "src7_objects_by_prefix", "", _removed,
    f"WITH a AS (SELECT DISTINCT archive AS name FROM ({FILES.format('doc_id // 10000')})) SELECT name, NOT starts_with(name, 'src1') AS kept, (SELECT {CNT} FROM a WHERE starts_with(name, 'src1')) AS removed FROM a",
)

# documents
LEAFLETS = """SELECT id AS leaflet_id, concat('LEAF_', CAST(id AS STRING)) AS human_id, CASE WHEN id % 4 > 0 THEN concat(retailer, '.pdf') END AS filename, retailer, CASE WHEN id % 5 > 0 THEN 'SI' END AS country, 'sl' AS language, CASE WHEN id % 2 = 0 THEN 'EUR' END AS currency,
    page_count, status, created_at AS started_at, created_at + CAST(1 AS INT) AS completed_at, page_count * 1000 AS tokens, CAST(processing_cost AS DOUBLE) AS cost FROM {0}"""


def _leaflets(x):
    return x.spark.sql(LEAFLETS.format("{l}"), l=x.leaflets)


ITEMS = "id string, leaflet_id string, leaflet_name string, retailer string, country string, page_number long, brand string, product_code string, product_name string, quantity long, units string, regular_price double, discounted_price double, discount_percentage double, currency string, category string, confidence decimal(6,2), review_status string, validation_passed boolean, created_at string"


def _collected(x):
    path = new_folder(x.spark, "products") + ".json"
    exports.product_document(x.offers, _leaflets(x).where("leaflet_id % 11 > 0"), path, "2024-01-01T00:00:00")
    return exports.read_items(x.spark, path, ITEMS)


add(
    "snk5_collected_document", "offers leaflets", _collected,
    f"""SELECT o.id, COALESCE(human_id, CAST(o.leaflet_id AS VARCHAR)) AS leaflet_id, filename AS leaflet_name, retailer, country, page_number, brand, product_code, product_name, quantity, units, regular_price, discounted_price, discount_percentage, COALESCE(NULLIF(o.currency, ''), l.currency) AS currency, category,
    confidence, state AS review_status, validation_passed, CAST(o.created_at AS VARCHAR) AS created_at FROM offers o LEFT JOIN (SELECT * FROM ({LEAFLETS.format("leaflets")}) WHERE leaflet_id % 11 > 0) l ON l.leaflet_id = o.leaflet_id""",
)
DOCUMENT = "leaflet_id string, total_pages long, total_products long, retailer string, country string, language string, currency string, products array<struct<page_number: long, id: string, product_name: string, regular_price: double>>, metadata struct<processing_started_at: string, processing_completed_at: string, status: string>, quality_metrics struct<overall_confidence: double, auto_approved_count: long, review_required_count: long, api_tokens_used: long, processing_cost: double>"
add(
    "snk2_leaflet_documents", "offers leaflets",
    lambda x: exports.leaflet_documents(x.offers, _leaflets(x)).select(F.from_json("json", DOCUMENT).alias("d")).select("d.leaflet_id", "d.total_pages", "d.total_products", "d.retailer", "d.country", "d.language", "d.currency", F.array_join("d.products.id", ",").alias("ids"), F.array_join("d.products.product_name", "|").alias("names"), "d.metadata.*", F.round("d.quality_metrics.overall_confidence", 9).alias("overall_confidence"), "d.quality_metrics.auto_approved_count", "d.quality_metrics.review_required_count", "d.quality_metrics.api_tokens_used", "d.quality_metrics.processing_cost"),
    f"""SELECT human_id AS leaflet_id, page_count AS total_pages, COALESCE(n, 0) AS total_products, retailer, country, language, currency, COALESCE(ids, '') AS ids, COALESCE(names, '') AS names, CAST(started_at AS VARCHAR) AS processing_started_at, CAST(completed_at AS VARCHAR) AS processing_completed_at, status,
    round(mean, 9) AS overall_confidence, COALESCE(approved, 0) AS auto_approved_count, COALESCE(review, 0) AS review_required_count, tokens AS api_tokens_used, cost AS processing_cost FROM ({LEAFLETS.format("leaflets")}) l LEFT JOIN (SELECT leaflet_id, {CNT} AS n, string_agg(id, ',' ORDER BY page_number, id) AS ids, string_agg(product_name, '|' ORDER BY page_number, id) AS names,
    AVG(CAST(confidence AS DOUBLE)) AS mean, CAST(COUNT(*) FILTER (state = 'A') AS BIGINT) AS approved, CAST(COUNT(*) FILTER (state = 'N') AS BIGINT) AS review FROM offers GROUP BY 1) p USING (leaflet_id)""",
)
#: A request for a bulk export names leaflets; one is not there.
WANTED = (5, 7, 11, 32, 33, 99_999_999)
add(
    "snk8_bulk_documents", "offers leaflets",
    lambda x: exports.bulk_export(x.offers, _leaflets(x), x.spark.createDataFrame([(i,) for i in WANTED], "leaflet_id long"), new_folder(x.spark, "bulk")),
    f"SELECT w.leaflet_id, CASE WHEN l.id IS NULL THEN 0 ELSE COALESCE(n, 0) END AS products, CASE WHEN l.id IS NULL THEN concat('Leaflet not found: ', CAST(w.leaflet_id AS VARCHAR)) END AS error FROM (SELECT CAST(unnest([{', '.join(map(str, WANTED))}]) AS BIGINT) AS leaflet_id) w LEFT JOIN leaflets l ON l.id = w.leaflet_id LEFT JOIN (SELECT leaflet_id, {CNT} AS n FROM offers GROUP BY 1) p ON p.leaflet_id = w.leaflet_id",
)
