"""Exports: rows as files of CSV, JSON and Parquet, with the writers' own conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes a row by format, for no images, links and embedded images.
ROW_BYTES = {"csv": (500, 600, 50_000), "excel": (700, 800, 50_000), "json": (1_000, 1_200, 50_000)}
IMAGES = ("none", "url", "base64")


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def product_rows(products: DataFrame, leaflets: DataFrame, images: str = "none") -> DataFrame:
    """Products with their leaflet in the fixed columns of product exports; zeros stay, missing values are empty, the
    currency falls back to the leaflet's. images: none, url or base64, which adds a column."""
    own = leaflets.select(F.col("id").alias("leaflet_id"), F.col("human_id").alias("_human_id"), F.col("filename").alias("_filename"), F.col("currency").alias("_currency"))
    have = set(products.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have or c.startswith("_") else F.lit("")
    named = {
        "Leaflet ID": text("_human_id"), "Leaflet Name": text("_filename"), "Page": F.col("page_number"), "Brand": text("brand"), "Product Code": text("product_code"), "Product Name": text("product_name"), "Quantity": text("quantity"), "Units": text("units"),
        "Regular Price": F.col("regular_price"), "Discounted Price": F.col("discounted_price"), "Discount %": F.col("discount_percentage"), "Currency": F.coalesce(F.nullif("currency", F.lit("")), "_currency", F.lit("")), "Product ID": F.col("id"),
        "Promotional Info": text("promotional_info"), "Category": text("category"), "Confidence": text("confidence"), "Review Status": text("state"), "Validation Passed": yes_no(F.col("validation_passed")), "Created At": text("created_at"),
    }
    if images != "none":
        named["Image URL" if images == "url" else "Image Base64"] = text(f"image_{images}")
    return products.join(own, "leaflet_id", "left").select(*[c.alias(n) for n, c in named.items()])


def write_csv(rows: DataFrame, path: str) -> None:
    """Quotes only where a value has a comma, a quote or a line break, and doubles quotes inside."""
    rows.write.option("header", True).option("escape", '"').option("quoteAll", False).mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def write_by_leaflet(rows: DataFrame, path: str) -> None:
    """A folder for each leaflet; rows are brought together by leaflet first, so that there are few files."""
    rows.repartition("leaflet_id").write.mode("overwrite").partitionBy("leaflet_id").parquet(path)


def documents(products: DataFrame, leaflets: DataFrame) -> DataFrame:
    """(id, json): each leaflet with its products. A leaflet's products are one document, as large as the leaflet."""
    item = F.struct("page_number", "id", "product_name")
    lists = products.groupBy(F.col("leaflet_id").alias("id")).agg(F.count("*").alias("n_products"), F.array_sort(F.collect_list(item)).alias("products"))
    both = leaflets.select("id", "status", "retailer").join(lists, "id", "left")
    none = F.array().cast(lists.schema["products"].dataType)
    whole = F.struct("id", "status", "retailer", F.coalesce("n_products", F.lit(0)).alias("n_products"), F.coalesce("products", none).alias("products"))
    return both.select("id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def json_lines(products: DataFrame) -> DataFrame:
    """(id, json): a document for each product; missing values are written as null."""
    item = F.struct("id", "leaflet_id", F.col("page_number").alias("page"), "brand", F.col("product_name").alias("name"), F.col("product_code").alias("code"), "currency")
    return products.select("id", F.to_json(item, {"ignoreNullFields": "false"}).alias("json"))


def leaflet_rows(products: DataFrame, currency: str, codes: bool = False, boxes: bool = False, confidence: bool = False, validation: bool = False) -> DataFrame:
    """A leaflet's rows: 13 columns and those asked for. Zeros are left out as missing values are; flags are True or False."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    filled = lambda c: F.nullif(F.col(c), F.lit(0))
    made = [F.col("leaflet_id").cast("string").alias("Leaflet_ID"), F.col("page_number").alias("Page"), text("brand").alias("Brand")]
    made += [text("product_code").alias("Product_Code")] if codes else []
    made += [
        F.col("product_name").alias("Product_Name"), F.coalesce(filled("quantity").cast("string"), F.lit("")).alias("Quantity"), text("units").alias("Units"), filled("regular_price").alias("Regular_Price"),
        filled("discounted_price").alias("Discounted_Price"), filled("discount_percentage").alias("Discount_Percentage"), F.coalesce(F.nullif("currency", F.lit("")), F.lit(currency)).alias("Currency"), F.col("id").alias("Product_ID"),
        F.lit("").alias("Promotional_Info"), text("category").alias("Category"),
    ]
    made += [F.col(f"bbox_{c.lower()}").alias(f"BoundingBox_{c}") for c in ("X", "Y", "Width", "Height")] if boxes else []
    made += [F.col("confidence").alias("Confidence")] if confidence else []
    made += [F.col("state").alias("Review_Status"), F.when(F.col("validation_passed"), "True").otherwise("False").alias("Validation_Passed")] if validation else []
    return products.select(*made)


def summary_sheet(products: DataFrame, leaflets: DataFrame) -> DataFrame:
    counts = products.groupBy(F.col("leaflet_id").alias("id")).agg(F.count("*").alias("products"), F.count("discounted_price").alias("reduced"))
    return leaflets.select("id", "status", "retailer", "page_count").join(counts, "id", "left").fillna(0, ["products", "reduced"])


def statistics_sheet(products: DataFrame) -> DataFrame:
    return products.groupBy("leaflet_id", "page_number").agg(F.count("*").alias("n"))


def products_sheet(products: DataFrame, currency: str) -> DataFrame:
    """The sheet of a leaflet's products: zeros are left out as missing values are, confidence is a percentage of one digit."""
    c = F.col
    text = lambda name: F.coalesce(c(name).cast("string"), F.lit(""))
    filled = lambda name: F.nullif(c(name), F.lit(0))
    named = {
        "Page": c("page_number"), "Brand": text("brand"), "Product Code": text("product_code"), "Product Name": c("product_name"), "Quantity": filled("quantity"), "Units": text("units"), "Regular Price": filled("regular_price"),
        "Discounted Price": filled("discounted_price"), "Discount %": filled("discount_percentage"), "Currency": F.coalesce(F.nullif("currency", F.lit("")), F.lit(currency)), "Product ID": F.lit(""), "Promotional Info": F.lit(""),
        "Category": text("category"), "Confidence": F.format_string("%.1f%%", F.coalesce(c("confidence").cast("double"), F.lit(0.0)) * 100), "Status": text("state"), "Validated": yes_no(c("validation_passed")),
    }
    return products.select("leaflet_id", "id", *[v.alias(n) for n, v in named.items()])


def brands_sheet(products: DataFrame, most: int = 10) -> DataFrame:
    """(leaflet_id, brand, n, place): each leaflet's `most` frequent brands, the one that comes first among equals; products without a
    brand are Unknown."""
    brand = F.coalesce(F.nullif("brand", F.lit("")), F.lit("Unknown"))
    counts = products.groupBy("leaflet_id", brand.alias("brand")).agg(F.count("*").alias("n"), F.min(F.struct("page_number", "id")).alias("begins"))
    place = F.row_number().over(Window.partitionBy("leaflet_id").orderBy(F.desc("n"), "begins"))
    return counts.select("leaflet_id", "brand", "n", place.alias("place")).where(F.col("place") <= most)


#: An audit export is for reading, so it stops at so many of the latest events.
AUDIT_ROWS = 10_000


def audit_export(audit: DataFrame) -> DataFrame:
    """The latest events, missing values as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    latest = audit.orderBy(F.desc("created_at"), "id").limit(AUDIT_ROWS)
    return latest.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), *map(text, ("event_type", "status", "organization_id", "user_id", "cost")))


def bulk(products: DataFrame, leaflet_ids: list[int]) -> DataFrame:
    """(leaflet_id, products, error) for each leaflet asked for; those without products have an error and stop none."""
    wanted = products.sparkSession.createDataFrame([(i,) for i in leaflet_ids], "leaflet_id long")
    counts = products.join(F.broadcast(wanted), "leaflet_id", "left_semi").groupBy("leaflet_id").agg(F.count("*").alias("n"))
    return wanted.join(counts, "leaflet_id", "left").select("leaflet_id", F.coalesce("n", F.lit(0)).alias("products"), F.when(F.col("n").isNull(), "not found").alias("error"))


def usage_rows(audit: DataFrame, organizations: DataFrame) -> DataFrame:
    """Usage by organization's name and day; the names, a dimension of few rows, are joined after the counting."""
    by = audit.groupBy("organization_id", "usage_date").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    named = by.join(organizations.select(F.col("id").alias("organization_id"), "name"), "organization_id", "left").withColumn("organization", F.coalesce("name", F.lit("Unknown")))
    return named.groupBy("organization", F.col("usage_date").cast("string").alias("day")).agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").cast("string").alias("cost"))


def estimated_bytes(n_rows: Column, kind: str, images: str = "none") -> Column:
    return n_rows * ROW_BYTES[kind][IMAGES.index(images)]


def read_categories(spark, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("code string, name string, parent string, sort_order int").csv(path)
