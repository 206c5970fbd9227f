"""Exports as whole JSON documents: one for each leaflet, one for all products, and bulk exports with an answer for each leaflet."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .archives import file_system

#: Bytes that are copied at a time when parts are joined.
COPY = 8 << 20
WHOLE = {"ignoreNullFields": "false"}


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str
    n: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.head, self.list_name = options["path"], options.get("head", "{}"), options.get("list", "items")

    def write(self, iterator: Iterator) -> _Part:
        """A task's rows as a file of texts, a line each, with commas between; the attempt is in its name, so that a lost one is in no part."""
        context = TaskContext.get()
        system, path = file_system(self.path)
        system.create_dir(f"{path}.parts", recursive=True)
        part, n = f"{path}.parts/{context.partitionId()}-{context.taskAttemptId()}", 0
        with system.open_output_stream(part) as out:
            for row in iterator:
                out.write((",\n" if n else "").encode() + row[0].encode())
                n += 1
        return _Part(context.partitionId(), part, n)

    def commit(self, messages: list[_Part | None]) -> None:
        """Joins the parts, in order, inside the head's object; they pass through in pieces of COPY bytes, and each goes when it
        is in the document. A commit that fails leaves no document, and Spark does not repeat it."""
        system, path = file_system(self.path)
        with system.open_output_stream(path) as out:
            out.write(self.head.rstrip().removesuffix("}").encode() + (b"," if json.loads(self.head) else b"") + json.dumps(self.list_name).encode() + b":[\n")
            before = False
            for part in sorted((m for m in messages if m and m.n), key=lambda m: m.number):
                out.write(b",\n" if before else b"")
                with system.open_input_stream(part.path) as piece:
                    while data := piece.read(COPY):
                        out.write(data)
                system.delete_file(part.path)  # so that the document is not there twice
                before = True
            out.write(b"\n]}\n")
        system.delete_dir(f"{path}.parts")

    def abort(self, messages: list[_Part | None]) -> None:
        system, path = file_system(self.path)
        if system.get_file_info(f"{path}.parts").type.name == "Directory":
            system.delete_dir(f"{path}.parts")


class JsonDocument(DataSource):
    """Format `json_document`, for writing rows (json) into one file: options path, head (an object), list (the list's name)."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def schema(self) -> str:
        return "json string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def write_document(items: DataFrame, head: dict, path: str, name: str = "products") -> None:
    """Writes one JSON object to path: head's fields, then the list `name` of items (json), in the order of items' partitions
    and rows, a line for each. Tasks write parts side by side; the commit joins them without holding them."""
    items.sparkSession.dataSource.register(JsonDocument)
    items.select("json").write.format("json_document").mode("append").option("head", json.dumps(head)).option("list", name).save(path)


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of a document that write_document has written, read as lines, so that a large one is split."""
    line = F.col("value")
    return spark.read.text(path).where(line.startswith('{"id"')).select(F.from_json(F.rtrim(line, F.lit(",")), schema).alias("x")).select("x.*")


def product_item(leaflet: Column) -> Column:
    """A product in an export, with its leaflet (struct or null): 22 fields."""
    c = F.col
    none = lambda name: F.lit(None).cast("string").alias(name)  # noqa: E731  (exports name it, the tables do not have it)
    return F.struct(
        c("id"), F.coalesce(leaflet["human_id"], c("leaflet_id").cast("string")).alias("leaflet_id"), leaflet["filename"].alias("leaflet_name"), leaflet["retailer"].alias("retailer"), leaflet["country"].alias("country"),
        c("page_number"), c("brand"), c("product_code"), c("product_name"), c("quantity"), c("units"), none("size"), c("regular_price"), c("discounted_price"), c("discount_percentage"),
        F.coalesce(F.nullif("currency", F.lit("")), leaflet["currency"]).alias("currency"), none("promotional_info"), c("category"), c("confidence"), c("state").alias("review_status"), c("validation_passed"), c("created_at").cast("string").alias("created_at"),
    )


def product_document(products: DataFrame, leaflets: DataFrame, path: str, exported_at: str) -> None:
    """One document of all products: exported_at, total_products, total_leaflets, products. leaflets (leaflet_id, human_id,
    filename, retailer, country, currency) may lack some; products go out by leaflet, page and id."""
    total, different = products.agg(F.count("*"), F.count_distinct("leaflet_id")).first()
    # products meet their leaflet, and come in order, in the same ranges of leaflets, so that they move once
    heads = leaflets.select("leaflet_id", F.struct("human_id", "filename", "retailer", "country", "currency").alias("leaflet"))
    both = products.withColumn("_product", F.lit(True)).unionByName(heads.withColumn("_product", F.lit(False)), allowMissingColumns=True)
    of_leaflet = Window.partitionBy("leaflet_id").orderBy("_product", "page_number", "id").rowsBetween(Window.unboundedPreceding, 0)
    ordered = both.repartitionByRange("leaflet_id").withColumn("leaflet", F.first("leaflet", ignorenulls=True).over(of_leaflet)).where("_product")
    items = ordered.select(F.to_json(product_item(F.col("leaflet")), WHOLE).alias("json"))
    write_document(items, {"exported_at": exported_at, "total_products": total, "total_leaflets": different}, path)


def leaflet_documents(products: DataFrame, leaflets: DataFrame) -> DataFrame:
    """(leaflet_id, json): a document for each leaflet: its head, products by page and id, metadata and quality_metrics.

    leaflets: leaflet_id, human_id, retailer, country, language, currency, page_count, status, started_at, completed_at, tokens,
    cost. A document is as large as its leaflet, which is a booklet; one without products has an empty list."""
    item = F.struct(
        "page_number", "id", "brand", "product_code", "product_name", "quantity", "units", "regular_price", "discounted_price", "discount_percentage", "currency", "category", "confidence", F.col("state").alias("review_status"), "validation_passed"
    )
    lists = products.groupBy("leaflet_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("products"), F.avg(F.col("confidence").cast("double")).alias("mean"), F.count_if(F.col("state") == "A").alias("approved"), F.count_if(F.col("state") == "N").alias("review")
    )
    both = leaflets.join(lists, "leaflet_id", "left")
    none = F.array().cast(lists.schema["products"].dataType)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    whole = F.struct(
        F.col("human_id").alias("leaflet_id"), F.col("page_count").alias("total_pages"), count("n").alias("total_products"), "retailer", "country", "language", "currency", F.coalesce("products", none).alias("products"),
        F.struct(F.col("started_at").cast("string").alias("processing_started_at"), F.col("completed_at").cast("string").alias("processing_completed_at"), "status").alias("metadata"),
        F.struct(F.col("mean").alias("overall_confidence"), count("approved").alias("auto_approved_count"), count("review").alias("review_required_count"), F.col("tokens").alias("api_tokens_used"), F.col("cost").alias("processing_cost")).alias("quality_metrics"),
    )
    return both.select("leaflet_id", F.to_json(whole, WHOLE).alias("json"))


def bulk_export(products: DataFrame, leaflets: DataFrame, wanted: DataFrame, path: str) -> DataFrame:
    """Writes the documents of the wanted leaflets (leaflet_id) to path, as lines in a folder by leaflet, and answers for each:
    (leaflet_id, products, error). One that there is not has an error and stops none; the answers are read from what was
    written, so they say what is there."""
    ids = wanted.select("leaflet_id").distinct()
    made = leaflet_documents(products.join(ids, "leaflet_id", "left_semi"), leaflets.join(ids, "leaflet_id", "left_semi"))
    made.repartition("leaflet_id").write.mode("overwrite").partitionBy("leaflet_id").text(path)
    written = products.sparkSession.read.schema("value string, leaflet_id long").text(path)
    counts = written.select("leaflet_id", F.get_json_object("value", "$.total_products").cast("long").alias("n"))
    return ids.join(counts, "leaflet_id", "left").select("leaflet_id", F.coalesce("n", F.lit(0)).alias("products"), F.when(F.col("n").isNull(), F.concat(F.lit("Leaflet not found: "), F.col("leaflet_id").cast("string"))).alias("error"))
