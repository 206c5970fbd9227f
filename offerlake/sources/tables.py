"""The model's tables as views over the driver's: one SQL text for Spark and DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (tables it reads, SQL with their names in braces)
ADAPTERS: dict[str, tuple[tuple[str, ...], str]] = {
    "leaflets": (
        ("orders",),
        """SELECT o_orderkey AS id, CAST(o_custkey % 10 AS BIGINT) AS organization_id,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'reviewing' ELSE 'failed' END AS status,
        CAST(o_orderdate AS DATE) AS created_at, o_orderpriority AS retailer, CAST(1 + o_orderkey % 12 AS BIGINT) AS page_count,
        CAST(CAST(o_totalprice AS DECIMAL(15,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS processing_cost
        FROM {orders}""",
    ),
    "products": (
        ("lineitem", "orders", "part"),
        """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
        CAST(CAST(l_quantity AS BIGINT) AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS id,
        l_orderkey AS leaflet_id, CAST(o_custkey % 10 AS BIGINT) AS organization_id, CAST(l_linenumber AS BIGINT) AS page_number,
        p_name AS product_name, p_brand AS brand, p_type AS category, p_retailprice AS regular_price,
        CASE WHEN l_discount > 0.02 THEN p_retailprice * (1 - l_discount) END AS discounted_price,
        CASE WHEN l_discount > 0.02 THEN l_discount * 100 END AS discount_percentage,
        CAST(1 - CAST(l_tax AS DECIMAL(4,2)) * 5 AS DECIMAL(6,2)) AS confidence, CAST(l_shipdate AS DATE) AS created_at,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'auto_approved' WHEN l_returnflag = 'A' THEN 'approved'
        WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'pending' WHEN l_returnflag = 'N' THEN 'needs_correction' ELSE 'rejected' END AS review_status,
        CAST(l_quantity AS BIGINT) * 2 AS review_priority, l_linestatus = 'F' AS validation_passed,
        CAST(l_partkey % 20 * 40 AS BIGINT) AS bbox_x, CAST(l_suppkey % 15 * 60 AS BIGINT) AS bbox_y,
        CAST(100 + p_size * 4 AS BIGINT) AS bbox_width, CAST(120 + l_partkey % 50 AS BIGINT) AS bbox_height
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey""",
    ),
    "offers": (  # products as they come from extraction: with gaps in pages, missing values, flags
        ("lineitem", "orders", "part"),
        """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
        CAST(CAST(l_quantity AS BIGINT) AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS id,
        l_orderkey AS leaflet_id, CAST(o_custkey % 10 AS BIGINT) AS organization_id, CAST(l_linenumber + CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END AS BIGINT) AS page_number,
        CASE WHEN l_partkey % 19 = 0 THEN upper(p_name) WHEN l_partkey % 23 = 0 THEN concat('  ', p_name, ' 500 g TO!') WHEN l_partkey % 29 = 0 THEN 'Test 1' WHEN l_partkey % 31 = 0 THEN '' ELSE p_name END AS product_name,
        CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 12 = 0 THEN '  ' ELSE p_brand END AS brand,
        CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' WHEN 2 THEN 'X' ELSE concat('SKU-', CAST(l_partkey AS STRING)) END AS product_code, p_type AS category,
        CASE WHEN l_suppkey % 13 = 0 THEN NULL WHEN l_suppkey % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice END AS regular_price,
        CASE WHEN l_discount > 0.02 THEN CASE WHEN l_suppkey % 19 = 0 THEN p_retailprice * 2 WHEN l_suppkey % 23 = 0 THEN p_retailprice ELSE p_retailprice * (1 - l_discount) END END AS discounted_price,
        CASE WHEN l_discount > 0.02 AND l_partkey % 3 > 0 THEN CASE WHEN l_suppkey % 7 = 0 THEN CAST(55 AS DOUBLE) ELSE l_discount * 100 END END AS discount_percentage,
        CASE l_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'HUF' WHEN 2 THEN 'RSD' WHEN 3 THEN 'XYZ' ELSE 'EUR' END AS currency, CAST(l_quantity AS BIGINT) % 40 AS quantity, 'kg' AS units,
        CAST(1 - CAST(l_tax AS DECIMAL(4,2)) * 8 AS DECIMAL(6,2)) AS confidence,
        CASE WHEN l_partkey % 4 > 0 THEN CAST(CAST(50 + l_suppkey % 50 AS DECIMAL(6,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(6,2)) END AS category_confidence,
        CASE WHEN l_partkey % 6 > 0 THEN CAST(CAST(60 + l_partkey % 40 AS DECIMAL(6,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(6,2)) END AS brand_confidence,
        CASE l_suppkey % 6 WHEN 0 THEN 'partial_product' WHEN 1 THEN 'continues_on_next_page' WHEN 2 THEN 'continued_from_previous,price_unclear' WHEN 3 THEN 'CATEGORY_LOW_CONFIDENCE' ELSE '' END AS flags,
        CASE WHEN l_partkey % 9 > 0 THEN CAST(l_partkey % 20 * 40 AS BIGINT) END AS bbox_x, CASE WHEN l_partkey % 9 > 0 THEN CAST(l_suppkey % 15 * 60 AS BIGINT) END AS bbox_y,
        CASE WHEN l_partkey % 9 > 0 THEN CAST(30 + p_size * 4 AS BIGINT) END AS bbox_width, CASE WHEN l_partkey % 9 > 0 THEN CAST(120 + l_partkey % 50 AS BIGINT) END AS bbox_height,
        CAST(l_shipdate AS DATE) AS created_at, l_returnflag AS state, l_linestatus = 'F' AS validation_passed
        FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey""",
    ),
    "regions": (  # of a leaflet's sheet, with what was read in them; one in four offers has none
        ("lineitem", "part"),
        """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
        CAST(CAST(l_quantity AS BIGINT) AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS region, l_orderkey AS leaflet_id,
        CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE CASE l_partkey % 7 WHEN 0 THEN concat(upper(p_brand), ' ', p_name, ' ', replace(CAST(p_retailprice AS STRING), '.', ',')) WHEN 1 THEN concat(p_name, ' extra') WHEN 2 THEN concat('akcija sku - ', CAST(l_partkey AS STRING))
        WHEN 3 THEN concat('samo ', CAST(p_retailprice AS STRING), ' eur') WHEN 4 THEN '' WHEN 5 THEN concat(p_name, ' ', CAST(CAST(l_quantity AS BIGINT) % 40 AS STRING), ' kg') END END AS text,
        CAST(l_partkey % 20 * 40 + 15 AS BIGINT) AS bbox_x, CAST(l_suppkey % 15 * 60 + 10 AS BIGINT) AS bbox_y, CAST(60 + p_size * 4 AS BIGINT) AS bbox_width, CAST(140 + l_partkey % 50 AS BIGINT) AS bbox_height
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_suppkey % 4 > 0""",
    ),
    "texts": (  # boxes of text on a leaflet's sheet: a name, a price, a unit or the like of each line
        ("lineitem", "part"),
        """SELECT concat(id, '-', CAST(nth AS STRING)) AS id, leaflet_id,
        CASE nth WHEN 1 THEN p_name WHEN 2 THEN CASE s % 3 WHEN 0 THEN concat(CAST(q AS STRING), ',99 €') WHEN 1 THEN '1⁹⁹' ELSE concat(CAST(q AS STRING), ',50') END
        ELSE CASE k % 4 WHEN 0 THEN '500 g' WHEN 1 THEN '-20 %' WHEN 2 THEN 'ab' END END AS text,
        CASE WHEN k % 37 > 0 THEN CAST(k % 20 * 40 + CASE nth WHEN 1 THEN 0 WHEN 2 THEN k % 3 * 30 ELSE 20 END AS BIGINT) END AS bbox_x,
        CASE WHEN k % 37 > 0 THEN CAST(s % 15 * 60 + CASE nth WHEN 1 THEN 0 WHEN 2 THEN 40 + s % 4 * 20 ELSE 110 + s % 5 * 30 END AS BIGINT) END AS bbox_y,
        CASE WHEN k % 37 > 0 THEN CAST(CASE nth WHEN 1 THEN 150 WHEN 2 THEN 80 ELSE 60 END AS BIGINT) END AS bbox_width,
        CASE WHEN k % 37 > 0 THEN CAST(CASE nth WHEN 1 THEN 30 WHEN 2 THEN 40 ELSE 20 END AS BIGINT) END AS bbox_height
        FROM (SELECT DISTINCT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
        CAST(CAST(l_quantity AS BIGINT) AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS id, l_orderkey AS leaflet_id, l_partkey AS k, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q, p_name
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey) CROSS JOIN (SELECT 1 AS nth UNION ALL SELECT 2 UNION ALL SELECT 3) WHERE nth = 1 OR nth = 2 AND k % 4 > 0 OR nth = 3 AND k % 5 > 0""",
    ),
    "costs": (
        ("orders",),
        """SELECT o_orderkey AS leaflet_id, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INT) AS processed_at,
        CASE o_orderkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider_type,
        CASE o_orderkey % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS model_name,
        CAST(o_orderkey % 1000 AS BIGINT) AS input_tokens, CAST(o_orderkey % 300 AS BIGINT) AS output_tokens,
        CAST(CAST(o_totalprice AS DECIMAL(15,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS total_cost FROM {orders}""",
    ),
    "audit": (
        ("events",),
        """SELECT event_id AS id, ts AS created_at, CAST(ts AS DATE) AS usage_date, CAST(extract(hour FROM ts) AS BIGINT) AS usage_hour, user_id,
        CAST(user_id % 10 AS BIGINT) AS organization_id, CAST(event_id % 5 AS BIGINT) AS provider_id, event_type,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
        CAST(CAST(abs(value) AS DECIMAL(15,2)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS cost,
        CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS tokens, concat('10.0.0.', CAST(user_id % 40 AS STRING)) AS request_ip FROM {events}""",
    ),
    "organizations": (("nation",), "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey AS region_id FROM {nation} WHERE n_nationkey < 8"),
    "providers": (("region",), "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM {region} WHERE r_regionkey < 4"),
}

#: How lines meet their parts in the texts above.
PARTS = " JOIN {part} ON p_partkey = l_partkey"


def duckdb_with(*names: str) -> str:
    """The adapters as a WITH clause over the driver's plain table names."""
    made = (f"{n} AS ({ADAPTERS[n][1].format(**{t: t for t in ADAPTERS[n][0]})})" for n in names)
    return "WITH RECURSIVE " + ", ".join(made) + " "


class Tables:
    """The model's tables of one folder, as attributes, each read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _adapted(self, name: str) -> DataFrame:
        reads, sql = ADAPTERS[name]
        tables = {t: self.raw(t) for t in reads}
        if "lineitem" in tables and "orders" in tables:
            tables["lineitem"], tables["orders"] = self._met(tables["lineitem"], tables["orders"].select("o_orderkey", "o_custkey"))
        return self.spark.sql(sql, **tables)

    def _sent(self, table: DataFrame) -> bool:
        """Whether a table is small enough to be sent to every task."""
        return table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()

    def _dealt(self, lines: DataFrame) -> DataFrame:
        """Lines by leaflet, in as many tasks as there are shuffle partitions."""
        return lines.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")

    def _met(self, lines: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Lines and orders for their join. Orders too large to be sent to all tasks are hashed (they are narrow, one row a key), so that
        neither side is sorted, and lines are dealt to as many tasks as there are shuffle partitions: adaptive execution would merge
        these by compressed size, and millions of narrow rows, in the aggregates and windows that follow, would be one task's."""
        return (lines, orders) if self._sent(orders) else (self._dealt(lines), orders.hint("shuffle_hash"))

    def _lines(self, *names: str) -> DataFrame:
        """Lines with their parts, with the columns that the views named speak of, dealt by leaflet before anything is made of them.
        Parts are sent to all tasks if they are small enough; else lines meet them first, which are hashed, and then move on by
        leaflet: each line moves twice, as narrow as it is read, and is not sorted."""
        said = " ".join(ADAPTERS[n][1] for n in names)
        lines, parts = (df.select([c for c in df.columns if c in said]) for df in map(self.raw, ("lineitem", "part")))
        on = F.col("p_partkey") == F.col("l_partkey")
        return lines.repartition("l_orderkey").join(parts, on) if self._sent(parts) else self._dealt(lines.join(parts.hint("shuffle_hash"), on))

    def _viewed(self, name: str, lines: DataFrame) -> DataFrame:
        """A view of lines that have met their parts and lie by leaflet."""
        reads, sql = ADAPTERS[name]
        tables = {"lineitem": lines}
        if "orders" in reads:
            orders = self.raw("orders").select("o_orderkey", "o_custkey")
            tables["orders"] = orders if self._sent(orders) else orders.hint("shuffle_hash")
        return self.spark.sql(sql.replace(PARTS, ""), **tables)

    def by_leaflet(self, name: str) -> DataFrame:
        """texts, regions or offers, whose lines are dealt by leaflet before anything is made of them: what follows by leaflet need not move
        the longer rows."""
        return self._viewed(name, self._lines(name))

    def gathered(self, *names: str) -> list[DataFrame]:
        """Several of texts, regions and offers by leaflet, or one that is read several times, of lines that move once for all: a leaflet's
        lines are gathered to a row, whose columns no reader can leave out below, so that all read what was dealt once."""
        lines = self._lines(*names)
        rows = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(*[c for c in lines.columns if c != "l_orderkey"])).alias("lines"))
        return [self._viewed(n, rows.select("l_orderkey", F.inline("lines"))) for n in names]

    leaflets = cached_property(lambda self: self._adapted("leaflets"))
    products = cached_property(lambda self: self._adapted("products"))
    offers = cached_property(lambda self: self._adapted("offers"))
    regions = cached_property(lambda self: self._adapted("regions"))
    texts = cached_property(lambda self: self._adapted("texts"))
    costs = cached_property(lambda self: self._adapted("costs"))
    audit = cached_property(lambda self: self._adapted("audit"))
    organizations = cached_property(lambda self: self._adapted("organizations"))
    providers = cached_property(lambda self: self._adapted("providers"))


for _name in ADAPTERS:
    getattr(Tables, _name).__set_name__(Tables, _name)
