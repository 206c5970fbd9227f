"""Queries over aggregates, trends, filters, joins, windows and orders, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analytics as a
from ..operators import predicates as p
from ..operators import sorting as s
from ..operators import trends as t
from ..sources.tables import Tables, duckdb_with

FIRST, LAST = "1998-01-01", "1998-03-31"
PERIOD = f"created_at >= DATE '{FIRST}' AND created_at < DATE '{LAST}' + 1"
QUERIES: dict[str, tuple] = {}
CNT = "CAST(COUNT(*) AS BIGINT)"


def n_if(condition: str) -> str:
    return f"CAST(COUNT(*) FILTER (WHERE {condition}) AS BIGINT)"




def _days_as_text(df: DataFrame) -> DataFrame:
    """Days go out as text, which reads alike everywhere."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def add(name: str, reads: str, run, sql: str, days: str = "") -> None:
    """days: the result's columns of days."""
    sql = duckdb_with(*reads.split()) + sql if reads and sql else sql
    if days:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in days.split())}) FROM ({sql})"
    QUERIES[name] = (lambda spark, sf_dir: _days_as_text(run(Tables(spark, sf_dir))), sql)


def period() -> Column:
    return p.days("created_at", FIRST, LAST)


add(
    "a1_analytics_summary", "products", lambda x: a.product_summary(p.tenant(x.products, 3)),
    f"""SELECT {CNT} AS total, {", ".join(f"{n_if(f"review_status = '{k}'")} AS {k}" for k in a.STATUSES)}, {n_if("validation_passed")} AS valid, {n_if("review_priority >= 70")} AS high_priority,
    CAST(SUM(confidence) AS DOUBLE) / CAST(COUNT(confidence) AS DOUBLE) AS mean_confidence, {n_if("review_status IN ('auto_approved', 'approved')")} AS total_approved,
    {n_if("review_status IN ('pending', 'needs_correction')")} AS awaiting_review, CAST({n_if("review_status = 'auto_approved'")} AS DOUBLE) * 100 / CAST(GREATEST(COUNT(*), 1) AS DOUBLE) AS auto_rate,
    CAST({n_if("validation_passed")} AS DOUBLE) * 100 / CAST(GREATEST(COUNT(*), 1) AS DOUBLE) AS validation_rate FROM products WHERE organization_id = 3""",
)
add(
    "a2_leaflet_summary", "leaflets", lambda x: a.leaflet_summary(p.tenant(x.leaflets, 3), period()),
    f"""SELECT {CNT} AS total, {n_if(PERIOD)} AS in_period, {n_if("status = 'completed'")} AS completed, {n_if("status = 'failed'")} AS failed, {n_if("status = 'reviewing'")} AS reviewing,
    CAST(COALESCE(SUM(page_count) FILTER (WHERE {PERIOD}), 0) AS BIGINT) AS pages, COALESCE(SUM(processing_cost) FILTER (WHERE {PERIOD}), 0) AS cost FROM leaflets WHERE organization_id = 3""",
)
add(
    "a3_product_period", "products", lambda x: p.tenant(x.products, 3).where(period()).agg(F.count("*").alias("n"), a.mean("confidence").alias("mean_confidence")),
    f"SELECT {CNT} AS n, CAST(SUM(confidence) AS DOUBLE) / CAST(COUNT(confidence) AS DOUBLE) AS mean_confidence FROM products WHERE organization_id = 3 AND {PERIOD}",
)
def cost_sums() -> dict[str, Column]:
    return dict(cost=F.sum("total_cost"), input_tokens=F.sum("input_tokens"), output_tokens=F.sum("output_tokens"), n=F.count("*"))


COST_SQL = f"SUM(total_cost) AS cost, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens, {CNT} AS n FROM costs WHERE leaflet_id IN (SELECT id FROM leaflets WHERE organization_id = 3)"
add("a4_costs_by_provider", "costs leaflets", lambda x: a.grouped(p.tenant_by_leaflet(x.costs, x.leaflets, 3), "provider_type", **cost_sums()), f"SELECT provider_type, {COST_SQL} GROUP BY provider_type")
add("a7_costs_by_model", "costs leaflets", lambda x: a.grouped(p.tenant_by_leaflet(x.costs, x.leaflets, 3), "model_name", **cost_sums()), f"SELECT model_name, {COST_SQL} GROUP BY model_name")
for name, kind, good, every in (
    ("a5_success_with_reviewing", "counted", "status = 'completed'", "TRUE"),
    ("a6_success_rate", "ignored", "status = 'completed'", "status IN ('completed', 'failed')"),
    ("a15_system_success", "success", "status IN ('completed', 'reviewing')", "TRUE"),
):
    add(name, "leaflets", lambda x, kind=kind: a.success_rate(x.leaflets, kind), f"SELECT CAST({n_if(good)} AS DOUBLE) * 100 / CAST(GREATEST({n_if(every)}, 1) AS DOUBLE) AS success_rate FROM leaflets")
add(
    "a8_usage_summary", "audit", lambda x: x.audit.where(p.since("usage_date", "2024-01-30", 7)).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")),
    f"SELECT {CNT} AS n, CAST(SUM(tokens) AS BIGINT) AS tokens, SUM(cost) AS cost FROM audit WHERE usage_date >= DATE '2024-01-23'",
)
add(
    "a9_event_counters", "audit", lambda x: x.audit.agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("view", "click", "purchase")]),
    f"SELECT {', '.join(n_if(f"event_type = '{k}'") + f' AS {k}' for k in ('view', 'click', 'purchase'))} FROM audit",
)
add(
    "a10_top_retailers", "leaflets", lambda x: s.top(a.grouped(x.leaflets.where("retailer is not null"), "retailer", n=F.count("*"), pages=F.sum("page_count")), 3, "n", "retailer"),
    f"SELECT retailer, {CNT} AS n, CAST(SUM(page_count) AS BIGINT) AS pages FROM leaflets WHERE retailer IS NOT NULL GROUP BY retailer ORDER BY n DESC, retailer LIMIT 3",
)
add(
    "a11_all_statuses", "products", lambda x: a.with_all_statuses(p.tenant_by_leaflet(x.products.where(F.col("review_status") != "pending"), x.leaflets, 4)),
    f"""SELECT s.review_status, COALESCE(c.n, 0) AS n FROM (VALUES {", ".join(f"('{k}')" for k in a.STATUSES)}) s(review_status) LEFT JOIN
    (SELECT review_status, {CNT} AS n FROM products WHERE organization_id = 4 AND review_status <> 'pending' GROUP BY review_status) c ON c.review_status = s.review_status""",
)
DEFAULTS = ["Dairy", "Bakery", "Drinks", "Household"]
add(
    "a12_popular_categories", "products", lambda x: a.padded_top(a.grouped(x.products.where("category is not null"), "category", n=F.count("*")), "category", 8, DEFAULTS),
    f"""SELECT category, n FROM (SELECT category, n, 0 AS kind FROM (SELECT category, {CNT} AS n FROM products GROUP BY category)
    UNION ALL SELECT category, CAST(0 AS BIGINT), 1 + place FROM (VALUES {", ".join(f"('{d}', {i})" for i, d in enumerate(DEFAULTS))}) d(category, place)) ORDER BY kind, n DESC, category LIMIT 8""",
)
add("a13_status_breakdown", "leaflets", lambda x: a.grouped(x.leaflets, "status", n=F.count("*")), f"SELECT status, {CNT} AS n FROM leaflets GROUP BY status")
add(
    "a14_delivery_success", "audit", lambda x: x.audit.agg(F.count("*").alias("n"), a.share(F.count_if(F.col("status") == "success"), F.count("*"), None).alias("success_rate")),
    f"SELECT {CNT} AS n, CAST({n_if("status = 'success'")} AS DOUBLE) * 100 / CAST(COUNT(*) AS DOUBLE) AS success_rate FROM audit",
)
add(
    "a16_by_organization", "leaflets products",
    lambda x: a.grouped(x.leaflets, "organization_id", leaflets=F.count("*"), cost=F.sum("processing_cost")).join(a.grouped(x.products, "organization_id", products=F.count("*")), "organization_id", "left").fillna(0, ["products"]),
    f"""SELECT l.*, COALESCE(p.products, 0) AS products FROM (SELECT organization_id, {CNT} AS leaflets, SUM(processing_cost) AS cost FROM leaflets GROUP BY organization_id) l
    LEFT JOIN (SELECT organization_id, {CNT} AS products FROM products GROUP BY organization_id) p ON p.organization_id = l.organization_id""",
)
add(
    "a17_my_stats", "audit", lambda x: a.grouped(x.audit, "user_id", n=F.count("*"), errors=a.count_status("error", column="status"), purchases=F.count_if(F.col("event_type") == "purchase")),
    f"SELECT user_id, {CNT} AS n, {n_if("status = 'error'")} AS errors, {n_if("event_type = 'purchase'")} AS purchases FROM audit GROUP BY user_id",
)
add(
    "a18_cost_report", "audit providers",
    lambda x: a.shares_of_total(a.grouped(x.audit.join(F.broadcast(x.providers.withColumnRenamed("id", "provider_id")), "provider_id", "left").withColumn("provider", F.coalesce("name", F.concat(F.lit("Provider "), "provider_id"))), "provider", cost=F.sum("cost"), n=F.count("*")), "cost"),
    f"""SELECT provider, cost, n, CAST(cost AS DOUBLE) * 100 / CAST(SUM(cost) OVER () AS DOUBLE) AS share FROM (SELECT COALESCE(name, concat('Provider ', CAST(provider_id AS STRING))) AS provider,
    SUM(cost) AS cost, {CNT} AS n FROM audit LEFT JOIN providers ON providers.id = provider_id GROUP BY 1)""",
)
for unit in ("week", "month"):
    add(
        f"a18_cost_by_{unit}", "costs", lambda x, unit=unit: a.grouped(x.costs, F.to_date(F.date_trunc(unit, "processed_at")).alias("period"), cost=F.sum("total_cost")),
        f"SELECT CAST(date_trunc('{unit}', processed_at) AS DATE) AS period, SUM(total_cost) AS cost FROM costs GROUP BY 1", "period",
    )
add(
    "a19_token_split", "audit", lambda x: a.grouped(x.audit, "organization_id", tokens=F.sum("tokens"), input_tokens=F.floor(F.sum("tokens") * 4 / 5), output_tokens=F.sum("tokens") - F.floor(F.sum("tokens") * 4 / 5)),
    "SELECT organization_id, CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(floor(SUM(tokens) * 4 / 5) AS BIGINT) AS input_tokens, CAST(SUM(tokens) - floor(SUM(tokens) * 4 / 5) AS BIGINT) AS output_tokens FROM audit GROUP BY organization_id",
)
add(
    "a20_usage_report", "audit", lambda x: a.grouped(x.audit, "organization_id", requests=F.count("*"), cost=F.sum("cost"), active_days=F.count_distinct("usage_date"), users=F.count_distinct("user_id")),
    f"SELECT organization_id, {CNT} AS requests, SUM(cost) AS cost, CAST(COUNT(DISTINCT usage_date) AS BIGINT) AS active_days, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users FROM audit GROUP BY organization_id",
)
add("a21_provider_by_day", "audit", lambda x: a.grouped(x.audit.where("provider_id is not null"), "provider_id", "usage_date", n=F.count("*"), cost=F.sum("cost")), f"SELECT provider_id, usage_date, {CNT} AS n, SUM(cost) AS cost FROM audit WHERE provider_id IS NOT NULL GROUP BY 1, 2", "usage_date")
add(
    "a22_trend_label", "audit", lambda x: a.trend_label(a.grouped(x.audit, "usage_date", n=F.count("*")), "usage_date", "n"),
    f"""SELECT CASE WHEN hi > lo * 1.1 THEN 'rising' WHEN hi < lo * 0.9 THEN 'falling' ELSE 'stable' END AS trend FROM (SELECT
    CAST(SUM(n) FILTER (WHERE i > m - 7) AS DOUBLE) / 7 AS hi, CAST(SUM(n) FILTER (WHERE i <= 7) AS DOUBLE) / 7 AS lo FROM
    (SELECT {CNT} AS n, row_number() OVER (ORDER BY usage_date) AS i, COUNT(*) OVER () AS m FROM audit GROUP BY usage_date))""",
)
add(
    "a23_organization_report", "audit", lambda x: s.top(a.grouped(x.audit, "organization_id", requests=F.count("*"), cost=F.sum("cost"), providers=F.count_distinct("provider_id")).where("cost > 10"), 5, "cost", "organization_id"),
    f"SELECT organization_id, {CNT} AS requests, SUM(cost) AS cost, CAST(COUNT(DISTINCT provider_id) AS BIGINT) AS providers FROM audit GROUP BY organization_id HAVING SUM(cost) > 10 ORDER BY cost DESC, organization_id LIMIT 5",
)
add(
    "a24_provider_first_last", "audit", lambda x: a.grouped(p.tenant(x.audit, 2), "provider_id", first_used=F.min("usage_date"), last_used=F.max("usage_date"), n=F.count("*")),
    f"SELECT provider_id, MIN(usage_date) AS first_used, MAX(usage_date) AS last_used, {CNT} AS n FROM audit WHERE organization_id = 2 GROUP BY provider_id", "first_used last_used",
)
GROWTH = "CASE WHEN b > 0 THEN (CAST(v AS DOUBLE) - CAST(b AS DOUBLE)) * 100 / CAST(b AS DOUBLE) WHEN b IS NULL THEN NULL WHEN v = 0 THEN 0.0 ELSE 100.0 END"
add(
    "a25_growth", "audit", lambda x: a.growth(a.grouped(x.audit, "usage_date", n=F.count("*")), "usage_date", "n"),
    f"SELECT usage_date, v AS n, {GROWTH} AS growth FROM (SELECT usage_date, v, LAG(v) OVER (ORDER BY usage_date) AS b FROM (SELECT usage_date, {CNT} AS v FROM audit GROUP BY usage_date))", "usage_date",
)
add(
    "w1_growth_by_organization", "audit", lambda x: a.growth(a.grouped(x.audit, "organization_id", "usage_date", cost=F.sum("cost")), "usage_date", "cost", "organization_id"),
    f"""SELECT organization_id, usage_date, v AS cost, {GROWTH} AS growth FROM (SELECT organization_id, usage_date, v, LAG(v) OVER (PARTITION BY organization_id ORDER BY usage_date) AS b
    FROM (SELECT organization_id, usage_date, SUM(cost) AS v FROM audit GROUP BY 1, 2))""", "usage_date",
)
add(
    "a26_audit_summary", "audit", lambda x: a.grouped(x.audit, "event_type", n=F.count("*"), cost=F.sum("cost"), users=F.count_distinct("user_id"), organizations=F.count_distinct("organization_id")),
    f"SELECT event_type, {CNT} AS n, SUM(cost) AS cost, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users, CAST(COUNT(DISTINCT organization_id) AS BIGINT) AS organizations FROM audit GROUP BY event_type",
)
add(
    "a27_suspicious_addresses", "audit", lambda x: a.suspicious_addresses(x.audit, 5, 1.05),
    f"""SELECT request_ip, requests, failures, users FROM (SELECT request_ip, {CNT} AS requests, {n_if("status = 'error'")} AS failures, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users, CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / CAST(COUNT(*) OVER () AS DOUBLE) AS m
    FROM audit GROUP BY request_ip) WHERE failures >= 5 AND requests > 1.05 * m""",
)
add(
    "a27_hour_spikes", "audit", lambda x: a.spikes(a.grouped(x.audit, "usage_hour", n=F.count("*")), "n", 1.02),
    f"SELECT usage_hour, n FROM (SELECT usage_hour, {CNT} AS n, CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / CAST(COUNT(*) OVER () AS DOUBLE) AS m FROM audit GROUP BY usage_hour) WHERE n > 1.02 * m",
)
add("a29_by_type_and_status", "audit", lambda x: a.grouped(x.audit, "event_type", "status", n=F.count("*")), f"SELECT event_type, status, {CNT} AS n FROM audit GROUP BY 1, 2")
add(
    "a30_usage_rollup", "audit", lambda x: a.usage_rollup(x.audit).withColumns({c: F.to_date(c) for c in ("first_at", "last_at")}),
    f"""SELECT organization_id, provider_id, usage_date, {CNT} AS requests, CAST(SUM(tokens) AS BIGINT) AS tokens, SUM(cost) AS cost, CAST(MIN(created_at) AS DATE) AS first_at, CAST(MAX(created_at) AS DATE) AS last_at,
    CAST(SUM(tokens) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS mean_tokens FROM audit WHERE status = 'success' GROUP BY 1, 2, 3""", "usage_date first_at last_at",
)
add(
    "a31_processing_days", "leaflets costs", lambda x: a.grouped(x.leaflets.join(x.costs.withColumnRenamed("leaflet_id", "id"), "id").withColumn("days", F.date_diff("processed_at", "created_at")), "status", n=F.count("*"), days=F.sum("days").cast("double") / F.count("*").cast("double")),
    f"SELECT status, {CNT} AS n, CAST(SUM(processed_at - created_at) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS days FROM leaflets JOIN costs ON leaflet_id = id GROUP BY status",
)
add(
    "a32_frequent_errors", "audit", lambda x: a.frequent_errors(x.audit.where("status = 'error'").select(F.col("user_id").alias("field"), F.col("provider_id").alias("kind"))),
    f"SELECT user_id AS field, provider_id AS kind, {CNT} AS n, CASE WHEN COUNT(*) >= 10 THEN 'high' WHEN COUNT(*) >= 5 THEN 'medium' ELSE 'low' END AS priority FROM audit WHERE status = 'error' GROUP BY 1, 2 HAVING COUNT(*) >= 3",
)
add("a33_error_users", "audit", lambda x: a.grouped(x.audit.where("status = 'error'"), "user_id", n=F.count("*")).where("n >= 5"), f"SELECT user_id, {CNT} AS n FROM audit WHERE status = 'error' GROUP BY user_id HAVING COUNT(*) >= 5")
add(
    "a34_confidence_means", "products", lambda x: a.mean_of_means(x.products, "leaflet_id", "page_number", "confidence"),
    """SELECT leaflet_id, list_sum(list_sort(list(m))) / CAST(COUNT(*) AS DOUBLE) AS mean_of_means, CAST(SUM(s) AS DOUBLE) / CAST(SUM(n) AS DOUBLE) AS flat_mean FROM
    (SELECT leaflet_id, page_number, CAST(SUM(confidence) AS DOUBLE) / CAST(COUNT(confidence) AS DOUBLE) AS m, SUM(COALESCE(confidence, 0)) AS s, COUNT(*) AS n FROM products GROUP BY 1, 2) GROUP BY leaflet_id""",
)
add("a36_export_counts", "products", lambda x: p.export_scope(x.products, "review_queue").agg(F.count("*").alias("n"), F.count_distinct("leaflet_id").alias("leaflets")), f"SELECT {CNT} AS n, CAST(COUNT(DISTINCT leaflet_id) AS BIGINT) AS leaflets FROM products WHERE review_status IN ('pending', 'needs_correction')")
add("a37_top_brands", "products", lambda x: s.top(a.grouped(x.products, F.coalesce("brand", F.lit("Unknown")).alias("brand"), n=F.count("*")), 10, "n", "brand"), f"SELECT COALESCE(brand, 'Unknown') AS brand, {CNT} AS n FROM products GROUP BY 1 ORDER BY n DESC, brand LIMIT 10")
add("a38_json_sum", "", lambda x: x.raw("events").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k")), "SELECT CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events")
add(
    "a39_priority_bands", "products", lambda x: a.priority_bands(x.products),
    f"SELECT {', '.join(n_if(f'100 - review_priority BETWEEN {lo} AND {hi}') + f' AS {k}' for k, lo, hi in (('critical', 0, 20), ('high', 20, 40), ('medium', 40, 60), ('low', 60, 100)))} FROM products",
)
add("a40_page_statuses", "products", lambda x: a.grouped(s.page(x.products, "created_at", "desc", 2, 50), "review_status", n=F.count("*")), f"SELECT review_status, {CNT} AS n FROM (SELECT * FROM products ORDER BY created_at DESC, id LIMIT 50 OFFSET 50) GROUP BY 1")
add(
    "a41_weighted_mean", "audit", lambda x: a.grouped(a.usage_rollup(x.audit), "organization_id", mean_tokens=F.sum("tokens").cast("double") / F.sum("requests").cast("double")),
    "SELECT organization_id, CAST(SUM(tokens) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS mean_tokens FROM audit WHERE status = 'success' GROUP BY organization_id",
)

# filters
PICK = "id, product_name, brand, leaflet_id"
pick = [c.strip() for c in PICK.split(",")]
add("p1_search", "products", lambda x: x.products.where(p.contains_any("RED", "product_name", "brand")).select(*pick), f"SELECT {PICK} FROM products WHERE product_name ILIKE '%RED%' OR brand ILIKE '%RED%'")
add("p2_optional_filters", "products", lambda x: p.optional(x.products, organization_id=3, review_status=["pending", "approved"], brand=None).select(*pick), f"SELECT {PICK} FROM products WHERE organization_id = 3 AND review_status IN ('pending', 'approved')")
add("p3_threshold", "products", lambda x: x.products.where(F.col("confidence") >= 0.9).select(*pick), f"SELECT {PICK} FROM products WHERE confidence >= 0.9")
add("p6_period", "products", lambda x: x.products.where(period()).select(*pick), f"SELECT {PICK} FROM products WHERE {PERIOD}")
add("p7_rolling", "leaflets", lambda x: x.leaflets.where(p.since("created_at", "2001-08-01", 30)).select("id", "status"), "SELECT id, status FROM leaflets WHERE created_at >= DATE '2001-07-02'")
add(
    "p9_addressed", "audit", lambda x: x.audit.select("id", F.nullif(F.col("user_id") % 7, F.lit(0)).alias("user_id"), F.nullif(F.col("organization_id") % 3, F.lit(0)).alias("organization_id"), F.when(F.col("provider_id") > 1, F.col("event_type")).alias("role")).where(p.addressed(3, [1, 2], ["click"])).select("id"),
    """SELECT id FROM (SELECT id, NULLIF(user_id % 7, 0) AS u, NULLIF(organization_id % 3, 0) AS o, CASE WHEN provider_id > 1 THEN event_type END AS r FROM audit)
    WHERE COALESCE(u = 3, FALSE) OR (COALESCE(o IN (1, 2), FALSE) AND u IS NULL) OR (COALESCE(r = 'click', FALSE) AND u IS NULL AND o IS NULL) OR (u IS NULL AND o IS NULL AND r IS NULL)""",
)
add(
    "p12_client_filters", "products",
    lambda x: x.products.where(p.client_filters([("product_name", "starts_with", "RED"), ("confidence", "greater_than", 0.8), ("page_number", "between", (2, 5)), ("category", "not_in", ["none"]), ("product_name", "contains", "o")])).select(*pick),
    f"SELECT {PICK} FROM products WHERE starts_with(lower(product_name), 'red') AND confidence > 0.8 AND page_number BETWEEN 2 AND 5 AND category NOT IN ('none') AND contains(lower(product_name), 'o')",
)
add("p13_any_text", "leaflets", lambda x: x.leaflets.where(p.any_text(x.leaflets, "urgent")).select("id", "retailer"), "SELECT id, retailer FROM leaflets WHERE contains(lower(status), 'urgent') OR contains(lower(retailer), 'urgent')")
add(
    "p15_ranked_search", "products", lambda x: s.ranked_search(x.products.select("id", "product_name", "category").distinct(), "r", "product_name", "category", "id").select("id"),
    "SELECT id FROM (SELECT DISTINCT id, product_name, category FROM products) WHERE contains(lower(product_name), 'r') OR contains(lower(category), 'r') ORDER BY CASE WHEN contains(lower(product_name), 'r') THEN 0 ELSE 1 END, id LIMIT 50",
)
add("p16_subscribed", "audit", lambda x: x.audit.groupBy("user_id").agg(F.collect_set("event_type").alias("events")).where(p.subscribed("purchase")).select("user_id"), "SELECT user_id FROM audit GROUP BY user_id HAVING list_contains(list(event_type), 'purchase')")

# joins
add("j1_semi_join", "costs leaflets", lambda x: p.tenant_by_leaflet(x.costs, x.leaflets, 5).select("leaflet_id", "total_cost"), "SELECT leaflet_id, total_cost FROM costs WHERE leaflet_id IN (SELECT id FROM leaflets WHERE organization_id = 5)")
add(
    "j2_semi_join_periods", "costs leaflets", lambda x: p.tenant_by_leaflet(x.costs.where(p.days("processed_at", FIRST, LAST)), x.leaflets.where(period()), 5).agg(F.sum("total_cost").alias("cost"), F.count("*").alias("n")),
    f"SELECT SUM(total_cost) AS cost, {CNT} AS n FROM costs WHERE processed_at >= DATE '{FIRST}' AND processed_at < DATE '{LAST}' + 1 AND leaflet_id IN (SELECT id FROM leaflets WHERE organization_id = 5 AND {PERIOD})",
)
add("j5_filter_options", "audit organizations", lambda x: x.organizations.join(x.audit.select(F.col("organization_id").alias("id")).distinct(), "id", "left_semi").select("id", "name"), "SELECT id, name FROM organizations WHERE id IN (SELECT organization_id FROM audit)")
add(
    "j8_lookup_names", "audit organizations", lambda x: a.grouped(x.audit.join(F.broadcast(x.organizations.select(F.col("id").alias("organization_id"), "name")), "organization_id", "left").withColumn("name", F.coalesce("name", F.lit("Unknown"))), "name", n=F.count("*")),
    f"SELECT COALESCE(name, 'Unknown') AS name, {CNT} AS n FROM audit LEFT JOIN organizations o ON o.id = organization_id GROUP BY 1",
)
add("j10_in_given_order", "leaflets", lambda x: s.in_given_order(x.leaflets.select("id", "status"), [7, 3, 99999999, 5]), "SELECT position, id, status FROM (VALUES (0, 7), (1, 3), (2, 99999999), (3, 5)) v(position, id) JOIN leaflets USING (id)")
add(
    "j11_product_counts", "leaflets products", lambda x: s.page(x.leaflets, "created_at", "desc", 1, 100).join(a.grouped(x.products, F.col("leaflet_id").alias("id"), n=F.count("*")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")),
    f"SELECT id, COALESCE(n, 0) AS n FROM (SELECT id FROM leaflets ORDER BY created_at DESC, id LIMIT 100) LEFT JOIN (SELECT leaflet_id, {CNT} AS n FROM products GROUP BY 1) ON leaflet_id = id",
)
add("j16_pages_of_leaflet", "products", lambda x: x.products.groupBy("leaflet_id").agg(F.array_join(F.array_sort(F.collect_set("page_number").cast("array<string>")), ",").alias("pages")), "SELECT leaflet_id, array_to_string(list_sort(list(DISTINCT CAST(page_number AS STRING))), ',') AS pages FROM products GROUP BY 1")

# windows
add(
    "w2_later_repeats", "products", lambda x: x.products.select("id", "leaflet_id", "product_name", F.row_number().over(Window.partitionBy("leaflet_id", "product_name").orderBy("id")).alias("k"), F.first("id").over(Window.partitionBy("leaflet_id", "product_name").orderBy("id")).alias("first_id")).where("k > 1").drop("k"),
    "SELECT id, leaflet_id, product_name, first_id FROM (SELECT id, leaflet_id, product_name, row_number() OVER w AS k, first_value(id) OVER w AS first_id FROM products WINDOW w AS (PARTITION BY leaflet_id, product_name ORDER BY id)) WHERE k > 1",
)
add("w5_last_twenty", "audit", lambda x: x.audit.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))).where("k <= 20").select("user_id", "id"), "SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS k FROM audit) WHERE k <= 20")
add(
    "w6_gap_clusters", "audit",
    lambda x: x.audit.withColumn("g", F.coalesce(F.date_diff("usage_date", F.lag("usage_date").over(Window.partitionBy("user_id").orderBy("created_at", "id"))) > 1, F.lit(True)).cast("int")).groupBy("user_id").agg(F.sum("g").alias("clusters")),
    "SELECT user_id, CAST(SUM(g) AS BIGINT) AS clusters FROM (SELECT user_id, CASE WHEN COALESCE(usage_date - LAG(usage_date) OVER (PARTITION BY user_id ORDER BY created_at, id) > 1, TRUE) THEN 1 ELSE 0 END AS g FROM audit) GROUP BY user_id",
)
add(
    "w7_islands", "audit",
    lambda x: a.grouped(a.grouped(x.audit, "user_id", "usage_date", n=F.count("*")).where("n > 1").withColumn("island", F.date_sub("usage_date", F.row_number().over(Window.partitionBy("user_id").orderBy("usage_date")))), "user_id", "island", days=F.count("*"), begins=F.min("usage_date")).where("days >= 3").drop("island"),
    f"""SELECT user_id, days, begins FROM (SELECT user_id, island, {CNT} AS days, MIN(usage_date) AS begins FROM (SELECT user_id, usage_date, usage_date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY usage_date) AS INT) AS island
    FROM (SELECT user_id, usage_date FROM audit GROUP BY 1, 2 HAVING COUNT(*) > 1)) GROUP BY 1, 2) WHERE days >= 3""", "begins",
)
add(
    "w8_local_maxima", "audit", lambda x: a.grouped(x.audit, "organization_id", "usage_date", n=F.count("*")).withColumn("m", F.max("n").over(Window.partitionBy("organization_id").orderBy("usage_date").rowsBetween(-3, 3))).where("n = m").drop("m"),
    f"SELECT organization_id, usage_date, n FROM (SELECT organization_id, usage_date, {CNT} AS n, MAX(COUNT(*)) OVER (PARTITION BY organization_id ORDER BY usage_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM audit GROUP BY 1, 2) WHERE n = m", "usage_date",
)
add("w9_share_of_total", "leaflets", lambda x: a.shares_of_total(a.grouped(x.leaflets, "retailer", cost=F.sum("processing_cost")), "cost"), "SELECT retailer, SUM(processing_cost) AS cost, CAST(SUM(processing_cost) AS DOUBLE) * 100 / CAST(SUM(SUM(processing_cost)) OVER () AS DOUBLE) AS share FROM leaflets GROUP BY retailer")
add("w10_above_mean", "audit", lambda x: a.spikes(a.grouped(x.audit, "user_id", cost=F.sum("cost")), "cost", 1.2), "SELECT user_id, cost FROM (SELECT user_id, SUM(cost) AS cost, CAST(SUM(SUM(cost)) OVER () AS DOUBLE) / CAST(COUNT(*) OVER () AS DOUBLE) AS m FROM audit GROUP BY user_id) WHERE CAST(cost AS DOUBLE) > 1.2 * m")

# orders
add("s1_page", "products", lambda x: s.page(x.products, "regular_price", "desc", 3, 40).select("id", "regular_price"), "SELECT id, regular_price FROM products ORDER BY regular_price DESC NULLS FIRST, id LIMIT 40 OFFSET 80")
add("s1_page_fallback", "products", lambda x: s.page(x.products, "no_such_column", "asc", 1, 25).select("id", "created_at"), "SELECT id, created_at FROM products ORDER BY created_at, id LIMIT 25", "created_at")
add("s2_review_queue", "products", lambda x: s.review_queue(x.products, 30).select("id"), "SELECT id FROM products WHERE review_status IN ('pending', 'needs_correction') ORDER BY review_priority DESC, confidence, id LIMIT 30")
add("s9_reading_order", "products", lambda x: x.products.select("id", F.row_number().over(Window.partitionBy("leaflet_id", "page_number").orderBy(F.floor(F.col("bbox_y") / 100), "bbox_x", "id")).alias("place")), "SELECT id, CAST(row_number() OVER (PARTITION BY leaflet_id, page_number ORDER BY floor(bbox_y / 100), bbox_x, id) AS INT) AS place FROM products")

# series
add(
    "t1_daily_counts", "leaflets", lambda x: t.daily(p.tenant(x.leaflets, 3), "created_at", FIRST, LAST, n=F.count("*"), pages=F.sum("page_count")),
    f"""SELECT d.day, COALESCE(n, 0) AS n, CAST(COALESCE(pages, 0) AS BIGINT) AS pages FROM (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS day) d
    LEFT JOIN (SELECT created_at AS day, {CNT} AS n, SUM(page_count) AS pages FROM leaflets WHERE organization_id = 3 GROUP BY 1) c ON c.day = d.day""", "day",
)
add("t2_same_day_costs", "leaflets costs", lambda x: t.same_day_costs(x.leaflets, x.costs), "SELECT created_at AS day, SUM(total_cost) AS cost FROM leaflets JOIN costs ON leaflet_id = id AND processed_at = created_at GROUP BY 1", "day")
add("t10_week_labels", "audit", lambda x: a.grouped(x.audit, t.week_label("usage_date").alias("week"), n=F.count("*")), f"SELECT strftime(date_trunc('week', usage_date), '%Y-W%U') AS week, {CNT} AS n FROM audit GROUP BY 1")

# figures whose terms come from two tables, each summed by itself first
STATES = "CASE WHEN id % 7 = 0 THEN 'extracting' WHEN id % 11 = 0 THEN 'processing' ELSE status END"
add("a2_leaflet_states", "leaflets", lambda x: p.tenant(x.leaflets, 3).withColumn("status", F.expr(STATES)).agg(F.count_if(F.col("status").isin("processing", "extracting")).alias("processing"), F.count_if(F.col("status") == "completed").alias("completed")), f"SELECT {n_if(f"{STATES} IN ('processing', 'extracting')")} AS processing, {n_if(f"{STATES} = 'completed'")} AS completed FROM leaflets WHERE organization_id = 3")
add(
    "a4_average_cost", "costs leaflets",
    lambda x: a.average_cost(p.tenant_by_leaflet(x.costs, x.leaflets, 3).where(p.days("processed_at", FIRST, LAST)), p.tenant(x.leaflets, 3).where(period())),
    f"""SELECT cost, input_tokens, output_tokens, leaflets, round_even(CAST(cost AS DOUBLE) / GREATEST(leaflets, 1), 4) AS average FROM (SELECT COALESCE(SUM(total_cost), 0) AS cost, CAST(COALESCE(SUM(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(COALESCE(SUM(output_tokens), 0) AS BIGINT) AS output_tokens FROM costs
    WHERE leaflet_id IN (SELECT id FROM leaflets WHERE organization_id = 3) AND {PERIOD.replace("created_at", "processed_at")}), (SELECT {CNT} AS leaflets FROM leaflets WHERE organization_id = 3 AND {PERIOD})""",
)
add(
    "a15_products_per_leaflet", "leaflets products", lambda x: a.products_per_leaflet(x.products, x.leaflets),
    f"SELECT products, leaflets, round_even(CAST(products AS DOUBLE) / GREATEST(leaflets, 1), 1) AS mean FROM (SELECT {CNT} AS products FROM products), (SELECT {CNT} AS leaflets FROM leaflets)",
)
add(
    "a16_users", "leaflets products", lambda x: a.by_user(x.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")), x.leaflets, x.products),
    f"""SELECT o_custkey AS user_id, CAST(COUNT(DISTINCT organization_id) AS BIGINT) AS organizations, {CNT} AS leaflets, CAST(SUM(COALESCE(n, 0)) AS BIGINT) AS products, SUM(processing_cost) AS cost FROM orders JOIN leaflets l ON l.id = o_orderkey LEFT JOIN (SELECT leaflet_id, COUNT(*) AS n FROM products GROUP BY 1) p ON p.leaflet_id = l.id GROUP BY 1""",
)
add(
    "a23_organization_days", "audit", lambda x: a.organization_report(x.audit, 100).select("organization_id", "requests", "cost", F.size("providers").alias("n_providers"), F.explode("days").alias("d")).select("organization_id", "requests", "cost", "n_providers", "d.*"),
    f"""SELECT organization_id, requests, cost, n_providers, usage_date, n, day_cost, CAST(day_cost AS DOUBLE) / CAST(n AS DOUBLE) AS mean FROM (SELECT organization_id, {CNT} AS requests, SUM(cost) AS cost, CAST(COUNT(DISTINCT provider_id) AS INT) AS n_providers FROM audit GROUP BY 1 HAVING SUM(cost) >= 100) JOIN (SELECT organization_id, usage_date, {CNT} AS n, SUM(cost) AS day_cost FROM audit GROUP BY 1, 2) USING (organization_id)""", "usage_date",
)
add(
    "a23_organization_providers", "audit", lambda x: a.organization_report(x.audit, 100).select("organization_id", F.explode("providers").alias("d")).select("organization_id", "d.*"),
    f"SELECT organization_id, provider_id, {CNT} AS n, SUM(cost) AS provider_cost FROM audit WHERE organization_id IN (SELECT organization_id FROM audit GROUP BY 1 HAVING SUM(cost) >= 100) GROUP BY 1, 2",
)
