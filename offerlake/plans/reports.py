"""The rest of the dashboards and reports: every figure that one shows, each query with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as a
from ..operators import predicates as p
from ..operators import sorting as s
from ..operators import trends as t
from .dashboards import CNT, FIRST, GROWTH, LAST, PERIOD, add, n_if, period

ratio = lambda n, d: f"CAST({n} AS DOUBLE) / CAST(GREATEST({d}, 1) AS DOUBLE)"
percent = lambda n, d: f"CAST({n} AS DOUBLE) * 100 / CAST(GREATEST({d}, 1) AS DOUBLE)"
PROCESSING = "status IN ('processing', 'extracting', 'validating')"
add(
    "a1_leaflets", "leaflets", lambda x: p.tenant(x.leaflets, 3).agg(F.count("*").alias("total"), *[a.count_status(k, column="status").alias(k) for k in ("completed", "reviewing", "failed")], a.count_status("processing", "extracting", "validating", column="status").alias("processing")),
    f"SELECT {CNT} AS total, {', '.join(n_if(f'''status = '{k}' ''') + f' AS {k}' for k in ('completed', 'reviewing', 'failed'))}, {n_if(PROCESSING)} AS processing FROM leaflets WHERE organization_id = 3",
)
# rounded as a dashboard shows them: one digit, half to even
add(
    "a1_shown_rates", "products", lambda x: a.shown_rates(p.tenant(x.products, 3)),
    f"SELECT round_even({percent(n_if("review_status = 'auto_approved'"), 'COUNT(*)')}, 1) AS auto_rate, round_even(COALESCE(CAST(SUM(confidence) AS DOUBLE) / CAST(COUNT(confidence) AS DOUBLE), 0) * 100, 1) AS mean_confidence, round_even({percent(n_if('validation_passed'), 'COUNT(*)')}, 1) AS validation_rate FROM products WHERE organization_id = 3",
)
add("a3_products_by_status", "products", lambda x: a.grouped(p.tenant(x.products, 3), "review_status", n=F.count("*"), in_period=F.count_if(period())), f"SELECT review_status, {CNT} AS n, {n_if(PERIOD)} AS in_period FROM products WHERE organization_id = 3 GROUP BY 1")
OWN = f"leaflet_id IN (SELECT id FROM leaflets WHERE organization_id = 3 AND {PERIOD}) AND processed_at >= DATE '{FIRST}' AND processed_at < DATE '{LAST}' + 1"


def own_costs(x):
    return p.tenant_by_leaflet(x.costs.where(p.days("processed_at", FIRST, LAST)), x.leaflets.where(period()), 3)


add(
    "a4_period_costs", "costs leaflets", lambda x: own_costs(x).agg(F.sum("total_cost").alias("cost"), (F.sum("total_cost").cast("double") / F.greatest(F.count_distinct("leaflet_id"), F.lit(1)).cast("double")).alias("per_leaflet")),
    f"SELECT SUM(total_cost) AS cost, {ratio('SUM(total_cost)', 'COUNT(DISTINCT leaflet_id)')} AS per_leaflet FROM costs WHERE {OWN}",
)
add("a7_costs_by_day", "costs leaflets", lambda x: a.grouped(own_costs(x), F.col("processed_at").alias("day"), "model_name", cost=F.sum("total_cost"), n=F.count("*")), f"SELECT processed_at AS day, model_name, SUM(total_cost) AS cost, {CNT} AS n FROM costs WHERE {OWN} GROUP BY 1, 2", "day")
add(
    "a5_quality", "products", lambda x: x.products.agg(a.share(F.count_if("validation_passed"), F.count("*"), None).alias("valid"), a.share(a.count_status("auto_approved"), F.count("*"), None).alias("auto")),
    f"SELECT {percent(n_if('validation_passed'), 'COUNT(*)')} AS valid, {percent(n_if("review_status = 'auto_approved'"), 'COUNT(*)')} AS auto FROM products",
)
FEEDBACK = "event_type = 'click'"  # corrections, on one of ten products' ids
add(
    "a6_error_and_correction", "products audit", lambda x: x.products.agg(F.count("*").alias("n"), F.count_if("validation_passed").alias("v")).join(F.broadcast(x.audit.where(FEEDBACK).agg(F.count("*").alias("c")))).select((100 - a.share(F.col("v"), F.col("n"), None)).alias("error_rate"), a.share(F.col("c"), F.col("n"), None).alias("correction_rate")),
    f"SELECT 100 - {percent('v', 'n')} AS error_rate, {percent('c', 'n')} AS correction_rate FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE validation_passed) AS v FROM products), (SELECT COUNT(*) AS c FROM audit WHERE {FEEDBACK})",
)
for name, days in (("day", 1), ("week", 7), ("month", 30), ("year", 365), ("all", 8795)):
    add(f"a8_usage_{name}", "audit", lambda x, days=days: x.audit.where(p.since("usage_date", "2024-01-30", days)).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")), f"SELECT {CNT} AS n, CAST(SUM(tokens) AS BIGINT) AS tokens, SUM(cost) AS cost FROM audit WHERE usage_date >= DATE '2024-01-30' - {days}")
add("a9_member_counters", "audit organizations", lambda x: x.audit.join(x.organizations.select(F.col("id").alias("organization_id")), "organization_id", "left_semi").agg(F.sum("tokens").alias("exports"), F.count_if(F.col("event_type") == "view").alias("views"), F.count("*").alias("n")), f"SELECT CAST(SUM(tokens) AS BIGINT) AS exports, {n_if("event_type = 'view'")} AS views, {CNT} AS n FROM audit WHERE organization_id IN (SELECT id FROM organizations)")
add(
    "a14_deliveries_30_days", "audit", lambda x: a.grouped(x.audit.where(p.since("usage_date", "2024-02-10", 30)), "status", n=F.count("*")), f"SELECT status, {CNT} AS n FROM audit WHERE usage_date >= DATE '2024-02-10' - 30 GROUP BY 1",
)
add(
    "a15_system_figures", "leaflets", lambda x: a.system_figures(x.leaflets, "2001-07-31"),
    f"SELECT {CNT} AS total, {n_if("created_at = DATE '2001-07-31'")} AS today, {n_if("created_at >= date_trunc('week', DATE '2001-07-31') AND created_at <= DATE '2001-07-31'")} AS this_week, {n_if("created_at >= DATE '2001-07-01' AND created_at <= DATE '2001-07-31'")} AS this_month, {percent(n_if("status IN ('completed', 'reviewing')"), 'COUNT(*)')} AS success, round_even({ratio('SUM(page_count)', 'COUNT(*)')}, 1) AS pages_per_leaflet FROM leaflets",
)
add("a16_by_user", "audit", lambda x: a.grouped(x.audit, "user_id", organizations=F.count_distinct("organization_id"), leaflets=F.count_distinct("provider_id"), n=F.count("*"), cost=F.sum("cost")), f"SELECT user_id, CAST(COUNT(DISTINCT organization_id) AS BIGINT) AS organizations, CAST(COUNT(DISTINCT provider_id) AS BIGINT) AS leaflets, {CNT} AS n, SUM(cost) AS cost FROM audit GROUP BY 1")
add(
    "a19_month_to_date", "audit", lambda x: a.grouped(x.audit, "organization_id", tokens=F.sum("tokens"), month=F.coalesce(F.sum(F.when(F.expr("usage_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'"), F.col("tokens"))), F.lit(0)), per_event=F.sum("tokens").cast("double") / F.count("*").cast("double")),
    f"SELECT organization_id, CAST(SUM(tokens) AS BIGINT) AS tokens, CAST(COALESCE(SUM(tokens) FILTER (WHERE usage_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'), 0) AS BIGINT) AS month, {ratio('SUM(tokens)', 'COUNT(*)')} AS per_event FROM audit GROUP BY 1",
)
ROLL = "SELECT organization_id, provider_id, usage_date, COUNT(*) AS requests, SUM(tokens) AS tokens, SUM(cost) AS cost, CAST(SUM(tokens) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS mean_tokens FROM audit WHERE status = 'success' GROUP BY 1, 2, 3"
add(
    "a20_unweighted_means", "audit", lambda x: a.usage_rollup(x.audit).groupBy("organization_id").agg(F.round(F.avg("mean_tokens"), 6).alias("mean"), F.count_distinct("usage_date").alias("active_days")),
    f"SELECT organization_id, round(AVG(mean_tokens), 6) AS mean, CAST(COUNT(DISTINCT usage_date) AS BIGINT) AS active_days FROM ({ROLL}) GROUP BY 1",
)
add(
    "a22_usage_analytics", "audit", lambda x: x.audit.agg(F.count("*").alias("requests"), F.sum("cost").alias("cost"), F.count_distinct("organization_id").alias("organizations"), F.count_distinct(F.when(F.col("status") == "success", F.col("user_id"))).alias("active_users")),
    f"SELECT {CNT} AS requests, SUM(cost) AS cost, CAST(COUNT(DISTINCT organization_id) AS BIGINT) AS organizations, CAST(COUNT(DISTINCT user_id) FILTER (WHERE status = 'success') AS BIGINT) AS active_users FROM audit",
)
add("a22_top_provider", "audit", lambda x: s.top(a.shares_of_total(a.grouped(x.audit, "provider_id", cost=F.sum("cost"), n=F.count("*")), "cost"), 1, "n", "provider_id"), f"SELECT provider_id, SUM(cost) AS cost, {CNT} AS n, CAST(SUM(cost) AS DOUBLE) * 100 / CAST(SUM(SUM(cost)) OVER () AS DOUBLE) AS share FROM audit GROUP BY 1 ORDER BY n DESC, provider_id LIMIT 1")
add(
    "a23_nested_days", "audit", lambda x: a.nested_days(x.audit),
    f"SELECT organization_id, SUM(c) AS cost, string_agg(concat(CAST(usage_date AS VARCHAR), ':', CAST(n AS VARCHAR)), ',' ORDER BY usage_date) AS days FROM (SELECT organization_id, usage_date, {CNT} AS n, SUM(cost) AS c FROM audit GROUP BY 1, 2) GROUP BY 1",
)
for unit, pattern, label in (("day", "yyyy-MM-dd", "%Y-%m-%d"), ("hour", "yyyy-MM-dd HH:00", "%Y-%m-%d %H:00")):
    add(f"a24_by_{unit}", "audit", lambda x, pattern=pattern: a.grouped(p.tenant(x.audit, 2), F.date_format("created_at", pattern).alias("label"), n=F.count("*"), cost=F.sum("cost")), f"SELECT strftime(created_at, '{label}') AS label, {CNT} AS n, SUM(cost) AS cost FROM audit WHERE organization_id = 2 GROUP BY 1")
for unit, column, sql in (("week", lambda: t.week_label("usage_date"), "strftime(date_trunc('week', usage_date), '%Y-W%U')"), ("month", lambda: F.date_format("usage_date", "yyyy-MM"), "strftime(usage_date, '%Y-%m')")):
    add(
        f"a25_growth_by_{unit}", "audit", lambda x, column=column: a.growth(a.grouped(x.audit, column().alias("period"), n=F.count("*"), organizations=F.count_distinct("organization_id"), providers=F.count_distinct("provider_id")), "period", "n"),
        f"SELECT period, v AS n, organizations, providers, {GROWTH} AS growth FROM (SELECT *, LAG(v) OVER (ORDER BY period) AS b FROM (SELECT {sql} AS period, {CNT} AS v, CAST(COUNT(DISTINCT organization_id) AS BIGINT) AS organizations, CAST(COUNT(DISTINCT provider_id) AS BIGINT) AS providers FROM audit GROUP BY 1))",
    )
add("a26_audit_totals", "audit", lambda x: x.audit.agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), (F.sum("tokens").cast("double") / F.count("tokens").cast("double")).alias("mean_latency"), F.count_distinct("user_id").alias("users"), F.count_distinct("request_ip").alias("addresses")), f"SELECT {CNT} AS n, SUM(cost) AS cost, {ratio('SUM(tokens)', 'COUNT(tokens)')} AS mean_latency, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users, CAST(COUNT(DISTINCT request_ip) AS BIGINT) AS addresses FROM audit")
for column in ("status", "provider_id", "organization_id"):
    add(f"a26_by_{column}", "audit", lambda x, column=column: a.grouped(x.audit, column, n=F.count("*"), cost=F.sum("cost")), f"SELECT {column}, {CNT} AS n, SUM(cost) AS cost FROM audit GROUP BY 1")
BY_IP = f"SELECT request_ip, {CNT} AS requests, {n_if("status = 'error'")} AS failures, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users FROM audit GROUP BY 1"
BY_USER = f"SELECT user_id, {CNT} AS requests, {n_if("status = 'error'")} AS failures, CAST(COUNT(DISTINCT request_ip) AS BIGINT) AS addresses FROM audit GROUP BY 1"
SHARED_IP, FAILING = "CASE WHEN user_id % 40 < 5 THEN '10.0.0.200' ELSE request_ip END", "CASE WHEN user_id % 40 = 39 THEN 'error' ELSE status END"  # planted: one address of many users, one whose requests all fail
add(
    "a27_addresses", "audit", lambda x: a.flagged_addresses(x.audit.withColumns({"request_ip": F.expr(SHARED_IP), "status": F.expr(FAILING)})), f"SELECT request_ip, requests, CASE WHEN failures * 100.0 / requests > 50 AND requests > 10 THEN 'High failure rate' ELSE 'Multiple users from same IP' END AS reason FROM ({BY_IP.replace('FROM audit', f'FROM (SELECT * REPLACE ({SHARED_IP} AS request_ip, {FAILING} AS status) FROM audit)')}) WHERE (failures * 100.0 / requests > 50 AND requests > 10) OR users > 10",
)
add("a27_top_addresses", "audit", lambda x: s.top(a.grouped(x.audit, "request_ip", requests=F.count("*")), 10, "requests", "request_ip"), f"SELECT request_ip, requests FROM ({BY_IP}) ORDER BY requests DESC, request_ip LIMIT 10")
add("a27_users", "audit", lambda x: a.flagged_users(x.audit), f"SELECT user_id, requests, CASE WHEN addresses > 5 THEN 'Multiple IP addresses' ELSE 'High failure rate' END AS reason FROM ({BY_USER}) WHERE addresses > 5 OR (failures * 100.0 / requests > 30 AND requests > 5)")
add(
    "a27_error_texts", "audit", lambda x: s.top(a.grouped(x.audit.where("status = 'error'"), F.substring(F.concat(F.lit("failed by provider "), "provider_id", F.lit(" " + "x" * 120), "user_id"), 1, 100).alias("error"), n=F.count("*"), users=F.count_distinct("user_id"), addresses=F.count_distinct("request_ip")), 10, "n", "error"),
    f"SELECT substring(concat('failed by provider ', CAST(provider_id AS VARCHAR), ' ', repeat('x', 120), CAST(user_id AS VARCHAR)), 1, 100) AS error, {CNT} AS n, CAST(COUNT(DISTINCT user_id) AS BIGINT) AS users, CAST(COUNT(DISTINCT request_ip) AS BIGINT) AS addresses FROM audit WHERE status = 'error' GROUP BY 1 ORDER BY n DESC, error LIMIT 10",
)
SPIKED = "CASE WHEN usage_hour = 13 THEN [1,2,3,4] ELSE [1] END"  # the hour of a planted spike, four times its events
add(
    "a27_hour_of_day_spikes", "audit", lambda x: a.spikes(a.grouped(x.audit.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(F.col("usage_hour") == 13, 4).otherwise(1)))), "usage_hour", n=F.count("*")), "n", 3),
    f"SELECT usage_hour, n FROM (SELECT usage_hour, n, CAST(SUM(n) OVER () AS DOUBLE) / CAST(COUNT(*) OVER () AS DOUBLE) AS m FROM (SELECT usage_hour, {CNT} AS n FROM (SELECT usage_hour, unnest({SPIKED}) AS i FROM audit) GROUP BY 1)) WHERE n > 3 * m",
)
BURST = "usage_hour = 13 AND usage_date = DATE '2024-01-05'"  # the hour of a planted burst, thirty times its events
add(
    "a27_bursts", "audit", lambda x: a.bursts(x.audit.withColumn("i", F.explode(F.sequence(F.lit(1), F.when(F.expr(BURST), 30).otherwise(1))))),
    f"SELECT usage_date, usage_hour, n FROM (SELECT usage_date, usage_hour, n, CAST(SUM(n) OVER () AS DOUBLE) / CAST(COUNT(*) OVER () AS DOUBLE) AS m, SUM(n) OVER () AS every FROM (SELECT usage_date, usage_hour, {CNT} AS n FROM (SELECT usage_date, usage_hour, unnest(range(CASE WHEN {BURST} THEN 30 ELSE 1 END)) AS i FROM audit) GROUP BY 1, 2)) WHERE every > 100 AND n > 4 * m", "usage_date",
)
ALERTS = "SELECT DISTINCT provider_id * 100 + organization_id AS id, CASE provider_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'monthly' ELSE 'hourly' END AS alert_type, CAST(50 + 10 * (organization_id % 5) AS BIGINT) AS threshold, organization_id % 4 > 0 AS is_active FROM {audit}"
TRIGGERS = "SELECT provider_id * 100 + organization_id AS id, COUNT(*) AS triggers FROM audit WHERE status = 'error' GROUP BY 1"
alerts = lambda x: x.spark.sql(ALERTS, audit=x.audit)
triggers = lambda x: x.audit.where("status = 'error'").select((F.col("provider_id") * 100 + F.col("organization_id")).alias("id"))
add(
    "a28_alerts_by_type", "audit", lambda x: a.alert_effect(alerts(x), triggers(x)),
    f"SELECT alert_type, {CNT} AS configured, {n_if('is_active')} AS active, CAST(SUM(COALESCE(triggers, 0)) AS BIGINT) AS triggers, {ratio('SUM(threshold)', 'COUNT(*)')} AS mean_threshold FROM ({ALERTS.format(audit='audit')}) LEFT JOIN ({TRIGGERS}) USING (id) GROUP BY 1",
)
add(
    "a28_most_triggered", "audit", lambda x: a.most_triggered(alerts(x), triggers(x)), f"SELECT threshold, CAST(SUM(COALESCE(triggers, 0)) AS BIGINT) AS triggers FROM ({ALERTS.format(audit='audit')}) LEFT JOIN ({TRIGGERS}) USING (id) GROUP BY 1 ORDER BY triggers DESC, threshold LIMIT 1",
)
SECONDS = "(leaflet_id % 3) * 86400 + leaflet_id % 977"
add(
    "a31_t6_processing_seconds", "leaflets costs", lambda x: a.processing_seconds(x.leaflets, x.costs.select(F.col("leaflet_id").alias("id"), F.expr("timestampadd(SECOND, leaflet_id % 977, CAST(processed_at AS TIMESTAMP_NTZ))").alias("done"))),
    f"SELECT s.status, COALESCE(n, 0) AS n, seconds FROM (VALUES ('pending'), ('processing'), ('completed'), ('reviewing'), ('failed')) s(status) LEFT JOIN (SELECT status, {CNT} AS n, CASE WHEN status = 'completed' THEN round_even(CAST(SUM({SECONDS}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE), 2) END AS seconds FROM leaflets JOIN costs ON leaflet_id = id GROUP BY 1) c ON c.status = s.status",
)
add("a33_unresolved_errors", "audit", lambda x: s.top(a.grouped(x.audit.where("status = 'error' and id % 3 > 0"), "provider_id", "organization_id", occurrences=F.count("*")).where("occurrences >= 5"), 20, "occurrences", "provider_id", "organization_id"), f"SELECT provider_id, organization_id, {CNT} AS occurrences FROM audit WHERE status = 'error' AND id % 3 > 0 GROUP BY 1, 2 HAVING COUNT(*) >= 5 ORDER BY occurrences DESC, provider_id, organization_id LIMIT 20")
add("a37_products_by_page", "offers", lambda x: a.grouped(x.offers, "page_number", n=F.count("*"), unbranded=F.count_if(F.col("brand").isNull())), f"SELECT page_number, {CNT} AS n, {n_if('brand IS NULL')} AS unbranded FROM offers GROUP BY 1")
add("a38_json_sum_of_month", "", lambda x: x.raw("events").where(F.date_trunc("month", "ts") == F.lit("2024-01-01").cast("timestamp_ntz")).agg(F.coalesce(F.sum(F.get_json_object("props", "$.k").cast("decimal(12,4)")), F.lit(0)).alias("k")), "SELECT COALESCE(SUM(CAST(json_extract_string(props, '$.k') AS DECIMAL(12,4))), 0) AS k FROM events WHERE date_trunc('month', ts) = TIMESTAMP '2024-01-01'")
ratios = {"per_request": ("cost", "requests"), "per_token": ("cost", "tokens"), "tokens_per_error": ("tokens", "errors")}
add(
    "a42_usage_ratios", "audit", lambda x: a.ratios(a.grouped(x.audit, "user_id", requests=F.count("*"), cost=F.sum("cost"), tokens=F.sum("tokens"), errors=F.count_if(F.col("status") == "error")), ratios).select("user_id", *ratios),
    f"SELECT user_id, {', '.join(f'CASE WHEN {d} = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END AS {k}' for k, (n, d) in ratios.items())} FROM (SELECT user_id, COUNT(*) AS requests, SUM(cost) AS cost, SUM(tokens) AS tokens, COUNT(*) FILTER (WHERE status = 'error') AS errors FROM audit GROUP BY 1)",
)
add(
    "a42_leaflet_ratios", "leaflets products",
    lambda x: a.ratios(a.grouped(x.leaflets, "organization_id", leaflets=F.count("*"), pages=F.sum("page_count"), cost=F.sum("processing_cost")).join(a.grouped(x.products, "organization_id", products=F.count("*")), "organization_id", "left").fillna(0, ["products"]), {"per_leaflet": ("cost", "leaflets"), "products_per_leaflet": ("products", "leaflets"), "pages_per_leaflet": ("pages", "leaflets")}).select("organization_id", "per_leaflet", "products_per_leaflet", "pages_per_leaflet"),
    "SELECT organization_id, CAST(cost AS DOUBLE) / n AS per_leaflet, CAST(COALESCE(products, 0) AS DOUBLE) / n AS products_per_leaflet, CAST(pages AS DOUBLE) / n AS pages_per_leaflet FROM (SELECT organization_id, COUNT(*) AS n, SUM(page_count) AS pages, SUM(processing_cost) AS cost FROM leaflets GROUP BY 1) LEFT JOIN (SELECT organization_id, COUNT(*) AS products FROM products GROUP BY 1) USING (organization_id)",
)
add("a44_unread_badge", "audit", lambda x: x.audit.where("organization_id < 5").limit(1000).agg(F.count("*").alias("unread")), "SELECT LEAST(COUNT(*), 1000) AS unread FROM audit WHERE organization_id < 5")

# joins, windows and series
add("j3_feedback_of_tenant", "audit leaflets", lambda x: p.tenant_by_leaflet(x.audit.withColumn("leaflet_id", F.col("id")), x.leaflets, 4).agg(F.count("*").alias("n")), f"SELECT {CNT} AS n FROM audit WHERE id IN (SELECT id FROM leaflets WHERE organization_id = 4)")
add("j4_usage_of_members", "audit organizations", lambda x: x.audit.join(x.organizations.where("region_id = 1").select(F.col("id").alias("organization_id")), "organization_id", "left_semi").groupBy("user_id").agg(F.sum("tokens").alias("tokens")), "SELECT user_id, CAST(SUM(tokens) AS BIGINT) AS tokens FROM audit WHERE organization_id IN (SELECT id FROM organizations WHERE region_id = 1) GROUP BY 1")
add("j6_members", "audit organizations", lambda x: x.audit.select("user_id", "organization_id").distinct().join(x.organizations.select(F.col("id").alias("organization_id"), "name"), "organization_id").select("user_id", "name"), "SELECT DISTINCT user_id, name FROM audit JOIN organizations o ON o.id = organization_id")
add("j7_failed_deliveries", "audit organizations", lambda x: s.top(x.audit.where("status = 'error' and usage_date >= DATE '2024-01-25'").join(x.organizations.select(F.col("id").alias("organization_id"), "name"), "organization_id"), 100, "created_at", "id").select("id", "name"), "SELECT audit.id, name FROM audit JOIN organizations o ON o.id = organization_id WHERE status = 'error' AND usage_date >= DATE '2024-01-25' ORDER BY audit.created_at DESC, audit.id LIMIT 100")
add(
    "w4_page_context", "offers", lambda x: x.offers.select("leaflet_id", "page_number").distinct().withColumns({k: f("page_number").over(Window.partitionBy("leaflet_id").orderBy("page_number")) for k, f in (("previous_page", F.lag), ("next_page", F.lead))}),
    "SELECT leaflet_id, page_number, LAG(page_number) OVER w AS previous_page, LEAD(page_number) OVER w AS next_page FROM (SELECT DISTINCT leaflet_id, page_number FROM offers) WINDOW w AS (PARTITION BY leaflet_id ORDER BY page_number)",
)
add(
    "w8_moving_average", "audit", lambda x: a.moving_average(a.grouped(x.audit, "organization_id", "usage_date", n=F.count("*")), "n", 2, "usage_date", "organization_id"),
    f"SELECT organization_id, usage_date, n, CAST(SUM(n) OVER (PARTITION BY organization_id ORDER BY usage_date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS DOUBLE) / 5 AS average FROM (SELECT organization_id, usage_date, {CNT} AS n FROM audit GROUP BY 1, 2)", "usage_date",
)
add("t3_presets", "", lambda x: t.presets(x.spark, "2024-03-31"), "SELECT * FROM (VALUES ('all', '2020-01-01', '2024-03-31'), ('last_30', '2024-03-02', '2024-03-31'), ('last_7', '2024-03-25', '2024-03-31'), ('last_month', '2024-02-01', '2024-02-29'), ('this_month', '2024-03-01', '2024-03-31'), ('this_year', '2024-01-01', '2024-03-31')) v(name, first, last)")
add(
    "t3_rows_by_preset", "audit", lambda x: x.audit.groupBy("usage_date").agg(F.count("*").alias("n"), F.sum("cost").alias("cost")).join(F.broadcast(t.presets(x.spark, "2024-02-10")), F.col("usage_date").between(F.to_date("first"), F.to_date("last"))).groupBy("name").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost")),
    f"SELECT name, {CNT} AS n, SUM(cost) AS cost FROM audit JOIN (VALUES ('all', DATE '2020-01-01', DATE '2024-02-10'), ('last_30', DATE '2024-01-12', DATE '2024-02-10'), ('last_7', DATE '2024-02-04', DATE '2024-02-10'), ('last_month', DATE '2024-01-01', DATE '2024-01-31'), ('this_month', DATE '2024-02-01', DATE '2024-02-10'), ('this_year', DATE '2024-01-01', DATE '2024-02-10')) v(name, first, last) ON usage_date BETWEEN first AND last GROUP BY 1",
)
add(
    "t4_custom_ranges", "costs", lambda x: x.costs.select("leaflet_id", *[c.alias(n) for n, c in zip(("allowed", "end"), t.custom_range(F.expr("CASE WHEN leaflet_id % 9 > 0 THEN processed_at - CAST(leaflet_id % 500 AS INT) END"), F.col("processed_at"), F.to_date(F.lit("1998-06-01"))), strict=True)]),
    "SELECT leaflet_id, COALESCE(ok, FALSE) AS allowed, CASE WHEN ok THEN l END AS end FROM (SELECT leaflet_id, l, f IS NOT NULL AND f <= DATE '1998-06-01' AND f <= l AND l - f <= 365 AS ok FROM (SELECT leaflet_id, CASE WHEN leaflet_id % 9 > 0 THEN processed_at - CAST(leaflet_id % 500 AS INT) END AS f, LEAST(processed_at, DATE '1998-06-01') AS l FROM costs))", '"end"',
)
add(
    "s6_page_facts", "products", lambda x: a.grouped(x.products, "organization_id", total=F.count("*")).select("organization_id", "total", *[c.alias(n) for n, c in s.page_columns(F.col("total"), F.col("organization_id") * 13, 50).items()]),
    f"SELECT organization_id, total, CAST(ceil(total / 50) AS BIGINT) AS pages, organization_id * 13 < ceil(total / 50) AS has_next, organization_id * 13 > 1 AS has_prev FROM (SELECT organization_id, {CNT} AS total FROM products GROUP BY 1)",
)
add("t7_month_labels", "costs", lambda x: a.grouped(x.costs, F.date_format("processed_at", "MMMM yyyy").alias("label"), cost=F.sum("total_cost")), "SELECT strftime(processed_at, '%B %Y') AS label, SUM(total_cost) AS cost FROM costs GROUP BY 1")
add(
    "t7_range_labels", "leaflets costs", lambda x: x.leaflets.select(F.col("id").alias("leaflet_id"), "created_at").join(x.costs, "leaflet_id").select("leaflet_id", t.range_label(F.col("created_at"), F.date_add("processed_at", (F.col("leaflet_id") % 400).cast("int"))).alias("label")),
    "SELECT leaflet_id, CASE WHEN date_trunc('month', f) = date_trunc('month', l) THEN strftime(f, '%b %d') ELSE strftime(f, '%b %d, %Y') END || ' – ' || strftime(l, '%b %d, %Y') AS label FROM (SELECT leaflet_id, created_at AS f, processed_at + CAST(leaflet_id % 400 AS INT) AS l FROM leaflets JOIN costs ON leaflet_id = id)",
)
add("t8_parsed_bounds", "", lambda x: x.raw("events").select("event_id", t.end_bound(F.expr("CASE event_id % 3 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") ELSE 'bad' END"), "2024-02-01 00:00:00").cast("string").alias("bound")), "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d 23:59:59') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '2024-02-01 00:00:00' END AS bound FROM events")
for unit in ("hour", "day", "month"):
    add(f"t9_reset_by_{unit}", "audit", lambda x, unit=unit: x.audit.select("id", t.reset_if_past("tokens", "created_at", F.lit("2024-01-20 13:30:00").cast("timestamp_ntz"), unit).alias("counter")), f"SELECT id, CASE WHEN date_trunc('{unit}', created_at) < date_trunc('{unit}', TIMESTAMP '2024-01-20 13:30:00') THEN 0 ELSE tokens END AS counter FROM audit")
