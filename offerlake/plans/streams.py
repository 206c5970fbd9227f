"""Queries over event streams and exports, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sorting as s
from ..sources import sinks
from ..sources.shared import new_folder
from ..streaming import stateful as st
from ..streaming import upsert as up
from ..streaming import usage as u
from .dashboards import CNT, add


add(
    "r6_hourly_usage_stream", "", lambda x: u.replay(u.usage_by_hour(u.events(x.spark, x.sf_dir)), keys=["hour", "organization_id"]),
    f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, user_id % 10 AS organization_id, {CNT} AS requests, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2",
)
add("r1_latest_event_stream", "", lambda x: u.replay(u.latest(u.events(x.spark, x.sf_dir)), keys=["user_id"]), "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
add("r4_rate_windows_stream", "", lambda x: u.replay(u.rate_windows(u.events(x.spark, x.sf_dir), 86_400, 3), "append"), """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT user_id, event_id, t, i, t AS opened, CAST(1 AS BIGINT) AS nth FROM e WHERE i = 1
    UNION ALL SELECT e.user_id, e.event_id, e.t, e.i, CASE WHEN e.t >= w.opened + 86400 THEN e.t ELSE w.opened END, CASE WHEN e.t >= w.opened + 86400 THEN 1 ELSE w.nth + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
    SELECT user_id, event_id, nth, nth <= 3 AS allowed FROM w""")  # fmt: skip
add("r9_budget_alerts_stream", "", lambda x: u.replay(st.budget_alerts(u.events(x.spark, x.sf_dir), 20_000, 3600, 3), "append"), """WITH RECURSIVE e AS (SELECT user_id % 10 AS o, strftime(ts, '%Y-%m-%d') AS day, event_id, epoch_us(ts) AS t, CAST(SUM(CAST(round(abs(value) * 100) AS BIGINT)) OVER w AS BIGINT) AS spent FROM events
    WINDOW w AS (PARTITION BY user_id % 10, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id)), c AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY t, event_id) AS k FROM e WHERE spent >= 20000),
    walked AS (SELECT o, day, event_id, spent, k, t AS last, day AS last_day, 1 AS fired, TRUE AS fires FROM c WHERE k = 1 UNION ALL SELECT o, day, event_id, spent, k, CASE WHEN f THEN t ELSE last END, CASE WHEN f THEN day ELSE last_day END, CASE WHEN NOT f THEN fired WHEN day = last_day THEN fired + 1 ELSE 1 END, f
    FROM (SELECT c.*, w.last, w.last_day, w.fired, w.fired < 3 AND c.t - w.last >= 3600000000 AS f FROM walked w JOIN c ON c.o = w.o AND c.k = w.k + 1))
    SELECT o AS organization_id, event_id, spent, fired < 3 AS active FROM walked WHERE fires""")  # fmt: skip
add(
    "r1_latest_with_lifetime", "", lambda x: u.replay(st.latest_alive(u.events(x.spark, x.sf_dir), 1800), keys=["user_id"]).where("live").drop("live"),
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id HAVING MAX(ts) + INTERVAL 30 MINUTE > (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events)",
)
add(
    "r3_replayed_histories", "", lambda x: u.replay(st.replayed(u.events(x.spark, x.sf_dir), F.col("user_id"), F.col("event_type") == "signup"), "append"),
    """SELECT user_id AS channel, join_id, sent[i] AS event_id, i AS nth FROM (SELECT *, unnest(range(1, len(sent) + 1)) AS i FROM (SELECT user_id, event_id AS join_id, (list(event_id) FILTER (event_type <> 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))[-10:] AS sent, event_type FROM events) WHERE event_type = 'signup')""",
)
FAILS = "CASE WHEN event_type = 'error' THEN event_id % 6 ELSE 0 END"
add(
    "r10_deliveries_stream", "", lambda x: u.replay(st.deliveries(u.events(x.spark, x.sf_dir), F.col("user_id") % 40, F.expr(FAILS), 2, 7_200, 2), "append"),
    f"""WITH RECURSIVE d AS (SELECT user_id % 40 AS hook, event_id AS id, epoch_us(ts) AS t, {FAILS} AS fails, epoch_us(ts) + CASE LEAST({FAILS}, 2) WHEN 0 THEN 0 WHEN 1 THEN 7200000000 ELSE 21600000000 END AS ends FROM events),
    moments AS (SELECT *, row_number() OVER (PARTITION BY hook ORDER BY at_us, begins, id) AS k FROM (SELECT hook, id, t AS at_us, TRUE AS begins, fails FROM d UNION ALL SELECT hook, id, ends, FALSE, fails FROM d WHERE fails > 0)),
    walk AS (SELECT hook, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS failures, TRUE AS active, CAST([] AS BIGINT[]) AS skipped, CAST(NULL AS BIGINT) AS id, FALSE AS taken FROM moments WHERE k = 1 UNION ALL
    SELECT hook, k, CASE WHEN (begins AND NOT active) OR list_contains(skipped, id) THEN failures WHEN begins AND fails = 0 OR NOT begins AND fails < 3 THEN 0 WHEN NOT begins THEN failures + 1 ELSE failures END,
    active AND NOT (NOT begins AND fails >= 3 AND NOT list_contains(skipped, id) AND failures + 1 >= 2), CASE WHEN begins AND NOT active AND fails > 0 THEN list_append(skipped, id) ELSE skipped END, CASE WHEN begins THEN id END, active
    FROM (SELECT m.*, w.failures, w.active, w.skipped FROM walk w JOIN moments m ON m.hook = w.hook AND m.k = w.k + 1)),
    told AS (SELECT d.*, taken FROM walk JOIN d USING (hook, id) WHERE id IS NOT NULL), seen AS (SELECT hook, GREATEST(MAX(t), (SELECT epoch_us(MAX(ts) - INTERVAL 1 HOUR) FROM events)) AS until FROM d GROUP BY 1),
    attempts AS (SELECT hook, id, a AS attempt, t + CASE a WHEN 1 THEN 0 WHEN 2 THEN 7200000000 ELSE 21600000000 END AS us, CASE WHEN a > fails THEN 'success' WHEN a < 3 THEN 'retry' ELSE 'failed' END AS outcome FROM (SELECT *, unnest(range(1, LEAST(fails, 2) + 2)) AS a FROM told WHERE taken)
    UNION ALL SELECT hook, id, 0, t, 'skipped' FROM told WHERE NOT taken) SELECT a.hook, id AS delivery_id, attempt, us, outcome FROM attempts a JOIN seen USING (hook) WHERE us <= until""",
)
add(
    "r1_live_events", "audit", lambda x: u.live_latest(x.audit.groupBy("user_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("ts")), 86_400, F.lit("2024-01-30").cast("timestamp_ntz")).select("user_id", "id"),
    "SELECT user_id, arg_max(id, (created_at, id)) AS id FROM audit GROUP BY user_id HAVING MAX(created_at) >= TIMESTAMP '2024-01-29'",
)
add(
    "r2_progress", "leaflets", lambda x: x.leaflets.select("id", u.progress(F.when(F.col("id") % 3 == 0, F.col("status")), F.when(F.col("id") % 3 > 0, F.col("id") % 5 + 1), F.lit(5)).alias("progress")),
    "SELECT id, CASE WHEN id % 3 > 0 THEN CAST(0.35 AS DOUBLE) + CAST(id % 5 + 1 AS DOUBLE) / 5 * CAST(0.45 AS DOUBLE) WHEN status = 'completed' THEN 1.0 WHEN status = 'failed' THEN -1.0 END AS progress FROM leaflets",
)
add("r3_w5_replayed", "audit", lambda x: x.audit.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))).where("k <= 20").withColumn("replayed", F.col("k") <= 10).select("user_id", "id", "replayed"), "SELECT user_id, id, k <= 10 AS replayed FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS k FROM audit) WHERE k <= 20")
WINDOWS = """e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    w AS (SELECT user_id, event_id, t, i, t AS a, t AS b, 1 AS na, 1 AS nb FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.t, e.i, CASE WHEN e.t >= w.a + 86400 THEN e.t ELSE w.a END, CASE WHEN e.t >= w.b + 432000 THEN e.t ELSE w.b END,
    CASE WHEN e.t >= w.a + 86400 THEN 1 ELSE w.na + 1 END, CASE WHEN e.t >= w.b + 432000 THEN 1 ELSE w.nb + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)"""
add(
    "r5_dual_limits_stream", "", lambda x: u.replay(u.rate_windows(u.events(x.spark, x.sf_dir), 86_400, 3), "append").select("user_id", "event_id", F.col("allowed").alias("a")).join(u.replay(u.rate_windows(u.events(x.spark, x.sf_dir), 432_000, 12), "append").select("event_id", F.col("allowed").alias("b")), "event_id").select("user_id", "event_id", (F.col("a") & F.col("b")).alias("allowed")),
    f"WITH RECURSIVE {WINDOWS} SELECT user_id, event_id, na <= 3 AND nb <= 12 AS allowed FROM w",
)
COUNTERS = """SELECT provider_id, SUM(cost) AS month_spent, CAST(COALESCE(SUM(cost) FILTER (WHERE CAST(created_at AS DATE) = DATE '2024-01-20'), 0) AS DECIMAL(28,4)) AS day_spent, CAST(COUNT(*) FILTER (WHERE date_trunc('hour', created_at) = TIMESTAMP '2024-01-20 13:00:00') AS BIGINT) AS hour_requests
    FROM audit WHERE created_at <= TIMESTAMP '2024-01-20 13:30:00' AND created_at >= TIMESTAMP '2024-01-01' GROUP BY 1"""
add("r7_provider_counters", "audit", lambda x: u.provider_counters(x.audit, "2024-01-20 13:30:00"), COUNTERS)
BUDGETS = "SELECT id AS provider_id, id AS priority, id % 2 = 0 AS is_default, TRUE AS is_active, CAST('2024-01-01' AS DATE) AS created_at, CASE id WHEN 0 THEN CAST(1 AS DECIMAL(28,4)) WHEN 1 THEN CAST(100000 AS DECIMAL(28,4)) END AS monthly_budget, CASE id WHEN 2 THEN CAST(0 AS DECIMAL(28,4)) END AS daily_budget, CAST(1000 AS BIGINT) AS max_requests_per_hour FROM providers"
budgets = lambda x: u.budget_states(x.spark.sql(BUDGETS.replace("FROM providers", "FROM {p}"), p=x.providers), u.provider_counters(x.audit, "2024-01-20 13:30:00"))
STATES = f"SELECT b.*, COALESCE(month_spent, 0) < COALESCE(monthly_budget, 1e18) AS month_ok, COALESCE(day_spent, 0) < COALESCE(daily_budget, 1e18) AS day_ok, COALESCE(hour_requests, 0) < max_requests_per_hour AS hour_ok FROM ({BUDGETS}) b LEFT JOIN ({COUNTERS}) c ON c.provider_id = b.provider_id"
add("r8_budget_checks", "audit providers", lambda x: budgets(x).select("provider_id", "month_ok", "day_ok", "hour_ok", "ok"), f"SELECT provider_id, month_ok, day_ok, hour_ok, month_ok AND day_ok AND hour_ok AS ok FROM ({STATES})")
add("s5_provider_pick", "audit providers", lambda x: s.within_budget(budgets(x).withColumn("id", F.col("provider_id"))).select("provider_id"), f"SELECT provider_id FROM ({STATES}) WHERE is_active AND month_ok AND day_ok AND hour_ok ORDER BY priority, is_default DESC, created_at DESC LIMIT 1")
add(
    "r10_disabled_hooks", "audit", lambda x: u.disabled_hooks(x.audit.withColumn("hook", F.col("user_id")), 3),
    """SELECT hook, arg_min(id, (created_at, id)) AS at FROM (SELECT *, row_number() OVER (PARTITION BY hook, run ORDER BY created_at, id) AS nth FROM (SELECT user_id AS hook, id, created_at, status, SUM(CASE WHEN status = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS run FROM audit) WHERE status <> 'success') WHERE nth = 3 GROUP BY hook""",
)
add("r10_retry_delays", "audit", lambda x: x.audit.select("id", F.array_join(u.retry_delays((F.col("id") % 4 + 1).cast("int"), 30).cast("array<string>"), ",").alias("delays")), "SELECT id, array_to_string(list_transform(generate_series(1, id % 4 + 1), lambda k: CAST(k * 30 AS VARCHAR)), ',') AS delays FROM audit")
add(
    "r13_cost_spikes", "audit", lambda x: u.cost_spikes(x.audit.withColumn("cost", F.when(F.expr("usage_date = DATE '2024-01-09'"), F.col("cost") * 4).otherwise(F.col("cost")))),
    "SELECT usage_date, cost, CASE WHEN cost > 3 * m THEN 'high' ELSE 'medium' END AS severity FROM (SELECT usage_date, SUM(c) AS cost, CAST(SUM(SUM(c)) OVER () AS DOUBLE) / COUNT(*) OVER () AS m, COUNT(*) OVER () AS days FROM (SELECT usage_date, CASE WHEN usage_date = DATE '2024-01-09' THEN cost * 4 ELSE cost END AS c FROM audit) GROUP BY 1) WHERE days >= 3 AND cost > 2 * m", "usage_date",
)
BUSY = "CASE WHEN user_id < 30 THEN 400 ELSE 1 END"  # planted: the first users have four hundred times their events
add("r13_busy_users", "audit", lambda x: x.audit.withColumn("i", F.explode(F.sequence(F.lit(1), F.expr(BUSY)))).groupBy("user_id").agg(F.count("*").alias("n")).where("n > 1000"), f"SELECT user_id, {CNT} AS n FROM (SELECT user_id, unnest(range({BUSY})) AS i FROM audit) GROUP BY 1 HAVING COUNT(*) > 1000")
for name, days, errors, today in (("notifications", 30, False, "2024-02-15"), ("files", 90, False, "2024-04-10"), ("audit", 365, True, "2025-01-20")):
    add(f"r15_retention_{name}", "audit", lambda x, days=days, errors=errors, today=today: u.kept(x.audit, "usage_date", today, days, errors).select("id"), f"SELECT id FROM audit WHERE usage_date >= DATE '{today}' - {days}" + (" OR status = 'error'" if errors else ""))
add("r11_within_quota", "audit", lambda x: u.within_quota(x.audit, 20, "organization_id", "usage_date").select("id"), "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY organization_id, usage_date ORDER BY created_at, id) AS k FROM audit) WHERE k <= 20")
add("r12_daily_counters", "audit", lambda x: x.audit.groupBy("user_id", "usage_date").agg(F.count("*").alias("n")), f"SELECT user_id, usage_date, {CNT} AS n FROM audit GROUP BY 1, 2", "usage_date")
add(
    "r13_error_hours", "audit", lambda x: u.error_hours(x.audit, 10, 0.2),
    f"SELECT usage_date, usage_hour, {CNT} AS n, CAST(COUNT(*) FILTER (WHERE status = 'error') AS BIGINT) AS errors, CASE WHEN COUNT(*) FILTER (WHERE status = 'error') > 0.5 * COUNT(*) THEN 'high' ELSE 'medium' END AS severity FROM audit GROUP BY 1, 2 HAVING COUNT(*) > 10 AND COUNT(*) FILTER (WHERE status = 'error') > 0.2 * COUNT(*)", "usage_date",
)
add("r15_retention", "audit", lambda x: u.kept(x.audit, "usage_date", "2024-01-30", 10, True).select("id"), "SELECT id FROM audit WHERE usage_date >= DATE '2024-01-20' OR status = 'error'")


def _upserted(x):
    path = new_folder(x.spark, "usage")
    stream = u.events(x.spark, x.sf_dir).writeStream.foreachBatch(lambda batch, number: up.upsert(batch, number, f"{path}/table"))
    stream.trigger(availableNow=True).option("checkpointLocation", f"{path}/check").start().awaitTermination()
    return up.with_mean(up.current(x.spark, f"{path}/table"))


def _rolled(x):
    path = new_folder(x.spark, "rollups")
    for query in up.scheduled(u.events(x.spark, x.sf_dir), x.raw("events"), path, once=True):
        query.awaitTermination()
    parts = [x.spark.read.parquet(f"{path}/{job}").select(F.lit(job).alias("job"), "start", "organization_id", "requests", "errors", "tokens") for job in up.SCHEDULES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


add(
    "r6_usage_upserts", "", _upserted,
    f"""SELECT user_id % 10 AS organization_id, event_id % 5 AS provider_id, CAST(ts AS DATE) AS usage_date, CAST(extract(hour FROM ts) AS BIGINT) AS usage_hour, {CNT} AS requests, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens,
    CAST(SUM(CASE WHEN event_id % 7 > 0 THEN event_id % 100 END) AS DOUBLE) / 100 / COUNT(CASE WHEN event_id % 7 > 0 THEN 1 END) AS average_confidence FROM events GROUP BY 1, 2, 3, 4""", "usage_date",
)
add(
    "r14_scheduled_rollups", "", _rolled,
    " UNION ALL ".join(f"SELECT '{job}' AS job, CAST(floor(epoch(ts) / {s}) * {s} AS BIGINT) AS start, user_id % 10 AS organization_id, {CNT} AS requests, CAST(COUNT(*) FILTER (event_type = 'error') AS BIGINT) AS errors, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2, 3" for job, s in up.SCHEDULES.items()),
)
human = lambda: [F.concat(F.lit("LEAF_"), "id").alias("human_id"), F.concat(F.col("retailer"), F.lit(".pdf")).alias("filename"), F.when(F.col("id") % 2 == 0, "EUR").alias("currency")]
add(
    "snk4_product_rows", "offers leaflets", lambda x: sinks.product_rows(x.offers, x.leaflets.select("id", *human()), "url"),
    """SELECT COALESCE('LEAF_' || l.id, '') AS "Leaflet ID", COALESCE(retailer || '.pdf', '') AS "Leaflet Name", page_number AS "Page", COALESCE(brand, '') AS "Brand", COALESCE(product_code, '') AS "Product Code", COALESCE(product_name, '') AS "Product Name", COALESCE(CAST(quantity AS VARCHAR), '') AS "Quantity", COALESCE(units, '') AS "Units",
    regular_price AS "Regular Price", discounted_price AS "Discounted Price", discount_percentage AS "Discount %", COALESCE(NULLIF(currency, ''), CASE WHEN l.id % 2 = 0 THEN 'EUR' END, '') AS "Currency", o.id AS "Product ID", '' AS "Promotional Info", COALESCE(category, '') AS "Category", COALESCE(CAST(confidence AS VARCHAR), '') AS "Confidence", COALESCE(state, '') AS "Review Status",
    CASE WHEN validation_passed THEN 'Yes' ELSE 'No' END AS "Validation Passed", CAST(o.created_at AS VARCHAR) AS "Created At", '' AS "Image URL" FROM offers o LEFT JOIN leaflets l ON l.id = leaflet_id""",
)
