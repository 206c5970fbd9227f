"""Dashboard aggregates: one pass over each table, conditional counts, exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "auto_approved", "approved", "rejected", "needs_correction")


def share(part: Column, whole: Column, digits: int | None = 1) -> Column:
    """Percentage of whole, 0 where there is nothing; rounded half to even."""
    out = part.cast("double") * 100 / F.greatest(whole, F.lit(1)).cast("double")
    return out if digits is None else F.bround(out, digits)


def mean(column: str) -> Column:
    """Mean of an exact decimal without nulls, as a double; null if there are no values."""
    return F.sum(column).cast("double") / F.count(column).cast("double")


def is_(status: str, column: str = "review_status") -> Column:
    return F.coalesce(F.col(column) == status, F.lit(False))


def count_status(*statuses: str, column: str = "review_status") -> Column:
    return F.count_if(F.coalesce(F.col(column).isin(*statuses), F.lit(False)))


def product_summary(products: DataFrame) -> DataFrame:
    """Counts by review status and the dashboard's ratios, in one pass."""
    counts = products.agg(
        F.count("*").alias("total"),
        *[count_status(s).alias(s) for s in STATUSES],
        F.count_if("validation_passed").alias("valid"),
        F.count_if(F.col("review_priority") >= 70).alias("high_priority"),
        F.coalesce(mean("confidence"), F.lit(0.0)).alias("mean_confidence"),
    )
    approved, waiting = F.col("auto_approved") + F.col("approved"), F.col("pending") + F.col("needs_correction")
    return counts.select(
        "*", approved.alias("total_approved"), waiting.alias("awaiting_review"), share(F.col("auto_approved"), F.col("total"), None).alias("auto_rate"), share(F.col("valid"), F.col("total"), None).alias("validation_rate")
    )


def leaflet_summary(leaflets: DataFrame, period: Column) -> DataFrame:
    """Totals of all time by status, and of the period."""
    return leaflets.agg(
        F.count("*").alias("total"),
        F.count_if(period).alias("in_period"),
        *[count_status(s, column="status").alias(s) for s in ("completed", "failed", "reviewing")],
        F.coalesce(F.sum(F.when(period, F.col("page_count"))), F.lit(0)).alias("pages"),
        F.coalesce(F.sum(F.when(period, F.col("processing_cost"))), F.lit(0)).alias("cost"),
    )


def success_rate(leaflets: DataFrame, reviewing: str = "ignored") -> DataFrame:
    """Completed of finished leaflets; reviewing ones are ignored, count as finished, or as successes too."""
    done, extra = count_status("completed", column="status"), count_status("reviewing", column="status")
    failed = count_status("failed", column="status")
    good = done + extra if reviewing == "success" else done
    every = done + failed if reviewing == "ignored" else done + failed + extra
    return leaflets.agg(share(good, every, None).alias("success_rate"))


def grouped(df: DataFrame, *by: str, **aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


def with_all_statuses(products: DataFrame) -> DataFrame:
    """(review_status, n) with a row for each status, 0 where there are none."""
    spine = products.sparkSession.createDataFrame([(s,) for s in STATUSES], "review_status string")
    counts = products.groupBy("review_status").agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(counts, "review_status", "left").select("review_status", F.coalesce("n", F.lit(0)).alias("n"))


def padded_top(counts: DataFrame, name: str, n: int, defaults: list[str]) -> DataFrame:
    """The n most frequent names, filled up with defaults at count 0 in their given order."""
    found = counts.where(f"{name} is not null").orderBy(F.desc("n"), name).limit(n).select(name, "n", F.lit(0).alias("kind"), F.lit(0).alias("place"))
    extra = counts.sparkSession.createDataFrame([(d, 0, 1, i) for i, d in enumerate(defaults)], f"{name} string, n long, kind int, place int").join(found, name, "left_anti")
    return found.unionByName(extra).orderBy("kind", F.desc("n"), "place", name).limit(n).select(name, "n")


def growth(df: DataFrame, period: str, value: str, *by: str) -> DataFrame:
    """Change against the period before, in percent: null in the first period; from 0 it is 0 or 100."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(period))
    now = F.col(value).cast("double")
    rate = F.when(before > 0, (now - before.cast("double")) * 100 / before.cast("double")).when(before.isNull(), None).when(F.col(value) == 0, 0.0).otherwise(100.0)
    return df.withColumn("growth", rate)


def shares_of_total(df: DataFrame, value: str) -> DataFrame:
    """Each row's part of the sum in percent; the sum is joined on as a single row."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.join(F.broadcast(total)).withColumn("share", F.col(value).cast("double") * 100 / F.col("_total").cast("double")).drop("_total")


def frequent_errors(feedback: DataFrame, least: int = 3) -> DataFrame:
    """Corrections by field and kind that occur at least `least` times, with a priority by their count."""
    counts = feedback.groupBy("field", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.withColumn("priority", F.when(F.col("n") >= 10, "high").when(F.col("n") >= 5, "medium").otherwise("low"))


def suspicious_addresses(audit: DataFrame, least_failures: int, factor: float) -> DataFrame:
    """Addresses with many failures whose number of requests is above `factor` times the mean address's."""
    by = audit.groupBy("request_ip").agg(F.count("*").alias("requests"), count_status("error", column="status").alias("failures"), F.count_distinct("user_id").alias("users"))
    mean_of_all = by.agg((F.sum("requests").cast("double") / F.count("*").cast("double")).alias("_mean"))
    return by.join(F.broadcast(mean_of_all)).where((F.col("failures") >= least_failures) & (F.col("requests") > factor * F.col("_mean"))).drop("_mean")


def spikes(counts: DataFrame, value: str, factor: float) -> DataFrame:
    """Rows of a grouped table whose value is above `factor` times the mean over it."""
    return counts.join(F.broadcast(counts.agg((F.sum(value).cast("double") / F.count("*").cast("double")).alias("_mean")))).where(F.col(value) > factor * F.col("_mean")).drop("_mean")


def usage_rollup(audit: DataFrame) -> DataFrame:
    """Successful events by organization, provider and day."""
    good = audit.where(is_("success", "status"))
    return good.groupBy("organization_id", "provider_id", "usage_date").agg(
        F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), (F.sum("tokens").cast("double") / F.count("*").cast("double")).alias("mean_tokens")
    )


def mean_of_means(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """By outer: the mean of the inner groups' means, and the mean over all rows with nulls as 0."""
    pages = df.groupBy(outer, inner).agg(F.coalesce(mean(value), F.lit(0.0)).alias("m"), F.sum(F.coalesce(value, F.lit(0))).alias("s"), F.count("*").alias("n"))
    return pages.groupBy(outer).agg(
        (F.aggregate(F.array_sort(F.collect_list("m")), F.lit(0.0), lambda a, x: a + x) / F.count("*").cast("double")).alias("mean_of_means"), (F.sum("s").cast("double") / F.sum("n").cast("double")).alias("flat_mean")
    )


def priority_bands(products: DataFrame) -> DataFrame:
    """Counts by band of 100 - priority; the bands share their edges, so rows on an edge count in both."""
    score = 100 - F.col("review_priority")
    bands = (("critical", 0, 20), ("high", 20, 40), ("medium", 40, 60), ("low", 60, 100))
    return products.agg(*[F.count_if(score.between(a, b)).alias(n) for n, a, b in bands])


def trend_label(daily: DataFrame, day: str, value: str) -> DataFrame:
    """rising, falling or stable: the last up to 7 days' mean against the first up to 7, by 10 percent."""
    ordered = daily.select(F.row_number().over(Window.orderBy(day)).alias("i"), F.col(value).alias("v"))  # a row for each day
    n = daily.agg(F.count("*").alias("n"))
    late, early = F.least(F.lit(7), F.ceil(F.col("n") / 2)), F.least(F.lit(7), F.floor(F.col("n") / 2))
    means = ordered.join(F.broadcast(n)).agg(
        F.sum(F.when(F.col("i") > F.col("n") - late, F.col("v"))).cast("double").alias("a"), F.max(late).cast("double").alias("na"), F.sum(F.when(F.col("i") <= early, F.col("v"))).cast("double").alias("b"), F.max(early).cast("double").alias("nb")
    )
    last, first = F.col("a") / F.col("na"), F.try_divide("b", "nb")
    return means.select(F.when(last > first * 1.1, "rising").when(last < first * 0.9, "falling").otherwise("stable").alias("trend"))


def shown_rates(products: DataFrame) -> DataFrame:
    """The ratios as a dashboard shows them: percentages of one digit, half to even."""
    n = F.count("*")
    return products.agg(share(count_status("auto_approved"), n).alias("auto_rate"), F.bround(F.coalesce(mean("confidence"), F.lit(0.0)) * 100, 1).alias("mean_confidence"), share(F.count_if("validation_passed"), n).alias("validation_rate"))


def system_figures(leaflets: DataFrame, as_of: str) -> DataFrame:
    """All figures of the system page in one pass."""
    day, now = F.col("created_at"), F.to_date(F.lit(as_of))
    since = lambda first: F.count_if((day >= first) & (day <= now))
    return leaflets.agg(
        F.count("*").alias("total"), since(now).alias("today"), since(F.to_date(F.date_trunc("week", now))).alias("this_week"), since(F.to_date(F.date_trunc("month", now))).alias("this_month"),
        share(count_status("completed", "reviewing", column="status"), count_status("completed", "reviewing", "failed", column="status"), None).alias("success"),
        F.bround(F.sum("page_count").cast("double") / F.greatest(F.count("*"), F.lit(1)).cast("double"), 1).alias("pages_per_leaflet"),
    )


def nested_days(audit: DataFrame) -> DataFrame:
    """By organization its cost and its days, as a text of day:requests; a row for each day comes before the list."""
    by = audit.groupBy("organization_id", "usage_date").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    days = F.transform(F.array_sort(F.collect_list(F.struct("usage_date", "n"))), lambda d: F.concat(d["usage_date"], F.lit(":"), d["n"]))
    return by.groupBy("organization_id").agg(F.sum("cost").alias("cost"), F.array_join(days, ",").alias("days"))


def flagged_addresses(audit: DataFrame) -> DataFrame:
    """Addresses with over half of more than ten requests failed, else those of more than ten users."""
    by = audit.groupBy("request_ip").agg(F.count("*").alias("requests"), count_status("error", column="status").alias("failures"), F.count_distinct("user_id").alias("users"))
    failing = (F.col("failures") * 2 > F.col("requests")) & (F.col("requests") > 10)
    return by.select("request_ip", "requests", F.when(failing, "High failure rate").when(F.col("users") > 10, "Multiple users from same IP").alias("reason")).where("reason is not null")


def flagged_users(audit: DataFrame) -> DataFrame:
    """Users of more than five addresses, else those with over 30 percent of more than five requests failed."""
    by = audit.groupBy("user_id").agg(F.count("*").alias("requests"), count_status("error", column="status").alias("failures"), F.count_distinct("request_ip").alias("addresses"))
    failing = (F.col("failures") * 10 > F.col("requests") * 3) & (F.col("requests") > 5)
    return by.select("user_id", "requests", F.when(F.col("addresses") > 5, "Multiple IP addresses").when(failing, "High failure rate").alias("reason")).where("reason is not null")


def bursts(audit: DataFrame, factor: float = 4, least: int = 100) -> DataFrame:
    """Hours with more than `factor` times the mean hour's events, if there are more than `least` in all."""
    by = audit.groupBy("usage_date", "usage_hour").agg(F.count("*").alias("n"))
    whole = by.agg((F.sum("n").cast("double") / F.count("*").cast("double")).alias("mean"), F.sum("n").alias("every"))  # one row
    return by.join(F.broadcast(whole)).where((F.col("every") > least) & (F.col("n") > factor * F.col("mean"))).drop("mean", "every")


def _with_triggers(alerts: DataFrame, triggers: DataFrame) -> DataFrame:
    counts = triggers.groupBy("id").agg(F.count("*").alias("triggers"))
    return alerts.join(counts, "id", "left").fillna(0, ["triggers"])


def alert_effect(alerts: DataFrame, triggers: DataFrame) -> DataFrame:
    """By type of alert how many are configured and active, how often they fired, and their mean threshold."""
    return _with_triggers(alerts, triggers).groupBy("alert_type").agg(
        F.count("*").alias("configured"), F.count_if("is_active").alias("active"), F.sum("triggers").alias("triggers"), (F.sum("threshold").cast("double") / F.count("*").cast("double")).alias("mean_threshold")
    )


def most_triggered(alerts: DataFrame, triggers: DataFrame) -> DataFrame:
    return _with_triggers(alerts, triggers).groupBy("threshold").agg(F.sum("triggers").alias("triggers")).orderBy(F.desc("triggers"), "threshold").limit(1)


RUN_STATES = ("pending", "processing", "completed", "reviewing", "failed")


def processing_seconds(leaflets: DataFrame, ends: DataFrame) -> DataFrame:
    """(status, n, seconds): a row for each status, and the mean time that completed leaflets took."""
    both = leaflets.join(ends, "id").withColumn("took", F.unix_micros(F.col("done").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")))
    by = both.groupBy("status").agg(F.count("*").alias("n"), F.sum("took").alias("micros"))
    spine = leaflets.sparkSession.createDataFrame([(s,) for s in RUN_STATES], "status string")
    seconds = F.when(F.col("status") == "completed", F.bround(F.col("micros").cast("double") / 1e6 / F.col("n").cast("double"), 2))
    return spine.join(by, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), seconds.alias("seconds"))


def ratios(df: DataFrame, named: dict[str, tuple[str, str]]) -> DataFrame:
    """df plus quotients of columns, 0 where the divisor is 0."""
    return df.withColumns({k: F.when(F.col(d) == 0, 0.0).otherwise(F.col(n).cast("double") / F.col(d).cast("double")) for k, (n, d) in named.items()})


def moving_average(df: DataFrame, value: str, reach: int, order: str, *by: str) -> DataFrame:
    """df plus average: over `reach` rows to either side; rows beyond the ends count as 0."""
    near = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)
    return df.withColumn("average", F.sum(value).over(near).cast("double") / (2 * reach + 1))


def average_cost(costs: DataFrame, leaflets: DataFrame) -> DataFrame:
    """Sums of a period's costs, and their mean over the period's leaflets, those without costs too; 0 leaflets count as one."""
    sums = costs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("total_cost", "cost"), ("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"))])
    both = sums.join(F.broadcast(leaflets.agg(F.count("*").alias("leaflets"))))  # one row each
    return both.withColumn("average", F.bround(F.col("cost").cast("double") / F.greatest(F.col("leaflets"), F.lit(1)), 4))


def products_per_leaflet(products: DataFrame, leaflets: DataFrame) -> DataFrame:
    both = products.agg(F.count("*").alias("products")).join(F.broadcast(leaflets.agg(F.count("*").alias("leaflets"))))  # one row each
    return both.withColumn("mean", F.bround(F.col("products").cast("double") / F.greatest(F.col("leaflets"), F.lit(1)), 1))


def by_user(owners: DataFrame, leaflets: DataFrame, products: DataFrame) -> DataFrame:
    """By user of owners (id of a leaflet, user_id): organizations, leaflets, products and cost; products are counted by leaflet
    first, so that no leaflet counts twice."""
    counts = products.groupBy(F.col("leaflet_id").alias("id")).agg(F.count("*").alias("n"))
    own = owners.join(leaflets, "id").join(counts, "id", "left")
    return own.groupBy("user_id").agg(F.count_distinct("organization_id").alias("organizations"), F.count("*").alias("leaflets"), F.sum(F.coalesce("n", F.lit(0))).alias("products"), F.sum("processing_cost").alias("cost"))


def organization_report(audit: DataFrame, least: float) -> DataFrame:
    """Organizations that cost `least` or more: requests, cost, and lists of providers (by cost) and of days with their mean cost.
    Lists have a row for each provider or day, counted before they are gathered."""
    n, cost = F.count("*").alias("n"), F.sum("cost")
    days = audit.groupBy("organization_id", "usage_date").agg(n, cost.alias("day_cost"))
    day = F.struct("usage_date", "n", "day_cost", (F.col("day_cost").cast("double") / F.col("n").cast("double")).alias("mean"))
    by_day = days.groupBy("organization_id").agg(F.sum("n").alias("requests"), F.sum("day_cost").alias("cost"), F.array_sort(F.collect_list(day)).alias("days")).where(F.col("cost") >= least)
    providers = audit.groupBy("organization_id", "provider_id").agg(n, cost.alias("provider_cost"))
    provider = F.struct((-F.col("provider_cost")).alias("order"), F.struct("provider_id", "n", "provider_cost").alias("p"))
    by_provider = providers.groupBy("organization_id").agg(F.transform(F.array_sort(F.collect_list(provider)), lambda x: x["p"]).alias("providers"))
    return by_day.join(by_provider, "organization_id")
