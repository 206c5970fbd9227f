"""Series by day, week and month, with a row for every day of the range."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.sql("SELECT explode(sequence(to_date(:a), to_date(:b))) AS day", args={"a": first, "b": last})


def daily(df: DataFrame, column: str, first: str, last: str, **aggregates: Column) -> DataFrame:
    """Aggregates for each day from first to last, 0 where there are no rows."""
    inside = df.where(F.col(column).between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    made = inside.groupBy(F.to_date(column).alias("day")).agg(*[c.alias(n) for n, c in aggregates.items()])
    out = spine(df.sparkSession, first, last).join(made, "day", "left")
    return out.select("day", *[F.coalesce(n, F.lit(0)).alias(n) for n in aggregates])


def same_day_costs(leaflets: DataFrame, costs: DataFrame) -> DataFrame:
    """Costs by day, of leaflets that were created on the day they were paid for."""
    own = leaflets.select(F.col("id").alias("leaflet_id"), F.to_date("created_at").alias("day"))
    both = costs.join(own, "leaflet_id").where(F.to_date("processed_at") == F.col("day"))
    return both.groupBy("day").agg(F.sum("total_cost").alias("cost"))


def week_label(day: str) -> Column:
    """Year and week of the day's Monday, weeks starting with the year's first Sunday."""
    monday = F.date_trunc("week", day)
    return F.concat(F.year(monday), F.lit("-W"), F.lpad(F.floor((F.dayofyear(monday) + 5) / 7).cast("int").cast("string"), 2, "0"))


def preset(name: str, as_of: date) -> tuple[date, date]:
    """The range of a named period that ends as of a day."""
    first = as_of.replace(day=1)
    if name == "last_month":
        end = first - timedelta(1)
        return end.replace(day=1), end
    starts = {"last_7": as_of - timedelta(6), "last_30": as_of - timedelta(29), "this_month": first, "this_year": as_of.replace(month=1, day=1), "all": date(2020, 1, 1)}
    return starts[name], as_of


def custom(first: date | None, last: date | None, as_of: date) -> tuple[date, date]:
    """A range of at most 365 days that starts by as_of; its end is moved there."""
    if first is None or last is None:
        raise ValueError("both ends are needed")
    last = min(last, as_of)
    if first > as_of or first > last or (last - first).days > 365:
        raise ValueError("the range is not allowed")
    return first, last


def custom_range(first: Column, last: Column, as_of: Column) -> tuple[Column, Column]:
    """(allowed, end) of ranges in columns, by the same rule: both ends, a start by as_of and by the end, 365 days at most after
    the end was moved to as_of."""
    end = F.least(last, as_of)
    allowed = first.isNotNull() & last.isNotNull() & (first <= as_of) & (first <= end) & (F.date_diff(end, first) <= 365)
    return F.coalesce(allowed, F.lit(False)), F.when(allowed, end)


def reset_if_past(counter: str, stamp: str, now: Column, unit: str) -> Column:
    """A counter, or 0 once a new hour, day or month has begun."""
    return F.when(F.date_trunc(unit, stamp) < F.date_trunc(unit, now), 0).otherwise(F.col(counter))


def presets(spark: SparkSession, as_of: str) -> DataFrame:
    """(name, first, last) of every named period."""
    names = ("all", "last_30", "last_7", "last_month", "this_month", "this_year")
    return spark.createDataFrame([(n, *map(str, preset(n, date.fromisoformat(as_of)))) for n in names], "name string, first string, last string")


def end_bound(text: Column, default: str) -> Column:
    """A bound's time: the last second of a day of ten characters, else an ISO time with or without Z, else the default."""
    day = F.try_to_timestamp(F.concat(text, F.lit(" 23:59:59")), F.lit("yyyy-MM-dd HH:mm:ss"))
    moment = F.replace(F.replace(text, F.lit("Z"), F.lit("")), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    return F.coalesce(F.when(F.length(text) == 10, day.cast("timestamp_ntz")).otherwise(moment), F.lit(default).cast("timestamp_ntz"))


def range_label(first: Column, last: Column) -> Column:
    """Jan 01 – Jan 31, 2024; the first year is named where month or year differ."""
    alike = F.date_trunc("month", first) == F.date_trunc("month", last)
    return F.concat(F.when(alike, F.date_format(first, "MMM dd")).otherwise(F.date_format(first, "MMM dd, yyyy")), F.lit(" – "), F.date_format(last, "MMM dd, yyyy"))
