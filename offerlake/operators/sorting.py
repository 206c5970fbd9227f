"""Orders, pages and top lists. Nulls come last in ascending and first in descending order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder


def key(column: str, direction: str = "asc") -> Column:
    return F.col(column).desc_nulls_first() if direction == "desc" else F.col(column).asc_nulls_last()


def page(df: DataFrame, column: str, direction: str, number: int, size: int, tie: str = "id", fallback: str = "created_at") -> DataFrame:
    """One page; an unknown column falls back, and ties are in ascending order of `tie`."""
    return df.orderBy(key(column if column in df.columns else fallback, direction), key(tie)).offset((number - 1) * size).limit(size)


def page_facts(total: int, number: int, size: int) -> dict[str, int | bool]:
    pages = math.ceil(total / size) if size else 0
    return {"total": total, "pages": pages, "has_next": number < pages, "has_prev": number > 1}


def page_columns(total: Column, number: Column, size: int) -> dict[str, Column]:
    """page_facts() for a count and a page's number in columns."""
    pages = F.ceil(total / size) if size else F.lit(0)
    return {"pages": pages.cast("long"), "has_next": number < pages, "has_prev": number > 1}


def top(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n largest; ties in ascending order of the columns named."""
    return df.orderBy(key(by, "desc"), *map(key, ties)).limit(n)


def review_queue(products: DataFrame, n: int) -> DataFrame:
    waiting = products.where(F.col("review_status").isin("pending", "needs_correction"))
    return waiting.orderBy(key("review_priority", "desc"), key("confidence"), key("id")).limit(n)


def ranked_search(df: DataFrame, text: str, name: str, description: str, order: str, n: int = 50) -> DataFrame:
    """Matches in the name before those in the description only."""
    low = text.lower()
    in_name, in_text = F.lower(name).contains(low), F.lower(description).contains(low)
    return df.where(in_name | in_text).orderBy(F.when(in_name, 0).otherwise(1), key(order)).limit(n)


def in_given_order(df: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    """The rows of a short list of ids, in its order; ids without rows are dropped."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(ids)), f"position int, {id_col} {dict(df.dtypes)[id_col]}")
    return df.join(F.broadcast(wanted), id_col).orderBy("position")


#: Every text that a cast to double takes looks like this: digits, hexadecimal digits, exponents, inf, infinity, nan.
NUMBER_LOOKS = r"(?i)^[\x00-\x20\x7f]*[+\-]?[0-9.in][0-9a-fxpinty.+\-]*[\x00-\x20\x7f]*$"


def client_key(column: str) -> list[Column]:
    """Numbers by value, then other texts by their characters; nulls are empty texts."""
    # a text that is no number fails by an exception, so that those that cannot be one are told by their characters
    number = F.when(F.col(column).rlike(NUMBER_LOOKS), F.col(column).try_cast("double"))
    return [number.isNull(), number, F.coalesce(column, F.lit(""))]


def client_sort(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(*client_key(column), *ties)


def within_budget(providers: DataFrame) -> DataFrame:
    """The first provider by priority, defaults and newer ones first among equals, that is active and within its budgets."""
    under = lambda spent, budget: F.col(budget).isNull() | (F.col(spent) < F.col(budget))
    free = providers.where(F.col("is_active") & under("month_spent", "monthly_budget") & under("day_spent", "daily_budget") & (F.col("hour_requests") < F.col("max_requests_per_hour")))
    return free.orderBy(key("priority"), F.desc("is_default"), F.desc("created_at"), key("id")).limit(1)


def client_numbered(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """numbered() in the order of client_sort(). The keys are columns, since a sort works out any other at each comparison."""
    keys = {f"_key{i}": c for i, c in enumerate(client_key(column))}
    return numbered(df, *map(F.col, (*keys, *ties)), keys=keys)


def numbered(df: DataFrame, *order: Column, keys: dict[str, Column] | None = None) -> DataFrame:
    """df plus place, from 1, in an order of all rows: ranges of the order are dealt to partitions and counted, and a row's place
    is its number in the partition after the rows of those before (one row a partition). Rows that are equal in the order are
    numbered as they come. keys: columns that the order names and the result does without."""
    path = new_folder(df.sparkSession, "ordered")
    part = F.spark_partition_id().alias("_part")
    dealt = df.withColumns(keys or {}).repartitionByRange(*order).sortWithinPartitions(*order).select(*df.columns, part, F.monotonically_increasing_id().alias("_at"))
    dealt.write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", "_first", before.alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")
