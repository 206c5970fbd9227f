"""Filters of list endpoints: scopes, searches, ranges. Each is a Column or a filtered DataFrame, so that it reaches the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenant(df: DataFrame, organization_id: int | None) -> DataFrame:
    """Rows of one organization; None is a superuser's scope, which is all rows."""
    return df if organization_id is None else df.where(F.col("organization_id") == organization_id)


def tenant_by_leaflet(df: DataFrame, leaflets: DataFrame, organization_id: int | None) -> DataFrame:
    """As tenant(), for tables that know their organization by leaflet only: a semi-join."""
    return df if organization_id is None else df.join(tenant(leaflets, organization_id).select(F.col("id").alias("leaflet_id")), "leaflet_id", "left_semi")


def contains_any(text: str, *columns: str) -> Column:
    """Case-insensitive substring in any column; % and _ in text keep their meaning as wildcards."""
    return reduce(or_, (F.col(c).ilike(f"%{text}%") for c in columns))


def days(column: str, first: str | None = None, last: str | None = None) -> Column:
    """From the first day's start to the last day's end."""
    out = F.lit(True)
    if first:
        out &= F.col(column) >= F.to_date(F.lit(first))
    if last:
        out &= F.col(column) < F.date_add(F.to_date(F.lit(last)), 1)
    return out


def since(column: str, as_of: str, n_days: int) -> Column:
    return F.col(column) >= F.date_sub(F.to_date(F.lit(as_of)), n_days)


def optional(df: DataFrame, **equal) -> DataFrame:
    """Equality filters for the arguments that are given; a list means membership."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column).isin(value) if isinstance(value, list | tuple | set) else F.col(column) == value)
    return df


def addressed(user_id: int, organizations: list[int], roles: list[str]) -> Column:
    """Messages to this user, to one of the organizations, to one of the roles, or to everyone."""
    to_user, to_org, to_role = F.col("user_id"), F.col("organization_id"), F.col("role")
    return (
        F.coalesce(to_user == user_id, F.lit(False))
        | (F.coalesce(to_org.isin(organizations), F.lit(False)) & to_user.isNull())
        | (F.coalesce(to_role.isin(roles), F.lit(False)) & to_user.isNull() & to_org.isNull())
        | (to_user.isNull() & to_org.isNull() & to_role.isNull())
    )


def live(expires: str, now: Column, read: Column | None = None, dismissed: Column | None = None) -> Column:
    """Messages that have not expired (null: never do), and, where asked, are neither read nor dismissed."""
    out = F.col(expires).isNull() | (F.col(expires) > now)
    for gone in (read, dismissed):
        out = out if gone is None else out & ~gone
    return out


def preferred(messages: DataFrame, kind: str, enabled: list[str], level: str, successes: bool = False) -> DataFrame:
    """Messages of the kinds a user wants (an empty list wants all), without those of success unless wanted. It comes after
    paging, so a page may hold fewer messages."""
    out = messages.where(F.col(kind).isin(enabled)) if enabled else messages
    return out if successes else out.where(F.col(level) != "success")


def by_human_id(df: DataFrame, leaflets: DataFrame, text: str) -> DataFrame:
    """Rows of the leaflet that a text names, by its id if it is a number, else by its human id; none if there is none."""
    if text.isdigit():
        return df.where(F.col("leaflet_id") == int(text))
    return df.join(leaflets.where(F.col("leaflet_id") == text).select(F.col("id").alias("leaflet_id")), "leaflet_id", "left_semi")


def subscribed(event: str, column: str = "events") -> Column:
    return F.array_contains(column, event) | F.array_contains(column, "*")


#: operator name -> Column of (column, value); string operators ignore case.
CLIENT_OPERATORS = {
    "equals": lambda c, v: c == v,
    "contains": lambda c, v: F.lower(c).contains(str(v).lower()),
    "starts_with": lambda c, v: F.lower(c).startswith(str(v).lower()),
    "ends_with": lambda c, v: F.lower(c).endswith(str(v).lower()),
    "greater_than": lambda c, v: c > v,
    "less_than": lambda c, v: c < v,
    "between": lambda c, v: c.between(*v),
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
}


def client_filters(filters: list[tuple[str, str, object]]) -> Column:
    """Conjunction of (column, operator, value)."""
    return reduce(and_, (CLIENT_OPERATORS[op](F.col(c), v) for c, op, v in filters), F.lit(True))


def any_text(df: DataFrame, text: str) -> Column:
    """Substring, ignoring case, in any string column of df."""
    return reduce(or_, (F.lower(c).contains(text.lower()) for c, kind in df.dtypes if kind == "string"), F.lit(False))


def export_scope(products: DataFrame, mode: str, ids: list[str] | None = None, **filters) -> DataFrame:
    """What an export takes: all, filtered, selected (1 to 500 ids) or review_queue."""
    if mode == "selected":
        if not ids or len(set(ids)) > 500:
            raise ValueError("1 to 500 product ids are needed")
        return products.where(F.col("id").isin(sorted(set(ids))))
    if mode == "review_queue":
        return products.where(F.col("review_status").isin("pending", "needs_correction"))
    return optional(products, **filters) if mode == "filtered" else products
