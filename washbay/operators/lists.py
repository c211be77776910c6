"""Sorted lists and top-k (T1–T4) and named column views.

``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps its own
top n and only n rows per task reach the final merge, so no full sort or shuffle
of the table happens. Keys are always appended as a tie-break (deterministic).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.operators.filters import in_date_range, search_people, with_service

MAX_LIST = 1000      # fixed value: the admin list is clamped to 1..1000 rows
DEFAULT_LIST = 500   # fixed value: its default length


# T1
def newest(df: DataFrame, n: int, ts: str = "created_at", keys=("order_id",)) -> DataFrame:
    """Newest ``n`` rows by ``ts`` (NULL stamps first, as PostgreSQL's DESC does)."""
    return df.orderBy(F.col(ts).desc_nulls_first(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


# T2
def catalog_order(cat: DataFrame, collation: str | None = None) -> DataFrame:
    """position ascending with missing positions last, then name
    (``collation='UNICODE'`` approximates the browser's locale compare)."""
    name = F.col("name") if not collation else F.collate(F.col("name"), collation)
    return cat.orderBy(F.col("position").asc_nulls_last(), name.asc_nulls_last())


# T3
def booking_list(bk: DataFrame, from_=None, to=None, service=None, search=None,
                 limit: int | str | None = DEFAULT_LIST) -> DataFrame:
    """Admin booking list: date range, service, name/phone search, newest first,
    ``limit`` clamped to 1..1000."""
    m = re.match(r"\s*([+-]?\d+)", str(limit)) if limit not in (None, "") else None   # parseInt
    n = min(MAX_LIST, max(1, int(m.group(1)))) if m else DEFAULT_LIST
    out = search_people(with_service(in_date_range(bk, from_, to), service), search)
    return newest(project_bookings(out, "admin"), n)


# T4
def sheet_order(df: DataFrame, sheet: str = "packages") -> DataFrame:
    """Oldest-first price sheets, id order for the long services list, name order
    for the public list."""
    if sheet in ("packages", "alacarte"):
        return df.orderBy(F.col("created_at").asc_nulls_last(), F.col("id").asc_nulls_last())
    if sheet == "services":
        return df.orderBy(F.col("id").asc_nulls_last())
    if sheet == "public":
        return df.orderBy(F.col("name").asc_nulls_last())
    raise ValueError(f"unknown sheet {sheet!r}")


# P18
VIEWS = {
    "admin": ["order_id", "name", "phone", "vehicle", "service", "date", "time", "visit_place",
              "address", "price", "created_at"],
    "owner": ["order_id", "name", "phone", "service", "vehicle", "price", "status"],
    "customer": ["created_at", "service", "vehicle", "status"],
    "recent": ["order_id", "name", "service", "vehicle", "price", "status", "created_at"],
}


def project_bookings(bk: DataFrame, view: str) -> DataFrame:
    """Named column subsets of the canonical bookings (missing columns are skipped)."""
    return bk.select(*[c for c in VIEWS[view] if c in bk.columns])
