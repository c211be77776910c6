"""Row filters (F1–F11). Bounds are turned into literals on the driver so the
predicates stay plain comparisons Catalyst can push into the parquet scan."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washbay.functions.columns import CLOSE_MINUTE, OPEN_MINUTE, minutes_of_day


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal from a date/datetime/ISO text (no session-zone shift)."""
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def _month_start(text: str) -> dt.date:
    m = re.fullmatch(r"\s*(\d{4})-(\d{1,2})\s*", text)
    if not m or not 1 <= int(m.group(2)) <= 12:
        raise ValueError(f"month bound must be YYYY-MM, got {text!r}")
    return dt.date(int(m.group(1)), int(m.group(2)), 1)


def _day(text: str) -> dt.date:
    m = re.fullmatch(r"\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*", text)
    if not m:
        raise ValueError(f"day bound must be YYYY-MM-DD, got {text!r}")
    return dt.date(int(m.group(1)), int(m.group(2)), int(m.group(3)))


def _next_month(d: dt.date) -> dt.date:
    return dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)


def period_bounds(group: str, from_: str | None, to: str | None):
    """Half-open [lower, upper) day bounds of a report window; None = open end."""
    group = (group or "month").lower()
    lo = hi = None
    if group == "day":
        if from_:
            lo = _day(from_)
        if to:
            hi = _day(to) + dt.timedelta(days=1)
    elif group == "month":
        if from_:
            lo = _month_start(from_)
        if to:
            hi = _next_month(_month_start(to))
    elif group == "year":
        if from_:
            lo = dt.date(int(from_), 1, 1)
        if to:
            hi = dt.date(int(to) + 1, 1, 1)
    else:
        raise ValueError(f"unknown group {group!r}; expected day, month or year")
    return lo, hi


# F1
def in_period(df: DataFrame, group: str = "month", from_: str | None = None,
              to: str | None = None, ts: str = "dt_local", day_text: str | None = None) -> DataFrame:
    """Keep rows whose ``ts`` lies in the report window (open ends allowed).

    ``day_text`` names the raw ISO text column ``ts`` was parsed from; the same
    bounds are then also applied to it, which is exact for ISO-shaped text and lets
    the parquet reader skip row groups by min/max statistics."""
    lo, hi = period_bounds(group, from_, to)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(ts) >= ntz(lo))
        if day_text:
            cond = cond & (F.col(day_text) >= F.lit(lo.isoformat()))
    if hi is not None:
        cond = cond & (F.col(ts) < ntz(hi))
        if day_text:
            cond = cond & (F.col(day_text) < F.lit(hi.isoformat()))
    return df.filter(cond) if (lo is not None or hi is not None) else df


# F2
def in_date_range(df: DataFrame, from_: str | None = None, to: str | None = None,
                  date: str = "date") -> DataFrame:
    """Text date cast to DATE ('' → NULL → excluded), inclusive on both ends. A
    ``visit_day`` column (the sink's partition column, NULL where the text is no date) has
    the same day as a DATE; filtering on it prunes partitions."""
    d = F.col("visit_day") if "visit_day" in df.columns else F.nullif(F.col(date), F.lit("")).try_cast("date")
    cond = F.lit(True)
    if from_:
        cond = cond & (d >= F.lit(from_).cast("date"))
    if to:
        cond = cond & (d <= F.lit(to).cast("date"))
    return df.filter(cond) if (from_ or to) else df


def _like_escape(q: str) -> str:
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


# F3
def search_people(df: DataFrame, q: str | None, literal: bool = False,
                  cols=("name", "phone"), skip_empty: bool = True) -> DataFrame:
    """Case-insensitive substring match on any of ``cols``; NULLs never match.
    By default ``%``/``_`` in ``q`` act as wildcards (as in the reference). An empty query
    keeps every row (the admin list) or, without ``skip_empty``, still asks for a non-NULL
    column (the owner's list)."""
    if not q and skip_empty:
        return df
    q = q or ""
    pat = "%" + (_like_escape(q) if literal else q) + "%"
    cond = None
    for c in cols:
        one = F.col(c).ilike(pat)
        cond = one if cond is None else (cond | one)
    return df.filter(F.coalesce(cond, F.lit(False)))


# F4
def with_service(df: DataFrame, service: str | None) -> DataFrame:
    return df.filter(F.col("service") == F.lit(service)) if service else df


# F5
def with_status(df: DataFrame, status: str | None, col: str = "status") -> DataFrame:
    return df.filter(F.col(col) == F.lit(status)) if status else df


# F6
def history_of(df: DataFrame, phones: DataFrame | list[str], phone: str = "phone",
               ts: str = "created_at") -> DataFrame:
    """All bookings of the given phones (a DataFrame or a short list), newest first."""
    if isinstance(phones, DataFrame):
        # Spark broadcasts a phone list that its statistics show to be short
        out = df.join(phones.select(F.col(phone)).distinct(), on=phone, how="left_semi")
    else:
        out = df.filter(F.col(phone).isin(list(phones)))
    return out.orderBy(F.col(ts).desc_nulls_first(), F.col("order_id").asc_nulls_last())


# F7
def on_day(df: DataFrame, as_of, ts: str = "created_at") -> DataFrame:
    """Rows created on ``as_of``'s calendar day: a half-open range on the raw
    column (pushes into parquet), not ``to_date(col) = day``."""
    day = as_of if isinstance(as_of, dt.date) and not isinstance(as_of, dt.datetime) else \
        dt.date.fromisoformat(str(as_of)[:10])
    return df.filter((F.col(ts) >= ntz(day)) & (F.col(ts) < ntz(day + dt.timedelta(days=1))))


# F8
def visible_offers(cat: DataFrame) -> DataFrame:
    return cat.filter(F.col("visible") == F.lit(True))


def active_services(df: DataFrame) -> DataFrame:
    return df.filter(F.col("active") == F.lit(True))


# F9
def within_hours(df: DataFrame, time: str = "time", lo: int = OPEN_MINUTE,
                 hi: int = CLOSE_MINUTE) -> DataFrame:
    """Bookable time of day: ``lo <= minutes <= hi`` (10:00–20:00 by default)."""
    m = minutes_of_day(time)
    return df.filter(F.coalesce(m.between(lo, hi), F.lit(False)))


# F10
def has_any_price(cat: DataFrame, cols=("bike", "hatchback", "sedan", "suv")) -> DataFrame:
    present = [c for c in cols if c in cat.columns]
    cond = None
    for c in present:
        one = F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != F.lit(""))
        cond = one if cond is None else (cond | one)
    return cat.filter(F.coalesce(cond, F.lit(False))) if cond is not None else cat.limit(0)


# F11
def is_new(df: DataFrame, as_of, days: int = 30, out: str = "is_new") -> DataFrame:
    """Flag rows changed (updated_at, else created_at) at most ``days`` × 24 h before
    ``as_of``; future stamps count as new, missing stamps do not."""
    stamp = F.coalesce(*[F.col(c) for c in ("updated_at", "created_at") if c in df.columns])
    flag = F.coalesce(stamp >= ntz(as_of) - F.make_dt_interval(F.lit(days)), F.lit(False))
    return df.withColumn(out, flag)
