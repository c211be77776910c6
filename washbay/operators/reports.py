"""Revenue, demand and customer aggregates.

Sums of whole-rupee INT prices are BIGINT (no overflow cap); every top-k adds the
group keys as tie-break so the result is deterministic. PostgreSQL sorts NULLs
first in DESC order, so the customer/day lists use ``desc_nulls_first`` while the
service/vehicle lists ask for ``NULLS LAST`` as the reference does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.functions.columns import (dow_of, effective_price, hour_of, period_label,
                                       visit_ts)
from washbay.operators.filters import in_period, ntz, on_day


def stats_base(bk: DataFrame, group: str = "month", from_: str | None = None,
               to: str | None = None, strict: bool = False) -> DataFrame:
    """Cleaned rows every stats part reads: parsed visit time (non-NULL), price with
    the digit fallback, restricted to the report window."""
    period_label(F.lit(None), group)           # validate group early (B5)
    base = bk.select(visit_ts("date", "time", strict).alias("dt_local"), "date", "name", "phone",
                     "vehicle", "service", effective_price("price", "service").alias("price_int"))
    base = base.filter(F.col("dt_local").isNotNull())
    return in_period(base, group, from_, to, ts="dt_local", day_text="date")


def _sum_count(total: str = "total", count: str = "count"):
    return [F.sum("price_int").cast("bigint").alias(total), F.count(F.lit(1)).alias(count)]


# A1
def trend(bk: DataFrame, group: str = "month", from_=None, to=None) -> DataFrame:
    base = stats_base(bk, group, from_, to)
    return (base.groupBy(period_label("dt_local", group).alias("label")).agg(*_sum_count())
                .orderBy("label"))


# A2
def totals(bk: DataFrame, group: str = "month", from_=None, to=None) -> DataFrame:
    """One row: total (0 if none), count, avg_ticket = round-half-up(total/count) or 0."""
    base = stats_base(bk, group, from_, to)
    return with_avg_ticket(base.agg(F.coalesce(F.sum("price_int"), F.lit(0)).cast("bigint").alias("total"),
                                    F.count(F.lit(1)).alias("count")))


def with_avg_ticket(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_ticket", F.when(F.col("count") > 0,
                                              F.floor(F.col("total") / F.col("count") + F.lit(0.5)))
                         .otherwise(F.lit(0)).cast("bigint"))


# A3
def by_service(bk: DataFrame, group: str = "month", from_=None, to=None, n: int = 8) -> DataFrame:
    base = stats_base(bk, group, from_, to)
    agg = base.groupBy(F.col("service").alias("label")).agg(*_sum_count())
    return agg.orderBy(F.col("total").desc_nulls_last(), F.col("label").asc_nulls_last()).limit(n)


# A4
def by_vehicle(bk: DataFrame, group: str = "month", from_=None, to=None) -> DataFrame:
    base = stats_base(bk, group, from_, to)
    agg = base.groupBy(F.col("vehicle").alias("label")).agg(*_sum_count())
    return agg.orderBy(F.col("total").desc_nulls_last(), F.col("label").asc_nulls_last())


# A5
def by_hour(bk: DataFrame, group: str = "month", from_=None, to=None) -> DataFrame:
    base = stats_base(bk, group, from_, to)
    return base.groupBy(hour_of("dt_local").alias("hour")).agg(*_sum_count()).orderBy("hour")


# A6
def by_weekday(bk: DataFrame, group: str = "month", from_=None, to=None) -> DataFrame:
    base = stats_base(bk, group, from_, to)
    return base.groupBy(dow_of("dt_local").alias("dow")).agg(*_sum_count()).orderBy("dow")


def _excluding(bk: DataFrame, exclude_status) -> DataFrame:
    if exclude_status:
        return bk.filter(~F.coalesce(F.col("status").isin(list(exclude_status)), F.lit(False)))
    return bk


# A7
def recent_active_days(bk: DataFrame, n: int = 7, exclude_status=()) -> DataFrame:
    """Revenue and bookings of the ``n`` latest days that have bookings."""
    bk = _excluding(bk, exclude_status)
    agg = bk.groupBy(F.to_date("created_at").alias("day")).agg(
        F.coalesce(F.sum("price"), F.lit(0)).cast("bigint").alias("revenue"),
        F.count(F.lit(1)).alias("bookings"))
    return agg.orderBy(F.col("day").desc_nulls_first()).limit(n)


# A8
def repeat_customers(bk: DataFrame, keys=("phone",), activity: DataFrame | None = None) -> DataFrame:
    """Number of customers (by ``keys``; NULL is one group) with more than one booking;
    rolled up from ``activity`` where it is given."""
    n = F.count(F.lit(1)) if activity is None else F.sum("visits")
    per = (bk if activity is None else activity).groupBy(*keys).agg(n.alias("n")).filter(F.col("n") > 1)
    return per.agg(F.count(F.lit(1)).alias("total"))


def customer_activity(bk: DataFrame, keys=("name", "phone")) -> DataFrame:
    """One row per customer with last visit, spend and visits: the shared exchange of A8-A10."""
    return bk.groupBy(*keys).agg(F.max("created_at").alias("last_visit"),
                                 F.sum("price").cast("bigint").alias("spend"),
                                 F.count(F.lit(1)).alias("visits"))


def _key_order(keys):
    return [F.col(k).asc_nulls_last() for k in keys]


# A9
def lapsed_customers(bk: DataFrame, as_of, days: int = 15, n: int = 50,
                     keys=("name", "phone"), activity: DataFrame | None = None) -> DataFrame:
    act = activity if activity is not None else customer_activity(bk, keys)
    cut = ntz(as_of) - F.make_dt_interval(F.lit(days))
    return (act.filter(F.col("last_visit") < cut).select(*keys, "last_visit")
               .orderBy(F.col("last_visit").desc_nulls_first(), *_key_order(keys)).limit(n))


# A10
def top_spenders(bk: DataFrame, n: int = 10, keys=("name", "phone"),
                 activity: DataFrame | None = None) -> DataFrame:
    act = activity if activity is not None else customer_activity(bk, keys)
    return (act.select(*keys, "spend")
               .orderBy(F.col("spend").desc_nulls_first(), *_key_order(keys)).limit(n))


# A11
def day_kpis(bk: DataFrame, att: DataFrame, as_of) -> DataFrame:
    """Bookings and revenue created on ``as_of`` and distinct staff with attendance
    created that day, in one pass over a tagged union (no join of the two counts)."""
    b = on_day(bk, as_of).select(F.lit(True).alias("is_booking"), F.col("price").cast("bigint").alias("price"),
                                 F.lit(None).cast("string").alias("employee_id"))
    a = on_day(att, as_of).select(F.lit(False).alias("is_booking"), F.lit(None).cast("bigint").alias("price"),
                                  F.col("employee_id").cast("string").alias("employee_id"))
    u = b.unionByName(a)
    return u.agg(F.count_if(F.col("is_booking")).alias("bookings_today"),
                 F.coalesce(F.sum("price"), F.lit(0)).cast("bigint").alias("revenue_today"),
                 F.count_distinct("employee_id").alias("staff_present"))


# A12
def attendance_ranking(att: DataFrame, n: int = 5) -> DataFrame:
    """Attendance rows per employee name, top ``n`` (counts clock-ins, not days)."""
    return (att.groupBy("employee_name").agg(F.count(F.lit(1)).alias("days_present"))
               .orderBy(F.col("days_present").desc(), F.col("employee_name").asc_nulls_last()).limit(n))
