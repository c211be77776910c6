"""Composite reports (A13, A14): several outputs from one scan.

``stats_report`` answers the trend, totals, by-service, by-vehicle, by-hour and
by-weekday parts with one GROUPING SETS aggregation: one scan of the bookings,
one map-side partial aggregate, one shuffle of partial rows (their number is
bounded by distinct labels + services + vehicles + 31, not by the data). The
reference instead ran six statements, each re-reading the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.functions.columns import dow_of, hour_of, period_label
from washbay.operators import reports as R
from washbay.operators.lists import newest
from washbay.plans.staging import staged

_KEYS = ["label", "service", "vehicle", "hour", "dow"]
# grouping_id bit is 1 for every key *not* grouped; label is the highest bit
_GID = {"label": 0b01111, "service": 0b10111, "vehicle": 0b11011, "hour": 0b11101,
        "dow": 0b11110, "all": 0b11111}


def stats_aggregate(bk: DataFrame, group: str = "month", from_=None, to=None) -> DataFrame:
    base = R.stats_base(bk, group, from_, to).select(
        period_label("dt_local", group).alias("label"), "service", "vehicle",
        hour_of("dt_local").alias("hour"), dow_of("dt_local").alias("dow"), "price_int")
    sets = [[k] for k in _KEYS] + [[]]
    return (base.groupingSets(sets, *_KEYS)
                .agg(F.sum("price_int").cast("bigint").alias("total"),
                     F.count(F.lit(1)).alias("count"), F.grouping_id().alias("gid")))


def stats_report(bk: DataFrame, group: str = "month", from_=None, to=None,
                 persist: bool = True) -> dict[str, DataFrame]:
    agg = stats_aggregate(bk, group, from_, to)
    if persist:
        agg = staged(agg, "stats-parts")              # small: bounded by distinct group values

    def part(key: str) -> DataFrame:
        return agg.filter(F.col("gid") == _GID[key])

    totals = R.with_avg_ticket(part("all").agg(
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("count")))
    by_service = (part("service").select(F.col("service").alias("label"), "total", "count")
                  .orderBy(F.col("total").desc_nulls_last(), F.col("label").asc_nulls_last()).limit(8))
    return {
        "points": part("label").select("label", "total", "count").orderBy("label"),
        "totals": totals,
        "by_service": by_service,
        "by_vehicle": part("vehicle").select(F.col("vehicle").alias("label"), "total", "count")
                                     .orderBy(F.col("total").desc_nulls_last(), F.col("label").asc_nulls_last()),
        # at most 24 and 7 rows: ordered inside one partition, no range-sampling job
        "by_hour": part("hour").select("hour", "total", "count").coalesce(1).sortWithinPartitions("hour"),
        "by_dow": part("dow").select("dow", "total", "count").coalesce(1).sortWithinPartitions("dow"),
    }


def growth_report(bk: DataFrame, as_of, persist: bool = True) -> dict[str, DataFrame]:
    """A7–A10 together; repeat and lapsed customers and top spenders share one
    per-customer aggregate (one shuffle of the bookings instead of three)."""
    act = R.customer_activity(bk)
    if persist:
        act = staged(act, "customer-activity")
    return {
        "revenue": R.recent_active_days(bk),
        "repeat": R.repeat_customers(bk, activity=act),
        "inactive": R.lapsed_customers(bk, as_of, activity=act),
        "vip": R.top_spenders(bk, activity=act),
    }


def owner_report(bk: DataFrame, att: DataFrame, as_of, persist: bool = True) -> dict[str, DataFrame]:
    """A11 + A12 + the two newest-10 lists of the owner dashboard. Three parts read
    the attendance rows, so they are staged once."""
    if persist:
        att = staged(att, "attendance")
    return {
        "kpis": R.day_kpis(bk, att, as_of),
        "recent": newest(bk.select("order_id", "name", "service", "vehicle", "price", "status", "created_at"),
                         10, keys=("order_id",)),
        "logs": newest(att.select("employee_name", "status", "check_in", "check_out", "created_at", "attendance_id"),
                       10, keys=("attendance_id",)).drop("created_at", "attendance_id"),
        "perf": R.attendance_ranking(att),
    }
