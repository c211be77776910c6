"""Registered report queries (A1–A14) with their DuckDB oracles."""

from __future__ import annotations

from washbay.operators import reports as R
from washbay.plans import reports as P
from washbay.plans.registry import register, sql_with
from washbay.sources.fixtures import fixture

ORDERS_AS_OF = "2001-08-01"

# DuckDB twin of stats_base: P1 + P2 over the bookings adapter, NULL times dropped
STATS_BASE = """
SELECT * FROM (
 SELECT CASE WHEN regexp_full_match("date", '[0-9]{4}-[0-9]{2}-[0-9]{2}')
              AND regexp_full_match("time", '[0-9]{2}:[0-9]{2}')
             THEN TRY_CAST("date" || ' ' || "time" AS TIMESTAMP)
             WHEN regexp_full_match("date", '[0-9]{4}-[0-9]{2}-[0-9]{2}')
             THEN TRY_CAST("date" AS TIMESTAMP) END AS dt_local,
  name, phone, vehicle, service,
  COALESCE(price, CASE WHEN regexp_matches(service, '[0-9]')
                       THEN TRY_CAST(regexp_extract(service, '([0-9]+)', 1) AS INTEGER) ELSE 0 END) AS price_int
 FROM bookings) s
WHERE dt_local IS NOT NULL"""

SUMS = "CAST(SUM(price_int) AS BIGINT) AS total, COUNT(*) AS count"


def _bk(spark, sf):
    return fixture(spark, sf, "bookings")


def _stats_sql(body: str, where: str = "") -> str:
    base = STATS_BASE + (f" AND {where}" if where else "")
    return sql_with(["bookings"], body, base=base)


TREND_WINDOWS = {
    # name: (group, from, to, DuckDB window predicate, label format)
    "a1_trend_month": ("month", None, None, "", "%Y-%m"),
    "a1_trend_day_window": ("day", "1998-01-01", "1998-03-31",
                            "CAST(dt_local AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'", "%Y-%m-%d"),
    "a1_trend_month_window": ("month", "1997-03", "1998-02",
                              "dt_local >= TIMESTAMP '1997-03-01' AND dt_local < TIMESTAMP '1998-03-01'", "%Y-%m"),
    "a1_trend_year_window": ("year", "1996", "1999",
                             "dt_local >= TIMESTAMP '1996-01-01' AND dt_local < TIMESTAMP '2000-01-01'", "%Y"),
    "a1_trend_year": ("year", None, None, "", "%Y"),
}

for _name, (_g, _f, _t, _w, _fmt) in TREND_WINDOWS.items():
    register(_name, _stats_sql(f"SELECT strftime(dt_local, '{_fmt}') AS label, {SUMS} FROM base GROUP BY 1", _w))(
        lambda spark, sf, g=_g, f=_f, t=_t: R.trend(_bk(spark, sf), g, f, t))

TOTALS_SQL = """SELECT COALESCE(CAST(SUM(price_int) AS BIGINT), 0) AS total, COUNT(*) AS count,
 CAST(CASE WHEN COUNT(*) > 0 THEN floor(COALESCE(SUM(price_int), 0) / COUNT(*) + 0.5) ELSE 0 END AS BIGINT) AS avg_ticket
FROM base"""


@register("a2_totals", _stats_sql(TOTALS_SQL))
def a2_totals(spark, sf):
    return R.totals(_bk(spark, sf))


@register("a2_totals_empty_window", _stats_sql(TOTALS_SQL, "dt_local >= TIMESTAMP '1980-01-01' AND dt_local < TIMESTAMP '1981-01-01'"))
def a2_totals_empty_window(spark, sf):
    return R.totals(_bk(spark, sf), "year", "1980", "1980")


BY_SERVICE_SQL = f"""SELECT service AS label, {SUMS} FROM base GROUP BY service
ORDER BY total DESC NULLS LAST, label ASC NULLS LAST LIMIT 8"""
BY_VEHICLE_SQL = f"SELECT vehicle AS label, {SUMS} FROM base GROUP BY vehicle"
BY_HOUR_SQL = f"SELECT CAST(hour(dt_local) AS INTEGER) AS hour, {SUMS} FROM base GROUP BY 1"
BY_DOW_SQL = f"SELECT CAST(dayofweek(dt_local) AS INTEGER) AS dow, {SUMS} FROM base GROUP BY 1"


@register("a3_by_service", _stats_sql(BY_SERVICE_SQL))
def a3_by_service(spark, sf):
    return R.by_service(_bk(spark, sf))


@register("a4_by_vehicle", _stats_sql(BY_VEHICLE_SQL))
def a4_by_vehicle(spark, sf):
    return R.by_vehicle(_bk(spark, sf))


@register("a5_by_hour", _stats_sql(BY_HOUR_SQL))
def a5_by_hour(spark, sf):
    return R.by_hour(_bk(spark, sf))


@register("a6_by_weekday", _stats_sql(BY_DOW_SQL))
def a6_by_weekday(spark, sf):
    return R.by_weekday(_bk(spark, sf))


@register("a6_by_weekday_day_window", _stats_sql(
    BY_DOW_SQL, "CAST(dt_local AS DATE) BETWEEN DATE '1999-06-01' AND DATE '1999-12-31'"))
def a6_by_weekday_day_window(spark, sf):
    return R.by_weekday(_bk(spark, sf), "day", "1999-06-01", "1999-12-31")


# The six parts of one report from a single grouping-sets pass
_A13_WIN = "dt_local >= TIMESTAMP '1997-01-01' AND dt_local < TIMESTAMP '2000-01-01'"
A13_PARTS = {
    "points": f"SELECT strftime(dt_local, '%Y') AS label, {SUMS} FROM base GROUP BY 1",
    "totals": TOTALS_SQL,
    "by_service": BY_SERVICE_SQL,
    "by_vehicle": BY_VEHICLE_SQL,
    "by_hour": BY_HOUR_SQL,
    "by_dow": BY_DOW_SQL,
}
for _part, _sql in A13_PARTS.items():
    register(f"a13_stats_{_part}", _stats_sql(_sql, _A13_WIN))(
        lambda spark, sf, part=_part: P.stats_report(_bk(spark, sf), "year", "1997", "1999", persist=False)[part])


# A7–A10 over the bookings table
@register("a7_recent_active_days", sql_with(["bookings"], """
SELECT CAST(created_at AS DATE) AS day, CAST(COALESCE(SUM(price), 0) AS BIGINT) AS revenue, COUNT(*) AS bookings
FROM bookings GROUP BY 1 ORDER BY day DESC NULLS FIRST LIMIT 7"""))
def a7_recent_active_days(spark, sf):
    return R.recent_active_days(_bk(spark, sf))


@register("a7_recent_active_days_no_cancelled", sql_with(["bookings"], """
SELECT CAST(created_at AS DATE) AS day, CAST(COALESCE(SUM(price), 0) AS BIGINT) AS revenue, COUNT(*) AS bookings
FROM bookings WHERE visit IS DISTINCT FROM 'Cancelled' GROUP BY 1 ORDER BY day DESC NULLS FIRST LIMIT 7"""))
def a7_recent_active_days_no_cancelled(spark, sf):
    bk = _bk(spark, sf).withColumnRenamed("visit", "status")
    return R.recent_active_days(bk, exclude_status=["Cancelled"])


@register("a8_repeat_customers", sql_with(["bookings"], """
SELECT COUNT(*) AS total FROM (SELECT phone FROM bookings GROUP BY phone HAVING COUNT(*) > 1) x"""))
def a8_repeat_customers(spark, sf):
    return R.repeat_customers(_bk(spark, sf))


LAPSED_SQL = f"""
SELECT name, phone, MAX(created_at) AS last_visit FROM bookings GROUP BY name, phone
HAVING MAX(created_at) < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 15 DAY
ORDER BY last_visit DESC NULLS FIRST, name ASC NULLS LAST, phone ASC NULLS LAST LIMIT 50"""
TOP_SQL = """
SELECT name, phone, CAST(SUM(price) AS BIGINT) AS spend FROM bookings GROUP BY name, phone
ORDER BY spend DESC NULLS FIRST, name ASC NULLS LAST, phone ASC NULLS LAST LIMIT 10"""


@register("a9_lapsed_customers", sql_with(["bookings"], LAPSED_SQL))
def a9_lapsed_customers(spark, sf):
    return R.lapsed_customers(_bk(spark, sf), ORDERS_AS_OF)


@register("a10_top_spenders", sql_with(["bookings"], TOP_SQL))
def a10_top_spenders(spark, sf):
    return R.top_spenders(_bk(spark, sf))


GROWTH_SQL = {
    "revenue": """SELECT CAST(created_at AS DATE) AS day, CAST(COALESCE(SUM(price), 0) AS BIGINT) AS revenue,
 COUNT(*) AS bookings FROM bookings GROUP BY 1 ORDER BY day DESC NULLS FIRST LIMIT 7""",
    "repeat": "SELECT COUNT(*) AS total FROM (SELECT phone FROM bookings GROUP BY phone HAVING COUNT(*) > 1) x",
    "inactive": LAPSED_SQL,
    "vip": TOP_SQL,
}
for _part, _sql in GROWTH_SQL.items():
    register(f"a14_growth_{_part}", sql_with(["bookings"], _sql))(
        lambda spark, sf, part=_part: P.growth_report(_bk(spark, sf), ORDERS_AS_OF, persist=False)[part])
