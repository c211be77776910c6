"""Registered streaming queries (X1–X3): each replays driver-derived rows as a file
stream and returns what the sink received; oracles are the batch twins."""

from __future__ import annotations

from washbay.operators import people as PE
from washbay.plans.registry import register, sql_with
from washbay.plans.window_queries import ATT_SQL, SCALED, STAFF, _walk
from washbay.sources.fixtures import fixture
from washbay.streaming import streams as X


@register("x1_stream_daily_revenue", sql_with(["bookings"], """
SELECT CAST(created_at AS DATE) AS day, CAST(COALESCE(SUM(price), 0) AS BIGINT) AS revenue, COUNT(*) AS bookings
FROM bookings GROUP BY 1
HAVING CAST(CAST(created_at AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY
       <= (SELECT max(created_at) FROM bookings) - INTERVAL 1 DAY"""))
def x1(spark, sf):
    bk = fixture(spark, sf, "bookings").select("order_id", "created_at", "price")
    return X.replay(spark, bk, X.stream_daily_revenue, "x1", "created_at")


@register("x2_stream_attendance", sql_with(["attendance_events", "users"], "SELECT * FROM att WHERE status = 'Completed'",
                                           staff=STAFF, att=ATT_SQL))
def x2(spark, sf):
    ok, _ = PE.known_employees(fixture(spark, sf, "attendance_events"), fixture(spark, sf, "users"))
    return X.replay(spark, ok, X.stream_attendance, "x2")


@register("x3_stream_code_cooldown", sql_with(["code_requests"], "SELECT seq, ts, phone, purpose, accepted FROM walk",
                                              recursive=True, **_walk(SCALED["cooldown"])))
def x3(spark, sf):
    return X.replay(spark, fixture(spark, sf, "code_requests"),
                    lambda s: X.stream_code_cooldown(s, SCALED["cooldown"]), "x3")
