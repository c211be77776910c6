"""Boundary rules on hand-made rows (values from the reference's own rules)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from washbay.functions import columns as C
from washbay.operators import catalog as CA
from washbay.operators import changes as CH
from washbay.operators import codes as CO
from washbay.operators import filters as FL
from washbay.operators import intake as I
from washbay.operators import packs as PK
from washbay.operators import reports as R
from washbay.operators.attendance import pair_attendance
from washbay.plans import reports as P


def one_col(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_phone_and_text(spark):
    assert one_col(spark, ["+91 98-765 43210", "1" * 20, None, ""], C.norm_phone) == \
        ["919876543210", "1" * 15, "", ""]
    assert one_col(spark, ["  Ravi \t", None, " x\n"], lambda c: C.norm_text(c, 3)) == ["Rav", "", "x"]


def test_dates_and_times(spark):
    assert one_col(spark, ["2024-02-31", "", "2024-01-05\n", "2024-01-05T10:00:00Z", "5 Jan 2024", None],
                   C.norm_date) == ["", "", "2024-01-05", "2024-01-05", "", ""]
    assert one_col(spark, ["9:05", "24:00", "10:00", "20:00", "20:01", "7:5", " 07:30 "], C.norm_time) == \
        ["09:05", "", "10:00", "20:00", "20:01", "", "07:30"]


def test_visit_ts_rules(spark):
    df = spark.createDataFrame([("2024-01-05", "09:30"), ("2024-01-05", "noon"), ("2024-02-31", "09:30"),
                                ("2024-01-05\n", "09:30"), ("", "09:30"), ("2024-01-05", "25:70")], "date string, time string")
    got = [r[0] for r in df.select(C.visit_ts()).collect()]
    assert got == [dt.datetime(2024, 1, 5, 9, 30), dt.datetime(2024, 1, 5), None, None, None, None]


def test_effective_price_first_digit_run(spark):
    df = spark.createDataFrame([(None, "Foam 150"), (None, "Foam 150 wash"), (None, "Basic"), (None, None),
                                (70, "Foam 150"), (None, "x99999999999")], "price int, service string")
    assert [r[0] for r in df.select(C.effective_price()).collect()] == [150, 150, 0, 0, 70, None]


def test_bool_words(spark):
    assert one_col(spark, ["Yes", "off", "maybe", "", None, " ON "], lambda c: C.norm_bool(c, True)) == \
        [True, False, True, True, True, True]


def test_rounding_rules(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0, t0 + dt.timedelta(seconds=s)) for s in (59.4, 59.5, 60, -59.5)],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(C.seconds_since("a", "b")).collect()] == [59, 60, 60, -60]


def test_month_rollover(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31), 1), (dt.date(2023, 1, 31), 1), (dt.date(2024, 3, 15), 9)],
                               "d date, n int")
    assert [r[0] for r in df.select(C.expiry_months("d", "n")).collect()] == \
        [dt.date(2024, 3, 2), dt.date(2023, 3, 3), dt.date(2024, 12, 15)]


def test_unknown_group_raises(spark):
    bk = spark.createDataFrame([("2024-01-01", "10:00", None, "Basic", "Bike", "a", "1")],
                               "date string, time string, price int, service string, vehicle string, name string, phone string")
    with pytest.raises(ValueError):
        R.trend(bk, "week")


def test_avg_ticket_half_up(spark):
    bk = spark.createDataFrame([("2024-01-01", "10:00", 1, "s"), ("2024-01-01", "11:00", 2, "s")],
                               "date string, time string, price int, service string") \
        .withColumn("vehicle", F.lit("Bike")).withColumn("name", F.lit("a")).withColumn("phone", F.lit("1"))
    row = R.totals(bk).first()
    assert (row.total, row["count"], row.avg_ticket) == (3, 2, 2)      # 1.5 rounds up
    rep = P.stats_report(bk, "day", "2030-01-01", "2030-01-02")
    assert rep["totals"].first().asDict() == {"total": 0, "count": 0, "avg_ticket": 0}


def test_search_percent_is_a_wildcard_unless_literal(spark):
    df = spark.createDataFrame([("a%b", "1"), ("axxb", "2"), (None, None)], "name string, phone string")
    assert FL.search_people(df, "a%b").count() == 2
    assert FL.search_people(df, "a%b", literal=True).count() == 1


@pytest.mark.parametrize("ids,expected", [([1, 2, 4], [3]), ([2, 3], [1]), ([], [1]), ([-1, 0, 1], [2])])
def test_next_free_id(spark, ids, expected):
    df = spark.createDataFrame([(i,) for i in ids], "order_id long")
    assert [r.id for r in I.next_free_ids(df, 1).collect()] == expected


def test_next_free_ids_many(spark):
    df = spark.createDataFrame([(i,) for i in [1, 2, 4, 7, 8, 10]], "order_id long")
    assert sorted(r.id for r in I.next_free_ids(df, 5).collect()) == [3, 5, 6, 9, 11]


def test_allocate_ids_batch(spark):
    existing = spark.createDataFrame([(i,) for i in [1, 3]], "order_id long")
    batch = spark.createDataFrame([(10, "a"), (5, "b"), (7, "c")], "seq long, name string")
    got = {r.name: r.order_id for r in I.allocate_ids(batch, existing).collect()}
    assert got == {"b": 2, "c": 4, "a": 5}


def test_attendance_pairs(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ev = spark.createDataFrame([(1, t(8), 7, "A", "OUT"), (2, t(9), 7, "A", "IN"), (3, t(10), 7, "A", "IN"),
                                (4, t(17), 7, "A", "OUT"), (5, t(18), 7, "A", "IN")],
                               "seq long, ts timestamp_ntz, employee_id long, employee_name string, type string")
    rows = {r.attendance_id: (r.check_out, r.status) for r in pair_attendance(ev).collect()}
    assert rows == {2: (t(17), "Completed"), 3: (t(17), "Completed"), 5: (None, "Present")}


def test_ledger_balance_zero(spark):
    m = spark.createDataFrame([(1, 0), (2, 2)], "id long, remaining_washes int")
    w = spark.createDataFrame([(i, dt.datetime(2024, 1, i), k) for i, k in [(1, 1), (2, 2), (3, 2), (4, 2)]],
                              "seq long, ts timestamp_ntz, membership_id long")
    got = {r.seq: (r.accepted, r.balance_after) for r in PK.wash_ledger(m, w).collect()}
    assert got == {1: (False, 0), 2: (True, 1), 3: (True, 0), 4: (False, 0)}


def test_cooldown_boundaries(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0), (2, t0 + dt.timedelta(seconds=59.4)), (3, t0 + dt.timedelta(seconds=59.5)),
            (4, t0 + dt.timedelta(seconds=100)), (5, t0 + dt.timedelta(seconds=119.6))]
    req = spark.createDataFrame([(s, ts, "9", "login") for s, ts in rows], "seq long, ts timestamp_ntz, phone string, purpose string")
    got = {r.seq: r.accepted for r in CO.code_cooldown(req, 60).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_code_outcomes_attempts(spark):
    t0 = dt.datetime(2024, 1, 1)
    s = lambda x: t0 + dt.timedelta(seconds=x)
    codes = spark.createDataFrame([(100, "9", "p", t0, s(300))],
                                  "code_id long, phone string, purpose string, created_at timestamp_ntz, expires_at timestamp_ntz")
    ver = spark.createDataFrame([(i, s(i), "9", "p", i >= 6) for i in range(1, 9)] + [(20, s(400), "9", "p", True),
                                                                                      (21, s(10), "8", "p", True)],
                                "seq long, ts timestamp_ntz, phone string, purpose string, matches boolean")
    got = {r.seq: r.outcome for r in CO.code_outcomes(ver, codes).collect()}
    assert [got[i] for i in range(1, 9)] == ["invalid"] * 5 + ["too many attempts"] * 3
    assert got[20] == "expired" and got[21] == "not found"
    ver2 = ver.withColumn("matches", F.col("seq") >= 5)
    got2 = {r.seq: r.outcome for r in CO.code_outcomes(ver2, codes).collect()}
    assert [got2[i] for i in range(1, 9)] == ["invalid"] * 4 + ["ok"] + ["already used"] * 3
    assert got2[20] == "already used"


def test_move_edges(spark):
    cat = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "name string, position int")
    moves = spark.createDataFrame([(1, "a", "up")], "seq long, name string, direction string")
    out, rej = CA.move_items(cat, moves)
    assert {r.name: r.position for r in out.collect()} == {"a": 1, "b": 2, "c": 3}
    moves = spark.createDataFrame([(0, "zz", "up"), (1, "c", "up"), (2, "a", "down"), (3, "c", None)],
                                  "seq long, name string, direction string")
    out, rej = CA.move_items(cat, moves)
    assert {r.name: r.position for r in out.collect()} == {"c": 1, "a": 2, "b": 3}
    assert {r.seq: r.reject_reason for r in rej.collect()} == {0: "service not found", 3: "invalid direction"}


def test_customer_edit_rules(spark):
    bk = spark.createDataFrame([(1, "Asha", "99", "Bike", "Basic", "2024-01-01", "09:00", "x", "New", "a", 50, None)],
                               "order_id long, name string, phone string, vehicle string, service string, date string, time string, "
                               "visit_place string, status string, address string, price int, created_at timestamp_ntz")
    cat = spark.createDataFrame([("Basic", 60, 150, 200, True)], "name string, bike int, sedan int, suv int, visible boolean")
    req = [(1, 1, "99", "2024-02-31", "10:00", "Bike", "Basic"), (2, 1, "99", "2024-02-03", "junk", "Bike", "Basic"),
           (3, 1, "98", "2024-02-03", "10:00", "Bike", "Gold"), (4, 1, "98", "2024-02-03", "10:00", "Bike", "Basic"),
           (5, None, "99", "2024-02-03", "10:00", "Bike", "Basic"), (6, 1, "99", "2024-02-03", " 7:30 ", "Bike", "Basic")]
    batch = spark.createDataFrame([(*r, None, None) for r in req], "seq long, order_id long, phone string, date string, time string, "
                                  "vehicle string, service string, visit string, address string")
    out, rej = CH.replace_bookings(bk, batch, "customer", catalog=cat)
    assert {r.seq: r.reject_reason for r in rej.collect()} == {
        1: "invalid date/time", 2: "invalid date/time", 3: "Gold not available for Bike", 4: "booking not found", 5: "missing phone/order_id"}
    r = out.first()
    assert (r.name, r.phone, r.date, r.time, r.visit_place, r.price) == ("Asha", "99", "2024-02-03", "07:30", "Wash Center", 60)


def test_no_request_is_lost(spark):
    ev = spark.createDataFrame([(1, 1, "cancel"), (2, 1, None), (3, 1, "edit"), (4, 1, "archive")], "seq long, order_id long, action string")
    bk = spark.createDataFrame([(1, "New")], "order_id long, status string")
    out, rej = CH.set_status(bk, ev)
    assert out.first().status == "Cancelled" and sorted(r.seq for r in rej.collect()) == [2, 4]
    from washbay.operators.attendance import clock_events
    types = spark.createDataFrame([("IN",), ("OUT",), (None,), ("x",)], "type string")
    ok, bad = clock_events(types)
    assert ok.count() == 2 and bad.count() == 2
    from washbay.operators.packs import open_memberships
    plans = spark.createDataFrame([(1, 30, 7)], "id int, validity_days int, total_washes int")
    req = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "customer_id long, plan_id int")
    opened, unknown = open_memberships(req, plans, "2024-01-30")
    assert opened.count() == 1 and sorted(r.customer_id for r in unknown.collect()) == [2, 3]


def test_search_with_an_empty_query(spark):
    df = spark.createDataFrame([("a", None), (None, None)], "name string, phone string")
    assert FL.search_people(df, "").count() == 2 and FL.search_people(df, "", skip_empty=False).count() == 1


def test_bike_offer_prefers_basic_then_cheapest(spark):
    cat = spark.createDataFrame([("Premium", 90, 2, ""), ("Cheap", 40, 3, ""), ("Super Basic", 99, 5, "")],
                                "name string, bike int, position int, description string")
    assert CA.offers_for(cat, "Bike").first().name == "Super Basic"
    assert CA.offers_for(cat.filter("name <> 'Super Basic'"), "Bike").first().name == "Cheap"


def test_hidden_and_null_visible_pricing(spark):
    cat = spark.createDataFrame([("Basic", 50, 150, 200, True), ("Hidden", 1, 1, 1, False), ("Null", 5, 5, 5, None),
                                 ("NoBike", None, 10, 10, True)],
                                "name string, bike int, sedan int, suv int, visible boolean")
    bk = spark.createDataFrame([(1, "Bike", "Basic", "Home Visit"), (2, "SUV", "Hidden", "x"), (3, "Bike", "Null", "x"),
                                (4, "Bike", "NoBike", "x"), (5, "Hatch/Sedan", "Ghost", "x")],
                               "order_id long, vehicle string, service string, visit string")
    got = {r.order_id: (r.price, r.reject_reason) for r in I.price_bookings(bk, cat).collect()}
    assert got[1] == (100, None) and got[3] == (5, None)
    assert got[2][0] is None and got[4][0] is None and got[5] == (None, "Ghost not available for Hatch/Sedan")


def test_patch_and_upsert(spark):
    base = spark.createDataFrame([(1, "red", "hi")], "id long, color string, tagline string")
    patch = spark.createDataFrame([(1, 1, None, "new"), (2, 9, "x", "y")], "seq long, id long, color string, tagline string")
    out, missing = CH.patch_rows(base, patch)
    assert out.first().asDict() == {"id": 1, "color": "red", "tagline": "new"} and missing.count() == 1
    cat = spark.createDataFrame([("A", 1, 2, 3, 2, True, "a"), ("B", 1, 2, 3, 1, True, "b")],
                                "name string, bike int, sedan int, suv int, position int, visible boolean, description string")
    batch = spark.createDataFrame([(1, "A", "5", None, None, "no", " d "), (2, "C", "x7", None, None, None, None),
                                   (3, "  ", "1", None, None, None, None)],
                                  "seq long, name string, bike string, sedan string, suv string, visible string, description string")
    out, rej = CA.upsert_catalog(cat, batch, "2024-01-01 00:00:00")
    rows = {r.name: (r.bike, r.position, r.visible, r.description) for r in out.collect()}
    assert rows == {"B": (1, 1, True, "b"), "A": (5, 2, False, "d"), "C": (7, 3, True, "")}
    assert rej.count() == 1


def test_price_label_like_js(spark):
    got = one_col(spark, ["100", "99.5", None, "", "abc", " 7 "], C.price_label)
    assert got == ["₹ 100", "₹ 99.5", "—", "—", "—", "₹ 7"]
    assert one_col(spark, [150, None], C.price_label, "int") == ["₹ 150", "—"]


def test_booking_list_limit_parsing(spark):
    from washbay.operators import lists as L
    bk = spark.createDataFrame([(i, f"2024-01-{i:02d}", dt.datetime(2024, 1, i)) for i in range(1, 21)],
                               "order_id long, date string, created_at timestamp_ntz")
    assert L.booking_list(bk, limit="5abc").count() == 5
    assert L.booking_list(bk, limit="0").count() == 1
    assert L.booking_list(bk, limit="junk").count() == 20


def test_norm_date_offsets_like_js(spark):
    got = one_col(spark, ["2024-01-05T01:00:00+05:30", "2024-01-05T23:30-02:00", "2024-01-05T10:00:00.123Z",
                          "2024-01-05 10:00", "2024-01-05T10:00+0530", "2024-02-30T10:00Z"], C.norm_date)
    assert got == ["2024-01-04", "2024-01-06", "2024-01-05", "2024-01-05", "2024-01-05", ""]


def test_strict_visit_time_raises_on_impossible_dates(spark):
    from pyspark.errors import PySparkException
    df = spark.createDataFrame([("2024-02-31", "09:30")], "date string, time string")
    assert df.select(C.visit_ts()).first()[0] is None
    if spark.conf.get("spark.sql.ansi.enabled") == "true":
        with pytest.raises(PySparkException):
            df.select(C.visit_ts(strict=True)).collect()


def test_period_bounds_accept_unpadded_days():
    import datetime as _dt
    assert FL.period_bounds("day", "2024-1-5", "2024-01-31") == (_dt.date(2024, 1, 5), _dt.date(2024, 2, 1))
    assert FL.period_bounds("month", "2023-12", "2024-2") == (_dt.date(2023, 12, 1), _dt.date(2024, 3, 1))
    assert FL.period_bounds("year", "2020", None) == (_dt.date(2020, 1, 1), None)
    with pytest.raises(ValueError):
        FL.period_bounds("day", "5/1/2024", None)
