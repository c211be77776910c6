"""Sources, sheets and less-travelled options on hand-made rows."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from washbay.operators import lists as L
from washbay.operators import nested as N
from washbay.sources import tables as S


def test_catalog_schema_evolution_defaults(spark):
    base = tempfile.mkdtemp(prefix="washbay-cat-")
    old = spark.createDataFrame([("Basic", 50, 150, 200)], "name string, bike int, sedan int, suv int")
    new = spark.createDataFrame([("Foam", None, 300, 400, 2, False, "x")],
                                "name string, bike int, sedan int, suv int, position int, visible boolean, description string")
    old.write.parquet(f"{base}/part=1")
    new.write.parquet(f"{base}/part=2")
    cat = {r.name: (r.position, r.visible, r.description) for r in S.load_catalog(spark, base).collect()}
    assert cat == {"Basic": (None, True, ""), "Foam": (2, False, "x")}


def test_bookings_from_datetime_dialect(spark):
    df = spark.createDataFrame([(7, "A", dt.datetime(2024, 3, 1, 9, 5), "Cancelled", 120)],
                               "id long, name string, datetime timestamp_ntz, visit string, price int")
    row = S.load_bookings(spark, df, "web").first()
    assert (row.order_id, row.date, row.time, row.status, row.visit_place) == (7, "2024-03-01", "09:05", "Cancelled", None)
    with pytest.raises(ValueError):
        S.load_bookings(spark, df, "other")


def test_price_sheets(spark):
    pk = spark.createDataFrame([(2, "B", None, 1, None, 3, 4, dt.datetime(2024, 1, 2), None),
                                (1, "A", "d", None, None, None, 9, dt.datetime(2024, 1, 1), None)],
                               "id long, name string, description string, bike int, hatchback int, sedan int, suv int, "
                               "created_at timestamp_ntz, updated_at timestamp_ntz")
    rows = S.load_price_sheets(spark, "packages", packages=pk)["packages"].collect()
    assert [r.name for r in rows] == ["A", "B"] and rows[0].prices.suv == 9
    sv = spark.createDataFrame([(2, "x", True), (1, "y", False), (3, "z", True)], "id long, name string, active boolean")
    assert [r.id for r in S.load_price_sheets(spark, "services", services=sv)["services"].collect()] == [2, 3]
    cat = spark.createDataFrame([("Basic", 50, 150, 200, 1, True, None), ("Hidden", 1, 1, 1, 2, False, "h")],
                                "name string, bike int, sedan int, suv int, position int, visible boolean, description string")
    out = S.load_price_sheets(spark, catalog=cat, alacarte=pk)
    p = out["packages"].collect()
    assert len(p) == 1 and p[0].prices.hatchback == 150 and p[0].description == ""
    assert out["alacarte"].count() == 2


def test_profile_and_views(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, None), (3, dt.datetime(2024, 1, 3))],
                               "order_id long, created_at timestamp_ntz")
    prof = S.table_profile(df, 2, keys=("order_id",))
    assert prof["columns"] == [("order_id", "bigint"), ("created_at", "timestamp_ntz")]
    assert prof["count"].first().rows == 3
    assert [r.order_id for r in prof["sample"].collect()] == [2, 3]


def test_collated_order_and_single_map(spark):
    cat = spark.createDataFrame([("b", 1, 2, 3, None), ("A", 1, None, 3, None)],
                                "name string, bike int, sedan int, suv int, position int")
    assert [r.name for r in L.catalog_order(cat).collect()] == ["A", "b"]
    assert [r.name for r in L.catalog_order(cat, "UNICODE_CI").collect()] == ["A", "b"]
    m = {r.name: r.prices for r in N.price_map(cat).collect()}
    assert m["A"] == {"Bike": 1, "Hatch/Sedan": None, "SUV": 3}


def test_gallery_round_trip(spark):
    df = spark.createDataFrame([('["a.jpg","b.png"]',), ("[broken",), (None,)], "g string")
    arr = df.select(N.gallery_array("g").alias("a"))
    assert [r.a for r in arr.collect()] == [["a.jpg", "b.png"], [], []]
    assert [r[0] for r in arr.select(N.gallery_json("a")).collect()] == ['["a.jpg","b.png"]', "[]", "[]"]
    lines = spark.createDataFrame([(" a \n\n b\t\n",)], "t string").select(N.split_lines("t")).first()[0]
    assert lines == ["a", "b"]


def test_cli_jobs_write_every_part(spark, sf_dir):
    import os
    from washbay import cli
    from washbay.sources.fixtures import fixture
    d = tempfile.mkdtemp(prefix="washbay-cli-")
    fixture(spark, sf_dir, "bookings").write.parquet(f"{d}/bookings")
    fixture(spark, sf_dir, "attendance_events").write.parquet(f"{d}/events")
    fixture(spark, sf_dir, "users").write.parquet(f"{d}/users")
    cli.main(["stats", "--bookings", f"{d}/bookings", "--group", "year", "--out", f"{d}/stats"])
    cli.main(["attendance", "--events", f"{d}/events", "--users", f"{d}/users", "--out", f"{d}/att"])
    assert sorted(os.listdir(f"{d}/stats")) == ["by_dow", "by_hour", "by_service", "by_vehicle", "points", "totals"]
    assert spark.read.parquet(f"{d}/stats/totals").first()["count"] > 0
    assert spark.read.parquet(f"{d}/att/attendance").count() > 0
