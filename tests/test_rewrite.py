"""Change batches on stored bookings: which folders are rewritten, and what they hold."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from washbay.operators import changes as CH
from washbay.sources import tables as S
from washbay.sources.rewrite import rewrite_days

DAYS = [f"2024-01-{d:02d}" for d in range(1, 11)]


@pytest.fixture
def stored(spark):
    """Ten days of ten bookings and five without a date."""
    path = tempfile.mkdtemp(prefix="washbay-days-") + "/bookings"
    rows = spark.range(105).select(
        (F.col("id") + 1).alias("order_id"), *[F.lit("x").alias(c) for c in ("name", "phone", "vehicle", "service", "time", "address")],
        F.lit("Wash Center").alias("visit_place"), F.lit("New").alias("status"), F.lit(10).alias("price"),
        F.when(F.col("id") < 100, F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 10 + 1).cast("string"), 2, "0"))).otherwise("soon").alias("date"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"))
    S.store_by_day(rows.select(*S.BOOKINGS.fieldNames()), path, "append")
    return path


def files(path):
    return {d: sorted(glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{path}/visit_day=*")}


def changed(before, after):
    return sorted(os.path.basename(d).split("=")[1] for d in after if before.get(d) != after[d])


def rows(spark, path):
    return {r.order_id: r for r in S.load_bookings(spark, path).collect()}


def test_a_one_day_batch_rewrites_one_day(spark, stored):
    before, was = files(stored), rows(spark, stored)
    events = spark.createDataFrame([(1, 3, "cancel"), (2, 13, "complete"), (3, 3, "complete"), (4, 999, "cancel"), (5, 23, "tear up")],
                                   "seq long, order_id long, action string")
    done = rewrite_days(spark, stored, events, CH.set_status)
    assert changed(before, files(stored)) == ["2024-01-03"] and [str(d) for d in done.days] == ["2024-01-03"]
    assert [r.reject_reason for r in done.others[0].collect()] == ["invalid action"]
    now = rows(spark, stored)
    assert now.keys() == was.keys() and {i: now[i].status for i in now if now[i].status != "New"} == {3: "Completed", 13: "Completed"}
    assert all(now[i] == was[i] for i in was if i not in (3, 13))


def test_rows_that_move_take_their_new_day_along(spark, stored):
    before = files(stored)
    patch = spark.createDataFrame([(2, "2024-01-07"), (12, "soon"), (101, "2024-03-01"), (777, "2024-01-09")], "order_id long, date string")
    done = rewrite_days(spark, stored, patch, lambda bk, p: CH.patch_rows(bk, p, "order_id"))
    assert changed(before, files(stored)) == ["2024-01-02", "2024-01-07", "2024-03-01", "__HIVE_DEFAULT_PARTITION__"]
    assert [str(d) for d in done.days] == ["None", "2024-01-02", "2024-01-07", "2024-03-01"]
    assert [r.order_id for r in done.others[0].collect()] == [777]
    now = rows(spark, stored)
    assert len(now) == 105 and S.load_bookings(spark, stored).count() == 105
    assert (str(now[2].visit_day), now[12].visit_day, str(now[101].visit_day)) == ("2024-01-07", None, "2024-03-01")


def test_emptied_days_lose_their_rows(spark, stored):
    before = files(stored)
    gone = [i + 1 for i in range(100) if i % 10 in (3, 4)] + [101, 102, 103, 104, 105]
    keys = spark.createDataFrame([(i,) for i in gone], "order_id long")
    rewrite_days(spark, stored, keys, lambda bk, k: CH.delete_rows(bk, k, "order_id"))
    assert changed(before, files(stored)) == ["2024-01-04", "2024-01-05", "__HIVE_DEFAULT_PARTITION__"]
    assert sorted(rows(spark, stored)) == sorted(set(range(1, 106)) - set(gone))
    again = rewrite_days(spark, stored, keys, lambda bk, k: CH.delete_rows(bk, k, "order_id"))
    assert again.days == [] and again.others[0].count() == len(gone)


def test_batch_without_hits_or_rows_rewrites_nothing(spark, stored):
    before = files(stored)
    for events in ([(1, 999, "cancel"), (2, None, "cancel")], []):
        df = spark.createDataFrame(events, "seq long, order_id long, action string")
        assert rewrite_days(spark, stored, df, CH.set_status).days == []
    assert files(stored) == before and len(rows(spark, stored)) == 105


def test_finding_the_days_reads_two_columns(spark, stored):
    keys = spark.createDataFrame([(3,)], "order_id long")
    table = S.load_bookings(spark, stored)
    plan = table.select("order_id", "visit_day").join(keys, "order_id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<order_id:bigint>" in plan


def test_bucketed_bookings_are_not_shuffled_again(spark):
    """Joins of M6, M5, M4 and J5 on a bucketed table: no exchange above its scan."""
    import uuid
    from washbay.operators import people as PE
    rows = spark.range(500).select((F.col("id") + 1).alias("order_id"), *[F.lit("x").alias(c) for c in ("name", "phone", "service", "status")], F.lit(1).alias("price"))
    bk = S.store_bucketed(rows, f"bookings_{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="washbay-buckets-") + "/t", buckets=4)
    ev = spark.createDataFrame([(1, 3, "edit", 9, "y", "x"), (2, 4, "cancel", 8, "z", "q")], "seq long, order_id long, action string, price int, service string, phone string")
    frames = {"m6": CH.edit_bookings(bk, ev), "m5": CH.set_status(bk, ev)[0], "m4": CH.delete_rows(bk, ev.select("order_id"), "order_id")[0],
              "j5": PE.owned_changes(ev, bk, bucketed=True)[0]}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, df in frames.items():
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x)
            depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
            above = []                                       # operators from the scan up to the join
            for x in reversed(lines[:scan]):
                d = len(x) - len(x.lstrip(" :+-"))
                if d < depth:
                    above.append(x)
                    depth = d
            joins = [i for i, x in enumerate(above) if "Join" in x]
            assert joins and not any("Exchange" in x for x in above[:joins[0]]), (name, lines)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.seq for r in frames["j5"].collect()] == [1]
    assert {r.order_id: r.price for r in frames["m6"].collect() if r.price != 1} == {3: 9}


def test_locale_order_is_not_binary_order(spark):
    from washbay.operators.lists import catalog_order
    names = ["zebra", "Apple", "\u00e4pple", "apple", "banana", "\u00c9clair", "eclair", "Zebra"]
    cat = spark.createDataFrame([(n, 1) for n in names] + [("first", 0), ("last", None)], "name string, position int")
    got = [r.name for r in catalog_order(cat, "UNICODE").collect()]
    assert got == ["first", "apple", "Apple", "\u00e4pple", "banana", "eclair", "\u00c9clair", "zebra", "Zebra", "last"]
    assert [r.name for r in catalog_order(cat).collect()] != got
