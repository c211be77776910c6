"""Streams on out-of-order input: the cooldown stream that holds requests until
the watermark passes them decides exactly as the batch operator."""

import datetime as dt

from pyspark.sql import functions as F

from washbay.operators import codes as CO
from washbay.session import checkpoint_path
from washbay.sources.fixtures import fixture
from washbay.streaming import streams as X


def test_cooldown_stream_with_late_arrivals(spark, sf_dir):
    req = fixture(spark, sf_dir, "code_requests")
    rows = req.orderBy("ts", "seq").collect()
    t0, t1 = rows[0].ts, rows[-1].ts
    width = (t1 - t0) / 4
    chunks = [[] for _ in range(5)]
    for r in rows:
        i = min(3, int((r.ts - t0) / width))
        chunks[i + (1 if r.seq % 5 == 0 else 0)].append(r)      # every fifth request arrives a chunk late
    base = checkpoint_path(spark, "late-arrivals")
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    for i, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, req.schema).write.mode("overwrite").parquet(f"{src}/{i:02d}")
        stream = spark.readStream.schema(req.schema).option("recursiveFileLookup", "true").parquet(src)
        X.run_to_parquet(X.stream_code_cooldown(stream, 43200, lateness="8 days", hold_until_watermark=True), out, ck)
    got = {r.seq: r.accepted for r in spark.read.parquet(out).collect()}
    want = {r.seq: r.accepted for r in CO.code_cooldown(req, 43200).collect()}
    assert got and all(want[s] == a for s, a in got.items())
    final_wm = t1 - dt.timedelta(days=8)
    assert set(got) == {r.seq for r in rows if r.ts <= final_wm}


def test_attendance_stream_with_late_arrivals(spark, sf_dir):
    from washbay.operators import attendance as AT, people as PE
    ok, _ = PE.known_employees(fixture(spark, sf_dir, "attendance_events"), fixture(spark, sf_dir, "users"))
    rows = ok.orderBy("ts", "seq").collect()
    t0, t1 = rows[0].ts, rows[-1].ts
    width = (t1 - t0) / 4
    chunks = [[] for _ in range(5)]
    for r in rows:
        i = min(3, int((r.ts - t0) / width))
        chunks[i + (1 if r.seq % 4 == 0 else 0)].append(r)      # every fourth event arrives a chunk late
    base = checkpoint_path(spark, "late-attendance")
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    for i, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, ok.schema).write.mode("overwrite").parquet(f"{src}/{i:02d}")
        stream = spark.readStream.schema(ok.schema).option("recursiveFileLookup", "true").parquet(src)
        X.run_to_parquet(X.stream_attendance(stream, hold_until_watermark=True, lateness="8 days"), out, ck)
    final_wm = t1 - dt.timedelta(days=8)
    got = {tuple(r) for r in spark.read.parquet(out).select("attendance_id", "check_in", "check_out").collect()}
    want = {tuple(r) for r in AT.pair_attendance(ok).filter(F.col("check_out") <= F.lit(final_wm))
            .select("attendance_id", "check_in", "check_out").collect()}
    assert got == want and got


ATT = "seq long, ts timestamp_ntz, employee_id long, employee_name string, type string"
REQ = "seq long, ts timestamp_ntz, phone string, purpose string"


def at(minute):
    return None if minute is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def drive(spark, name, chunks, schema, build):
    """Feed micro-batches one by one; the rows that came out, and the last query."""
    base = checkpoint_path(spark, name)
    q = None
    for i, chunk in enumerate(chunks):
        spark.createDataFrame(chunk, schema).write.mode("overwrite").parquet(f"{base}/src/{i:02d}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/src")
        q = X.run_to_parquet(build(stream), f"{base}/out", f"{base}/ck")
    return spark.read.parquet(f"{base}/out").collect(), q


def state_rows(q):
    return q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_attendance_null_keys_times_and_empty_state(spark):
    from washbay.operators.attendance import pair_attendance
    chunks = [[(1, at(0), None, "n", "IN"), (2, at(5), 7, "g", "IN"), (3, None, 7, "g", "IN"), (4, None, 7, "g", "OUT"), (5, at(6), 8, "h", "OUT")],
              [(6, at(20), None, "m", "OUT"), (7, at(21), 7, "other", "OUT"), (8, at(22), None, None, "IN"), (9, at(23), 9, None, None)],
              [(10, at(60 * 24 * 30), 8, "h", "OUT")]]
    for hold in (False, True):
        got, q = drive(spark, f"att-null-{hold}", chunks, ATT, lambda s, hold=hold: X.stream_attendance(s, hold, "1 minute"))
        batch = spark.createDataFrame([r for c in chunks for r in c], ATT)
        want = pair_attendance(batch).where("status = 'Completed'").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(got) == 3
        assert state_rows(q) <= (1 if not hold else 5)      # the one open clock-in (held events besides), no state for other keys


def test_cooldown_null_keys_times_and_expiry(spark):
    chunks = [[(1, at(0), "p", None), (2, None, "p", None), (3, at(0.5), "p", None), (4, at(0), None, None)],
              [(5, at(2), "p", None), (6, at(0.25), None, None)],
              [(7, at(60), "z", "u")], [(8, at(120), "z", "u")], [(9, at(180), "z", "u")]]
    got, q = drive(spark, "cool-null", chunks, REQ, lambda s: X.stream_code_cooldown(s, 60, "1 minute"))
    assert {r.seq: r.accepted for r in got} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: True, 9: True}
    assert state_rows(q) <= 4                                # p and NULL have gone; z's time and its timer's rows remain


def test_forgotten_clock_ins_leave_the_state(spark):
    """The TTL runs by processing time, so the query has no end of its own and is stopped."""
    import time
    base = checkpoint_path(spark, "att-ttl")
    spark.createDataFrame([(1, at(0), 1, "a", "IN"), (2, at(0), 2, "b", "IN"), (3, at(1), 2, "b", "OUT")], ATT).write.parquet(f"{base}/src/0")
    stream = spark.readStream.schema(ATT).option("recursiveFileLookup", "true").parquet(f"{base}/src")
    spark.conf.set(X.STATE_STORE, X.ROCKSDB)
    try:
        q = (X.stream_attendance(stream, forget_after_ms=1).writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ck").trigger(processingTime="1 second").start())
        try:
            for i, seen in enumerate((3, 4)):
                if i:
                    spark.createDataFrame([(4, at(9), 1, "a", "OUT")], ATT).write.parquet(f"{base}/src/1")
                end = time.time() + 40
                while time.time() < end and sum(p["numInputRows"] for p in q.recentProgress) < seen:
                    time.sleep(0.2)
                assert sum(p["numInputRows"] for p in q.recentProgress) == seen
        finally:
            q.stop()
    finally:
        spark.conf.unset(X.STATE_STORE)
    assert [r.attendance_id for r in spark.read.parquet(f"{base}/out").collect()] == [2]


def test_replay_delivers_rows_without_a_time(spark):
    rows = [(1, at(0), "p", "u"), (2, None, "q", "u"), (3, at(90), "p", "u")]
    out = X.replay(spark, spark.createDataFrame(rows, REQ), lambda s: X.stream_code_cooldown(s, 60), "null-times")
    assert sorted(r.seq for r in out.collect()) == [1, 2, 3]


def test_cooldown_state_comes_with_the_rows(spark):
    """No message per look at a key's state, and numbers beyond 2^53 stay whole beside missing ones."""
    big = (1 << 53) + 1
    chunks = [[(big, at(0), "p", "u"), (None, at(0.5), "p", "u")], [(big + 2, at(2), "p", "u"), (4, at(90), "q", "u")]]
    for hold in (False, True):
        got, q = drive(spark, f"cool-rows-{hold}", chunks, REQ, lambda s, hold=hold: X.stream_code_cooldown(s, 60, "0 seconds", hold))
        assert {(r.seq, r.ts, r.phone, r.accepted) for r in got} == {
            (big, at(0), "p", True), (None, at(0.5), "p", False), (big + 2, at(2), "p", True), (4, at(90), "q", True)}
        assert "transformWithState" not in q.lastProgress["stateOperators"][0]["operatorName"]
