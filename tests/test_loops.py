"""Loop equivalence: the reference's per-request rules written as plain Python
loops (tests only) versus the set-based operators on random input."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from washbay.operators import catalog as CA
from washbay.operators import codes as CO
from washbay.operators import intake as I
from washbay.operators import packs as PK
from washbay.operators.attendance import pair_attendance
from washbay.plans.keyed import Scan, keyed_scan

T0 = dt.datetime(2024, 1, 1)


def _round_secs(delta: dt.timedelta) -> int:
    us = delta // dt.timedelta(microseconds=1)
    return (abs(us) + 500_000) // 1_000_000 * (1 if us >= 0 else -1)


def loop_cooldown(rows, cooldown):
    last, out = {}, {}
    for seq, ts, key in sorted(rows, key=lambda r: (r[1], r[0])):
        ok = key not in last or _round_secs(ts - last[key]) >= cooldown
        if ok:
            last[key] = ts
        out[seq] = ok
    return out


def test_cooldown_matches_loop_with_a_hot_key(spark):
    rnd = random.Random(7)
    rows, seq = [], 0
    for key, n in [("hot", 3000), ("a", 50), ("b", 50)]:
        t = T0
        for _ in range(n):
            t += dt.timedelta(seconds=rnd.choice([1, 5, 30, 59.4, 59.5, 61, 400]))
            seq += 1
            rows.append((seq, t, key))
    df = spark.createDataFrame([(s, t, k, "p") for s, t, k in rows], "seq long, ts timestamp_ntz, phone string, purpose string")
    want = loop_cooldown(rows, 60)
    got = {r.seq: r.accepted for r in CO.code_cooldown(df, 60).collect()}
    assert got == want
    # the same input with "hot" above the threshold takes the parallel doubling path
    got_hot = {r.seq: r.accepted for r in CO.code_cooldown(df, 60, hot_key_rows=1000).collect()}
    assert got_hot == want


def test_cooldown_doubling_on_dense_burst(spark):
    rnd = random.Random(13)
    rows, t = [], T0
    for seq in range(1, 2001):                      # no quiet gap at all: one long chain
        t += dt.timedelta(seconds=rnd.choice([0, 0.5, 1, 7, 20.25, 29.75, 30]))
        rows.append((seq, t, "hot"))
    df = spark.createDataFrame([(s, ts, k, "p") for s, ts, k in rows], "seq long, ts timestamp_ntz, phone string, purpose string")
    got = {r.seq: r.accepted for r in CO.code_cooldown(df, 60, hot_key_rows=10).collect()}
    assert got == loop_cooldown(rows, 60)


@pytest.mark.parametrize("hot_rows", [1, None])
def test_keyed_scan_equals_window_on_skewed_key(spark, hot_rows):
    rnd = random.Random(3)
    rows = [(i, T0 + dt.timedelta(minutes=rnd.randint(0, 10_000)), "hot" if i % 3 else f"k{i % 7}",
             rnd.choice([None, 1, 2])) for i in range(4000)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, k string, v int")
    got = keyed_scan(df, ["k"], ["ts", "seq"], [Scan("s", "sum", F.coalesce("v", F.lit(0)).cast("bigint"), False),
                                                 Scan("mx", "max", F.col("v")),
                                                 Scan("lastv", "last", F.col("v"), False),
                                                 Scan("nextv", "next", F.col("v"), False)], partitions=16, hot_rows=hot_rows)
    pdf = pd.DataFrame(rows, columns=["seq", "ts", "k", "v"]).sort_values(["k", "ts", "seq"])
    exp = {}
    for k, g in pdf.groupby("k"):
        vals = list(g.v)
        for i, s in enumerate(g.seq):
            prev = [x for x in vals[:i] if x is not None and x == x]
            after = [x for x in vals[i + 1:] if x is not None and x == x]
            upto = [x for x in vals[:i + 1] if x is not None and x == x]
            exp[s] = (sum(prev), max(upto) if upto else None, prev[-1] if prev else None, after[0] if after else None)
    res = {r.seq: (r.s, r.mx, r.lastv, r.nextv) for r in got.collect()}
    assert res == {s: tuple(None if (x is not None and x != x) else (int(x) if x is not None else None) for x in e)
                   for s, e in exp.items()}


def test_attendance_matches_loop(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(600):
        rows.append((i, T0 + dt.timedelta(minutes=i * 7 + rnd.randint(0, 5)), rnd.choice([1, 1, 1, 2, 3]),
                     rnd.choice(["IN", "IN", "OUT"])))
    df = spark.createDataFrame([(s, t, e, f"e{e}", ty) for s, t, e, ty in rows],
                               "seq long, ts timestamp_ntz, employee_id long, employee_name string, type string")
    exp, open_rows = {}, {}
    for s, t, e, ty in sorted(rows, key=lambda r: (r[1], r[0])):
        if ty == "IN":
            exp[s] = None
            open_rows.setdefault(e, []).append(s)
        else:
            for o in open_rows.pop(e, []):
                exp[o] = t
    got = {r.attendance_id: r.check_out for r in pair_attendance(df).collect()}
    assert got == exp


def test_ledger_matches_loop(spark):
    rnd = random.Random(5)
    bal = {m: rnd.randint(0, 4) for m in range(1, 30)}
    uses = [(i, T0 + dt.timedelta(hours=i), rnd.randint(1, 35)) for i in range(400)]
    left, exp = dict(bal), {}
    for s, _, m in uses:
        ok = left.get(m, 0) > 0
        if ok:
            left[m] -= 1
        exp[s] = (ok, left.get(m, 0))
    mem = spark.createDataFrame(list(bal.items()), "id long, remaining_washes int")
    w = spark.createDataFrame(uses, "seq long, ts timestamp_ntz, membership_id long")
    got = {r.seq: (r.accepted, r.balance_after) for r in PK.wash_ledger(mem, w).collect()}
    assert got == exp


def test_renumber_matches_sort(spark):
    rnd = random.Random(2)
    rows = [(f"s{i:04d}", rnd.choice([None, 1, 2, 3, 5, 8])) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, position int")
    got = {r.name: r.position for r in CA.renumber(df).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert got == {n: i + 1 for i, (n, _) in enumerate(order)}


def test_next_free_ids_match_loop(spark):
    rnd = random.Random(9)
    ids = sorted(set(rnd.randint(-3, 60) for _ in range(40)))
    taken, free, x = set(ids), [], 1
    while len(free) < 7:
        if x not in taken:
            free.append(x)
        x += 1
    df = spark.createDataFrame([(i,) for i in ids], "order_id long")
    assert sorted(r.id for r in I.next_free_ids(df, 7).collect()) == free


def loop_outcomes(codes, verifications, max_attempts=5):
    """The reference's verify handler, one request at a time (newest code of the
    key at that moment; consumed / expired / attempts / hash check)."""
    state = {c[0]: {"attempts": 0, "consumed": False} for c in codes}
    out = {}
    for seq, ts, key, matches in sorted(verifications, key=lambda v: (v[1], v[0])):
        live = [c for c in codes if c[1] == key and c[2] <= ts]
        if not live:
            out[seq] = "not found"
            continue
        cid, _, created, expires = max(live, key=lambda c: (c[2], c[0]))
        st = state[cid]
        if st["consumed"]:
            out[seq] = "already used"
        elif ts > expires:
            out[seq] = "expired"
        elif st["attempts"] >= max_attempts:
            out[seq] = "too many attempts"
        elif not matches:
            st["attempts"] += 1
            out[seq] = "invalid"
        else:
            st["consumed"] = True
            out[seq] = "ok"
    return out


def test_code_outcomes_match_loop(spark):
    rnd = random.Random(21)
    codes, vers = [], []
    for k in range(6):
        t = T0
        for c in range(4):
            t += dt.timedelta(minutes=rnd.choice([1, 3, 10]))
            codes.append((k * 100 + c, f"k{k}", t, t + dt.timedelta(minutes=5)))
    for seq in range(500):
        vers.append((1000 + seq, T0 + dt.timedelta(seconds=rnd.randint(-60, 2500)), f"k{rnd.randint(0, 6)}",
                     rnd.random() < 0.15))
    cdf = spark.createDataFrame([(c, k, "p", a, b) for c, k, a, b in codes],
                                "code_id long, phone string, purpose string, created_at timestamp_ntz, expires_at timestamp_ntz")
    vdf = spark.createDataFrame([(s, t, k, "p", m) for s, t, k, m in vers],
                                "seq long, ts timestamp_ntz, phone string, purpose string, matches boolean")
    got = {r.seq: r.outcome for r in CO.code_outcomes(vdf, cdf).collect()}
    assert got == loop_outcomes(codes, vers)


def list_sorted(rows):
    return sorted(rows, key=lambda r: (r["position"] is None, r["position"] or 0, r["name"]))


def normalise(rows, now):
    """The one-by-one renumbering: dense positions in list order, moved rows stamped."""
    for k, r in enumerate(list_sorted(rows), 1):
        if r["position"] != k:
            r.update(position=k, updated_at=now)


@pytest.mark.parametrize("seed", [1, 2])
def test_moves_match_loop(spark, seed):
    rnd = random.Random(seed)
    names = [f"s{i:03d}" for i in range(120)]
    rows = [{"name": n, "position": rnd.choice([None, -3, 0, 5, rnd.randint(1, 200)]), "updated_at": None} for n in names]
    cat = spark.createDataFrame([(r["name"], r["position"], None) for r in rows], "name string, position int, updated_at timestamp_ntz")
    few = rnd.sample(names, 12)
    moves = [(q, rnd.choice([*few, *few, *few, rnd.choice(names), "zz", " "]), rnd.choice(["up", "down", "up", "down", "left", None]))
             for q in range(80)]
    normalise(rows, T0)
    order, rejected = [r["name"] for r in list_sorted(rows)], {}
    for q, name, way in moves:
        if not name.strip():
            rejected[q] = "missing service name"
        elif way not in ("up", "down"):
            rejected[q] = "invalid direction"
        elif name not in order:
            rejected[q] = "service not found"
        else:
            i = order.index(name)
            j = i - 1 if way == "up" else i + 1
            if 0 <= j < len(order):
                order[i], order[j] = order[j], order[i]
    out, rej = CA.move_items(cat, spark.createDataFrame(moves, "seq long, name string, direction string"), T0)
    got = {r.name: (r.position, r.updated_at) for r in out.collect()}
    stamps = {r["name"]: r["updated_at"] for r in rows}
    assert got == {n: (k + 1, stamps[n]) for k, n in enumerate(order)}
    assert {r.seq: r.reject_reason for r in rej.collect()} == rejected


@pytest.mark.parametrize("seed,names,requests", [(3, 14, 57), (4, 200, 90), (5, 60, 25), (6, 14, 57)])
def test_renames_and_upserts_match_loop(spark, seed, names, requests):
    rnd = random.Random(seed)
    now = T0 + dt.timedelta(days=9)
    pool = [f"n{i:02d}" for i in range(names)]
    rows = [{"name": n, "position": rnd.choice([None, None, 0, -2, rnd.randint(1, 30)]), "bike": 1, "updated_at": T0} for n in rnd.sample(pool, names * 2 // 3)]
    cat = spark.createDataFrame([(r["name"], 1, None, None, r["position"], True, "", T0) for r in rows],
                                "name string, bike int, sedan int, suv int, position int, visible boolean, description string, "
                                "updated_at timestamp_ntz")
    batch = [(q, rnd.choice([None, *pool]), rnd.choice([*pool, *pool, " "]), rnd.randint(10, 99)) for q in range(3, 3 + requests)]
    rejected, state = {}, rows
    for q, old, name, bike in batch:
        name = name.strip()
        if not name:
            rejected[q] = "missing service name"
            continue
        by = {r["name"]: r for r in state}
        old = old or name
        if old != name and old in by:
            if name in by:
                rejected[q] = "name already in use"
                continue
            by[old].update(name=name, bike=bike, updated_at=now)
        elif name in by:
            by[name].update(bike=bike, updated_at=now)
        else:
            state.append({"name": name, "position": None, "bike": bike, "updated_at": now})
        normalise(state, now)
    frame = spark.createDataFrame([(q, o, n, str(b)) for q, o, n, b in batch], "seq long, original_name string, name string, bike string")
    out, rej = CA.rename_items(cat, frame, now)
    assert {r.name: (r.bike, r.position, r.updated_at) for r in out.collect()} == \
        {r["name"]: (r["bike"], r["position"], r["updated_at"]) for r in state}
    assert {r.seq: r.reject_reason for r in rej.collect()} == rejected


def test_upserts_of_an_unplaced_list_match_loop(spark):
    now = T0 + dt.timedelta(days=9)
    rows = [{"name": n, "position": p, "bike": 1, "updated_at": None} for n, p in [("m", None), ("z", 0), ("b", 2), ("q", -4)]]
    cat = spark.createDataFrame([(r["name"], 1, None, None, r["position"], True, "", None) for r in rows],
                                "name string, bike int, sedan int, suv int, position int, visible boolean, description string, "
                                "updated_at timestamp_ntz")
    batch = [(1, "a", "5"), (2, "z", "6"), (3, "0new", "7"), (4, "a", "8")]
    for _, name, bike in batch:
        hit = next((r for r in rows if r["name"] == name), None)
        if hit is None:
            rows.append(hit := {"name": name, "position": None})
        hit.update(bike=int(bike), updated_at=now)
        normalise(rows, now)
    out, _ = CA.upsert_catalog(cat, spark.createDataFrame(batch, "seq long, name string, bike string"), now)
    assert {r.name: (r.bike, r.position, r.updated_at) for r in out.collect()} == \
        {r["name"]: (r["bike"], r["position"], r["updated_at"]) for r in rows}
    assert [r.name for r in out.orderBy("position").collect()] == ["q", "z", "b", "a", "m", "0new"]


def test_one_key_of_many_events_is_linear(spark):
    n = 200_000
    ev = spark.range(n).select(F.col("id").alias("seq"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"),
                               F.lit(1).cast("bigint").alias("employee_id"), F.lit("e").alias("employee_name"),
                               F.when(F.col("id") % 3 == 2, "OUT").otherwise("IN").alias("type"))
    t = time.monotonic()
    r = pair_attendance(ev).agg(F.count(F.lit(1)).alias("n"), F.count("check_out").alias("closed")).first()
    assert r.n == n - n // 3 and r.closed >= r.n - 2
    assert time.monotonic() - t < 60


def test_cooldown_with_a_seq_per_key_is_the_same_on_both_paths(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(3):
        t = T0
        for seq in range(1, 41):
            t += dt.timedelta(seconds=rnd.choice([0, 5, 20, 59.4, 59.5, 70, 200]))
            rows.append((seq, t, f"k{k}", "p"))
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, phone string, purpose string")
    want = {(k, q): a for k in range(3) for q, a in loop_cooldown([(q, t, p) for q, t, p, _ in rows if p == f"k{k}"], 60).items()}
    for limit in (5, 1000):
        got = {(int(r.phone[1:]), r.seq): r.accepted for r in CO.code_cooldown(df, 60, hot_key_rows=limit).collect()}
        assert got == want


def test_many_next_free_ids_match_loop(spark):
    rnd = random.Random(17)
    ids = sorted(set(rnd.randint(-3, 3000) for _ in range(2000)))
    taken, free, x = set(ids), [], 1
    while len(free) < 2500:
        if x not in taken:
            free.append(x)
        x += 1
    df = spark.createDataFrame([(i,) for i in ids], "order_id long")
    got = sorted(r.id for r in I.next_free_ids(df, 2500, chunk=97).collect())
    assert got == free
    assert sorted(r.id for r in I.next_free_ids(spark.createDataFrame([], "order_id long"), 5).collect()) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("seed", [1, 2])
def test_free_ids_around_block_borders(spark, seed):
    """Full, nearly full, sparse and missing blocks of 65,536 ids, repeated ids, NULLs and ids below 1."""
    rnd = random.Random(seed)
    block = I.ID_BLOCK
    ids = {*range(1, block + 50), *range(2 * block - 3, 2 * block + 3), *(3 * block + rnd.randrange(block) for _ in range(6000)), 5 * block, 9 * block - 1}
    ids -= {17, block - 1, block, block + 1}
    rows = [(i,) for i in [*ids, *list(ids)[:500], 0, -5, None]]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "order_id long").repartition(5)
    for k in (1, 5, block + 10, 3 * block):
        free, x = [], 1
        while len(free) < k:
            if x not in ids:
                free.append(x)
            x += 1
        assert sorted(r.id for r in I.next_free_ids(df, k, chunk=30_000).collect()) == free
    packed = {r.block: r.taken for r in I.id_blocks(df).select("block", "taken").collect()}
    assert packed == {b: sum(1 for i in ids if i >> 16 == b) for b in {i >> 16 for i in ids}}


@pytest.mark.parametrize("hot_rows", [1, None])
def test_keyed_scan_null_key_spanning_partitions(spark, hot_rows):
    rows = [(i, T0 + dt.timedelta(minutes=i), None if i % 4 else "a", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, k string, v int")
    got = keyed_scan(df, ["k"], ["ts", "seq"], [Scan("n", "sum", F.col("v").cast("bigint"))], partitions=12, hot_rows=hot_rows)
    counts = {}
    exp = {}
    for s, _, k, _v in rows:
        counts[k] = counts.get(k, 0) + 1
        exp[s] = counts[k]
    assert {r.seq: r.n for r in got.collect()} == exp


def test_upserts_match_one_by_one_application(spark):
    from washbay.operators import changes as CH  # noqa: F401
    rnd = random.Random(31)
    cat = {f"svc{i:02d}": {"bike": i, "position": i + 1} for i in range(8)}          # a normalised catalogue
    batch = []
    for seq in range(60):
        name = rnd.choice(list(cat) + [f"new{j}" for j in range(6)] + [" "])
        batch.append((seq, name, str(rnd.randint(1, 500))))
    # one request at a time: overwrite fields, new names are renumbered to the tail
    state = {n: dict(v) for n, v in cat.items()}
    for seq, name, bike in batch:
        name = name.strip()
        if not name:
            continue
        if name in state:
            state[name]["bike"] = int(bike)
        else:
            state[name] = {"bike": int(bike), "position": max(v["position"] for v in state.values()) + 1}
    cdf = spark.createDataFrame([(n, v["bike"], None, None, v["position"], True, "") for n, v in cat.items()],
                                "name string, bike int, sedan int, suv int, position int, visible boolean, description string")
    bdf = spark.createDataFrame(batch, "seq long, name string, bike string")
    out, _ = CA.upsert_catalog(cdf, bdf, "2024-01-01 00:00:00")
    assert {r.name: (r.bike, r.position) for r in out.collect()} == {n: (v["bike"], v["position"]) for n, v in state.items()}


def test_patches_match_one_by_one_application(spark):
    from washbay.operators import changes as CH
    rnd = random.Random(41)
    base = {i: {"color": f"c{i}", "tag": f"t{i}"} for i in range(10)}
    patches = [(s, rnd.randint(0, 12), rnd.choice([None, f"x{s}"]), rnd.choice([None, f"y{s}"])) for s in range(80)]
    state = {k: dict(v) for k, v in base.items()}
    for _, k, color, tag in patches:
        if k in state:
            state[k]["color"] = color if color is not None else state[k]["color"]
            state[k]["tag"] = tag if tag is not None else state[k]["tag"]
    bdf = spark.createDataFrame([(k, v["color"], v["tag"]) for k, v in base.items()], "id long, color string, tag string")
    pdf = spark.createDataFrame(patches, "seq long, id long, color string, tag string")
    out, missing = CH.patch_rows(bdf, pdf)
    assert {r.id: {"color": r.color, "tag": r.tag} for r in out.collect()} == state
    assert {r.id for r in missing.collect()} == {k for _, k, _, _ in patches if k not in base}


def test_cooldown_replay_across_tiny_arrow_batches(spark):
    rnd = random.Random(23)
    rows, seq = [], 0
    for key in ["a", "b", None, "c"]:
        t = T0
        for _ in range(rnd.randint(1, 40)):
            t += dt.timedelta(seconds=rnd.choice([0, 1, 20, 59.4, 59.5, 61, 300]))
            seq += 1
            rows.append((seq, t, key))
    df = spark.createDataFrame([(s, t, k, "p") for s, t, k in rows], "seq long, ts timestamp_ntz, phone string, purpose string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {r.seq: r.accepted for r in CO.code_cooldown(df, 60).collect()}
            assert got == loop_cooldown(rows, 60), size
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def ref_offers(rows, vehicle):
    """The booking page's rule: list order (position, missing = 1e9; then name), offers
    with a name and a price; a Bike gets the first 'basic' offer, else the cheapest."""
    key = "bike" if vehicle == "Bike" else "suv" if vehicle == "SUV" else "sedan"
    lst = sorted(rows, key=lambda r: (r["position"] if r["position"] is not None else 1e9, r["name"]))
    offers = [r for r in lst if r["name"] and r[key] is not None]
    if vehicle != "Bike":
        return [(r["name"], r[key]) for r in offers]
    basic = [r for r in offers if "basic" in r["name"].lower()]
    if basic:
        return [(basic[0]["name"], basic[0][key])]
    return [(r["name"], r[key]) for r in sorted(offers, key=lambda r: r[key])[:1]]


def test_offers_match_the_page_rule(spark):
    rnd = random.Random(8)
    for trial in range(4):
        rows = [{"name": rnd.choice(["Wash", "Basic wash", "BASIC+", "Foam", "Polish", "Detail"]) + f" {i}",
                 "bike": rnd.choice([None, 50, 80, 120]), "sedan": rnd.choice([None, 150, 200]),
                 "suv": rnd.choice([None, 200, 250]), "position": rnd.choice([None, 1, 2, 3, 4, 5])}
                for i in range(rnd.randint(3, 25))]
        if trial == 3:
            rows = [r for r in rows if "asic" not in r["name"].lower()] or rows
        df = spark.createDataFrame([(r["name"], r["bike"], r["sedan"], r["suv"], r["position"], "") for r in rows],
                                   "name string, bike int, sedan int, suv int, position int, description string")
        for v in ("Bike", "SUV", "Hatch/Sedan"):
            got = [(r.name, r.price) for r in CA.offers_for(df, v).collect()]
            assert got == ref_offers(rows, v), (trial, v)


def test_status_edit_and_delete_batches_match_one_by_one(spark):
    from washbay.operators import changes as CH
    rnd = random.Random(12)
    bk = {i: {"status": "New", "price": 100 + i, "service": "Basic"} for i in range(20)}
    events = [(s, rnd.randint(0, 24), rnd.choice(["cancel", "complete", "edit", "bogus"]),
               rnd.randint(1, 999), rnd.choice([None, "Premium", "Detailing"])) for s in range(120)]
    state = {k: dict(v) for k, v in bk.items()}
    for _, k, action, price, service in events:
        if k not in state:
            continue
        if action == "cancel":
            state[k]["status"] = "Cancelled"
        elif action == "complete":
            state[k]["status"] = "Completed"
        elif action == "edit":
            state[k]["price"], state[k]["service"] = price, service
    bdf = spark.createDataFrame([(k, v["status"], v["price"], v["service"]) for k, v in bk.items()],
                                "order_id long, status string, price int, service string")
    edf = spark.createDataFrame(events, "seq long, order_id long, action string, price int, service string")
    after, rejected = CH.set_status(bdf, edf)
    after = CH.edit_bookings(after, edf)
    assert {r.order_id: {"status": r.status, "price": r.price, "service": r.service} for r in after.collect()} == state
    assert rejected.count() == sum(1 for e in events if e[2] == "bogus")
    gone = [k for k in range(0, 30, 3)]
    rest, missing = CH.delete_rows(bdf, spark.createDataFrame([(k,) for k in gone], "order_id long"), "order_id")
    assert {r.order_id for r in rest.collect()} == set(bk) - set(gone)
    assert {r.order_id for r in missing.collect()} == set(gone) - set(bk)


def test_sketch_finds_every_heavy_key(spark):
    """Keys at and above a piece's share are found among many small ones, also a NULL key."""
    from washbay.plans.keyed import heavy_keys
    key = (F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 < 4, F.lit(-1))
            .when(F.col("id") % 100 == 4, F.lit(-2)).otherwise(F.col("id")))
    df = spark.range(0, 200_000, 1, 7).select(key.alias("k"), F.lit("p").alias("q"))
    share = df.groupBy(F.xxhash64("k", "q").alias("h")).count().collect()
    want = {r["h"] for r in share if r["count"] >= 200_000 / 100}
    assert len(want) == 3
    found = heavy_keys(df, ["k", "q"], pieces=100, hot_rows=1)
    assert want <= set(found) and len(found) <= 200
    assert heavy_keys(df, ["k", "q"], pieces=100, hot_rows=100_000) == []
    assert heavy_keys(df.limit(0), ["k", "q"], pieces=100, hot_rows=1) == []


@pytest.mark.parametrize("name", ["w7_pair_attendance", "w8_wash_ledger", "w10_code_cooldown", "w11_code_outcomes", "j8_code_as_of", "a14_owner_report_team"])
def test_cut_heavy_keys_give_the_same_results(spark, sf_dir, name, monkeypatch):
    """Every key that holds a piece's share is cut; the results equal the oracle's."""
    import __spark_entry__ as E
    from oracle import compare, duck_connect
    from washbay.plans import keyed
    names = [n for n in E.queries() if n.startswith(name)] or [n for n in E.queries() if n.startswith(name.rsplit("_", 1)[0])]
    monkeypatch.setattr(keyed, "HOT_ROWS", 1)
    for n in names[:2]:
        r = compare(spark, duck_connect(sf_dir), n, E.queries()[n], E.oracle_sql()[n], sf_dir)
        assert r["status"] == "ok", r


def test_many_moves_are_clustered_in_many_tasks(spark):
    """100,000 moves over 120,000 items: the clusters come out of several tasks (no single
    partition holds the moved items), and the list equals the moves applied one by one."""
    n = 120_000
    cat = spark.range(n).select(F.format_string("i%06d", "id").alias("name"), (F.col("id") + 1).cast("int").alias("position"))
    rnd = random.Random(12)
    picked = rnd.sample(range(n), 30_000)
    moves = [(q, f"i{(picked[q % 30_000] if q % 3 else picked[q % 50]):06d}", rnd.choice(["up", "down"])) for q in range(100_000)]
    order = [f"i{i:06d}" for i in range(n)]
    at = {x: i for i, x in enumerate(order)}
    for _, name, way in moves:
        i = at[name]
        j = i - 1 if way == "up" else i + 1
        if 0 <= j < n:
            order[i], order[j] = order[j], order[i]
            at[order[i]], at[order[j]] = i, j
    df = spark.createDataFrame(moves, "seq long, name string, direction string").repartition(4)
    out, rej = CA.move_items(cat, df)
    assert dict(out.select("name", "position").collect()) == {x: k + 1 for k, x in enumerate(order)} and rej.count() == 0
    from washbay.plans.staging import staged
    items = staged(df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(cat, "name")
                   .select("name", F.col("position").cast("bigint").alias("at"), "n"), "items")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = CA.move_clusters(items).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and sum(t["count"] for t in tasks) == items.count()


def test_a_long_chain_of_renames_is_no_group(spark, monkeypatch):
    """100,000 renames of one row after another: nothing is replayed as a group."""
    n = 100_000
    cat = spark.createDataFrame([("c0", 1, 1), ("other", 2, 2), ("x0", 3, 3), ("x1", 4, 4)], "name string, bike int, position int") \
        .selectExpr("name", "bike", "cast(null as int) sedan", "cast(null as int) suv", "position", "true visible", "'' description",
                    "cast(null as timestamp_ntz) updated_at")
    chain = spark.range(n).selectExpr("id + 1 AS seq", "concat('c', id) AS original_name", "concat('c', id + 1) AS name", "cast(id % 50 as string) AS bike")
    more = spark.createDataFrame([(n + 5, "x0", "x1", "7"), (n + 6, "gone", "new", "8"), (n + 7, "new", "newer", "9")],
                                 "seq long, original_name string, name string, bike string")
    sizes = []
    real = CA.settled_renames
    monkeypatch.setattr(CA, "settled_renames", lambda old, req: (lambda out: (sizes.append(req.join(out[1], "root").count()), out)[1])(real(old, req)))
    out, rej = CA.rename_items(cat, chain.unionByName(more), T0)
    assert sorted((r.name, r.bike, r.position) for r in out.collect()) == [
        (f"c{n}", (n - 1) % 50, 1), ("newer", 9, 5), ("other", 2, 2), ("x0", 3, 3), ("x1", 4, 4)]
    assert [(r.seq, r.reject_reason) for r in rej.collect()] == [(n + 5, "name already in use")]
    assert sizes == [1]                                     # only the refused request's component is replayed
