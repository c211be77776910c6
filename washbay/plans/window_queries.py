"""Registered queries for ordered/windowed operators (W1–W12, J8, A11, A12, A14 owner)
with DuckDB oracles (window functions, ASOF JOIN, a recursive CTE for W10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from washbay.operators import attendance as AT
from washbay.operators import catalog as CA
from washbay.operators import codes as CO
from washbay.operators import packs as PK
from washbay.operators import people as PE
from washbay.operators import reports as R
from washbay.plans import reports as P
from washbay.plans.keyed import keyed_row_number
from washbay.plans.registry import in_place, register, sql_with
from washbay.sources.fixtures import fixture

EVENTS_AS_OF = "2024-01-30"
NOW = "2024-01-30 12:00:00"
CAT_RANKED = f"""SELECT * REPLACE (CASE WHEN position IS DISTINCT FROM rn THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at)
FROM (SELECT *, CAST(row_number() OVER (ORDER BY position ASC NULLS LAST, name) AS INTEGER) AS rn FROM catalog_edited) x"""


def _edited(spark, sf):
    return fixture(spark, sf, "catalog_edited")


# ---- catalogue ---------------------------------------------------------------
@register("w1_renumber", sql_with(["catalog_edited"], """
SELECT name, bike, sedan, suv, rn AS position, visible, description, updated_at, position IS DISTINCT FROM rn AS changed FROM ranked""",
                                  ranked=CAT_RANKED))
def w1(spark, sf):
    return CA.renumber(_edited(spark, sf), NOW)


# (seq, place of the item before the batch or 0 for an unknown name, direction)
MOVES = [(1, 10, "up"), (2, 20, "down"), (0, 30, "left"), (3, 0, "up"), (4, 10, "up"), (5, 9, "down"), (6, 1, "up"), (7, 1, "down"),
         (8, 20, "down"), (9, 22, "up"), (10, 40, None), (11, 8, "down"), (12, 60, "up")]


def _moves(spark, sf):
    m = spark.createDataFrame(MOVES, "seq int, at int, direction string")
    ranked = CA.renumber(_edited(spark, sf), NOW).select(F.col("position").alias("at"), "name")
    return m.join(ranked, "at", "left").select("seq", F.coalesce("name", F.lit("no such service")).alias("name"), "direction")


MOVES_SQL = """
SELECT m.seq, COALESCE(r.name, 'no such service') AS name, m.direction
FROM (VALUES """ + ", ".join(f"({q}, {at}, {repr(d) if d else 'NULL'})" for q, at, d in MOVES) + """) m(seq, spot, direction)
LEFT JOIN ranked r ON r.rn = m.spot"""
MOVES_CTES = {
    "ranked": CAT_RANKED,
    "moves": MOVES_SQL,
    "steps": """SELECT row_number() OVER (ORDER BY seq) AS k, name, CASE direction WHEN 'up' THEN -1 ELSE 1 END AS d
FROM moves WHERE direction IN ('up', 'down') AND name IN (SELECT name FROM ranked)""",
    "lists(k, l)": """
SELECT CAST(0 AS BIGINT), (SELECT list(name ORDER BY rn) FROM ranked)
UNION ALL
SELECT s.k, CASE WHEN p + d < 1 OR p + d > len(l) THEN l ELSE list_concat(list_concat(l[1:least(p, p + d) - 1],
   [l[greatest(p, p + d)], l[least(p, p + d)]]), l[greatest(p, p + d) + 1:]) END
FROM (SELECT s.k, s.d, t.l, list_position(t.l, s.name) AS p FROM lists t JOIN steps s ON s.k = t.k + 1) s""",
    "final": "SELECT unnest(l) AS name, generate_subscripts(l, 1) AS place FROM lists WHERE k = (SELECT max(k) FROM lists)",
}


@register("w3_move_items", sql_with(["catalog_edited"], """
SELECT r.name, bike, sedan, suv, CAST(f.place AS INTEGER) AS position, visible, description, updated_at
FROM ranked r JOIN final f USING (name)""", recursive=True, **MOVES_CTES))
def w3(spark, sf):
    return CA.move_items(_edited(spark, sf), _moves(spark, sf), NOW)[0]


@register("w3_rejected_moves", sql_with(["catalog_edited"], """
SELECT seq, name, direction, CASE WHEN direction IN ('up', 'down') THEN 'service not found' ELSE 'invalid direction' END AS reject_reason
FROM moves WHERE direction IS NULL OR direction NOT IN ('up', 'down') OR name NOT IN (SELECT name FROM ranked)""",
                                        ranked=CAT_RANKED, moves=MOVES_SQL))
def w3b(spark, sf):
    return CA.move_items(_edited(spark, sf), _moves(spark, sf), NOW)[1]


@register("w4_append_at_tail", sql_with(["catalog_edited"], f"""
SELECT name, bike, sedan, suv, rn AS position, visible, description, CASE WHEN position IS DISTINCT FROM rn THEN TIMESTAMP '{NOW}'
 ELSE updated_at END AS updated_at, position IS DISTINCT FROM rn AS changed FROM (
 SELECT *, CAST(row_number() OVER (ORDER BY late, position ASC NULLS LAST, name) AS INTEGER) AS rn
 FROM (SELECT *, false AS late FROM catalog_edited UNION ALL
       SELECT n, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), true, '',
        TIMESTAMP '{NOW}', n > min(n) OVER ()
       FROM (SELECT DISTINCT concat(p_brand, ' pack') AS n FROM part) x
       WHERE NOT EXISTS (SELECT 1 FROM catalog_edited c WHERE c.name = x.n)) u) r"""))
def w4(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    new = part.select(F.concat("p_brand", F.lit(" pack")).alias("name")).distinct().select(
        "name", *[F.lit(None).cast("int").alias(c) for c in ("bike", "sedan", "suv")],
        F.lit(True).alias("visible"), F.lit("").alias("description"))
    return CA.append_at_tail(_edited(spark, sf), new, NOW)


OFFERS_SQL = """SELECT name, CASE WHEN regexp_matches(CAST({col} AS VARCHAR), '[0-9]')
 THEN TRY_CAST(regexp_extract(CAST({col} AS VARCHAR), '([0-9]+)', 1) AS INTEGER) END AS price,
 COALESCE(description, '') AS description, COALESCE(position, 1000000000) AS pos FROM {cat}"""
BASIC_CAT = "SELECT * REPLACE (regexp_replace(name, 'bolt', 'BASIC bolt') AS name) FROM catalog"


def _bike_sql(cat):
    return f"""SELECT name, price, description FROM o WHERE COALESCE(name, '') <> '' AND price IS NOT NULL
ORDER BY CASE WHEN lower(name) LIKE '%basic%' THEN 0 ELSE 1 END,
 CASE WHEN lower(name) LIKE '%basic%' THEN pos ELSE price END, pos, name LIMIT 1"""


@register("w6_bike_offer", sql_with(["catalog"], _bike_sql("catalog"), o=OFFERS_SQL.format(col="bike", cat="catalog")))
def w6(spark, sf):
    return CA.offers_for(fixture(spark, sf, "catalog"), "Bike")


@register("w6_bike_offer_basic", sql_with(["catalog"], _bike_sql("bc"), bc=BASIC_CAT,
                                          o=OFFERS_SQL.format(col="bike", cat="bc")))
def w6b(spark, sf):
    cat = fixture(spark, sf, "catalog").withColumn("name", F.regexp_replace("name", "bolt", "BASIC bolt"))
    return CA.offers_for(cat, "Bike")


@register("w6_suv_offers", sql_with(["catalog"], """
SELECT name, price, description, row_number() OVER (ORDER BY pos, name) - 1 AS place FROM o
WHERE COALESCE(name, '') <> '' AND price IS NOT NULL""", o=OFFERS_SQL.format(col="suv", cat="catalog")))
def w6c(spark, sf):
    return in_place(CA.offers_for(fixture(spark, sf, "catalog"), "SUV"))


# ---- attendance --------------------------------------------------------------
STAFF = """SELECT username, min(id) AS employee_id, arg_min(name, id) AS employee_name
 FROM users WHERE role = 'employee' AND username IS NOT NULL GROUP BY username"""
ATT_SQL = """
SELECT seq AS attendance_id, employee_id, employee_name, ts AS check_in, nxt AS check_out,
 CASE WHEN nxt IS NULL THEN 'Present' ELSE 'Completed' END AS status, ts AS created_at
FROM (SELECT *, first_value(CASE WHEN type = 'OUT' THEN ts END IGNORE NULLS) OVER (
        PARTITION BY employee_id ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
      FROM (SELECT e.*, s.employee_id, s.employee_name FROM attendance_events e JOIN staff s USING (username)) ev) x
WHERE type = 'IN'"""


def attendance(spark, sf):
    ok, _ = PE.known_employees(fixture(spark, sf, "attendance_events"), fixture(spark, sf, "users"))
    return AT.pair_attendance(ok)


def _att_sql(body, fixtures=("attendance_events", "users"), **extra):
    return sql_with(list(fixtures), body, staff=STAFF, att=ATT_SQL, **extra)


@register("w7_pair_attendance", _att_sql("SELECT * FROM att"))
def w7(spark, sf):
    return attendance(spark, sf)


@register("w7_rejected_events", sql_with(["attendance_events"], """
SELECT *, 'invalid type' AS reject_reason FROM attendance_events WHERE type IS NULL OR type NOT IN ('IN', 'OUT')"""))
def w7b(spark, sf):
    return AT.clock_events(fixture(spark, sf, "attendance_events"))[1]


@register("w7_clock_counts", sql_with(["attendance_events"], """
SELECT count(*) AS events, count(*) FILTER (WHERE type IN ('IN', 'OUT')) AS valid FROM attendance_events"""))
def w7c(spark, sf):
    ev = fixture(spark, sf, "attendance_events")
    ok, bad = AT.clock_events(ev)
    n = lambda df: df.agg(F.count(F.lit(1)))
    return n(ok.select("seq").unionByName(bad.select("seq"))).select(F.col("count(1)").alias("events"), n(ok).scalar().alias("valid"))


@register("a12_attendance_ranking", _att_sql("""
SELECT employee_name, COUNT(*) AS days_present FROM att GROUP BY employee_name
ORDER BY days_present DESC, employee_name ASC NULLS LAST LIMIT 5"""))
def a12(spark, sf):
    return R.attendance_ranking(attendance(spark, sf))


def _kpi_sql(day):
    return _att_sql(f"""
SELECT (SELECT COUNT(*) FROM bookings WHERE CAST(created_at AS DATE) = DATE '{day}') AS bookings_today,
 (SELECT CAST(COALESCE(SUM(price), 0) AS BIGINT) FROM bookings WHERE CAST(created_at AS DATE) = DATE '{day}') AS revenue_today,
 (SELECT COUNT(DISTINCT employee_id) FROM att WHERE CAST(created_at AS DATE) = DATE '{day}') AS staff_present""",
                    fixtures=("attendance_events", "users", "bookings"))


for _name, _day in {"a11_day_kpis_staff": "2024-01-15", "a11_day_kpis_bookings": "2001-07-31"}.items():
    register(_name, _kpi_sql(_day))(
        lambda spark, sf, day=_day: R.day_kpis(fixture(spark, sf, "bookings").withColumnRenamed("visit", "status"),
                                               attendance(spark, sf), day))

OWNER_PARTS = {
    "kpis": f"""
SELECT (SELECT COUNT(*) FROM bookings WHERE CAST(created_at AS DATE) = DATE '{EVENTS_AS_OF}') AS bookings_today,
 (SELECT CAST(COALESCE(SUM(price), 0) AS BIGINT) FROM bookings WHERE CAST(created_at AS DATE) = DATE '{EVENTS_AS_OF}') AS revenue_today,
 (SELECT COUNT(DISTINCT employee_id) FROM att WHERE CAST(created_at AS DATE) = DATE '{EVENTS_AS_OF}') AS staff_present""",
    "recent": """SELECT order_id, name, service, vehicle, price, visit AS status, created_at FROM bookings
ORDER BY created_at DESC NULLS FIRST, order_id LIMIT 10""",
    "logs": """SELECT employee_name, status, check_in, check_out FROM att
ORDER BY created_at DESC NULLS FIRST, attendance_id LIMIT 10""",
    "perf": """SELECT employee_name, COUNT(*) AS days_present FROM att GROUP BY employee_name
ORDER BY days_present DESC, employee_name ASC NULLS LAST LIMIT 5""",
}
for _part, _sql in OWNER_PARTS.items():
    register(f"a14_owner_{_part}", _att_sql(_sql, fixtures=("attendance_events", "users", "bookings")))(
        lambda spark, sf, part=_part: P.owner_report(
            fixture(spark, sf, "bookings").withColumnRenamed("visit", "status"), attendance(spark, sf), EVENTS_AS_OF,
            persist=False)[part])


# ---- packs -------------------------------------------------------------------
@register("w8_wash_ledger", sql_with(["washes", "memberships"], """
SELECT w.seq, w.ts, w.membership_id, w.rn <= COALESCE(m.remaining_washes, 0) AS accepted,
 CAST(greatest(COALESCE(m.remaining_washes, 0) - w.rn, 0) AS INTEGER) AS balance_after
FROM (SELECT *, row_number() OVER (PARTITION BY membership_id ORDER BY ts, seq) AS rn FROM washes) w
LEFT JOIN memberships m ON w.membership_id = m.id"""))
def w8(spark, sf):
    return PK.wash_ledger(fixture(spark, sf, "memberships"), fixture(spark, sf, "washes"))


@register("w8_wash_ledger_small_packs", sql_with(["washes", "memberships"], """
SELECT w.seq, w.ts, w.membership_id, w.rn <= COALESCE(m.remaining_washes, 0) AS accepted,
 CAST(greatest(COALESCE(m.remaining_washes, 0) - w.rn, 0) AS INTEGER) AS balance_after
FROM (SELECT *, row_number() OVER (PARTITION BY membership_id ORDER BY ts, seq) AS rn FROM washes) w
LEFT JOIN (SELECT id, CAST(id % 4 AS INTEGER) AS remaining_washes FROM memberships) m ON w.membership_id = m.id"""))
def w8b(spark, sf):
    m = fixture(spark, sf, "memberships").withColumn("remaining_washes", (F.col("id") % 4).cast("int"))
    return PK.wash_ledger(m, fixture(spark, sf, "washes"))


@register("w9_pack_status", sql_with(["memberships", "plans", "washes"], """
SELECT m.id, p.total_washes AS total, CAST(least(COALESCE(u.n, 0), p.total_washes) AS INTEGER) AS used,
 CASE WHEN least(COALESCE(u.n, 0), p.total_washes) >= p.total_washes THEN 'Expired' ELSE 'Active' END AS status
FROM memberships m JOIN plans p ON m.plan_id = p.id
LEFT JOIN (SELECT membership_id, COUNT(*) AS n FROM washes GROUP BY membership_id) u ON u.membership_id = m.id"""))
def w9(spark, sf):
    m = fixture(spark, sf, "memberships").join(
        fixture(spark, sf, "plans").select(F.col("id").alias("plan_id"), "total_washes"), "plan_id")
    return PK.pack_status(m, fixture(spark, sf, "washes"))


# ---- one-time codes ----------------------------------------------------------
@register("w5_latest_code_request", sql_with(["code_requests"], """
SELECT phone, purpose, seq, ts FROM code_requests
QUALIFY row_number() OVER (PARTITION BY phone, purpose ORDER BY ts DESC, seq DESC) = 1"""))
def w5(spark, sf):
    return CO.latest_per_key(fixture(spark, sf, "code_requests"))


def _walk(cooldown):
    return {
        "r0": "SELECT *, row_number() OVER (PARTITION BY phone, purpose ORDER BY ts, seq) AS rn FROM code_requests",
        "walk(phone, purpose, rn, seq, ts, accepted, last_ts)": f"""
SELECT phone, purpose, rn, seq, ts, true, ts FROM r0 WHERE rn = 1
UNION ALL
SELECT r.phone, r.purpose, r.rn, r.seq, r.ts,
 (datediff('microsecond', w.last_ts, r.ts) + 500000) // 1000000 >= {cooldown},
 CASE WHEN (datediff('microsecond', w.last_ts, r.ts) + 500000) // 1000000 >= {cooldown} THEN r.ts ELSE w.last_ts END
FROM walk w JOIN r0 r ON r.phone = w.phone AND r.purpose = w.purpose AND r.rn = w.rn + 1""",
    }


def _codes_sql(cooldown, ttl):
    return {**_walk(cooldown), "codes": f"""SELECT seq AS code_id, phone, purpose, ts AS created_at,
 ts + INTERVAL {ttl} SECOND AS expires_at FROM walk WHERE accepted"""}


SCALED = {"cooldown": 43200, "ttl": 172800}   # event gaps are hours: scaled rules exercise every branch


for _sfx, _cd in {"": 60, "_scaled": SCALED["cooldown"]}.items():
    register(f"w10_code_cooldown{_sfx}", sql_with(["code_requests"], "SELECT seq, ts, phone, purpose, accepted FROM walk",
                                                  recursive=True, **_walk(_cd)))(
        lambda spark, sf, cd=_cd: CO.code_cooldown(fixture(spark, sf, "code_requests"), cd))

register("w10_code_cooldown_hot_path", sql_with(["code_requests"], "SELECT seq, ts, phone, purpose, accepted FROM walk",
                                              recursive=True, **_walk(SCALED["cooldown"])))(
    lambda spark, sf: CO.code_cooldown(fixture(spark, sf, "code_requests"), SCALED["cooldown"], hot_key_rows=5))

PER_KEY = {"r0": "SELECT ts, phone, purpose, row_number() OVER (PARTITION BY phone, purpose ORDER BY ts, seq) AS seq, "
                 "row_number() OVER (PARTITION BY phone, purpose ORDER BY ts, seq) AS rn FROM code_requests"}


def _per_key_seq(spark, sf):
    return keyed_row_number(fixture(spark, sf, "code_requests"), ["phone", "purpose"], ["ts", "seq"], "n").drop("seq").withColumnRenamed("n", "seq")


for _sfx, _rows in {"replay": 1_000_000, "hot": 5}.items():
    register(f"w10_per_key_seq_{_sfx}", sql_with(["code_requests"], "SELECT seq, ts, phone, purpose, accepted FROM walk",
                                                 recursive=True, **(_walk(SCALED["cooldown"]) | PER_KEY)))(
        lambda spark, sf, rows=_rows: CO.code_cooldown(_per_key_seq(spark, sf), SCALED["cooldown"], hot_key_rows=rows))

ASOF = """SELECT v.*, c.code_id, c.created_at, c.expires_at FROM verifications v
ASOF LEFT JOIN codes c ON v.phone = c.phone AND v.purpose = c.purpose AND v.ts >= c.created_at"""
OUTCOMES = """
SELECT seq, ts, phone, purpose, matches, code_id, created_at, expires_at,
 CASE WHEN used = 1 THEN 'already used' WHEN ts > expires_at THEN 'expired' WHEN m >= 5 THEN 'too many attempts'
      WHEN NOT matches THEN 'invalid' ELSE 'ok' END AS outcome FROM g
UNION ALL SELECT seq, ts, phone, purpose, matches, code_id, created_at, expires_at, 'not found' FROM j WHERE code_id IS NULL"""
OUT_CTES = {
    "j": ASOF,
    "f": """SELECT *, COALESCE(SUM(CASE WHEN NOT matches THEN 1 ELSE 0 END) OVER (PARTITION BY code_id ORDER BY ts, seq
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM j WHERE code_id IS NOT NULL""",
    "g": """SELECT *, COALESCE(MAX(CASE WHEN matches AND NOT (ts > expires_at) AND m < 5 THEN 1 ELSE 0 END) OVER (
 PARTITION BY code_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f""",
}


def _codes(spark, sf, cd, ttl):
    return CO.issued_codes(fixture(spark, sf, "code_requests"), cd, ttl)


for _sfx, (_cd, _ttl) in {"": (60, 300), "_scaled": (SCALED["cooldown"], SCALED["ttl"])}.items():
    register(f"j8_code_as_of{_sfx}", sql_with(["code_requests", "verifications"], ASOF, recursive=True,
                                              **_codes_sql(_cd, _ttl)))(
        lambda spark, sf, cd=_cd, ttl=_ttl: CO.code_as_of(fixture(spark, sf, "verifications"), _codes(spark, sf, cd, ttl)))
    register(f"w11_code_outcomes{_sfx}", sql_with(["code_requests", "verifications"], OUTCOMES, recursive=True,
                                                  **_codes_sql(_cd, _ttl), **OUT_CTES))(
        lambda spark, sf, cd=_cd, ttl=_ttl: CO.code_outcomes(fixture(spark, sf, "verifications"),
                                                             _codes(spark, sf, cd, ttl)))

STATUS_AS_OF = "2024-01-20 12:00:00"


@register("w12_code_status", sql_with(["code_requests", "verifications"], f"""
SELECT l.phone, l.purpose, l.code_id, l.created_at, l.expires_at, CAST(COALESCE(s.attempts, 0) AS BIGINT) AS attempts,
 CASE WHEN COALESCE(s.consumed, false) THEN 'consumed' WHEN TIMESTAMP '{STATUS_AS_OF}' > l.expires_at THEN 'expired'
      WHEN COALESCE(s.attempts, 0) >= 5 THEN 'locked' ELSE 'active' END AS status
FROM live l LEFT JOIN seen s USING (code_id)""", recursive=True, **_codes_sql(SCALED["cooldown"], SCALED["ttl"]), **OUT_CTES,
    o=OUTCOMES,
    seen=f"""SELECT code_id, COUNT(*) FILTER (WHERE outcome = 'invalid') AS attempts, bool_or(outcome = 'ok') AS consumed
 FROM o WHERE code_id IS NOT NULL AND ts <= TIMESTAMP '{STATUS_AS_OF}' GROUP BY code_id""",
    live=f"""SELECT * FROM codes WHERE created_at <= TIMESTAMP '{STATUS_AS_OF}'
 QUALIFY row_number() OVER (PARTITION BY phone, purpose ORDER BY created_at DESC, code_id DESC) = 1"""))
def w12(spark, sf):
    codes = _codes(spark, sf, SCALED["cooldown"], SCALED["ttl"])
    outcomes = CO.code_outcomes(fixture(spark, sf, "verifications"), codes)
    return CO.code_status(codes, outcomes, STATUS_AS_OF)
