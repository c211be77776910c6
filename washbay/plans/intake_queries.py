"""Registered queries for columns (P*), filters (F*), lists (T*), nested shapes (N*),
intake and people joins (J1–J7) and sources (S*), with DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from washbay.functions import columns as C
from washbay.operators import changes as CH
from washbay.operators import filters as FL
from washbay.operators import intake as I
from washbay.operators import lists as L
from washbay.operators import nested as N
from washbay.operators import people as PE
from washbay.operators.packs import open_memberships
from washbay.plans.registry import ORACLES, in_place, register, sql_with
from washbay.plans.staging import staged_path
from washbay.sources import tables as S
from washbay.sources.fixtures import adapted, duck_text, fixture

EVENTS_AS_OF = "2024-01-30"


# ---- DuckDB twins of the text rules ------------------------------------------
def d_trim(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def d_text(x, n):
    return f"substr({d_trim(f'COALESCE(CAST({x} AS VARCHAR), {chr(39)}{chr(39)})')}, 1, {n})"


def d_phone(x):
    return f"substr(regexp_replace(COALESCE({x}, ''), '[^0-9]', '', 'g'), 1, 15)"


D_ISO = "[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,9})?)?Z?)?"
D_TIME = "([01]?[0-9]|2[0-3]):([0-5][0-9])"


def d_date(x):
    t = d_trim(x)
    return f"COALESCE(CASE WHEN regexp_full_match({t}, '{D_ISO}') THEN CAST(TRY_CAST(substr({t},1,10) AS DATE) AS VARCHAR) END, '')"


def d_time(x):
    t = d_trim(f"COALESCE({x}, '')")
    return (f"CASE WHEN regexp_full_match({t}, '{D_TIME}') THEN lpad(regexp_extract({t}, '^{D_TIME}$', 1), 2, '0')"
            f" || ':' || regexp_extract({t}, '^{D_TIME}$', 2) ELSE '' END")


def d_parse_int(x):
    return f"TRY_CAST(NULLIF(regexp_extract({d_trim(x)}, '^[+-]?[0-9]+', 0), '') AS INTEGER)"


# ---- P: column rules ---------------------------------------------------------
@register("p1_p4_visit_time_parts", sql_with(["bookings"], """
SELECT order_id, dt_local, strftime(dt_local, '%Y-%m-%d') AS day_label, strftime(dt_local, '%Y-%m') AS month_label,
 strftime(dt_local, '%Y') AS year_label, CAST(hour(dt_local) AS INTEGER) AS hour, CAST(dayofweek(dt_local) AS INTEGER) AS dow
FROM (SELECT order_id, CASE WHEN regexp_full_match("date", '[0-9]{4}-[0-9]{2}-[0-9]{2}')
              AND regexp_full_match("time", '[0-9]{2}:[0-9]{2}') THEN TRY_CAST("date" || ' ' || "time" AS TIMESTAMP)
             WHEN regexp_full_match("date", '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST("date" AS TIMESTAMP) END AS dt_local
      FROM bookings) b"""))
def p1_p4(spark, sf):
    bk = fixture(spark, sf, "bookings").select("order_id", C.visit_ts().alias("dt_local"))
    return bk.select("order_id", "dt_local", C.period_label("dt_local", "day").alias("day_label"),
                     C.period_label("dt_local", "month").alias("month_label"),
                     C.period_label("dt_local", "year").alias("year_label"),
                     C.hour_of("dt_local").alias("hour"), C.dow_of("dt_local").alias("dow"))


@register("p2_p9_prices_and_digits", sql_with(["bookings"], """
SELECT order_id,
 COALESCE(price, CASE WHEN regexp_matches(service, '[0-9]') THEN TRY_CAST(regexp_extract(service, '([0-9]+)', 1) AS INTEGER) ELSE 0 END) AS price_int,
 CASE WHEN regexp_matches(name, '[0-9]') THEN TRY_CAST(regexp_extract(name, '([0-9]+)', 1) AS INTEGER) END AS name_number
FROM bookings"""))
def p2_p9(spark, sf):
    bk = fixture(spark, sf, "bookings")
    return bk.select("order_id", C.effective_price().alias("price_int"), C.first_int("name").alias("name_number"))


@register("p5_p8_normalised_text", sql_with(["raw_requests"], f"""
SELECT seq, {d_text('name', 200)} AS name, {d_phone('phone')} AS phone, {d_date('"date"')} AS "date",
 {d_time('"time"')} AS "time", {d_text('address', 500)} AS address FROM raw_requests"""))
def p5_p8(spark, sf):
    r = fixture(spark, sf, "raw_requests")
    return r.select("seq", C.norm_text("name", 200).alias("name"), C.norm_phone("phone").alias("phone"),
                    C.norm_date("date").alias("date"), C.norm_time("time").alias("time"),
                    C.norm_text("address", 500).alias("address"))


_BOOL_WORDS = "CASE o_orderkey % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN 'off' WHEN 2 THEN 'maybe' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN ' TRUE ' WHEN 6 THEN '0' ELSE 'n' END"


@register("p10_norm_bool", f"""
SELECT o_orderkey AS order_id, w,
 CASE WHEN lower({d_trim('w')}) IN ('1','true','yes','y','on') THEN true
      WHEN lower({d_trim('w')}) IN ('0','false','no','n','off') THEN false ELSE true END AS flag_default_true,
 CASE WHEN lower({d_trim('w')}) IN ('1','true','yes','y','on') THEN true
      WHEN lower({d_trim('w')}) IN ('0','false','no','n','off') THEN false ELSE false END AS flag_default_false
FROM (SELECT o_orderkey, {_BOOL_WORDS} AS w FROM orders) x""")
def p10(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS order_id", f"{_BOOL_WORDS} AS w")
    return o.select("order_id", "w", C.norm_bool("w", True).alias("flag_default_true"),
                    C.norm_bool("w", False).alias("flag_default_false"))


@register("p11_p12_p16_vehicle_price", sql_with(["booking_requests", "catalog"], """
SELECT b.order_id, CASE WHEN b.vehicle='Bike' THEN 'bike' WHEN b.vehicle='SUV' THEN 'suv' ELSE 'sedan' END AS price_column,
 c.suv + CASE WHEN b.visit = 'Home Visit' THEN 50 ELSE 0 END AS suv_with_surcharge,
 CASE WHEN c.bike IS NULL THEN '—' ELSE '₹ ' || CAST(c.bike AS VARCHAR) END AS bike_label
FROM booking_requests b LEFT JOIN catalog c ON b.service = c.name"""))
def p11_p12_p16(spark, sf):
    b, c = fixture(spark, sf, "booking_requests"), fixture(spark, sf, "catalog")
    j = b.join(c, b["service"] == c["name"], "left")
    return j.select("order_id", C.price_column_for(b["vehicle"]).alias("price_column"),
                    C.home_surcharge(c["suv"], b["visit"]).alias("suv_with_surcharge"),
                    C.price_label(c["bike"]).alias("bike_label"))


@register("p13_f9_within_hours", sql_with(["raw_requests"], """
SELECT seq, "time", mins FROM (
 SELECT seq, "time",
  TRY_CAST(NULLIF(regexp_extract(regexp_replace(split_part("time", ':', 1), '^\\s+|\\s+$', '', 'g'), '^[+-]?[0-9]+', 0), '') AS INTEGER) * 60
  + TRY_CAST(NULLIF(regexp_extract(regexp_replace(split_part("time", ':', 2), '^\\s+|\\s+$', '', 'g'), '^[+-]?[0-9]+', 0), '') AS INTEGER) AS mins
 FROM raw_requests) x WHERE mins BETWEEN 600 AND 1200"""))
def p13_f9(spark, sf):
    r = fixture(spark, sf, "raw_requests").select("seq", "time")
    return FL.within_hours(r).withColumn("mins", C.minutes_of_day("time"))


@register("p14_p15_expiry", """
SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS start_day,
 CAST(o_orderdate AS DATE) + CAST(o_orderkey % 300 AS INTEGER) AS expiry_by_days,
 CAST(date_trunc('month', CAST(o_orderdate AS DATE)) + to_months(CAST(o_orderkey % 12 AS INTEGER))
      + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)) AS DATE) AS expiry_by_months
FROM orders""")
def p14_p15(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    start = F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("order_id"), start.alias("start_day"),
                    C.expiry_date(start, F.col("o_orderkey") % 300).alias("expiry_by_days"),
                    C.expiry_months(start, F.col("o_orderkey") % 12).alias("expiry_by_months"))


@register("p17_seconds_since", """
SELECT event_id, CAST(sign(d) * ((abs(d) + 500000) // 1000000) AS BIGINT) AS secs
FROM (SELECT event_id, datediff('microsecond', TIMESTAMP '2024-01-15 00:00:00', ts) AS d FROM events) x""")
def p17(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", C.seconds_since(FL.ntz("2024-01-15 00:00:00"), F.col("ts")).alias("secs"))


@register("p18_owner_view", sql_with(["bookings"], """
SELECT order_id, name, phone, service, vehicle, price, visit AS status FROM bookings"""))
def p18(spark, sf):
    return L.project_bookings(S.load_bookings(spark, fixture(spark, sf, "bookings"), "web"), "owner")


P19_SQL = f"""
SELECT seq, name, phone, vehicle, service, "date", "time", visit_place, address,
 CASE WHEN m <> '' THEN 'missing ' || m END AS reject_reason
FROM (SELECT *, concat_ws(',', CASE WHEN name = '' THEN 'name' END, CASE WHEN phone = '' THEN 'phone' END,
        CASE WHEN vehicle = '' THEN 'vehicle' END, CASE WHEN service = '' THEN 'service' END,
        CASE WHEN "date" = '' THEN 'date' END, CASE WHEN "time" = '' THEN 'time' END) AS m
 FROM (SELECT seq, {d_text('name', 200)} AS name, {d_phone('phone')} AS phone, {d_text('vehicle', 40)} AS vehicle,
        {d_text('service', 120)} AS service, {d_date('"date"')} AS "date", {d_time('"time"')} AS "time",
        {d_text("COALESCE(NULLIF(visit, ''), 'Wash Center')", 40)} AS visit_place, {d_text('address', 500)} AS address
       FROM raw_requests) c) r"""


@register("p19_clean_bookings", sql_with(["raw_requests"], P19_SQL))
def p19(spark, sf):
    return I.clean_bookings(fixture(spark, sf, "raw_requests"))


# ---- F: filters --------------------------------------------------------------
@register("f1_f2_in_date_range", sql_with(["bookings"], """
SELECT order_id, "date" FROM bookings
WHERE TRY_CAST(NULLIF("date", '') AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"""))
def f2(spark, sf):
    return FL.in_date_range(fixture(spark, sf, "bookings"), "1998-01-01", "1998-12-31").select("order_id", "date")


@register("f3_search_people", sql_with(["bookings"], """
SELECT order_id, name, phone FROM bookings WHERE name ILIKE '%customer#0000001%' OR phone ILIKE '%customer#0000001%'"""))
def f3(spark, sf):
    return FL.search_people(fixture(spark, sf, "bookings"), "customer#0000001").select("order_id", "name", "phone")


@register("f3_search_people_pattern", sql_with(["bookings"], """
SELECT order_id, name, phone FROM bookings WHERE name ILIKE '%00_1%4%' OR phone ILIKE '%00_1%4%'"""))
def f3b(spark, sf):
    return FL.search_people(fixture(spark, sf, "bookings"), "00_1%4").select("order_id", "name", "phone")


@register("f4_f5_service_and_status", sql_with(["bookings"], """
SELECT order_id, service, visit AS status FROM bookings WHERE service = '1-URGENT' AND visit = 'Cancelled'"""))
def f4_f5(spark, sf):
    bk = S.load_bookings(spark, fixture(spark, sf, "bookings"), "web")
    return FL.with_status(FL.with_service(bk, "1-URGENT"), "Cancelled").select("order_id", "service", "status")


@register("f6_history_of", sql_with(["bookings", "users"], """
SELECT order_id, phone, created_at, row_number() OVER (ORDER BY created_at DESC NULLS FIRST, order_id) - 1 AS place FROM bookings
WHERE phone IN (SELECT phone FROM users WHERE role = 'employee' AND NOT is_active)"""))
def f6(spark, sf):
    users = fixture(spark, sf, "users").filter((F.col("role") == "employee") & ~F.col("is_active"))
    return in_place(FL.history_of(fixture(spark, sf, "bookings"), users).select("order_id", "phone", "created_at"))


@register("f7_on_day", sql_with(["bookings"], """
SELECT order_id, created_at FROM bookings WHERE CAST(created_at AS DATE) = DATE '1998-06-15'"""))
def f7(spark, sf):
    return FL.on_day(fixture(spark, sf, "bookings"), "1998-06-15").select("order_id", "created_at")


@register("f8_visible_offers", sql_with(["catalog"], "SELECT * FROM catalog WHERE visible = true"))
def f8(spark, sf):
    return FL.visible_offers(fixture(spark, sf, "catalog"))


_SHEET = """SELECT name, CAST(NULL AS INTEGER) AS hatchback, bike, sedan,
 CASE WHEN length(name) % 2 = 0 THEN NULL ELSE suv END AS suv FROM catalog"""


@register("f10_has_any_price", sql_with(["catalog"], """
SELECT * FROM sheet WHERE bike IS NOT NULL OR hatchback IS NOT NULL OR sedan IS NOT NULL OR suv IS NOT NULL""",
                                        sheet=_SHEET))
def f10(spark, sf):
    c = fixture(spark, sf, "catalog")
    sheet = c.select("name", F.lit(None).cast("int").alias("hatchback"), "bike", "sedan",
                     F.when(F.length("name") % 2 == 0, F.lit(None)).otherwise(F.col("suv")).alias("suv"))
    return FL.has_any_price(sheet)


@register("f11_is_new", sql_with(["bookings"], """
SELECT order_id, created_at, COALESCE(created_at >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY, false) AS is_new FROM bookings"""))
def f11(spark, sf):
    return FL.is_new(fixture(spark, sf, "bookings").select("order_id", "created_at"), "2001-08-01")


# ---- T: lists ----------------------------------------------------------------
@register("t1_newest_bookings", sql_with(["bookings"], """
SELECT * FROM bookings ORDER BY created_at DESC NULLS FIRST, order_id ASC NULLS LAST LIMIT 10"""))
def t1(spark, sf):
    return L.newest(fixture(spark, sf, "bookings"), 10)


@register("t2_catalog_order", sql_with(["catalog"], """
SELECT *, row_number() OVER (ORDER BY position ASC NULLS LAST, name) - 1 AS place FROM catalog"""))
def t2(spark, sf):
    return in_place(L.catalog_order(fixture(spark, sf, "catalog")))


# names that differ in case and accents; locale order goes by letters first, so neither decides before a later letter does
LOCALE_NAMES = """SELECT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN translate(p_name, 'ae', '\u00e4\u00e9') ELSE p_name END
 || ' ' || CAST(p_partkey AS VARCHAR) AS name, CAST(p_partkey % 4 AS INTEGER) AS position FROM part"""


@register("t2_catalog_order_locale", sql_with([], """
SELECT *, row_number() OVER (ORDER BY position ASC NULLS LAST, translate(lower(name), '\u00e4\u00e9', 'ae')) - 1 AS place
FROM (SELECT name, CASE WHEN position > 0 THEN position END AS position FROM named) x""",
                                               named=LOCALE_NAMES))
def t2_locale(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.translate("p_name", "ae", "\u00e4\u00e9")) \
            .otherwise(F.col("p_name"))
    place = (F.col("p_partkey") % 4).cast("int")
    cat = part.select(F.concat(name, F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.when(place > 0, place).alias("position"))
    return in_place(L.catalog_order(cat, collation="UNICODE"))


@register("t3_booking_list", sql_with(["bookings"], """
SELECT order_id, name, phone, vehicle, service, "date", "time", visit AS visit_place, CAST(NULL AS VARCHAR) AS address,
 price, created_at FROM bookings
WHERE TRY_CAST(NULLIF("date", '') AS DATE) >= DATE '1997-01-01' AND TRY_CAST(NULLIF("date", '') AS DATE) <= DATE '1997-12-31'
  AND service = '2-HIGH' AND (name ILIKE '%customer#00000%' OR phone ILIKE '%customer#00000%')
ORDER BY created_at DESC NULLS FIRST, order_id LIMIT 20"""))
def t3(spark, sf):
    bk = S.load_bookings(spark, fixture(spark, sf, "bookings"), "staff")
    return L.booking_list(bk, "1997-01-01", "1997-12-31", "2-HIGH", "customer#00000", "20")


@register("t4_public_sheet", sql_with(["catalog"], """
SELECT name, bike, sedan, suv, row_number() OVER (ORDER BY name) - 1 AS place FROM catalog"""))
def t4(spark, sf):
    return in_place(L.sheet_order(fixture(spark, sf, "catalog").select("name", "bike", "sedan", "suv"), "public"))


# ---- N: nested shapes (JSON text of the nested value is compared) ------------
_J = {"ignoreNullFields": "false"}


@register("n1_price_struct", """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS description,
 CAST(to_json(struct_pack(bike := CAST(floor(p_retailprice) AS INTEGER),
                     hatchback := CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INTEGER) + 50 END,
                     sedan := CAST(floor(p_retailprice) AS INTEGER) + 100, suv := CAST(NULL AS INTEGER))) AS VARCHAR) AS prices
FROM part""")
def n1(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    base = F.floor("p_retailprice").cast("int")
    sheet = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
                     F.col("p_type").alias("description"), base.alias("bike"),
                     F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).otherwise(base + 50).alias("hatchback"),
                     (base + 100).alias("sedan"), F.lit(None).cast("int").alias("suv"))
    s = N.with_price_struct(sheet)
    return s.select("id", "name", "description", F.to_json("prices", _J).alias("prices"))


@register("n2_s6_catalog_as_packages", sql_with(["catalog"], """
SELECT name AS id, name, COALESCE(NULLIF(description, ''), '') AS description,
 CAST(to_json(struct_pack(bike := bike, hatchback := sedan, sedan := sedan, suv := suv)) AS VARCHAR) AS prices,
 CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at
FROM catalog WHERE visible = true"""))
def n2(spark, sf):
    pk = S.load_price_sheets(spark, catalog=fixture(spark, sf, "catalog"))["packages"]
    return pk.withColumn("prices", F.to_json("prices", _J))


@register("n3_price_map", sql_with(["catalog"], """
SELECT name, CAST(to_json(MAP {'Bike': bike, 'Hatch/Sedan': sedan, 'SUV': suv}) AS VARCHAR) AS prices FROM catalog"""))
def n3(spark, sf):
    return N.price_map(fixture(spark, sf, "catalog")).withColumn("prices", F.to_json("prices", _J))


@register("n4_unpivot_prices", sql_with(["catalog"], """
SELECT name, 'bike' AS vehicle, bike AS price FROM catalog UNION ALL
SELECT name, 'sedan', sedan FROM catalog UNION ALL SELECT name, 'suv', suv FROM catalog"""))
def n4(spark, sf):
    return N.unpivot_prices(fixture(spark, sf, "catalog"))


@register("n5_gallery_array", sql_with(["settings"], """
SELECT id, CAST(len(g) AS BIGINT) AS n_images, CAST(to_json(g) AS VARCHAR) AS gallery_json FROM (
 SELECT id, CASE WHEN json_valid(COALESCE(gallery_json, '[]')) THEN json_extract_string(COALESCE(gallery_json, '[]'), '$[*]')
            ELSE []::VARCHAR[] END AS g FROM settings) x"""))
def n5(spark, sf):
    s = fixture(spark, sf, "settings").select("id", N.gallery_array("gallery_json").alias("g"))
    return s.select("id", F.size("g").cast("bigint").alias("n_images"), N.gallery_json("g").alias("gallery_json"))


@register("n6_split_lines", """
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, ls[1] AS first_line, ls[-1] AS last_line FROM (
 SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
                            lambda x: x <> '') AS ls FROM documents) d""")
def n6(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", N.split_lines("text").alias("ls"))
    return d.select("doc_id", F.size("ls").cast("bigint").alias("n_lines"), F.get(F.col("ls"), 0).alias("first_line"),
                    F.try_element_at("ls", F.lit(-1)).alias("last_line"))


# ---- J: intake and people joins ----------------------------------------------
@register("j1_price_bookings", sql_with(["booking_requests", "catalog"], """
SELECT b.order_id, b.name, b.phone, b.vehicle, b.service, b.visit,
 CASE WHEN o.base IS NOT NULL THEN o.base + CASE WHEN b.visit = 'Home Visit' THEN 50 ELSE 0 END END AS price,
 CASE WHEN o.base IS NULL THEN COALESCE(b.service, '') || ' not available for ' || COALESCE(b.vehicle, '') END AS reject_reason
FROM booking_requests b LEFT JOIN offers o
 ON b.service = o.svc AND (CASE WHEN b.vehicle = 'Bike' THEN 'bike' WHEN b.vehicle = 'SUV' THEN 'suv' ELSE 'sedan' END) = o.k""",
                                          offers="""
SELECT name AS svc, 'bike' AS k, bike AS base FROM catalog WHERE visible IS DISTINCT FROM false AND bike IS NOT NULL UNION ALL
SELECT name, 'sedan', sedan FROM catalog WHERE visible IS DISTINCT FROM false AND sedan IS NOT NULL UNION ALL
SELECT name, 'suv', suv FROM catalog WHERE visible IS DISTINCT FROM false AND suv IS NOT NULL"""))
def j1(spark, sf):
    return I.price_bookings(fixture(spark, sf, "booking_requests"), fixture(spark, sf, "catalog"))


_MATRIX_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{v}', '{s}', {'NULL' if p is None else p})" for v, s, p in I.PRICE_MATRIX) + ") t(v, s, cell)"


@register("j2_price_from_matrix", sql_with(["edit_requests"], f"""
SELECT e.order_id, e.vehicle, e.service, e.visit,
 CASE WHEN e.price IS NOT NULL AND e.price <> '' THEN {d_parse_int('e.price')}
      ELSE m.cell + CASE WHEN COALESCE(NULLIF({d_trim('e.visit')}, ''), 'Wash Center') = 'Home Visit' THEN 50 ELSE 0 END
 END AS price
FROM edit_requests e LEFT JOIN matrix m ON e.vehicle = m.v AND e.service = m.s""", matrix=_MATRIX_SQL))
def j2(spark, sf):
    return I.price_from_matrix(fixture(spark, sf, "edit_requests"))


@register("j3_open_memberships", sql_with(["memberships", "plans"], f"""
SELECT r.customer_id, r.plan_id, CAST(DATE '{EVENTS_AS_OF}' + p.validity_days AS DATE) AS expiry_date,
 CAST(p.total_washes AS INTEGER) AS remaining_washes
FROM (SELECT id AS customer_id, CAST(id % 4 AS INTEGER) AS plan_id FROM memberships) r JOIN plans p ON r.plan_id = p.id"""))
def j3(spark, sf):
    req = fixture(spark, sf, "memberships").select(F.col("id").alias("customer_id"),
                                                   (F.col("id") % 4).cast("int").alias("plan_id"))
    return open_memberships(req, fixture(spark, sf, "plans"), EVENTS_AS_OF)[0]


@register("j3_unknown_plans", sql_with(["memberships", "plans"], """
SELECT customer_id, plan_id, 'plan not found' AS reject_reason
FROM (SELECT id AS customer_id, CAST(id % 4 AS INTEGER) AS plan_id FROM memberships) r
WHERE NOT EXISTS (SELECT 1 FROM plans p WHERE p.id = r.plan_id)"""))
def j3b(spark, sf):
    req = fixture(spark, sf, "memberships").select(F.col("id").alias("customer_id"),
                                                   (F.col("id") % 4).cast("int").alias("plan_id"))
    return open_memberships(req, fixture(spark, sf, "plans"), EVENTS_AS_OF)[1]


_STAFF = """SELECT username, min(id) AS employee_id, arg_min(name, id) AS employee_name
 FROM users WHERE role = 'employee' AND username IS NOT NULL GROUP BY username"""


@register("j4_known_employees", sql_with(["attendance_events", "users"], """
SELECT e.*, s.employee_id, s.employee_name FROM attendance_events e JOIN staff s USING (username)""", staff=_STAFF))
def j4(spark, sf):
    return PE.known_employees(fixture(spark, sf, "attendance_events"), fixture(spark, sf, "users"))[0]


@register("j4_unknown_employees", sql_with(["attendance_events", "users"], """
SELECT e.* FROM attendance_events e WHERE NOT EXISTS (SELECT 1 FROM staff s WHERE s.username = e.username)""",
                                           staff=_STAFF))
def j4b(spark, sf):
    return PE.known_employees(fixture(spark, sf, "attendance_events"), fixture(spark, sf, "users"))[1]


@register("j5_owned_changes", sql_with(["change_requests", "bookings"], """
SELECT c.* FROM change_requests c WHERE EXISTS (
 SELECT 1 FROM bookings b WHERE b.order_id = c.order_id AND b.phone = c.phone)"""))
def j5(spark, sf):
    return PE.owned_changes(fixture(spark, sf, "change_requests"), fixture(spark, sf, "bookings"))[0]


@register("j5_not_found_changes", sql_with(["change_requests", "bookings"], """
SELECT c.* FROM change_requests c WHERE NOT EXISTS (
 SELECT 1 FROM bookings b WHERE b.order_id = c.order_id AND b.phone = c.phone)"""))
def j5b(spark, sf):
    return PE.owned_changes(fixture(spark, sf, "change_requests"), fixture(spark, sf, "bookings"))[1]


def _bucketed(spark, sf, name):
    """The bookings as a table bucketed by order_id."""
    return S.store_bucketed(fixture(spark, sf, "bookings"), f"{name}_{uuid.uuid4().hex}", staged_path(spark, "bucketed-bookings"))


@register("j5_owned_changes_bucketed", ORACLES["j5_owned_changes"])
def j5c(spark, sf):
    return PE.owned_changes(fixture(spark, sf, "change_requests"), _bucketed(spark, sf, "j5"), bucketed=True)[0]


@register("m6_edit_bookings_bucketed", sql_with(["bookings", "status_events"], """
SELECT b.* EXCLUDE (price, service), CASE WHEN e.order_id IS NOT NULL THEN e.service ELSE b.service END AS service,
 CASE WHEN e.order_id IS NOT NULL THEN e.price ELSE b.price END AS price
FROM bookings b LEFT JOIN (SELECT order_id, price, CASE WHEN seq % 2 = 0 THEN 'Premium' END AS service FROM status_events
                           WHERE action = 'edit' QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) = 1) e USING (order_id)"""))
def m6_bucketed(spark, sf):
    ev = fixture(spark, sf, "status_events").withColumn("service", F.when(F.col("seq") % 2 == 0, F.lit("Premium")))
    return CH.edit_bookings(_bucketed(spark, sf, "m6"), ev)


@register("j6_resolve_login_key", sql_with(["login_events", "users"], """
SELECT e.*, h.user_id FROM login_events e LEFT JOIN (
 SELECT seq, min(id) AS user_id FROM (
  SELECT e.seq, u.id FROM login_events e JOIN users u ON e.login = u.phone UNION ALL
  SELECT e.seq, u.id FROM login_events e JOIN users u ON e.login = u.username) x GROUP BY seq) h USING (seq)"""))
def j6(spark, sf):
    return PE.resolve_login_key(fixture(spark, sf, "login_events"), fixture(spark, sf, "users"))


@register("j7_register_missing", sql_with(["users"], """
SELECT 'Customer' AS name, phone, 'customer' AS role, true AS is_active FROM (
 SELECT DISTINCT lpad(CAST(o_custkey * 3 AS VARCHAR), 10, '9') AS phone FROM orders) p
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.phone = p.phone)"""))
def j7(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    phones = o.select(F.lpad((F.col("o_custkey") * 3).cast("string"), 10, "9").alias("phone"))
    return PE.register_missing(phones, fixture(spark, sf, "users"))


# ---- S: sources and sinks ----------------------------------------------------
@register("s1_load_bookings", sql_with(["bookings"], """
SELECT order_id, name, phone, vehicle, service, "date", "time", CAST(NULL AS VARCHAR) AS visit_place, visit AS status,
 CAST(NULL AS VARCHAR) AS address, price, created_at FROM bookings"""))
def s1(spark, sf):
    return S.load_bookings(spark, fixture(spark, sf, "bookings"), "web")


@register("s2_load_catalog", sql_with(["catalog"], """
SELECT name, bike, sedan, suv, position, COALESCE(visible, true) AS visible, COALESCE(description, '') AS description,
 CAST(NULL AS TIMESTAMP) AS updated_at FROM catalog"""))
def s2(spark, sf):
    return S.load_catalog(spark, fixture(spark, sf, "catalog"))


@register("s3_profile_count", sql_with(["bookings"], "SELECT COUNT(*) AS rows FROM bookings"))
def s3(spark, sf):
    return S.table_profile(fixture(spark, sf, "bookings"))["count"]


@register("s3_profile_sample", sql_with(["bookings"], """
SELECT * FROM bookings ORDER BY created_at DESC NULLS FIRST, order_id LIMIT 3"""))
def s3b(spark, sf):
    return S.table_profile(fixture(spark, sf, "bookings"), keys=("order_id",))["sample"]


@register("s4_prepare_booking_rows", sql_with(["raw_requests"], """
SELECT CAST(NULL AS BIGINT) AS order_id, name, phone, vehicle, service, "date", "time", visit_place,
 CAST('New' AS VARCHAR) AS status, address, 0 AS price, TIMESTAMP '2024-01-30 12:00:00' AS created_at
FROM clean WHERE reject_reason IS NULL""", clean=P19_SQL))
def s4(spark, sf):
    valid, _ = I.split_outcome(I.clean_bookings(fixture(spark, sf, "raw_requests")))
    return S.prepare_booking_rows(valid.drop("seq"), "2024-01-30 12:00:00")


@register("s4_append_read_back", sql_with(["raw_requests"], """
SELECT CAST(NULL AS BIGINT) AS order_id, name, phone, vehicle, service, "date", "time", visit_place,
 CAST('New' AS VARCHAR) AS status, address, 0 AS price, TIMESTAMP '2024-01-30 12:00:00' AS created_at, CAST("date" AS DATE) AS visit_day
FROM clean WHERE reject_reason IS NULL AND CAST("date" AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1997-02-28'""", clean=P19_SQL))
def s4_read_back(spark, sf):
    """Two years of the stored rows, read from their day folders alone."""
    path = staged_path(spark, "appended-bookings")
    valid, _ = I.split_outcome(I.clean_bookings(fixture(spark, sf, "raw_requests")))
    S.append_bookings(valid.drop("seq"), path, "2024-01-30 12:00:00")
    return S.load_bookings(spark, path).where("visit_day BETWEEN DATE '1995-03-01' AND DATE '1997-02-28'")


@register("s4_written_outcomes", sql_with(["raw_requests"], """
SELECT CASE WHEN reject_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS outcome, count(*) AS written, count(*) AS stored
FROM clean GROUP BY 1""", clean=P19_SQL))
def s4_outcomes(spark, sf):
    """Rows of each outcome as the writing job counted them, and as they are read back."""
    path = staged_path(spark, "written-outcomes")
    written = S.write_outcomes(I.clean_bookings(fixture(spark, sf, "raw_requests")), path)
    counted = F.when(F.col("outcome") == "accepted", F.lit(written["accepted"])).otherwise(F.lit(written["rejected"])).cast("bigint")
    return spark.read.parquet(path).groupBy("outcome").agg(F.count(F.lit(1)).alias("stored")).select("outcome", counted.alias("written"), "stored")


CUSTOMER_INPUT = """SELECT concat(' ', c_name, '  ') AS name, concat('+91 ', lpad(CAST(c_custkey AS VARCHAR), 10, '9')) AS phone,
 CAST(NULL AS VARCHAR) AS email, concat('KA-', CAST(c_nationkey AS VARCHAR), '-', CAST(c_custkey AS VARCHAR)) AS vehicle_number,
 c_mktsegment AS vehicle_type FROM customer"""


@register("s5_customer_rows", CUSTOMER_INPUT)
def s5(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    raw = c.select(F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("name"),
                   F.concat(F.lit("+91 "), F.lpad(F.col("c_custkey").cast("string"), 10, "9")).alias("phone"),
                   F.lit(None).cast("string").alias("email"),
                   F.concat(F.lit("KA-"), F.col("c_nationkey").cast("string"), F.lit("-"),
                            F.col("c_custkey").cast("string")).alias("vehicle_number"),
                   F.col("c_mktsegment").alias("vehicle_type"))
    return S.prepare_customer_rows(raw)


@register("s5_append_read_back", CUSTOMER_INPUT)
def s5_read_back(spark, sf):
    path = staged_path(spark, "appended-customers")
    S.append_customers(s5(spark, sf), path)
    return S.load_customers(spark, path)


SERVICES_SHEET = """SELECT p_partkey AS id, p_name AS name,
 CASE p_size % 3 WHEN 0 THEN 'Bike' WHEN 1 THEN 'Hatch/Sedan' ELSE 'SUV' END AS vehicle_type,
 CAST(floor(p_retailprice) AS INTEGER) AS price, p_brand AS category, p_size * 5 AS duration_minutes,
 p_type AS description, p_partkey % 4 <> 0 AS active FROM part"""


@register("s6_f8_t4_services_sheet", f"SELECT * EXCLUDE (active) FROM ({SERVICES_SHEET}) s WHERE active = true ORDER BY id")
def s6_services(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    sheet = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                     F.when(F.col("p_size") % 3 == 0, "Bike").when(F.col("p_size") % 3 == 1, "Hatch/Sedan")
                      .otherwise("SUV").alias("vehicle_type"),
                     F.floor("p_retailprice").cast("int").alias("price"), F.col("p_brand").alias("category"),
                     (F.col("p_size") * 5).alias("duration_minutes"), F.col("p_type").alias("description"),
                     (F.col("p_partkey") % 4 != 0).alias("active"))
    return S.load_price_sheets(spark, "services", services=sheet)["services"]


@register("s7_load_users", sql_with(["users"], """
SELECT CAST(id AS VARCHAR) AS id, name, phone, username, role, is_active, CAST(NULL AS TIMESTAMP) AS created_at,
 CAST(NULL AS TIMESTAMP) AS last_login FROM users"""))
def s7(spark, sf):
    users = fixture(spark, sf, "users").withColumn("password_hash", F.lit("x"))
    return S.load_operations(spark, {"users": users})["users"]


# the other operations tables, with a secret column that must not be read, and the sheets of S6
_OPS = {
    "attendance": ("""SELECT event_id AS id, user_id AS employee_id, event_type AS employee_name, ts AS check_in, ts AS created_at,
 'Present' AS status, 'x' AS nonce FROM {events}""",
                   """SELECT CAST(id AS VARCHAR) AS id, CAST(employee_id AS VARCHAR) AS employee_id, employee_name, check_in,
 CAST(NULL AS TIMESTAMP) AS check_out, status, created_at FROM src"""),
    "plans": ("SELECT p_partkey AS id, p_size AS validity_days, p_size * 2 AS total_washes, 'x' AS note FROM {part}",
              "SELECT CAST(id AS INTEGER) AS id, CAST(validity_days AS INTEGER) AS validity_days, CAST(total_washes AS INTEGER) AS total_washes FROM src"),
    "memberships": ("""SELECT c_custkey AS id, c_custkey AS customer_id, c_nationkey AS plan_id, DATE '2024-05-06' AS expiry_date,
 c_nationkey AS remaining_washes FROM {customer}""",
                    """SELECT id, customer_id, CAST(plan_id AS INTEGER) AS plan_id, expiry_date, CAST(remaining_washes AS INTEGER) AS remaining_washes FROM src"""),
    "customer_otps": ("""SELECT event_id AS id, lpad(CAST(user_id AS STRING),10,'9') AS phone, 'manage_booking' AS purpose, 1 AS attempts,
 event_id % 2 = 0 AS consumed, ts AS created_at, 'secret' AS code_hash FROM {events}""",
                      """SELECT id, phone, purpose, attempts, consumed, CAST(NULL AS TIMESTAMP) AS expires_at, created_at,
 CAST(NULL AS TIMESTAMP) AS last_sent_at FROM src"""),
    "site_settings": ("SELECT p_partkey % 2 = 0 AS id, p_brand AS primary_color, p_type AS tagline FROM {part}",
                      """SELECT id, primary_color, CAST(NULL AS VARCHAR) AS accent_color, CAST(NULL AS VARCHAR) AS text_color,
 CAST(NULL AS VARCHAR) AS hero_image, CAST(NULL AS VARCHAR) AS gallery_json, tagline, CAST(NULL AS TIMESTAMP) AS updated_at FROM src"""),
}


def _ops(spark, sf, name):
    src = adapted(spark, sf, _OPS[name][0])
    return S.load_operations(spark, {name: src})[name]


for _name, (_src, _sql) in _OPS.items():
    register(f"s7_load_{_name}", f"WITH src AS ({duck_text(_src)}) {_sql}")(lambda spark, sf, name=_name: _ops(spark, sf, name))


_SHEET_SQL = """SELECT id, name, description,
 CAST(json_object('bike', bike, 'hatchback', hatchback, 'sedan', sedan, 'suv', suv) AS VARCHAR) AS prices, created_at, updated_at,
 row_number() OVER (ORDER BY created_at ASC NULLS LAST, id) - 1 AS place FROM stamped"""
_STAMPED = """SELECT id, name, description, bike, hatchback, sedan, suv,
 CASE WHEN id % 5 <> 0 THEN CAST('2023-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * (id % 100) END AS created_at, updated_at
FROM price_sheet"""


def _sheet(spark, sf, which):
    sheet = fixture(spark, sf, "price_sheet").withColumn("created_at", F.expr(
        "CASE WHEN id % 5 <> 0 THEN CAST('2023-01-01 00:00:00' AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(id % 100 AS INT)) END"))
    out = S.load_price_sheets(spark, which, **{which: sheet})[which]
    return in_place(out).withColumn("prices", F.to_json("prices", _J))


for _which in ("packages", "alacarte"):
    register(f"s6_{_which}_sheet", sql_with(["price_sheet"], _SHEET_SQL, stamped=_STAMPED))(
        lambda spark, sf, which=_which: _sheet(spark, sf, which))


# ---- W2 and the intake job (E2) ------------------------------------------------
IDS_SQL = "SELECT DISTINCT order_id AS id FROM change_requests"


def _ids(spark, sf):
    return fixture(spark, sf, "change_requests").select("order_id")


@register("w2_next_free_id", sql_with(["change_requests"], """
SELECT min(c) AS id FROM (SELECT 1 AS c UNION ALL SELECT id + 1 FROM ids) x
WHERE c >= 1 AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.id = x.c)""", ids=IDS_SQL))
def w2(spark, sf):
    return I.next_free_ids(_ids(spark, sf), 1)


@register("w2_next_free_ids_many", sql_with(["change_requests"], """
SELECT s AS id FROM range(1, (SELECT COALESCE(max(id), 0) FROM ids) + 5002) t(s)
WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.id = t.s) ORDER BY s LIMIT 5000""", ids=IDS_SQL))
def w2b(spark, sf):
    return I.next_free_ids(_ids(spark, sf), 5000)


@register("w2_next_free_ids_large_path", sql_with(["change_requests"], """
SELECT s AS id FROM range(1, (SELECT COALESCE(max(id), 0) FROM ids) + 5002) t(s)
WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.id = t.s) ORDER BY s LIMIT 5000""", ids=IDS_SQL))
def w2c(spark, sf):
    return I.next_free_ids(_ids(spark, sf), 5000, chunk=1000)


E2_NOW = "2024-01-30 12:00:00"
E2_CTES = {
    "clean": P19_SQL,
    "offers": """
SELECT name AS svc, 'bike' AS k, bike AS base FROM catalog WHERE visible IS DISTINCT FROM false AND bike IS NOT NULL UNION ALL
SELECT name, 'sedan', sedan FROM catalog WHERE visible IS DISTINCT FROM false AND sedan IS NOT NULL UNION ALL
SELECT name, 'suv', suv FROM catalog WHERE visible IS DISTINCT FROM false AND suv IS NOT NULL""",
    "priced": """
SELECT c.*, o.base + CASE WHEN c.visit_place = 'Home Visit' THEN 50 ELSE 0 END AS price FROM clean c JOIN offers o
 ON c.service = o.svc AND (CASE WHEN c.vehicle = 'Bike' THEN 'bike' WHEN c.vehicle = 'SUV' THEN 'suv' ELSE 'sedan' END) = o.k
WHERE c.reject_reason IS NULL""",
    "ids": IDS_SQL,
    "free": """SELECT s AS id, row_number() OVER (ORDER BY s) AS rn FROM range(1, (SELECT max(id) FROM ids) + 1 +
 (SELECT COUNT(*) FROM priced)) t(s) WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.id = t.s)""",
}


@register("e2_intake_accepted", sql_with(["raw_requests", "catalog", "change_requests"], f"""
SELECT f.id AS order_id, p.name, p.phone, p.vehicle, p.service, p."date", p."time", p.visit_place, 'New' AS status,
 p.address, p.price, TIMESTAMP '{E2_NOW}' AS created_at
FROM (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM priced) p JOIN free f USING (rn)""", **E2_CTES))
def e2(spark, sf):
    from washbay.plans.intake import intake
    return intake(fixture(spark, sf, "raw_requests"), fixture(spark, sf, "catalog"), _ids(spark, sf), E2_NOW,
                  persist=False)["accepted"]


@register("e2_intake_rejected", sql_with(["raw_requests", "catalog"], """
SELECT seq, reject_reason FROM clean WHERE reject_reason IS NOT NULL UNION ALL
SELECT c.seq, c.service || ' not available for ' || c.vehicle FROM clean c WHERE c.reject_reason IS NULL
 AND NOT EXISTS (SELECT 1 FROM offers o WHERE c.service = o.svc
   AND (CASE WHEN c.vehicle = 'Bike' THEN 'bike' WHEN c.vehicle = 'SUV' THEN 'suv' ELSE 'sedan' END) = o.k)""",
                                         clean=P19_SQL, offers=E2_CTES["offers"]))
def e2b(spark, sf):
    from washbay.plans.intake import intake
    return intake(fixture(spark, sf, "raw_requests"), fixture(spark, sf, "catalog"), _ids(spark, sf), E2_NOW,
                  persist=False)["rejected"]
