"""Registered queries for change batches (M1–M9) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from washbay.operators import catalog as CA
from washbay.operators import changes as CH
from washbay.plans.intake_queries import d_phone, d_text, d_trim, _MATRIX_SQL, d_parse_int
from washbay.plans.registry import ORACLES, register, sql_with
from washbay.plans.staging import staged_path
from washbay.sources import tables as S
from washbay.sources.rewrite import rewrite_days
from washbay.sources.fixtures import fixture

NOW = "2024-01-30 12:00:00"
TRUE_W, FALSE_W = "('1','true','yes','y','on')", "('0','false','no','n','off')"


def d_first_int(x):
    return f"CASE WHEN regexp_matches({x}, '[0-9]') THEN TRY_CAST(regexp_extract({x}, '([0-9]+)', 1) AS INTEGER) END"


def d_bool(x, default="true"):
    t = f"lower({d_trim(f'CAST({x} AS VARCHAR)')})"
    return f"CASE WHEN {t} IN {TRUE_W} THEN true WHEN {t} IN {FALSE_W} THEN false ELSE {default} END"


NORM_BATCH = f"""SELECT seq, {d_text('name', 100)} AS name, {d_first_int('bike')} AS bike, {d_first_int('sedan')} AS sedan,
 {d_first_int('suv')} AS suv, {d_bool('visible')} AS visible, {d_text('description', 1000)} AS description
FROM catalog_changes"""
UPSERT_CTES = {
    "nb": NORM_BATCH,
    "lastb": """SELECT *, min(seq) OVER (PARTITION BY name) AS arrival FROM nb WHERE name <> ''
 QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1""",
    "merged": f"""SELECT COALESCE(c.name, b.name) AS name, COALESCE(c.name, b.name) AS sort,
 CASE WHEN b.name IS NOT NULL THEN b.bike ELSE c.bike END AS bike, CASE WHEN b.name IS NOT NULL THEN b.sedan ELSE c.sedan END AS sedan,
 CASE WHEN b.name IS NOT NULL THEN b.suv ELSE c.suv END AS suv, c.position AS position,
 CASE WHEN b.name IS NOT NULL THEN b.visible ELSE c.visible END AS visible,
 CASE WHEN b.name IS NOT NULL THEN b.description ELSE c.description END AS description,
 CASE WHEN b.name IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE c.updated_at END AS updated_at,
 CASE WHEN c.name IS NULL THEN b.arrival END AS arrival
FROM catalog_edited c FULL OUTER JOIN lastb b ON c.name = b.name""",
    "first_seq": "SELECT min(seq) AS s FROM nb WHERE name <> ''",
}
# the first request renumbers the list with its new row; later new rows join the tail as they arrive
RELISTED = f"""
SELECT name, bike, sedan, suv, rn AS position, visible, description,
 CASE WHEN position IS DISTINCT FROM rn THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
FROM (SELECT *, CAST(row_number() OVER (ORDER BY late, position ASC NULLS LAST, CASE WHEN late THEN arrival END, sort) AS INTEGER) AS rn
      FROM (SELECT *, COALESCE(arrival > (SELECT s FROM first_seq), false) AS late FROM merged) m) r"""


@register("m1_upsert_catalog", sql_with(["catalog_edited", "catalog_changes"], RELISTED, **UPSERT_CTES))
def m1(spark, sf):
    return CA.upsert_catalog(fixture(spark, sf, "catalog_edited"), fixture(spark, sf, "catalog_changes"), NOW)[0]


@register("m1_rejected_changes", sql_with(["catalog_changes"], """
SELECT *, 'missing service name' AS reject_reason FROM nb WHERE name = ''""", nb=NORM_BATCH))
def m1b(spark, sf):
    return CA.upsert_catalog(fixture(spark, sf, "catalog_edited"), fixture(spark, sf, "catalog_changes"), NOW)[1]


# The rename fixture step by step, per part k (requests in seq order): k renames to "v2" (k % 3 = 0), to a neighbour's
# number (k % 3 = 1, refused where that name exists) or updates; then "v2" -> "v3" (k % 6 = 0); then the first name again
# to "v2", which finds no original: a new row where v2 has moved on (k % 12 = 0), an update where it stands (k % 12 = 3);
# then the first name as a new row (k % 24 = 0).
RENAME_CTES = {
    "parts": """SELECT p_partkey AS k, p_size, p_type, concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) AS nm,
 concat(p_name, ' ', CAST(p_partkey + 1 AS VARCHAR)) AS nxt FROM part""",
    "told": """SELECT *, k % 3 = 1 AND nxt IN (SELECT nm FROM parts) AS refused,
 CASE WHEN k % 6 = 0 THEN 3 WHEN k % 12 = 3 THEN 2 ELSE 1 END AS said FROM parts""",
    "merged": f"""
SELECT CASE WHEN k % 3 = 2 OR refused THEN nm WHEN k % 3 = 1 THEN nxt WHEN said = 3 THEN nm || ' v3' ELSE nm || ' v2' END AS name, nm AS sort,
 CAST(CASE WHEN refused THEN c.bike WHEN said = 3 THEN 7 WHEN said = 2 THEN 1 ELSE p_size END AS INTEGER) AS bike,
 CAST(CASE WHEN refused THEN c.sedan WHEN said = 3 THEN 8 WHEN said = 2 THEN 2 END AS INTEGER) AS sedan,
 CAST(CASE WHEN refused THEN c.suv WHEN said = 3 THEN 9 WHEN said = 2 THEN 3 ELSE p_size * 2 END AS INTEGER) AS suv, c.position,
 CASE WHEN refused THEN c.visible ELSE said <> 3 END AS visible,
 CASE WHEN refused THEN c.description WHEN said = 3 THEN 'third' WHEN said = 2 THEN 'late' ELSE p_type END AS description,
 CASE WHEN refused THEN c.updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at, CAST(NULL AS BIGINT) AS arrival
FROM told JOIN catalog_edited c ON c.name = nm
UNION ALL SELECT nm || ' v2', nm || ' v2', 1, 2, 3, NULL, true, 'late', TIMESTAMP '{NOW}', 20000000 + k FROM told WHERE k % 12 = 0
UNION ALL SELECT nm, nm, 4, 5, 6, NULL, true, 'again', TIMESTAMP '{NOW}', 30000000 + k FROM told WHERE k % 24 = 0""",
    "first_seq": "SELECT min(k) AS s FROM told WHERE NOT refused",
}


@register("m2_rename_items", sql_with(["catalog_edited"], RELISTED, **RENAME_CTES))
def m2(spark, sf):
    return CA.rename_items(fixture(spark, sf, "catalog_edited"), fixture(spark, sf, "catalog_renames"), NOW)[0]


@register("m2_rejected_renames", sql_with(["catalog_edited"], """
SELECT CAST(k AS BIGINT) AS seq, nxt AS name, CAST(p_size AS INTEGER) AS bike, CAST(NULL AS INTEGER) AS sedan, CAST(p_size * 2 AS INTEGER) AS suv,
 true AS visible, p_type AS description, 'name already in use' AS reject_reason FROM told WHERE refused
UNION ALL SELECT 40000000 + k, '', 4, 5, 6, true, 'nameless', 'missing service name' FROM told WHERE k % 40 = 0""",
                                             parts=RENAME_CTES["parts"], told=RENAME_CTES["told"]))
def m2b(spark, sf):
    return CA.rename_items(fixture(spark, sf, "catalog_edited"), fixture(spark, sf, "catalog_renames"), NOW)[1]


@register("m3_patch_rows", sql_with(["settings", "settings_patch"], f"""
SELECT s.id, COALESCE(p.primary_color, s.primary_color) AS primary_color, COALESCE(p.tagline, s.tagline) AS tagline,
 COALESCE(p.gallery_json, s.gallery_json) AS gallery_json, CASE WHEN p.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE s.updated_at END AS updated_at
FROM settings s LEFT JOIN (SELECT id, arg_max(primary_color, seq) FILTER (WHERE primary_color IS NOT NULL) AS primary_color,
  arg_max(tagline, seq) FILTER (WHERE tagline IS NOT NULL) AS tagline,
  arg_max(gallery_json, seq) FILTER (WHERE gallery_json IS NOT NULL) AS gallery_json
  FROM settings_patch GROUP BY id) p ON s.id = p.id"""))
def m3(spark, sf):
    return CH.patch_rows(fixture(spark, sf, "settings"), fixture(spark, sf, "settings_patch"), now=NOW)[0]


@register("m3_not_found", sql_with(["settings", "settings_patch"], """
SELECT p.* FROM settings_patch p WHERE NOT EXISTS (SELECT 1 FROM settings s WHERE s.id = p.id)"""))
def m3b(spark, sf):
    return CH.patch_rows(fixture(spark, sf, "settings"), fixture(spark, sf, "settings_patch"), now=NOW)[1]


# the delete batch: every ECONOMY service, plus names that do not exist (one per SMALL part)
DELETE_KEYS = """SELECT CASE WHEN p_type = 'SMALL' THEN concat('ghost ', CAST(p_partkey AS VARCHAR))
 ELSE concat(p_name, ' ', CAST(p_partkey AS VARCHAR)) END AS name FROM part WHERE p_type IN ('ECONOMY', 'SMALL')"""


def _delete_keys(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.filter(F.col("p_type").isin("ECONOMY", "SMALL")).select(
        F.when(F.col("p_type") == "SMALL", F.concat(F.lit("ghost "), F.col("p_partkey").cast("string")))
         .otherwise(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))).alias("name"))


@register("m4_delete_rows", sql_with(["catalog_edited"], f"""
SELECT name, bike, sedan, suv, rn AS position, visible, description,
 CASE WHEN position IS DISTINCT FROM rn THEN TIMESTAMP '{NOW}' ELSE updated_at END AS updated_at
FROM (SELECT *, CAST(row_number() OVER (ORDER BY position ASC NULLS LAST, name) AS INTEGER) AS rn
      FROM catalog_edited c WHERE NOT EXISTS (SELECT 1 FROM dk WHERE dk.name = c.name)) x""", dk=DELETE_KEYS))
def m4(spark, sf):
    return CH.delete_rows(fixture(spark, sf, "catalog_edited"), _delete_keys(spark, sf), "name", renumber_catalog=True, now=NOW)[0]


@register("m4_missing_keys", sql_with(["catalog"], """
SELECT DISTINCT name FROM dk WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.name = dk.name)""", dk=DELETE_KEYS))
def m4b(spark, sf):
    return CH.delete_rows(fixture(spark, sf, "catalog"), _delete_keys(spark, sf), "name")[1]


WEB_BOOKINGS = """SELECT order_id, name, phone, vehicle, service, "date", "time", CAST(NULL AS VARCHAR) AS visit_place,
 visit AS status, CAST(NULL AS VARCHAR) AS address, price, created_at FROM bookings"""


@register("m5_set_status", sql_with(["bookings", "status_events"], """
SELECT b.order_id, b.name, b.phone, b.vehicle, b.service, b."date", b."time", b.visit_place,
 COALESCE(l.st, b.status) AS status, b.address, b.price, b.created_at
FROM bk b LEFT JOIN (SELECT order_id, arg_max(CASE action WHEN 'cancel' THEN 'Cancelled' ELSE 'Completed' END, seq) AS st
                     FROM status_events WHERE action IN ('cancel', 'complete') GROUP BY order_id) l USING (order_id)""",
                                    bk=WEB_BOOKINGS))
def m5(spark, sf):
    bk = S.load_bookings(spark, fixture(spark, sf, "bookings"), "web")
    return CH.set_status(bk, fixture(spark, sf, "status_events"))[0]


def _stored(spark, sf, dialect):
    """The bookings as ``append_bookings`` stores them, one folder per visit day."""
    path = staged_path(spark, "stored-bookings")
    S.store_by_day(S.load_bookings(spark, fixture(spark, sf, "bookings"), dialect), path, "append")
    return path


@register("m5_rewritten_bookings", ORACLES["m5_set_status"])
def m5_stored(spark, sf):
    path = _stored(spark, sf, "web")
    rewrite_days(spark, path, fixture(spark, sf, "status_events"), CH.set_status)
    return S.load_bookings(spark, path).drop("visit_day")


@register("m5_rejected_actions", sql_with(["status_events"], """
SELECT *, 'invalid action' AS reject_reason FROM status_events WHERE action IS NULL OR action NOT IN ('cancel', 'complete', 'edit')"""))
def m5b(spark, sf):
    bk = S.load_bookings(spark, fixture(spark, sf, "bookings"), "web")
    return CH.set_status(bk, fixture(spark, sf, "status_events"))[1]


@register("m6_edit_bookings", sql_with(["bookings", "status_events"], """
SELECT b.order_id, b.name, b.phone, b.vehicle, b."date", b."time", b.visit_place, b.status, b.address, b.created_at,
 CASE WHEN e.order_id IS NOT NULL THEN e.service ELSE b.service END AS service,
 CASE WHEN e.order_id IS NOT NULL THEN e.price ELSE b.price END AS price
FROM bk b LEFT JOIN (SELECT order_id, price, CASE WHEN seq % 2 = 0 THEN 'Premium' END AS service FROM status_events
                     WHERE action = 'edit' QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY seq DESC) = 1) e
 USING (order_id)""", bk=WEB_BOOKINGS))
def m6(spark, sf):
    bk = S.load_bookings(spark, fixture(spark, sf, "bookings"), "web")
    ev = fixture(spark, sf, "status_events").withColumn(
        "service", F.when(F.col("seq") % 2 == 0, F.lit("Premium")))
    return CH.edit_bookings(bk, ev)


@register("m7_replace_bookings_staff", sql_with(["bookings", "replace_requests"], f"""
SELECT b.order_id,
 CASE WHEN r.order_id IS NOT NULL THEN r.name ELSE b.name END AS name,
 CASE WHEN r.order_id IS NOT NULL THEN r.phone ELSE b.phone END AS phone,
 CASE WHEN r.order_id IS NOT NULL THEN r.vehicle ELSE b.vehicle END AS vehicle,
 CASE WHEN r.order_id IS NOT NULL THEN r.service ELSE b.service END AS service,
 CASE WHEN r.order_id IS NOT NULL THEN r."date" ELSE b."date" END AS "date",
 CASE WHEN r.order_id IS NOT NULL THEN r."time" ELSE b."time" END AS "time",
 CASE WHEN r.order_id IS NOT NULL THEN r.visit ELSE b.visit_place END AS visit_place,
 b.status, CASE WHEN r.order_id IS NOT NULL THEN r.address ELSE b.address END AS address,
 CASE WHEN r.order_id IS NOT NULL THEN r.price ELSE b.price END AS price, b.created_at
FROM bk b LEFT JOIN (
 SELECT x.order_id, x.name, x.phone, x.vehicle, x.service, x."date", x."time", x.visit, x.address,
  CASE WHEN x.price IS NOT NULL AND x.price <> '' THEN {d_parse_int('x.price')}
       ELSE m.cell + CASE WHEN x.visit = 'Home Visit' THEN 50 ELSE 0 END END AS price
 FROM (SELECT seq, order_id, {d_text('name', 200)} AS name, {d_phone('phone')} AS phone,
        {d_trim("COALESCE(\"date\", '')")} AS "date", {d_trim("COALESCE(\"time\", '')")} AS "time",
        {d_trim("COALESCE(vehicle, '')")} AS vehicle, {d_trim("COALESCE(service, '')")} AS service,
        COALESCE(NULLIF({d_trim("COALESCE(visit, '')")}, ''), 'Wash Center') AS visit, {d_text('address', 500)} AS address,
        price FROM replace_requests) x
 LEFT JOIN matrix m ON x.vehicle = m.v AND x.service = m.s
 QUALIFY row_number() OVER (PARTITION BY x.order_id ORDER BY x.seq DESC) = 1) r USING (order_id)""",
                                                 bk=WEB_BOOKINGS.replace("CAST(NULL AS VARCHAR) AS visit_place", "visit AS visit_place")
                                                 .replace("visit AS status", "CAST(NULL AS VARCHAR) AS status"),
                                                 matrix=_MATRIX_SQL))
def m7(spark, sf):
    bk = S.load_bookings(spark, fixture(spark, sf, "bookings"), "staff")
    return CH.replace_bookings(bk, fixture(spark, sf, "replace_requests"), "staff")[0]


@register("m7_rewritten_bookings", ORACLES["m7_replace_bookings_staff"])
def m7_stored(spark, sf):
    path = _stored(spark, sf, "staff")
    rewrite_days(spark, path, fixture(spark, sf, "replace_requests"), CH.replace_bookings)
    return S.load_bookings(spark, path).drop("visit_day")


_STAFF_REQ = f"""SELECT x.order_id, x.seq, x.name, x.phone, x."date", x."time", x.vehicle, x.service, x.visit, x.address,
  CASE WHEN x.price IS NOT NULL AND x.price <> '' THEN {d_parse_int('x.price')}
       ELSE m.cell + CASE WHEN x.visit = 'Home Visit' THEN 50 ELSE 0 END END AS price
 FROM (SELECT seq, order_id, {d_text('name', 200)} AS name, {d_phone('phone')} AS phone,
        {d_trim("COALESCE(\"date\", '')")} AS "date", {d_trim("COALESCE(\"time\", '')")} AS "time",
        {d_trim("COALESCE(vehicle, '')")} AS vehicle, {d_trim("COALESCE(service, '')")} AS service,
        COALESCE(NULLIF({d_trim("COALESCE(visit, '')")}, ''), 'Wash Center') AS visit, {d_text('address', 500)} AS address,
        price FROM replace_requests) x
 LEFT JOIN matrix m ON x.vehicle = m.v AND x.service = m.s"""


@register("m7_staff_missing", sql_with(["bookings", "replace_requests"], """
SELECT r.*, 'booking not found' AS reject_reason FROM r WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.order_id = r.order_id)""",
                                       matrix=_MATRIX_SQL, r=_STAFF_REQ))
def m7_missing(spark, sf):
    bk = S.load_bookings(spark, fixture(spark, sf, "bookings"), "staff")
    return CH.replace_bookings(bk, fixture(spark, sf, "replace_requests"), "staff")[1]


# a customer's edit: fields cleaned, then date/time, then the offer, then the ownership are checked
CUSTOMER_CTES = {
    "bk": WEB_BOOKINGS.replace("CAST(NULL AS VARCHAR) AS visit_place", "visit AS visit_place")
                      .replace("visit AS status", "CAST(NULL AS VARCHAR) AS status"),
    "req": f"""SELECT x.seq AS order_id, x.seq,
 {d_phone("CASE WHEN x.seq % 2 = 0 THEN regexp_replace(x.phone, '^[+]91-', '') WHEN x.seq % 7 = 3 THEN 'none' ELSE x.phone END")} AS phone,
 CASE WHEN TRY_CAST(x."date" AS DATE) IS NULL THEN '' ELSE x."date" END AS "date",
 CASE WHEN {d_trim('x."time"')} = '9:30' THEN '09:30' ELSE '' END AS "time",
 {d_trim("COALESCE(x.vehicle, '')")} AS vehicle, {d_trim("COALESCE(br.service, '')")} AS service,
 {d_trim("COALESCE(NULLIF(x.visit, ''), 'Wash Center')")} AS visit_place, {d_text('x.address', 500)} AS address
FROM replace_requests x JOIN booking_requests br ON br.order_id = x.seq""",
    "offers": """
SELECT name AS svc, 'bike' AS k, bike AS base FROM catalog WHERE visible IS DISTINCT FROM false AND bike IS NOT NULL UNION ALL
SELECT name, 'sedan', sedan FROM catalog WHERE visible IS DISTINCT FROM false AND sedan IS NOT NULL UNION ALL
SELECT name, 'suv', suv FROM catalog WHERE visible IS DISTINCT FROM false AND suv IS NOT NULL""",
    "judged": """SELECT r.*, f.base + CASE WHEN r.visit_place = 'Home Visit' THEN 50 ELSE 0 END AS price,
 CASE WHEN r.phone = '' OR r.order_id = 0 THEN 'missing phone/order_id'
      WHEN r."date" = '' OR r."time" = '' THEN 'invalid date/time'
      WHEN f.svc IS NULL THEN r.service || ' not available for ' || r.vehicle
      WHEN NOT EXISTS (SELECT 1 FROM bk b WHERE b.order_id = r.order_id AND b.phone = r.phone) THEN 'booking not found' END AS reject_reason
FROM req r LEFT JOIN offers f
 ON r.service = f.svc AND (CASE WHEN r.vehicle = 'Bike' THEN 'bike' WHEN r.vehicle = 'SUV' THEN 'suv' ELSE 'sedan' END) = f.k""",
}


def _customer_requests(spark, sf):
    req = fixture(spark, sf, "replace_requests")
    svc = fixture(spark, sf, "booking_requests").select(F.col("order_id").alias("seq"), "service")
    return (req.drop("service", "order_id").join(svc, "seq")
               .withColumn("order_id", F.col("seq"))
               .withColumn("phone", F.when(F.col("seq") % 2 == 0, F.regexp_replace("phone", "^[+]91-", ""))
                           .when(F.col("seq") % 7 == 3, F.lit("none")).otherwise(F.col("phone"))))


@register("m7_replace_bookings_customer", sql_with(["bookings", "replace_requests", "booking_requests", "catalog"], """
SELECT b.order_id, b.name, b.phone,
 CASE WHEN p.order_id IS NOT NULL THEN p.vehicle ELSE b.vehicle END AS vehicle,
 CASE WHEN p.order_id IS NOT NULL THEN p.service ELSE b.service END AS service,
 CASE WHEN p.order_id IS NOT NULL THEN p."date" ELSE b."date" END AS "date",
 CASE WHEN p.order_id IS NOT NULL THEN p."time" ELSE b."time" END AS "time",
 CASE WHEN p.order_id IS NOT NULL THEN p.visit_place ELSE b.visit_place END AS visit_place,
 b.status, CASE WHEN p.order_id IS NOT NULL THEN p.address ELSE b.address END AS address,
 CASE WHEN p.order_id IS NOT NULL THEN p.price ELSE b.price END AS price, b.created_at
FROM bk b LEFT JOIN (SELECT * FROM judged WHERE reject_reason IS NULL) p USING (order_id)""", **CUSTOMER_CTES))
def m7b(spark, sf):
    bk = S.load_bookings(spark, fixture(spark, sf, "bookings"), "staff")
    return CH.replace_bookings(bk, _customer_requests(spark, sf), "customer", catalog=fixture(spark, sf, "catalog"))[0]


@register("m7_customer_rejected", sql_with(["bookings", "replace_requests", "booking_requests", "catalog"], """
SELECT * EXCLUDE (price) FROM judged WHERE reject_reason IS NOT NULL""", **CUSTOMER_CTES))
def m7c(spark, sf):
    bk = S.load_bookings(spark, fixture(spark, sf, "bookings"), "staff")
    return CH.replace_bookings(bk, _customer_requests(spark, sf), "customer", catalog=fixture(spark, sf, "catalog"))[1]


@register("m8_set_active", sql_with(["users", "employee_actions"], """
SELECT u.id, u.name, u.phone, u.username, u.role, COALESCE(a.flag, u.is_active) AS is_active
FROM users u LEFT JOIN (SELECT username, arg_max(action = 'activate', seq) AS flag FROM employee_actions
                        WHERE action IN ('suspend', 'activate') GROUP BY username) a USING (username)"""))
def m8(spark, sf):
    return CH.set_active(fixture(spark, sf, "users"), fixture(spark, sf, "employee_actions"))[0]


@register("m8_rejected_actions", sql_with(["employee_actions"], """
SELECT *, 'invalid action' AS reject_reason FROM employee_actions WHERE action NOT IN ('suspend', 'activate')"""))
def m8b(spark, sf):
    return CH.set_active(fixture(spark, sf, "users"), fixture(spark, sf, "employee_actions"))[1]


@register("m9_insert_prices", sql_with(["price_sheet", "price_inserts"], f"""
SELECT * FROM price_sheet UNION ALL
SELECT (SELECT max(id) FROM price_sheet) + row_number() OVER (ORDER BY seq) AS id, name, NULLIF(description, '') AS description,
 bike, hatchback, sedan, suv, TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at
FROM price_inserts WHERE name IS NOT NULL AND name <> ''"""))
def m9(spark, sf):
    return CH.insert_prices(fixture(spark, sf, "price_sheet"), fixture(spark, sf, "price_inserts"), NOW)[0]


@register("m9_rejected_inserts", sql_with(["price_inserts"], """
SELECT *, 'name required' AS reject_reason FROM price_inserts WHERE name IS NULL OR name = ''"""))
def m9b(spark, sf):
    return CH.insert_prices(fixture(spark, sf, "price_sheet"), fixture(spark, sf, "price_inserts"), NOW)[1]
