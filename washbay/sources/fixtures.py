"""Adapters from the driver's test tables to the canonical service-business tables.

Each adapter is one SQL text accepted by both Spark and DuckDB. Driver tables are
written as ``{orders}``-style placeholders: Spark binds them to DataFrames through
``spark.sql(text, orders=df)`` (no global temp views), the DuckDB oracle replaces
them by the pre-registered view names. Adapters are test/bench inputs only; the
library operators take any DataFrame with the canonical columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADAPTERS: dict[str, str] = {
    # bookings: empty and impossible dates, bad times, NULL prices
    "bookings": """
SELECT o_orderkey AS order_id, c_name AS name, lpad(CAST(c_custkey AS STRING),10,'9') AS phone,
 CASE o_orderkey % 3 WHEN 0 THEN 'Bike' WHEN 1 THEN 'Hatch/Sedan' ELSE 'SUV' END AS vehicle,
 o_orderpriority AS service,
 CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 101 = 0 THEN '2000-02-31'
      ELSE substr(CAST(o_orderdate AS STRING),1,10) END AS date,
 CASE WHEN o_orderkey % 13 = 0 THEN 'noon' ELSE concat(lpad(CAST(o_orderkey % 24 AS STRING),2,'0'),':',
      lpad(CAST(o_orderkey % 60 AS STRING),2,'0')) END AS time,
 CASE o_orderstatus WHEN 'O' THEN 'New' WHEN 'F' THEN 'Completed' ELSE 'Cancelled' END AS visit,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS INT) END AS price,
 o_orderdate + INTERVAL '1' MINUTE * (o_orderkey % 1440) AS created_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    # catalog: NULL prices, NULL and tied positions, hidden items
    "catalog": """
SELECT concat(p_name,' ',CAST(p_partkey AS STRING)) AS name,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INT) END AS bike,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INT)+100 END AS sedan,
 CAST(floor(p_retailprice) AS INT)+200 AS suv,
 CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS position,
 p_partkey % 6 <> 0 AS visible, p_type AS description FROM {part}""",
    # the same list as it is edited: zero and negative positions, stamps
    "catalog_edited": """
SELECT concat(p_name,' ',CAST(p_partkey AS STRING)) AS name,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INT) END AS bike,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INT)+100 END AS sedan,
 CAST(floor(p_retailprice) AS INT)+200 AS suv,
 CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN CAST(0 - p_partkey AS INT) WHEN p_partkey % 23 = 0 THEN 0
      ELSE CAST(p_partkey AS INT) END AS position,
 p_partkey % 6 <> 0 AS visible, p_type AS description,
 CASE WHEN p_partkey % 4 <> 0 THEN CAST('2023-05-06 07:08:09' AS TIMESTAMP) END AS updated_at FROM {part}""",
    "users": """
SELECT c_custkey AS id, c_name AS name, lpad(CAST(c_custkey AS STRING),10,'9') AS phone,
 concat('u',CAST(c_custkey AS STRING)) AS username,
 CASE c_custkey % 4 WHEN 0 THEN 'employee' ELSE 'customer' END AS role, c_custkey % 9 <> 0 AS is_active
FROM {customer}""",
    "attendance_events": """
SELECT event_id AS seq, ts, concat('u',CAST(user_id AS STRING)) AS username,
 CASE event_type WHEN 'view' THEN 'IN' WHEN 'purchase' THEN 'OUT'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'BREAK' END END AS type
FROM {events} WHERE event_type IN ('view','purchase','error')""",
    # the three plans are a lookup table; memberships and washes grow with the data
    "plans": """
SELECT * FROM (VALUES (0,60,7),(1,90,15),(2,270,31)) t(id, validity_days, total_washes)""",
    "memberships": """
SELECT c_custkey AS id, CAST(c_custkey % 3 AS INT) AS plan_id,
 CASE c_custkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 15 ELSE 31 END AS remaining_washes FROM {customer}""",
    "washes": """
SELECT event_id AS seq, ts, user_id AS membership_id FROM {events} WHERE event_type='purchase'""",
    "code_requests": """
SELECT event_id AS seq, ts, lpad(CAST(user_id AS STRING),10,'9') AS phone, 'manage_booking' AS purpose
FROM {events} WHERE event_type='click'""",
    "verifications": """
SELECT event_id AS seq, ts, lpad(CAST(user_id AS STRING),10,'9') AS phone, 'manage_booking' AS purpose,
 event_id % 3 = 0 AS matches FROM {events} WHERE event_type='signup'""",
    "status_events": """
SELECT event_id AS seq, ts, event_id % 15000 AS order_id,
 CASE event_type WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'edit'
      ELSE CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'archive' END END AS action,
 CAST(floor(value) AS INT) AS price FROM {events} WHERE event_type IN ('error','purchase','click','signup')""",
    # bookings whose service is a catalogue item (or 'none'), half of them home visits
    "booking_requests": """
SELECT o_orderkey AS order_id, c_name AS name, lpad(CAST(c_custkey AS STRING),10,'9') AS phone,
 CASE o_orderkey % 3 WHEN 0 THEN 'Bike' WHEN 1 THEN 'Hatch/Sedan' ELSE 'SUV' END AS vehicle,
 CASE WHEN p_partkey IS NULL THEN 'none' ELSE concat(p_name,' ',CAST(p_partkey AS STRING)) END AS service,
 CASE o_orderkey % 2 WHEN 0 THEN 'Home Visit' ELSE 'Wash Center' END AS visit
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
LEFT JOIN {part} ON p_partkey = o_orderkey % 2100""",
    # raw booking requests with untidy text: padded names, formatted phones, ISO
    # date-times, impossible dates, 1-digit/24:00/"noon" times, empty places
    "raw_requests": """
SELECT o_orderkey AS seq, concat('  ', c_name, ' ') AS name,
 concat('+91 ', substr(lpad(CAST(c_custkey AS STRING),10,'9'),1,5), '-', substr(lpad(CAST(c_custkey AS STRING),10,'9'),6,5)) AS phone,
 CASE o_orderkey % 3 WHEN 0 THEN 'Bike' WHEN 1 THEN 'Hatch/Sedan' ELSE 'SUV' END AS vehicle,
 CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE CASE WHEN p_partkey IS NULL THEN 'none' ELSE concat(p_name,' ',CAST(p_partkey AS STRING)) END END AS service,
 CASE o_orderkey % 7 WHEN 4 THEN concat(substr(CAST(o_orderdate AS STRING),1,10),'T10:30:00')
      WHEN 5 THEN '' WHEN 6 THEN '2001-02-29' ELSE substr(CAST(o_orderdate AS STRING),1,10) END AS date,
 CASE o_orderkey % 6 WHEN 0 THEN '9:05' WHEN 1 THEN '24:00' WHEN 2 THEN ' 10:00 ' WHEN 3 THEN '20:01'
      WHEN 4 THEN 'noon' ELSE concat(lpad(CAST(o_orderkey % 24 AS STRING),2,'0'),':',lpad(CAST(o_orderkey % 60 AS STRING),2,'0')) END AS time,
 CASE o_orderkey % 4 WHEN 0 THEN 'Home Visit' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'Wash Center' END AS visit,
 CASE WHEN o_orderkey % 2 = 0 THEN concat(' ', c_mktsegment, ' street ') END AS address
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
LEFT JOIN {part} ON p_partkey = o_orderkey % 2100""",
    # staff edits priced by the fixed matrix: explicit, empty and missing prices
    "edit_requests": """
SELECT o_orderkey AS order_id,
 CASE o_orderkey % 3 WHEN 0 THEN 'Bike' WHEN 1 THEN 'Hatch/Sedan' ELSE 'SUV' END AS vehicle,
 CASE o_orderkey % 4 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Premium' WHEN 2 THEN 'Detailing' ELSE 'Polish' END AS service,
 CASE o_orderkey % 5 WHEN 0 THEN 'Home Visit' WHEN 1 THEN '' ELSE 'Wash Center' END AS visit,
 CASE o_orderkey % 6 WHEN 0 THEN CAST(floor(o_totalprice) AS STRING) WHEN 1 THEN ''
      WHEN 2 THEN concat(' ', CAST(o_orderkey % 500 AS STRING), 'rs') WHEN 3 THEN 'free' END AS price
FROM {orders}""",
    # ownership-checked changes: (order_id, phone) pairs, some not matching
    "change_requests": """
SELECT event_id AS seq, ts, event_id % 15000 AS order_id,
 lpad(CAST(CASE WHEN event_id % 4 = 0 THEN user_id ELSE user_id * 10 END AS STRING),10,'9') AS phone,
 CASE event_type WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'complete' ELSE 'edit' END AS action,
 CAST(floor(value) AS INT) AS price
FROM {events}""",
    # login attempts keyed by phone, by username or by unknown text
    "login_events": """
SELECT event_id AS seq, ts,
 CASE event_id % 3 WHEN 0 THEN lpad(CAST(user_id AS STRING),10,'9') WHEN 1 THEN concat('u',CAST(user_id AS STRING))
      ELSE concat('guest', CAST(user_id AS STRING)) END AS login
FROM {events}""",
    # site settings rows with JSON galleries, some malformed
    "settings": """
SELECT p_partkey AS id, p_brand AS primary_color, p_type AS tagline,
 CASE WHEN p_partkey % 7 = 0 THEN concat('[', p_name)
      WHEN p_partkey % 11 = 0 THEN NULL
      ELSE concat('["', p_name, '.jpg","', p_brand, '.png"]') END AS gallery_json,
 CASE WHEN p_partkey % 3 = 0 THEN CAST('2023-05-06 07:08:09' AS TIMESTAMP) END AS updated_at
FROM {part}""",
    # catalogue change batch: updates, repeated inserts per brand, blank names, messy text
    "catalog_changes": """
SELECT p_partkey AS seq,
 CASE p_partkey % 3 WHEN 1 THEN concat(p_brand, ' pack')
      ELSE CASE WHEN p_partkey % 30 = 2 THEN '  ' ELSE concat(p_name,' ',CAST(p_partkey AS STRING)) END END AS name,
 concat(CAST(p_size AS STRING), ' rs') AS bike,
 CASE WHEN p_partkey % 2 = 0 THEN 'n/a' ELSE CAST(p_partkey AS STRING) END AS sedan,
 CAST(NULL AS STRING) AS suv,
 CASE p_partkey % 4 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN NULL ELSE 'maybe' END AS visible,
 concat(' ', p_type, ' ') AS description
FROM {part}""",
    # renames: to a fresh name, to a name already taken, from a missing original
    "catalog_renames": """
SELECT p_partkey AS seq, concat(p_name,' ',CAST(p_partkey AS STRING)) AS original_name,
 CASE p_partkey % 3 WHEN 0 THEN concat(p_name,' ',CAST(p_partkey AS STRING),' v2')
      WHEN 1 THEN concat(p_name,' ',CAST(p_partkey + 1 AS STRING))
      ELSE concat(p_name,' ',CAST(p_partkey AS STRING)) END AS name,
 CAST(p_size AS STRING) AS bike, CAST(NULL AS STRING) AS sedan, CAST(p_size * 2 AS STRING) AS suv,
 'yes' AS visible, p_type AS description
FROM {part}
UNION ALL SELECT 10000000 + p_partkey, concat(p_name,' ',CAST(p_partkey AS STRING),' v2'), concat(p_name,' ',CAST(p_partkey AS STRING),' v3'),
 '7', '8', '9', 'no', 'third' FROM {part} WHERE p_partkey % 6 = 0
UNION ALL SELECT 20000000 + p_partkey, concat(p_name,' ',CAST(p_partkey AS STRING)), concat(p_name,' ',CAST(p_partkey AS STRING),' v2'),
 '1', '2', '3', 'yes', 'late' FROM {part} WHERE p_partkey % 12 IN (0, 3)
UNION ALL SELECT 30000000 + p_partkey, concat(p_name,' ',CAST(p_partkey AS STRING)), concat(p_name,' ',CAST(p_partkey AS STRING)),
 '4', '5', '6', 'yes', 'again' FROM {part} WHERE p_partkey % 24 = 0
UNION ALL SELECT 40000000 + p_partkey, concat(p_name,' ',CAST(p_partkey AS STRING)), ' ',
 '4', '5', '6', 'yes', 'nameless' FROM {part} WHERE p_partkey % 40 = 0""",
    "settings_patch": """
SELECT p_partkey AS seq, CASE WHEN p_partkey % 50 = 1 THEN p_partkey + 1000000 ELSE p_partkey END AS id,
 CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat(p_brand, '-new') END AS primary_color,
 concat('new ', p_type) AS tagline, CAST(NULL AS STRING) AS gallery_json
FROM {part}""",
    "employee_actions": """
SELECT event_id AS seq, ts, concat('u', CAST(user_id AS STRING)) AS username,
 CASE event_type WHEN 'error' THEN 'suspend' WHEN 'signup' THEN 'activate' ELSE 'promote' END AS action
FROM {events} WHERE event_type IN ('error', 'signup', 'click')""",
    "price_sheet": """
SELECT p_partkey AS id, p_name AS name, p_type AS description, CAST(p_size AS INT) AS bike,
 CAST(NULL AS INT) AS hatchback, CAST(floor(p_retailprice) AS INT) AS sedan, CAST(floor(p_retailprice) AS INT) + 50 AS suv,
 CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at
FROM {part}""",
    "price_inserts": """
SELECT c_custkey AS seq, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('pack ', c_name) END AS name,
 CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS description, c_nationkey AS bike,
 CAST(NULL AS INT) AS hatchback, CAST(floor(c_acctbal) AS INT) AS sedan, CAST(NULL AS INT) AS suv
FROM {customer}""",
    "replace_requests": """
SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 50 = 3 THEN o_orderkey + 100000000 ELSE o_orderkey * 2 END AS order_id, concat(' ', c_name, ' ') AS name,
 concat('+91-', lpad(CAST(c_custkey AS STRING),10,'9')) AS phone,
 CASE WHEN o_orderkey % 9 = 4 THEN '2024-02-31' ELSE substr(CAST(o_orderdate AS STRING),1,10) END AS date,
 CASE WHEN o_orderkey % 10 = 7 THEN 'junk' ELSE ' 9:30 ' END AS time,
 CASE o_orderkey % 3 WHEN 0 THEN 'Bike' WHEN 1 THEN 'Hatch/Sedan' ELSE 'SUV' END AS vehicle,
 CASE o_orderkey % 4 WHEN 0 THEN 'Basic' WHEN 1 THEN 'Premium' WHEN 2 THEN 'Detailing' ELSE 'Polish' END AS service,
 CASE o_orderkey % 5 WHEN 0 THEN 'Home Visit' WHEN 1 THEN '' ELSE 'Wash Center' END AS visit,
 concat(c_mktsegment, ' road') AS address,
 CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey % 900 AS STRING) END AS price
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def driver_tables(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(ADAPTERS[name])))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The canonical test table ``name`` built by Spark from the driver parquet in ``sf_dir``."""
    return adapted(spark, sf_dir, ADAPTERS[name])


def adapted(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The table of an adapter text."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_PLACEHOLDER.findall(text))}
    if "JOIN" in text:         # a small file is a large hash table: joined tables are merged, never sent through the driver
        tables = {t: df.hint("merge") for t, df in tables.items()}
    df = spark.sql(text, **tables)
    # `CAST(NULL AS TIMESTAMP)` is zoned in Spark but naive in DuckDB: keep all stamps NTZ
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
                       else F.col(f.name) for f in df.schema.fields])


def duck_sql(name: str) -> str:
    """The same adapter as DuckDB text over the driver's pre-registered views."""
    return duck_text(ADAPTERS[name])


def duck_text(text: str) -> str:
    return _PLACEHOLDER.sub(lambda m: m.group(1), text)


def with_fixtures(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({duck_sql(n)})" for n in names) + "\n"
