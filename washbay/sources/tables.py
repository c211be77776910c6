"""Scans and sinks (S1–S7) into/out of the canonical schemas.

Sources accept a parquet path, a DataFrame, or JDBC options. JDBC reads are split
by a numeric partition column so a large table is read by many tasks in parallel
instead of one connection.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from washbay.functions.columns import WASH_CENTER
from washbay.operators.nested import catalog_as_packages, with_price_struct
from washbay.operators.filters import ntz, visible_offers
from washbay.operators.lists import catalog_order, sheet_order
from washbay.plans.staging import staged

BOOKINGS = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("phone", T.StringType()), T.StructField("vehicle", T.StringType()),
    T.StructField("service", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("time", T.StringType()), T.StructField("visit_place", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("address", T.StringType()),
    T.StructField("price", T.IntegerType()), T.StructField("created_at", T.TimestampNTZType()),
])

def visit_day():
    """The folder of a booking: its date, NULL for text that is no date."""
    return F.nullif(F.col("date"), F.lit("")).try_cast("date").alias("visit_day")


def _catalog_defaults():
    return {"position": F.lit(None).cast("int"), "visible": F.lit(True),
            "description": F.lit(""), "updated_at": F.lit(None).cast("timestamp_ntz")}

OPERATION_SCHEMAS = {
    "users": "id string, name string, phone string, username string, role string, is_active boolean, "
             "created_at timestamp_ntz, last_login timestamp_ntz",
    "attendance": "id string, employee_id string, employee_name string, check_in timestamp_ntz, "
                  "check_out timestamp_ntz, status string, created_at timestamp_ntz",
    "plans": "id int, validity_days int, total_washes int",
    "memberships": "id bigint, customer_id bigint, plan_id int, expiry_date date, remaining_washes int",
    "customer_otps": "id bigint, phone string, purpose string, attempts int, consumed boolean, "
                     "expires_at timestamp_ntz, created_at timestamp_ntz, last_sent_at timestamp_ntz",
    "site_settings": "id boolean, primary_color string, accent_color string, text_color string, "
                     "hero_image string, gallery_json string, tagline string, updated_at timestamp_ntz",
}


def read_source(spark: SparkSession, src, schema=None, merge_schema: bool = False) -> DataFrame:
    """``src``: DataFrame, parquet path, or dict of JDBC options (``url``, ``dbtable``,
    and for a parallel read ``partitionColumn``/``lowerBound``/``upperBound``/``numPartitions``)."""
    if isinstance(src, DataFrame):
        return src
    if isinstance(src, dict):
        return spark.read.format("jdbc").options(**{k: str(v) for k, v in src.items()}).load()
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if merge_schema:
        r = r.option("mergeSchema", "true")
    return r.parquet(src)


def _col_or_null(df: DataFrame, name: str, dtype: T.DataType):
    return (F.col(name) if name in df.columns else F.lit(None)).try_cast(dtype).alias(name)


# S1
def load_bookings(spark: SparkSession, src, dialect: str = "staff") -> DataFrame:
    """Either bookings table in the canonical schema. ``staff`` tables store the
    place in ``visit``; ``web`` tables store the status there and may carry one
    ``datetime`` column instead of text date/time. The partition column ``visit_day`` of
    ``append_bookings`` is carried along as a DATE, so a filter on it prunes partitions."""
    df = read_source(spark, src)
    if dialect not in ("staff", "web"):
        raise ValueError("dialect must be 'staff' or 'web'")
    if "visit" in df.columns:
        df = df.withColumnRenamed("visit", "visit_place" if dialect == "staff" else "status")
    if "id" in df.columns and "order_id" not in df.columns:
        df = df.withColumnRenamed("id", "order_id")
    if "datetime" in df.columns:
        ts = F.col("datetime").cast("timestamp_ntz").cast("string")
        if "date" not in df.columns:
            df = df.withColumn("date", F.substring(ts, 1, 10))
        if "time" not in df.columns:
            df = df.withColumn("time", F.substring(ts, 12, 5))
    day = [F.col("visit_day").try_cast("date").alias("visit_day")] if "visit_day" in df.columns else []
    return df.select(*[_col_or_null(df, f.name, f.dataType) for f in BOOKINGS.fields], *day)


# S2
def load_catalog(spark: SparkSession, src) -> DataFrame:
    """Catalogue scan; columns added late get their defaults (visible true,
    description '') also for files written before they existed."""
    df = read_source(spark, src, merge_schema=not isinstance(src, (DataFrame, dict)))
    cols = [F.col(c) for c in ("name", "bike", "sedan", "suv") if c in df.columns]
    for c, default in _catalog_defaults().items():
        if c in df.columns:
            cols.append((F.coalesce(F.col(c), default) if c in ("visible", "description") else F.col(c)).alias(c))
        else:
            cols.append(default.alias(c))
    return df.select(*cols)


# S3
def table_profile(df: DataFrame, n: int = 3, ts: str = "created_at", keys=()) -> dict:
    """Column names/types (from the schema, no data read), row count, newest rows."""
    cols = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    tie = [F.col(k).asc_nulls_last() for k in keys]
    sample = df.orderBy(F.col(ts).desc_nulls_first(), *tie).limit(n) if ts in df.columns else df.limit(n)
    return {"columns": cols, "count": df.agg(F.count(F.lit(1)).alias("rows")), "sample": sample}


# S4
def prepare_booking_rows(df: DataFrame, now) -> DataFrame:
    """Rows to append: stamped ``created_at`` (kept when given), status New,
    price 0, address '' and place Wash Center when missing."""
    out = df
    defaults = {"status": F.lit("New"), "price": F.lit(0), "address": F.lit(""),
                "visit_place": F.lit(WASH_CENTER), "created_at": ntz(now)}
    for c, d in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), d) if c in out.columns else d)
    return out.select(*[_col_or_null(out, f.name, f.dataType) for f in BOOKINGS.fields])


def append_bookings(df: DataFrame, path: str, now=None) -> DataFrame:
    """Append new bookings partitioned by visit day (an append adds files, it never
    rewrites existing partitions) and return the rows written. Text that is no date goes
    to the NULL partition. Rows are dealt by (day, part of the day's rows) first, so a day
    gets a few files and a crowded day is spread."""
    rows = prepare_booking_rows(df, now or dt.datetime.now().replace(microsecond=0))
    batch = staged(rows, "booking-batch")            # ids of the batch must not be allocated anew after the append
    store_by_day(batch, path, "append")
    return batch


def store_by_day(rows: DataFrame, path: str, mode: str) -> None:
    """Write bookings one folder per day. ``overwrite`` replaces only the folders that ``rows``
    has rows for."""
    (rows.select(*BOOKINGS.fieldNames(), visit_day())
         .hint("rebalance", "visit_day")              # a day's rows together, oversized days split
         .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("visit_day").parquet(path))


def write_keyed_log(df: DataFrame, path: str, keys=("phone", "purpose"), ts: str = "ts",
                    mode: str = "append") -> None:
    """Store an event log clustered by key, the role the (phone, purpose, created_at)
    index plays for the code handlers: one folder per event day, rows range
    partitioned and sorted by (day, keys, time), so each file covers a narrow key
    range and parquet min/max statistics let a one-key lookup skip most row groups.
    Range partitioning keeps a hot key spread over several files."""
    order = ["event_day", *keys, ts]
    (df.withColumn("event_day", F.to_date(F.col(ts)))
       .repartitionByRange(*order).sortWithinPartitions(*order)
       .write.mode(mode).partitionBy("event_day").parquet(path))


def store_bucketed(df: DataFrame, table: str, path: str, key: str = "order_id", buckets: int | None = None) -> DataFrame:
    """Store ``df`` as a table bucketed and sorted by ``key``, one file a bucket, and return it.
    Batches that join it on the key (J5, M3-M7) shuffle their own rows into its buckets; the
    table itself is not shuffled again. ``buckets``: as many tasks as its joins shall have
    (default: the session's shuffle partitions)."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, key).write.mode("overwrite").option("path", path)
       .bucketBy(n, key).sortBy(key).saveAsTable(table))
    return spark.table(table)


def write_outcomes(df: DataFrame, path: str, reason: str = "reject_reason", mode: str = "append") -> dict[str, int]:
    """Write accepted and rejected rows of one tagged DataFrame in ONE job, as
    ``outcome=accepted`` / ``outcome=rejected`` folders (one scan, not two), and return
    how many rows of each were written, counted by that job as it wrote them."""
    tagged = df.withColumn("outcome", F.when(F.col(reason).isNull(), F.lit("accepted")).otherwise(F.lit("rejected")))
    return _written(tagged, lambda w: w.mode(mode).partitionBy("outcome").parquet(path),
                    accepted=F.count_if(F.col("outcome") == "accepted"), rejected=F.count_if(F.col("outcome") == "rejected"))


def _written(df: DataFrame, write, **metrics) -> dict[str, int]:
    """Run ``write`` on the frame's writer; ``metrics`` are observed by the writing job."""
    seen = Observation()
    write(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]).write)
    return {name: seen.get[name] for name in metrics}


# S5
def prepare_customer_rows(df: DataFrame) -> DataFrame:
    """Customer rows as stored: every field as given."""
    return df.select(*[_col_or_null(df, c, T.StringType()) for c in ("name", "phone", "email", "vehicle_number", "vehicle_type")])


def append_customers(df: DataFrame, path: str) -> DataFrame:
    rows = prepare_customer_rows(df)
    rows.write.mode("append").parquet(path)
    return rows


def load_customers(spark: SparkSession, src) -> DataFrame:
    """Customer rows as ``append_customers`` stores them."""
    return prepare_customer_rows(read_source(spark, src))


# S6
def load_price_sheets(spark: SparkSession, which: str | None = None, catalog=None,
                      packages=None, alacarte=None, services=None) -> dict[str, DataFrame]:
    """Price sheets. ``which`` = packages / alacarte / services reads that sheet;
    the default is the visible catalogue as packages plus the a-la-carte sheet."""
    if which == "services":
        df = read_source(spark, services)
        rows = sheet_order(df.filter(F.col("active") == F.lit(True)), "services")
        return {"services": rows.drop("active")}
    if which in ("packages", "alacarte"):
        src = packages if which == "packages" else alacarte
        return {which: with_price_struct(sheet_order(read_source(spark, src), which))}
    out = {"packages": catalog_as_packages(catalog_order(visible_offers(load_catalog(spark, catalog))))}
    if alacarte is not None:
        out["alacarte"] = with_price_struct(sheet_order(read_source(spark, alacarte), "alacarte"))
    return out


# S7
def load_operations(spark: SparkSession, src: dict) -> dict[str, DataFrame]:
    """Operations tables with fixed schemas; secret columns (password and code
    hashes, nonces) are never selected."""
    out = {}
    for name, path in src.items():
        schema = T._parse_datatype_string(OPERATION_SCHEMAS[name]) if name in OPERATION_SCHEMAS else None
        df = read_source(spark, path)
        if schema is not None:
            df = df.select(*[_col_or_null(df, f.name, f.dataType) for f in schema.fields])
        out[name] = df
    return out
