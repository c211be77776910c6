"""Change batches applied to tables (M3–M9): the set form of one-row UPDATE /
DELETE / INSERT requests. A batch has a ``seq`` column; the last change per key
wins (``max_by`` partial aggregates, so a hot key is pre-reduced per task). Each
operator returns the new table version plus the changes it could not apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.functions.columns import WASH_CENTER, js_trim, norm_date, norm_phone, norm_text, norm_time
from washbay.operators.catalog import _stamp, renumber
from washbay.operators.filters import ntz
from washbay.operators.intake import price_bookings, price_from_matrix
from washbay.plans.ranking import dense_index


def last_per_key(batch: DataFrame, keys, seq: str = "seq") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    others = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_r")).select(*keys, "_r.*")


# M3
def patch_rows(base: DataFrame, patch: DataFrame, key: str = "id", seq: str = "seq", now=None):
    """(patched, not_found): each field takes the newest non-NULL value any patch of
    the key gave it (a NULL field leaves the value as it was), else keeps the
    current one — the result of applying the patches one by one. Rows with a patch
    get ``updated_at`` = ``now`` where the table has that column."""
    fields = [c for c in patch.columns if c not in (key, seq, "updated_at") and c in base.columns]
    if seq in patch.columns:
        p = patch.groupBy(key).agg(F.lit(True).alias("_hit"), *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_p_{c}")
                                     for c in fields])
    else:
        p = patch.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_p_{c}") for c in fields])
    j = base.join(p, key, "left")
    new = {c: F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c) for c in fields}
    new["updated_at"] = F.when(F.col("_hit"), _stamp(now)).otherwise(F.col("updated_at")).alias("updated_at")
    out = j.select(*[new.get(c, F.col(c)) for c in base.columns])
    return out, patch.join(base.select(key), key, "left_anti")


# M4
def delete_rows(base: DataFrame, keys: DataFrame, key: str = "id", renumber_catalog: bool = False, now=None):
    """(rest, missing): keyed delete, reporting keys that were not there. A
    catalogue delete renumbers the remaining positions (and stamps moved rows)."""
    k = keys.select(key).distinct()
    rest = base.join(k, key, "left_anti")
    if renumber_catalog:
        rest = renumber(rest, now).drop("changed")
    return rest, k.join(base.select(key), key, "left_anti")


ACTIONS = {"cancel": "Cancelled", "complete": "Completed"}   # fixed values


# M5
def set_status(bk: DataFrame, events: DataFrame, key: str = "order_id"):
    """(bookings, rejected): cancel → Cancelled, complete → Completed, no guard;
    the last status event per booking wins. Unknown actions are rejected; edits
    are left to ``edit_bookings``."""
    status = F.when(F.col("action") == "cancel", F.lit(ACTIONS["cancel"])) \
              .when(F.col("action") == "complete", F.lit(ACTIONS["complete"]))
    ev = events.withColumn("_status", status)
    last = (ev.filter(F.col("_status").isNotNull()).groupBy(key)
              .agg(F.max_by("_status", "seq").alias("_new_status")))
    out = bk.join(last, key, "left").withColumn("status", F.coalesce(F.col("_new_status"), F.col("status"))) \
            .drop("_new_status")
    rejected = ev.filter(F.col("_status").isNull() & ~F.col("action").eqNullSafe("edit")).drop("_status") \
                 .withColumn("reject_reason", F.lit("invalid action"))
    return out.select(*bk.columns), rejected


# M6
def edit_bookings(bk: DataFrame, edits: DataFrame, key: str = "order_id") -> DataFrame:
    """Overwrite price and service with the last edit per booking (NULLs included,
    as the reference's UPDATE does)."""
    e = edits.filter(F.col("action") == "edit") if "action" in edits.columns else edits
    last = e.groupBy(key).agg(F.max_by(F.struct("price", "service"), "seq").alias("_e"))
    j = bk.join(last, key, "left")
    hit = F.col("_e").isNotNull()
    return j.select(*[F.when(hit, F.col(f"_e.{c}").cast(bk.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                      if c in ("price", "service") else F.col(c) for c in bk.columns])


# M7
def replace_bookings(bk: DataFrame, batch: DataFrame, mode: str = "staff", catalog: DataFrame | None = None,
                     key: str = "order_id"):
    """(bookings, rejected): overwrite the descriptive fields of a booking.
    ``staff``: fields sanitised as the admin edit does and priced by the fixed
    matrix (an explicit price wins). ``customer``: see ``customer_edits``."""
    if mode == "customer":
        return customer_edits(bk, batch, catalog, key)
    if mode != "staff":
        raise ValueError("mode must be 'staff' or 'customer'")
    b = batch.select(
        key, "seq", norm_text("name", 200).alias("name"), norm_phone("phone").alias("phone"),
        js_trim(F.coalesce(F.col("date"), F.lit(""))).alias("date"),
        js_trim(F.coalesce(F.col("time"), F.lit(""))).alias("time"),
        js_trim(F.coalesce(F.col("vehicle"), F.lit(""))).alias("vehicle"),
        js_trim(F.coalesce(F.col("service"), F.lit(""))).alias("service"),
        F.coalesce(F.nullif(js_trim(F.coalesce(F.col("visit"), F.lit(""))), F.lit("")), F.lit(WASH_CENTER)).alias("visit"),
        norm_text("address", 500).alias("address"),
        (F.col("price") if "price" in batch.columns else F.lit(None).cast("string")).alias("price"))
    b = price_from_matrix(b)
    fields = ["name", "phone", "vehicle", "service", "date", "time", "visit_place", "address", "price"]
    out = _overwritten(bk, b.withColumnRenamed("visit", "visit_place"), key, fields)
    missing = b.join(bk.select(key), key, "left_anti").withColumn("reject_reason", F.lit("booking not found"))
    return out, missing


def _overwritten(bk: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``bk`` with ``fields`` of the last edit per key."""
    last = last_per_key(edits.select(key, "seq", *fields), key).select(key, F.struct(*fields).alias("_e"))
    j = bk.join(last, key, "left")
    hit = F.col("_e").isNotNull()
    return j.select(*[F.when(hit, F.col(f"_e.{c}").cast(bk.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                      if c in fields else F.col(c) for c in bk.columns])


def customer_edits(bk: DataFrame, batch: DataFrame, catalog: DataFrame, key: str = "order_id"):
    """(bookings, rejected): a customer's own edits. Date, time, vehicle, service, place,
    address and price are overwritten; name and phone stay. A request is rejected for the
    first of: no phone or order id; a date or time that is none; a service that is hidden,
    unknown or not offered for the vehicle; a booking that is not the phone's."""
    place = F.col("visit") if "visit" in batch.columns else F.lit(None).cast("string")
    b = batch.select(
        key, "seq", norm_phone("phone").alias("phone"), norm_date("date").alias("date"), norm_time("time").alias("time"),
        js_trim(F.coalesce(F.col("vehicle"), F.lit(""))).alias("vehicle"),
        js_trim(F.coalesce(F.col("service"), F.lit(""))).alias("service"),
        js_trim(F.coalesce(F.nullif(place, F.lit("")), F.lit(WASH_CENTER))).alias("visit_place"),
        norm_text("address", 500).alias("address"))
    priced = price_bookings(b, catalog)
    own = bk.select(F.col(key).alias("_own_key"), F.col("phone").alias("_own_phone")).distinct()
    j = priced.join(own, (priced[key] == own["_own_key"]) & (priced["phone"] == own["_own_phone"]), "left")
    reason = (F.when((F.col("phone") == "") | (F.coalesce(F.col(key), F.lit(0)) == 0), F.lit("missing phone/order_id"))
               .when((F.col("date") == "") | (F.col("time") == ""), F.lit("invalid date/time"))
               .when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
               .when(F.col("_own_key").isNull(), F.lit("booking not found")))
    judged = j.withColumn("reject_reason", reason).drop("_own_key", "_own_phone")
    good = judged.filter(F.col("reject_reason").isNull())
    fields = ["date", "time", "vehicle", "service", "visit_place", "address", "price"]
    out = _overwritten(bk, good, key, fields)
    return out, judged.filter(F.col("reject_reason").isNotNull()).drop("price")


# M8
def set_active(users: DataFrame, events: DataFrame, key: str = "username"):
    """(users, rejected): suspend / activate by username, the last event wins."""
    flag = F.when(F.col("action") == "suspend", F.lit(False)).when(F.col("action") == "activate", F.lit(True))
    ev = events.withColumn("_flag", flag)
    last = ev.filter(F.col("_flag").isNotNull()).groupBy(key).agg(F.max_by("_flag", "seq").alias("_new"))
    out = users.join(last, key, "left").withColumn("is_active", F.coalesce(F.col("_new"), F.col("is_active")))
    return out.select(*users.columns), ev.filter(F.col("_flag").isNull()).drop("_flag") \
        .withColumn("reject_reason", F.lit("invalid action"))


# M9
def insert_prices(sheet: DataFrame, batch: DataFrame, now=None):
    """(sheet, rejected): new price rows get ids after the current maximum (in
    batch ``seq`` order); a missing name is rejected; an empty description is NULL."""
    ok = batch.filter(F.col("name").isNotNull() & (F.col("name") != ""))
    rejected = batch.join(ok.select("seq"), "seq", "left_anti").withColumn("reject_reason", F.lit("name required"))
    top = F.coalesce(sheet.agg(F.max("id")).scalar(), F.lit(0))
    stamp = ntz(now) if now is not None else F.current_timestamp().cast("timestamp_ntz")
    new = dense_index(ok, ["seq"], "_rn").select(
        (top + F.col("_rn")).cast(sheet.schema["id"].dataType).alias("id"), "name",
        F.nullif(F.col("description"), F.lit("")).alias("description"),
        *[F.col(c).cast(sheet.schema[c].dataType).alias(c) for c in ("bike", "hatchback", "sedan", "suv")],
        stamp.alias("created_at"), stamp.alias("updated_at"))
    return sheet.unionByName(new.select(*sheet.columns)), rejected
