"""User lookups in set form (J4–J7). Where the reference took "any first row"
(``LIMIT 1`` without ORDER BY) we take the smallest id, so results are stable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _first_user_per(users: DataFrame, key: str, cols=("id", "name")) -> DataFrame:
    """One row per ``key`` value: the user with the smallest id (min over a struct,
    a partial aggregate, so a popular key never gathers its rows in one task)."""
    pick = F.min(F.struct(*[F.col(c) for c in cols])).alias("_u")
    return users.filter(F.col(key).isNotNull()).groupBy(key).agg(pick).select(key, "_u.*")


# J4
def known_employees(events: DataFrame, users: DataFrame, key: str = "username"):
    """(ok, unknown): events whose username belongs to a user with role employee,
    with that user's id and name attached; the rest are unknown."""
    staff = _first_user_per(users.filter(F.col("role") == F.lit("employee")), key)
    staff = staff.select(key, F.col("id").alias("employee_id"), F.col("name").alias("employee_name"))
    ok = events.join(staff, key, "inner")
    unknown = events.join(staff, key, "left_anti")
    return ok, unknown


# J5
def owned_changes(changes: DataFrame, bk: DataFrame, keys=("order_id", "phone"), bucketed: bool = False):
    """(found, not_found): changes whose (order_id, phone) match a booking.

    ``bucketed``: ``bk`` is bucketed by ``keys[0]`` (``store_bucketed``). Then that key alone is
    the join key, so only the changes move to the bookings' buckets, and the other keys are
    compared on the pairs that meet (as two bounds, which the planner keeps out of the join
    keys)."""
    k = bk.select(*keys).filter(F.col(keys[0]).isNotNull())
    if bucketed:
        c, b = changes.alias("c"), k.alias("b")
        on = F.col(f"c.{keys[0]}") == F.col(f"b.{keys[0]}")
        for x in keys[1:]:
            on = on & (F.col(f"c.{x}") >= F.col(f"b.{x}")) & (F.col(f"c.{x}") <= F.col(f"b.{x}"))
        return c.join(b, on, "left_semi"), c.join(b, on, "left_anti")
    return changes.join(k, list(keys), "left_semi"), changes.join(k, list(keys), "left_anti")


# J6
def resolve_login_key(events: DataFrame, users: DataFrame, key: str = "login") -> DataFrame:
    """Attach the user whose phone OR username equals the event's key (smallest id
    when several match). Two equi joins + union instead of one OR join, which
    Spark could only run as a nested loop."""
    by_phone = _first_user_per(users, "phone", ("id",)).select(F.col("phone").alias("_k"), "id")
    by_name = _first_user_per(users, "username", ("id",)).select(F.col("username").alias("_k"), "id")
    ev = events.select("seq", key)
    hits = (ev.join(by_phone, ev[key] == by_phone["_k"]).select("seq", "id")
              .unionByName(ev.join(by_name, ev[key] == by_name["_k"]).select("seq", "id")))
    best = hits.groupBy("seq").agg(F.min("id").alias("user_id"))
    return events.join(best, "seq", "left")


# J7
def register_missing(phones: DataFrame, users: DataFrame, phone: str = "phone") -> DataFrame:
    """New customer rows for distinct non-empty phones that no user has yet."""
    new = (phones.select(F.col(phone)).filter(F.col(phone).isNotNull() & (F.col(phone) != F.lit("")))
                 .distinct().join(users.select(phone), phone, "left_anti"))
    return new.select(F.lit("Customer").alias("name"), phone, F.lit("customer").alias("role"),
                      F.lit(True).alias("is_active"))
