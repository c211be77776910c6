"""Staff attendance pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.plans.keyed import Scan, keyed_scan


# W7
def clock_events(events: DataFrame):
    """(valid, rejected): events whose type is neither IN nor OUT are rejected."""
    ok = F.coalesce(F.col("type").isin("IN", "OUT"), F.lit(False))
    return events.filter(ok), events.filter(~ok).withColumn("reject_reason", F.lit("invalid type"))


def pair_attendance(events: DataFrame, key: str = "employee_id") -> DataFrame:
    """One attendance row per clock-in: it is closed (Completed) by the first later
    clock-out of the same employee, which closes *every* open row at once (two INs
    then one OUT give two rows with the same check_out); no later OUT → Present.
    ``events``: seq, ts, employee_id, employee_name, type ('IN'/'OUT'; others have no
    effect here, ``clock_events`` reports them)."""
    out_ts = F.when(F.col("type") == F.lit("OUT"), F.col("ts"))
    scanned = keyed_scan(events, [key], ["ts", "seq"], [Scan("_next_out", "next", out_ts, inclusive=False)])
    return (scanned.filter(F.col("type") == F.lit("IN"))
                   .select(F.col("seq").alias("attendance_id"), F.col(key).alias("employee_id"),
                           "employee_name", F.col("ts").alias("check_in"),
                           F.col("_next_out").alias("check_out"),
                           F.when(F.col("_next_out").isNull(), F.lit("Present"))
                            .otherwise(F.lit("Completed")).alias("status"),
                           F.col("ts").alias("created_at")))
