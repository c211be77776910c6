"""Prepaid wash packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.functions.columns import expiry_date
from washbay.operators.filters import ntz
from washbay.plans.keyed import keyed_row_number

# fixed values: browser-side packs (washes, months)
PACKS = [("starter", 7, 2), ("three", 15, 3), ("nine", 31, 9)]


# J3
def open_memberships(requests: DataFrame, plans: DataFrame, as_of):
    """(memberships, rejected). Attach the plan of each request: expiry = as_of + validity
    days, starting balance = the plan's washes. Requests for an unknown (or NULL) plan are
    rejected."""
    p = plans.select(F.col("id").alias("plan_id"), "validity_days", "total_washes")
    day = F.to_date(ntz(as_of))
    opened = (requests.join(p, "plan_id", "inner")
                      .select(*requests.columns, expiry_date(day, F.col("validity_days")).alias("expiry_date"),
                              F.col("total_washes").cast("int").alias("remaining_washes")))
    rejected = requests.join(p, "plan_id", "left_anti").select(*requests.columns, F.lit("plan not found").alias("reject_reason"))
    return opened, rejected


# W8
def wash_ledger(memberships: DataFrame, washes: DataFrame, key: str = "membership_id") -> DataFrame:
    """Each use takes one wash while the balance is positive, otherwise it is
    rejected; ``balance_after`` is the running balance. Since the balance only
    decreases by one per accepted use, use number rn is accepted iff rn <= balance:
    a row number per membership (skew-safe keyed scan, so one busy membership is
    spread over several tasks), no row-by-row state."""
    bal = memberships.select(F.col("id").alias(key), F.col("remaining_washes").alias("_start"))
    numbered = keyed_row_number(washes, [key], [F.col("ts").isNull(), F.col("ts"), F.col("seq")], "_rn")
    j = numbered.join(bal, key, "left")
    start = F.coalesce(F.col("_start"), F.lit(0))
    return (j.withColumn("accepted", F.col("_rn") <= start)
             .withColumn("balance_after", F.greatest(start - F.col("_rn"), F.lit(0)).cast("int"))
             .drop("_rn", "_start"))


# W9
def pack_status(memberships: DataFrame, washes: DataFrame, key: str = "membership_id") -> DataFrame:
    """used/total per pack; a use after the pack is spent is ignored, so used =
    min(uses, total); status Expired once used >= total (dates are not consulted)."""
    uses = washes.groupBy(key).agg(F.count(F.lit(1)).alias("_uses"))
    m = memberships.join(uses, memberships["id"] == uses[key], "left")
    total = F.col("total_washes")
    used = F.least(F.coalesce(F.col("_uses"), F.lit(0)), total).cast("int")
    return (m.select(F.col("id"), total.alias("total"), used.alias("used"))
             .withColumn("status", F.when(F.col("used") >= F.col("total"), F.lit("Expired")).otherwise(F.lit("Active"))))
