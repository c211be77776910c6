"""Change batches applied to stored bookings: only the days that a batch touches are read
and rewritten.

The table is the one that ``append_bookings`` writes (one folder per ``visit_day``). A
rewrite finds the days that hold a key of the batch (a semi join over the key and partition
columns alone), applies any change operator (M3–M7) to the rows of those days, and writes
the result with dynamic partition overwrite, so all other folders keep their files. A row
whose date changes lands in another day: the rows already there are taken along. A day that
loses its last row is overwritten by an empty file.

Results are staged in the shared checkpoint folder before anything is overwritten, so a lost
executor never recomputes rows from files that are being replaced. Plain Parquet folders
have no transactions: readers can see some days before others.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from washbay.plans.staging import staged
from washbay.sources.tables import BOOKINGS, load_bookings, store_by_day, visit_day

NO_DAY = "__HIVE_DEFAULT_PARTITION__"     # fixed value: the folder of a NULL partition value


@dataclass
class Rewritten:
    """``days``: the folders that were rewritten (None: rows without a date); ``others``: what
    the change operator returned beside the table (rejected or missing requests), staged."""

    days: list[dt.date | None]
    others: list[DataFrame] = field(default_factory=list)


def in_days(days: Iterable[dt.date | None]) -> Column:
    """Rows of the given days, a filter on the partition column alone."""
    known = sorted(d for d in days if d is not None)
    cond = F.col("visit_day").isin(known) if known else F.lit(False)
    return cond | F.col("visit_day").isNull() if None in set(days) else cond


def touched_days(table: DataFrame, batch: DataFrame, key: str) -> set:
    """Days that hold a key of the batch: at most one row per folder reaches the driver."""
    hit = table.select(key, "visit_day").join(batch.select(key).distinct(), key, "left_semi").select("visit_day").distinct()
    return {r["visit_day"] for r in hit.collect()}


def rewrite_days(spark: SparkSession, path: str, batch: DataFrame, change: Callable[[DataFrame, DataFrame], object],
                 key: str = "order_id", dialect: str = "staff") -> Rewritten:
    """Apply ``change(bookings, batch)`` to the table at ``path``. ``change`` returns the new
    rows, or a tuple of these and other frames; it may change or drop rows whose ``key`` is
    in the batch and must leave all others as they are."""
    table = load_bookings(spark, path, dialect)
    touched = touched_days(table, batch, key)
    result = change(table.where(in_days(touched)), batch)
    rows, *others = result if isinstance(result, tuple) else (result,)
    stored = rows.select(*BOOKINGS.fieldNames(), visit_day())
    new = staged(stored, "rewritten-days")
    others = [staged(o, "rewrite-others") for o in others]
    landed = {r["visit_day"] for r in new.select("visit_day").distinct().collect()}
    if landed - touched:                           # rows that moved to other days join the rows there
        new = staged(new.unionByName(table.where(in_days(landed - touched)).select(*new.columns)), "rewritten-days")
    store_by_day(new, path, "overwrite")
    empty = new.drop("visit_day").limit(0)
    for day in touched - landed:
        empty.write.mode("overwrite").parquet(f"{path.rstrip('/')}/visit_day={NO_DAY if day is None else day.isoformat()}")
    return Rewritten(sorted(landed | touched, key=lambda d: d or dt.date.min), others)
