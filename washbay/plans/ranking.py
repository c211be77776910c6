"""Global ordering that does not funnel a table through one task.

``dense_index`` numbers rows 1..n in a total order. A window ``row_number()`` without
PARTITION BY moves every row into a single partition; here the table is sorted into ranges
(``keyed.in_ranges``), whose rows are numbered as they lie, and the totals of the ranges
(one row each) shift the numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from washbay.plans.keyed import in_ranges


def dense_index(df: DataFrame, order_cols: list, out: str = "rn",
                partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1..n following ``order_cols`` (names or Columns, ascending, NULLs first;
    must be a total order for a deterministic result)."""
    rows = in_ranges(df, order_cols, partitions)
    totals = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_pid").alias("_k_pid"), (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))     # a row per range
    return rows.join(F.broadcast(totals), F.col("_pid") == F.col("_k_pid")).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_nth") + 1).alias(out))
