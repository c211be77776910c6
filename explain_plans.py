"""Write PLANS.md: the physical operator trees of the headline jobs at $BENCH_SF_DIR
(python explain_plans.py). Only the tree part of explain("formatted") is kept."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from washbay.session import get_spark  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def tree(df) -> str:
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return text.split("\n\n")[0]


def main():
    spark = get_spark(os.environ.get("CHECK_MASTER", "local[8]"), 16)
    from washbay.operators import attendance as AT, codes as CO, intake as I, packs as PK, people as PE
    from washbay.plans import reports as P
    from washbay.sources.fixtures import fixture
    bk = fixture(spark, SF_DIR, "bookings")
    ok, _ = PE.known_employees(fixture(spark, SF_DIR, "attendance_events"), fixture(spark, SF_DIR, "users"))
    jobs = {
        "A13 stats report: one grouping-sets aggregation": P.stats_aggregate(bk, "month", "1997-01", "1998-12"),
        "A14 lapsed customers (shared per-customer aggregate + top-k)": P.growth_report(bk, "2001-08-01", persist=False)["inactive"],
        "J1 price bookings (join with the unpivoted catalogue)":
            I.price_bookings(fixture(spark, SF_DIR, "booking_requests"), fixture(spark, SF_DIR, "catalog")),
        "W7 attendance pairing (keyed scan: one shuffle of the rows)": AT.pair_attendance(ok),
        "W8 wash ledger (keyed row number)": PK.wash_ledger(fixture(spark, SF_DIR, "memberships"),
                                                            fixture(spark, SF_DIR, "washes")),
        "W10 cooldown (per-key replay; no hot key at this scale)": CO.code_cooldown(fixture(spark, SF_DIR, "code_requests")),
    }
    out = ["# Physical plans of the headline jobs", "",
           f"Generated by `python explain_plans.py` on `{SF_DIR}` (local[8], AQE on; the",
           "final AQE plan may coalesce partitions or switch join strategies at run time).", ""]
    for title, df in jobs.items():
        out += [f"## {title}", "", "```", tree(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
