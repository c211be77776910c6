"""Batch jobs from the command line (spark-submit washbay/cli.py <job> ...).

Each job reads canonical tables from parquet (or anything ``read_source`` takes),
runs the operators and writes every output as parquet under ``--out/<part>``:

  stats       --bookings P [--group month] [--from X] [--to Y]      (A13)
  growth      --bookings P --as-of DAY                              (A7–A10)
  owner       --bookings P --attendance P --as-of DAY               (A11, A12, lists)
  intake      --requests P --catalog P --bookings P [--now TS]      (E2: clean, price, ids)
  attendance  --events P --users P                                  (J4 + W7)
  cooldown    --requests P [--cooldown 60]                          (W10)
  codes       --requests P --verifications P [--as-of TS]           (W10 → J8 → W11, W12)
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from washbay.session import get_spark  # noqa: E402
from washbay.sources.tables import load_bookings, load_catalog, read_source  # noqa: E402


def _write(parts: dict, out: str) -> None:
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(os.path.join(out, name))


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="washbay")
    ap.add_argument("job", choices=["stats", "growth", "owner", "intake", "attendance", "cooldown", "codes"])
    ap.add_argument("--out", required=True)
    for opt in ("bookings", "attendance", "requests", "catalog", "events", "users", "verifications"):
        ap.add_argument(f"--{opt}")
    ap.add_argument("--dialect", default="staff", choices=["staff", "web"])
    ap.add_argument("--group", default="month")
    ap.add_argument("--from", dest="from_")
    ap.add_argument("--to")
    ap.add_argument("--as-of", dest="as_of", default=dt.date.today().isoformat())
    ap.add_argument("--now", default=dt.datetime.now().replace(microsecond=0).isoformat(sep=" "))
    ap.add_argument("--cooldown", type=int, default=60)
    ap.add_argument("--master")
    a = ap.parse_args(argv)

    spark = get_spark(a.master)
    from washbay.operators import attendance as AT, codes as CO, people as PE
    from washbay.plans import reports as P
    from washbay.plans.intake import intake

    if a.job == "stats":
        parts = P.stats_report(load_bookings(spark, a.bookings, a.dialect), a.group, a.from_, a.to)
    elif a.job == "growth":
        parts = P.growth_report(load_bookings(spark, a.bookings, a.dialect), a.as_of)
    elif a.job == "owner":
        parts = P.owner_report(load_bookings(spark, a.bookings, a.dialect), read_source(spark, a.attendance), a.as_of)
    elif a.job == "intake":
        bk = load_bookings(spark, a.bookings, a.dialect)
        parts = intake(read_source(spark, a.requests), load_catalog(spark, a.catalog), bk, a.now)
    elif a.job == "attendance":
        ok, unknown = PE.known_employees(read_source(spark, a.events), read_source(spark, a.users))
        parts = {"attendance": AT.pair_attendance(ok), "unknown": unknown}
    elif a.job == "cooldown":
        parts = {"requests": CO.code_cooldown(read_source(spark, a.requests), a.cooldown)}
    else:
        codes = CO.issued_codes(read_source(spark, a.requests), a.cooldown)
        outcomes = CO.code_outcomes(read_source(spark, a.verifications), codes)
        parts = {"codes": codes, "outcomes": outcomes, "status": CO.code_status(codes, outcomes, a.as_of)}
    _write(parts, a.out)


if __name__ == "__main__":
    main()
