"""The booking intake job (E2): clean → price → allocate order ids → rows to append.

One batch replaces the reference's per-request read-all-ids-then-insert loop, so
concurrent requests can no longer collide on an order id."""

from __future__ import annotations

from pyspark.sql import DataFrame

from washbay.operators.intake import allocate_ids, clean_bookings, price_bookings, split_outcome
from washbay.plans.staging import staged
from washbay.sources.tables import prepare_booking_rows


def intake(raw: DataFrame, catalog: DataFrame, existing: DataFrame, now,
           persist: bool = True) -> dict[str, DataFrame]:
    """``raw`` holds the request fields (name, phone, vehicle, service, date, time,
    visit, address) and a unique ``seq`` giving arrival order, which is also the
    order in which free order ids are handed out.
    ``accepted``: canonical rows ready for ``append_bookings``; ``rejected``: the
    request ``seq`` with the first failing rule (missing fields, or not offered).
    The cleaned batch is staged once (``persist``), so counting it for the id allocation
    and producing both outputs do not read and clean the requests again; the staged table
    lies in the shared checkpoint folder and needs no release."""
    cleaned = clean_bookings(raw)
    if persist:
        cleaned = staged(cleaned, "cleaned-requests")
    valid, bad = split_outcome(cleaned)
    priced = price_bookings(valid, catalog)
    ok, unpriced = split_outcome(priced)
    numbered = allocate_ids(ok, existing, order=("seq",))
    accepted = prepare_booking_rows(numbered, now)
    rejected = bad.select("seq", "reject_reason").unionByName(unpriced.select("seq", "reject_reason"))
    return {"accepted": accepted, "rejected": rejected}
