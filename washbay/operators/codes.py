"""One-time-code logs (W5, W10, J8, W11, W12): throttling, as-of lookup, outcomes.

Requests, codes and verifications are event tables keyed by (phone, purpose).
Codes are the accepted requests: issued at the request time, valid for the TTL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from washbay.functions.columns import seconds_since
from washbay.operators.filters import ntz
from washbay.plans.keyed import Pieces, Scan, frozen_layout, keyed_scan
from washbay.plans.staging import staged

# fixed values of the code rules
CODE_TTL_SECONDS = 5 * 60
RESEND_COOLDOWN_SECONDS = 60
MAX_ATTEMPTS = 5
KEYS = ["phone", "purpose"]


# W5
def latest_per_key(df: DataFrame, keys=KEYS, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Newest row per key, as a partial aggregate (max_by over (ts, seq)): each task
    pre-reduces its rows, so a hot key never gathers in one task."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(F.col(ts), F.col(seq))).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def _jump(ts, acc, start: int, end: int, ref: int, limit_us: int) -> None:
    """Accept the greedy chain after ``ref`` in the sorted ts[start:end], by binary search."""
    at = start + int(np.searchsorted(ts[start:end], ref + limit_us))
    while at < end:
        acc[at] = True
        at = at + 1 + int(np.searchsorted(ts[at + 1:end], ts[at] + limit_us))


def _cooldown_partition(cooldown: int, group_cols: list[str]):
    """mapInPandas body: rows arrive sorted by (group, ts, seq). A request at least
    the cooldown after the previous request of its group is accepted whatever
    came before (a head): heads are found with vectorised numpy, and only bursts as long
    as the cooldown are walked, by binary search from one accepted request to the next. The current group, its last
    accepted and last seen times carry across Arrow batches (memory = one batch)."""
    limit_us = cooldown * 1_000_000 - 500_000      # round-half-up(diff) >= cooldown

    def run(batches):
        cur, last, seen = None, None, None         # group key, last accepted, last request (µs)
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            ts = pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            keys = [pdf[c].to_numpy(dtype=object) for c in group_cols]
            same = np.ones(n, dtype=bool)           # row i continues the group of row i-1
            for k in keys:
                same[1:] &= k[1:] == k[:-1]
            first_key = tuple(k[0] for k in keys)
            same[0] = cur is not None and first_key == cur
            prev = np.empty(n, dtype=np.int64)
            prev[1:] = ts[:-1]
            prev[0] = seen if same[0] else 0
            head = ~same | (ts - prev >= limit_us)
            acc = head.copy()
            if not same[0] or head[0]:
                opened = 0
            else:                                    # the carried group's burst goes on
                opened = int(np.argmax(head)) if head.any() else n
                _jump(ts, acc, 0, opened, last, limit_us)
            starts = opened + np.flatnonzero(head[opened:])
            ends = np.append(starts[1:], n)
            # only bursts that last at least the cooldown can accept a second request
            for a, b in zip(starts, ends):
                if b > a + 1 and ts[b - 1] - ts[a] >= limit_us:
                    _jump(ts, acc, a + 1, b, ts[a], limit_us)
            # carry the state of the batch's last group
            tail_start = n - 1
            while tail_start > 0 and same[tail_start]:
                tail_start -= 1
            accepted_tail = np.flatnonzero(acc[tail_start:])
            if len(accepted_tail):
                last = int(ts[tail_start + accepted_tail[-1]])
            elif not same[tail_start]:
                last = None
            cur = tuple(k[n - 1] for k in keys)
            seen = int(ts[n - 1])
            out = pdf.copy()
            out["accepted"] = acc
            yield out
    return run


def _null_safe_keys(left: DataFrame, right: DataFrame):
    cond = None
    for k in KEYS:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def _chain_from_heads(rows: DataFrame, cooldown: int) -> DataFrame:
    """Exact parallel form of the greedy rule for hot keys.

    nxt(i) = first request at/after ts_i + (cooldown - 0.5 s): the next request
    the rule would accept if i is accepted. Heads = requests whose previous request
    is at least ``cooldown`` earlier (always accepted). The accepted set is every
    request reachable from a head through nxt. Pointer doubling finds it with
    joins on a row number given here (unique whatever ``seq`` holds, no key skew):
    R ← R ∪ J(R), J ← J∘J, until J(R) ⊆ R, i.e. about log2(longest chain) rounds, each
    pinned by a checkpoint."""
    limit_us = cooldown * 1_000_000 - 500_000
    rows = frozen_layout(rows.withColumn("_rid", F.monotonically_increasing_id()))
    base = rows.select(*KEYS, "ts", "seq", "_rid")
    prev = keyed_scan(base, KEYS, ["ts", "seq", "_rid"], [Scan("_prev", "last", F.col("ts"), inclusive=False)])
    heads = prev.filter(F.col("_prev").isNull() | (seconds_since("_prev", "ts") >= F.lit(cooldown))) \
                .select(F.col("_rid").alias("node"))
    probes = base.select(*KEYS, F.timestamp_add("MICROSECOND", F.lit(limit_us), F.col("ts")).alias("ts"),
                         "seq", "_rid", F.lit(0).alias("_kind"))
    timeline = base.withColumn("_kind", F.lit(1)).unionByName(probes)
    scanned = keyed_scan(timeline, KEYS, ["ts", "_kind", "seq", "_rid"],
                         [Scan("_to", "next", F.when(F.col("_kind") == 1, F.col("_rid")))])
    jump = frozen_layout(scanned.filter(F.col("_kind") == 0).select(F.col("_rid").alias("node"), F.col("_to").alias("to")))
    reached = frozen_layout(heads.distinct())
    while True:
        step = reached.join(jump, "node").select(F.col("to").alias("node")).filter(F.col("node").isNotNull())
        new = frozen_layout(step.distinct().join(reached, "node", "left_anti"))
        if new.isEmpty():                                 # J(R) ⊆ R: nothing more is reachable
            break
        reached = frozen_layout(reached.unionByName(new))
        a, b = jump.alias("a"), jump.alias("b")
        jump = frozen_layout(a.join(b, F.col("a.to") == F.col("b.node"), "left")
                              .select(F.col("a.node").alias("node"), F.col("b.to").alias("to")))
    flags = reached.select(F.col("node").alias("_rid"), F.lit(True).alias("_acc"))
    out = rows.join(flags, "_rid", "left")
    return out.withColumn("accepted", F.coalesce(F.col("_acc"), F.lit(False))).drop("_rid", "_acc")


# W10
def code_cooldown(requests: DataFrame, cooldown: int = RESEND_COOLDOWN_SECONDS,
                  hot_key_rows: int = 1_000_000) -> DataFrame:
    """A request is accepted iff at least ``cooldown`` whole seconds (rounded half
    up) passed since the last *accepted* request of its (phone, purpose).

    The rule is recursive, so ``lag`` alone is wrong. Keys with at most
    ``hot_key_rows`` requests are replayed in order, one key per group, inside
    ``mapInPandas`` after a hash shuffle on the key (bounded group size, streaming
    memory). Hotter keys take the exact parallel path of ``_chain_from_heads``; both
    give the same answer, requests at one time of one key being taken in ``seq`` order."""
    if cooldown <= 0:                       # a rounded non-negative gap always passes
        return requests.withColumn("accepted", F.lit(True))
    counts = requests.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col("_n") > hot_key_rows).select(*KEYS)       # at most rows / hot_key_rows keys
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", accepted boolean"

    def replayed(rows: DataFrame) -> DataFrame:
        return (rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "ts", "seq")        # AQE sizes the shuffle
                    .mapInPandas(_cooldown_partition(cooldown, KEYS), schema))

    if hot.isEmpty():
        return replayed(requests)
    cold = requests.join(hot, _null_safe_keys(requests, hot), "left_anti")
    hot_rows = requests.join(hot, _null_safe_keys(requests, hot), "left_semi")
    return replayed(cold).unionByName(_chain_from_heads(hot_rows, cooldown).select(*requests.columns, "accepted"))


def issued_codes(requests: DataFrame, cooldown: int = RESEND_COOLDOWN_SECONDS,
                 ttl: int = CODE_TTL_SECONDS) -> DataFrame:
    """Codes = accepted requests: id (request seq), created_at, expires_at."""
    acc = code_cooldown(requests, cooldown).filter(F.col("accepted"))
    return acc.select(F.col("seq").alias("code_id"), *KEYS, F.col("ts").alias("created_at"),
                      (F.col("ts") + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"))


def _code_timeline(verifications: DataFrame, codes: DataFrame, carried: list[str]) -> DataFrame:
    """Codes (_kind 0, before verifications at a tie) and verifications (_kind 1) in one table."""
    v = verifications.select(*verifications.columns, F.lit(1).alias("_kind"),
                             *[F.lit(None).cast(codes.schema[c].dataType).alias(c) for c in carried])
    c = codes.select(*KEYS, F.col("created_at").alias("ts"), F.col("code_id").alias("seq"),
                     *[F.lit(None).cast(verifications.schema[x].dataType).alias(x)
                       for x in verifications.columns if x not in KEYS + ["ts", "seq"]],
                     F.lit(0).alias("_kind"), *carried)
    return v.unionByName(c)


CODE_COLUMNS = ["code_id", "created_at", "expires_at"]
TIMELINE = ["ts", "_kind", "seq"]


# J8
def code_as_of(verifications: DataFrame, codes: DataFrame) -> DataFrame:
    """Backward as-of join: each verification gets the newest code of its key
    issued at or before it. Both timelines are unioned and the code is carried
    forward by a skew-safe keyed scan (codes sort before verifications at a tie)."""
    u = _code_timeline(verifications, codes, CODE_COLUMNS)
    carried = keyed_scan(u, KEYS, TIMELINE, [Scan("_code", "last", F.when(F.col("_kind") == 0, F.struct(*CODE_COLUMNS)))])
    return (carried.filter(F.col("_kind") == 1)
                   .select(*verifications.columns, *[F.col(f"_code.{x}").alias(x) for x in CODE_COLUMNS]))


# W11
def code_outcomes(verifications: DataFrame, codes: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Outcome of every verification, in the reference's precedence: not found,
    already used, expired, too many attempts, invalid, ok.

    Per code, in time order: ``m`` = earlier mismatches; a row succeeds iff it
    matches, is not expired, ``m < max`` and no earlier row succeeded. Attempts
    only grow on counted mismatches, which equals min(m, max) before the first
    success, so running sums/maxes over earlier rows give the sequential answer.

    A code's rows are consecutive in its key's timeline, so every "per code" value is a
    running value of the key less the value carried from the code's own row: three scans
    that share one shuffle and one order, or one set of pieces where keys are heavy."""
    u = _code_timeline(verifications, codes, CODE_COLUMNS)
    p = Pieces(u, KEYS, TIMELINE)
    is_code = F.col("_kind") == 0
    wrong = F.when(~is_code & ~F.col("matches"), 1).otherwise(0).cast("bigint")
    s1 = keyed_scan(u, KEYS, TIMELINE, [Scan("_code", "last", F.when(is_code, F.struct(*CODE_COLUMNS))),
                                        Scan("_wrong", "sum", wrong, inclusive=False)], pieces=p)
    if not p.plain:
        s1 = staged(s1, "code-scan")            # a cut scan reads its input twice
    s2 = keyed_scan(s1, KEYS, TIMELINE, [Scan("_wrong0", "last", F.when(is_code, F.col("_wrong")))], pieces=p)
    m = F.col("_wrong") - F.col("_wrong0")
    expired = F.col("ts") > F.col("_code.expires_at")
    # per key at most one success a code counts; the newest success is this code's iff it is not older than the code's row
    cand = ~is_code & F.col("_code").isNotNull() & F.col("matches") & ~expired & (m < max_attempts)
    if not p.plain:
        s2 = staged(s2, "code-scan")
    s3 = keyed_scan(s2, KEYS, TIMELINE, [Scan("_used", "last", F.when(cand, F.col("_code.code_id")), inclusive=False)], pieces=p)
    outcome = (F.when(F.col("_code").isNull(), F.lit("not found"))
                .when(F.col("_used") == F.col("_code.code_id"), F.lit("already used"))
                .when(expired, F.lit("expired"))
                .when(m >= max_attempts, F.lit("too many attempts"))
                .when(~F.col("matches"), F.lit("invalid"))
                .otherwise(F.lit("ok")))
    return (s3.filter(~is_code)
              .select(*verifications.columns, *[F.col(f"_code.{x}").alias(x) for x in CODE_COLUMNS], outcome.alias("outcome")))


# W12
def code_status(codes: DataFrame, outcomes: DataFrame, as_of, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """State of the newest code per key at ``as_of``: consumed / expired / locked / active.
    Attempts and consumption come from the verification outcomes up to ``as_of``."""
    at = ntz(as_of)
    seen = (outcomes.filter(F.col("code_id").isNotNull() & (F.col("ts") <= at))
                    .groupBy("code_id").agg(F.count_if(F.col("outcome") == "invalid").alias("attempts"),
                                            F.max(F.col("outcome") == "ok").alias("consumed")))
    live = latest_per_key(codes.filter(F.col("created_at") <= at).withColumnRenamed("created_at", "ts")
                               .withColumn("seq", F.col("code_id")), KEYS, "ts", "seq")
    st = live.join(seen, "code_id", "left")
    attempts = F.coalesce(F.col("attempts"), F.lit(0))
    status = (F.when(F.coalesce(F.col("consumed"), F.lit(False)), F.lit("consumed"))
               .when(at > F.col("expires_at"), F.lit("expired"))
               .when(attempts >= max_attempts, F.lit("locked"))
               .otherwise(F.lit("active")))
    return st.select(*KEYS, "code_id", F.col("ts").alias("created_at"), "expires_at",
                     attempts.cast("bigint").alias("attempts"), status.alias("status"))
