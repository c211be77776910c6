"""Skew-safe ordered scans per key: running sums/maxes and carried values.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of one key to one
task, so a key holding a third of the rows would run on one core. ``keyed_scan``
first looks for such keys with a mergeable frequency sketch of the key hashes
(``approx_top_k``: a bounded summary per task, merged as a partial aggregate; one read of
the key columns alone when the scan is set up). A key is heavy if it holds at least a
piece's share of the rows and ``HOT_ROWS`` of them; the sketch misses none of these, and a
key that it reports wrongly is scanned the other way, with the same result.

Without heavy keys the scan is the plain window: one read, one shuffle. Scans over the whole
table (no keys) sort it once into ranges of the order (``in_ranges``, staged); a range is a
piece, and only the pieces' totals (a row each) are carried on. Otherwise the heavy rows are cut:

1. a deterministic sample of their (key, order) tuples (a hash condition whose rate
   follows from the row count, about ``SAMPLE`` rows per piece) gives the piece borders, a
   scalar subquery;
2. every heavy row gets its piece, a pure expression of (key, order), all others piece 0,
   and each scan is a window on (key, piece): one shuffle for all rows, and a heavy key
   is several balanced window groups;
3. only the keys that hold a border (at most one per border) are summarised per piece by a
   partial aggregate, those summaries are scanned in piece order, and the carried values
   broadcast back (at most 2 x pieces rows, whatever the number of keys).

The result equals the per-key window over the whole key. Spec kinds:

* ``sum`` / ``max``  running aggregate up to the row (``inclusive``) or before it;
* ``last``           the last non-NULL value at/before the row (forward fill);
* ``next``           the first non-NULL value at/after the row (backward fill).

``order`` is ascending with NULLs first; for NULLs last put ``col.isNull()`` before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from washbay.plans.staging import staged
from washbay.session import ensure_checkpoint_dir

U_PREC = Window.unboundedPreceding
SAMPLE = 32          # sampled tuples per piece
HOT_ROWS = 1 << 17   # a window group below this size is no burden for one task
TRACKED = 16         # sketch counters per piece
MOST_TRACKED = 1_000_000     # fixed value: what the sketch allows


def frozen_layout(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder, for iterative algorithms that
    read them in every round (reliable, so a lost executor does not recompute them)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_ranges(df: DataFrame, order: list, pieces: int | None = None) -> DataFrame:
    """``df`` sorted by ``order`` into ranges (a task each; ``pieces``: how many to aim for), with
    ``_pid``, a range's number in their order, and ``_nth``, a row's place in its range from 0.
    Staged: the numbers stay as they are, and what reads them does not plan ``df`` again."""
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    ranges = df.repartitionByRange(pieces, *by).sortWithinPartitions(*by) if pieces else df.orderBy(*by)
    rows = staged(ranges.withColumn("_m", F.monotonically_increasing_id()), "ranges")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.shiftright("_m", 33).cast("int").alias("_pid"),
                       F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth"))


@dataclass
class Scan:
    out: str
    kind: str            # sum | max | last | next
    expr: Column
    inclusive: bool = True


def heavy_keys(df: DataFrame, keys: list[str], pieces: int, hot_rows: int | None = None) -> list[int]:
    """Hashes (``xxhash64`` of the key columns) of all keys with at least 1/pieces of the rows
    and ``hot_rows`` of them, and perhaps of some a little below that.

    The sketch keeps ``TRACKED`` counters per piece, so a count is off by at most
    3.5 / TRACKED of a piece's share: no such key is missed, and fewer than 2 x pieces
    keys come near enough to be reported with them."""
    tracked = min(TRACKED * pieces, MOST_TRACKED)
    top = df.select(F.xxhash64(*keys).alias("k")).agg(
        F.expr(f"approx_top_k(k, {min(2 * pieces, tracked)}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    least = max(HOT_ROWS if hot_rows is None else hot_rows, top["n"] / pieces) * (1 - 3.5 / TRACKED)
    return [r["item"] for r in top["top"] or [] if r["count"] >= least]


class Pieces:
    """How the rows of ``df`` are cut for scans over (keys, order): ``heavy`` holds the hashes
    of the heavy keys. One object serves several scans over frames that still hold these columns."""

    def __init__(self, df: DataFrame, keys: list[str], order: list, pieces: int | None = None, hot_rows: int | None = None):
        self.keys = keys
        self.order = [F.col(o) if isinstance(o, str) else o for o in order]
        self.n = n = max(2, pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        self.heavy = heavy_keys(df, keys, n, hot_rows)
        if self.plain:
            return
        parts = [F.col(k) for k in keys] + self.order
        # keys as a struct of their own: NULL keys compare like values
        self.key = F.struct(F.lit(0).alias("x"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
        self.tuple = F.struct(self.key.alias("k"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(self.order)]).alias("o"))
        hot = df.where(self.is_heavy)
        rate = F.greatest(F.lit(1), F.floor(hot.agg(F.count(F.lit(1))).scalar() / F.lit(n * SAMPLE)).cast("bigint"))
        sample = hot.where(F.pmod(F.xxhash64(*parts), rate) == 0).select(self.tuple.alias("t")).distinct()
        self.borders = (sample.agg(F.array_sort(F.collect_list("t")).alias("s"))       # about n * SAMPLE tuples
                        .select(F.expr(f"""array_distinct(transform(filter(sequence(1, {n - 1}), i -> size(s) > 0),
                                           i -> s[cast(i * size(s) div {n} as int)]))""").alias("b")))

    @property
    def plain(self) -> bool:
        """No key needs cutting."""
        return not self.heavy

    @property
    def is_heavy(self) -> Column:
        return F.xxhash64(*self.keys).isin(self.heavy)

    def tag(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_pid``, the number of borders at or before a heavy row (0 for others),
        and ``_split``, whether the row's key holds a border."""
        width = max(2, round(self.n ** 0.5))             # borders are counted in two steps

        def reached(i) -> Column:
            return F.coalesce(F.get("_b", i) <= F.col("_t"), F.lit(False)).cast("int")

        coarse = sum((reached(F.lit(i)) for i in range(width - 1, self.n - 1, width)), F.lit(0))
        fine = sum((reached(F.col("_from") + j) for j in range(width - 1)), F.col("_from"))
        mine = [F.coalesce(F.get("_b", i)["k"] == F.col("_t")["k"], F.lit(False)) for i in (F.col("_pid") - 1, F.col("_pid"))]
        split = F.when(F.col("_pid") > 0, mine[0]).otherwise(F.lit(False)) | mine[1]
        return (df.select("*", self.is_heavy.alias("_hot")).select("*", F.when(F.col("_hot"), self.tuple).alias("_t"), self.borders.scalar().alias("_b"))
                  .select("*", F.when(F.col("_hot"), coarse * width).otherwise(0).alias("_from"))
                  .select("*", F.when(F.col("_hot"), fine).otherwise(0).alias("_pid"))
                  .select(*[F.col(f"`{c}`") for c in df.columns], "_pid", (F.col("_hot") & split).alias("_split")))


def _running(s: Scan, run, back) -> Column:
    """The scan's value within one window group."""
    v, end = s.expr, 0 if s.inclusive else -1
    if s.kind in ("sum", "max"):
        return (F.sum if s.kind == "sum" else F.max)(v).over(run.rowsBetween(U_PREC, end))
    if s.kind in ("last", "next"):    # "next" runs in reverse order: linear, unlike ... AND UNBOUNDED FOLLOWING
        return F.last(v, ignorenulls=True).over((run if s.kind == "last" else back).rowsBetween(U_PREC, end))
    raise ValueError(f"unknown scan kind {s.kind}")


def keyed_scan(df: DataFrame, keys: list[str], order: list, scans: list[Scan],
               partitions: int | None = None, pieces: Pieces | None = None, hot_rows: int | None = None) -> DataFrame:
    """``df`` with one column per scan. ``partitions``: pieces to aim for (default: the
    session's shuffle partitions); ``pieces``: heavy keys and borders to share with other
    scans; ``hot_rows``: see ``heavy_keys`` (default HOT_ROWS)."""
    scans = list(scans)
    p = (pieces or Pieces(df, keys, order, partitions, hot_rows)) if keys else None
    places = p.order if p else [F.col(o) if isinstance(o, str) else o for o in order]
    named = [f"_o_{i}" for i in range(len(places))]

    def valued(rows: DataFrame) -> DataFrame:
        return rows.select("*", *[o.alias(n) for o, n in zip(places, named)], *[s.expr.alias(f"_v_{s.out}") for s in scans])

    if not keys:
        cut = in_ranges(valued(df), named, partitions).withColumn("_split", F.lit(True))
        named = ["_nth"]
    else:
        cut = valued(df if p.plain else p.tag(df))
    held = [Scan(s.out, s.kind, F.col(f"_v_{s.out}"), s.inclusive) for s in scans]
    by = [*keys] if p and p.plain else [*keys, "_pid"]
    run = Window.partitionBy(*by).orderBy(*named)
    back = Window.partitionBy(*by).orderBy(*[F.col(n).desc() for n in named])
    zero = {s.out: F.coalesce(F.col(f"_l_{s.out}"), F.lit(0)) if s.kind == "sum" else F.col(f"_l_{s.out}") for s in scans}
    scanned = cut.select("*", *[_running(s, run, back).alias(f"_l_{s.out}") for s in held])
    if p and p.plain:
        return scanned.select(*[F.col(f"`{c}`") for c in df.columns], *[zero[s.out].alias(s.out) for s in scans])

    place, summary, carry = F.struct(*named), [], []
    per_key = (Window.partitionBy(*keys) if keys else Window).orderBy("_pid")
    per_key_back = (Window.partitionBy(*keys) if keys else Window).orderBy(F.desc("_pid"))
    for s in held:
        of, v = F.when(s.expr.isNotNull(), place), F.col(f"_s_{s.out}")
        whole = {"sum": F.sum, "max": F.max}.get(s.kind) or (lambda x, of=of, f=F.max_by if s.kind == "last" else F.min_by: f(x, of))
        summary.append(whole(s.expr).alias(f"_s_{s.out}"))
        if s.kind in ("sum", "max"):
            c = (F.sum if s.kind == "sum" else F.max)(v).over(per_key.rowsBetween(U_PREC, -1))
        else:
            c = F.last(v, ignorenulls=True).over((per_key if s.kind == "last" else per_key_back).rowsBetween(U_PREC, -1))
        carry.append(c.alias(f"_c_{s.out}"))
    runs = cut.where("_split").groupBy(*keys, "_pid").agg(*summary)          # <= 2 x pieces rows
    carried = runs.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_pid").alias("_k_pid"), *carry)

    cond = F.col("_pid") == F.col("_k_pid")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = scanned.join(F.broadcast(carried), cond, "left")
    outs = []
    for s in scans:
        c = F.col(f"_c_{s.out}")
        val = (zero[s.out] + F.coalesce(c, F.lit(0)) if s.kind == "sum"
               else F.greatest(zero[s.out], c) if s.kind == "max" else F.coalesce(zero[s.out], c))
        outs.append(val.alias(s.out))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *outs)


def keyed_row_number(df: DataFrame, keys: list[str], order: list, out: str = "rn",
                     partitions: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """1, 2, … per key in ``order`` (order must be total within a key)."""
    return keyed_scan(df, keys, order, [Scan(out, "sum", F.lit(1).cast("bigint"))], partitions, hot_rows=hot_rows)
