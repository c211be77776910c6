"""Booking intake (P19, J1, J2, W2): clean, price, allocate order ids.

Each step adds columns in one pass; a ``reject_reason`` column marks rows that
fail, so valid and rejected rows come out of the same scan (``split_outcome``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washbay.functions.columns import (HOME_SURCHARGE, HOME_VISIT, WASH_CENTER, home_surcharge,
                                       js_trim, norm_date, norm_phone, norm_text, norm_time,
                                       price_column_for)
from washbay.operators.nested import unpivot_prices
from washbay.plans.keyed import Scan, keyed_scan
from washbay.plans.ranking import dense_index
from washbay.plans.staging import staged

# fixed values: the staff price matrix (vehicle → service → price, None = not offered)
PRICE_MATRIX = [
    ("Bike", "Basic", 50), ("Bike", "Premium", None), ("Bike", "Detailing", None),
    ("Hatch/Sedan", "Basic", 150), ("Hatch/Sedan", "Premium", 200), ("Hatch/Sedan", "Detailing", 1500),
    ("SUV", "Basic", 200), ("SUV", "Premium", 250), ("SUV", "Detailing", 2500),
]
REQUIRED = ["name", "phone", "vehicle", "service", "date", "time"]
FEW_SERVICES = 2000                                  # a catalogue of at most so many rows is broadcast


def split_outcome(df: DataFrame, reason: str = "reject_reason"):
    """(valid, rejected) views of one tagged DataFrame."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def _reason(missing: list[tuple[str, Column]]) -> Column:
    names = F.concat_ws(",", *[F.when(cond, F.lit(n)) for n, cond in missing])
    return F.when(names != F.lit(""), F.concat(F.lit("missing "), names))


# P19
def clean_bookings(raw: DataFrame, keep=("seq",)) -> DataFrame:
    """Normalise every field of raw booking requests; ``reject_reason`` names the
    required fields that end up empty (NULL when the row is valid)."""
    place = F.coalesce(F.nullif(F.col("visit").cast("string"), F.lit("")), F.lit(WASH_CENTER)) \
        if "visit" in raw.columns else F.lit(WASH_CENTER)
    addr = F.col("address") if "address" in raw.columns else F.lit(None).cast("string")
    cleaned = raw.select(
        *[c for c in keep if c in raw.columns],
        norm_text("name", 200).alias("name"), norm_phone("phone").alias("phone"),
        norm_text("vehicle", 40).alias("vehicle"), norm_text("service", 120).alias("service"),
        norm_date("date").alias("date"), norm_time("time").alias("time"),
        norm_text(place, 40).alias("visit_place"), norm_text(addr, 500).alias("address"))
    return cleaned.withColumn("reject_reason", _reason([(c, F.col(c) == F.lit("")) for c in REQUIRED]))


# J1
def price_bookings(bk: DataFrame, catalog: DataFrame) -> DataFrame:
    """Price each booking from the catalogue row of its service and the vehicle's
    price column, plus the home-visit surcharge. Unknown, hidden (visible = false;
    NULL counts as bookable) and not-offered services get a ``reject_reason``.
    By its files' size a catalogue may look small, so its rows are counted (up to a limit)."""
    few = catalog.limit(FEW_SERVICES + 1).count() <= FEW_SERVICES
    offers = (unpivot_prices(catalog.filter(~F.coalesce(F.col("visible") == F.lit(False), F.lit(False))))
              .filter(F.col("price").isNotNull())
              .select(F.col("name").alias("_svc"), F.col("vehicle").alias("_key"),
                      F.col("price").cast("int").alias("_base")))
    # a catalogue has one row per service name (its key); should a source repeat one,
    # take the lowest price so the result does not depend on row order
    offers = offers.groupBy("_svc", "_key").agg(F.min("_base").alias("_base"))
    joined = bk.join(offers.hint("broadcast" if few else "merge"),
                     (bk["service"] == F.col("_svc")) & (price_column_for(bk["vehicle"]) == F.col("_key")), "left")
    place = F.col("visit_place") if "visit_place" in bk.columns else F.col("visit")
    return (joined.withColumn("price", F.when(F.col("_base").isNotNull(), home_surcharge(F.col("_base"), place)))
                  .withColumn("reject_reason", F.when(F.col("_base").isNull(), F.concat(
                      F.coalesce(F.col("service"), F.lit("")), F.lit(" not available for "),
                      F.coalesce(F.col("vehicle"), F.lit("")))))
                  .drop("_svc", "_key", "_base"))


def js_parse_int(c) -> Column:
    """JavaScript ``parseInt(x, 10)``: leading signed digits after white space, else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_extract(js_trim(c.cast("string")), r"^[+-]?[0-9]+", 0), F.lit("")).try_cast("int")


def price_matrix(spark) -> DataFrame:
    return spark.createDataFrame(PRICE_MATRIX, "vehicle string, service string, cell int")


# J2
def price_from_matrix(bk: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """Staff edit pricing: an explicit price wins (parsed like parseInt); otherwise
    the vehicle × service cell plus the surcharge; a missing cell gives NULL."""
    m = matrix if matrix is not None else F.broadcast(price_matrix(bk.sparkSession))      # 9 cells
    m = m.select(F.col("vehicle").alias("_v"), F.col("service").alias("_s"), F.col("cell"))
    j = bk.join(m, (bk["vehicle"] == F.col("_v")) & (bk["service"] == F.col("_s")), "left")
    given = F.col("price").cast("string")
    explicit = given.isNotNull() & (given != F.lit(""))
    place = F.coalesce(F.nullif(js_trim(F.col("visit")), F.lit("")), F.lit(WASH_CENTER))
    computed = F.col("cell") + F.when(place == F.lit(HOME_VISIT), F.lit(HOME_SURCHARGE)).otherwise(F.lit(0))
    return (j.withColumn("price", F.when(explicit, js_parse_int(given)).otherwise(computed))
             .drop("_v", "_s", "cell"))


# W2
ID_BLOCK = 1 << 16       # ids of one block share all but their last 16 bits
SPARSE = ID_BLOCK // 16  # up to this many ids, two bytes an id take no more room than the block's bitmap
PACKED_AT_ONCE = 1 << 20


def id_blocks(ids_df: DataFrame, col: str = "order_id") -> DataFrame:
    """block, taken, bits for every block of 65,536 ids (block = id >> 16) that holds a
    positive id: how many of its ids are taken, and which (a bitmap of 8 KB).

    Tasks pack the ids they read before the shuffle: a block's ids go as a bitmap, or as two
    bytes each where they are few, so what is shuffled is at most two bytes an id and a
    bitmap per task and block, whatever is repeated."""
    def bitmap(low: np.ndarray) -> bytes:
        taken = np.zeros(ID_BLOCK, dtype=bool)
        taken[low] = True
        return np.packbits(taken).tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit():
            ids = np.unique(np.concatenate(held))
            block = ids >> 16
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            ends = np.append(first[1:], len(ids))
            low, body = (ids & (ID_BLOCK - 1)).astype("<u2"), []
            for a, b in zip(first.tolist(), ends.tolist()):
                body.append(low[a:b].tobytes() if b - a <= SPARSE else bitmap(low[a:b]))
            for i in range(0, len(body), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(block[first[i:i + 10_000]]), pa.array(ends[i:i + 10_000] - first[i:i + 10_000] > SPARSE),
                                                  pa.array(body[i:i + 10_000], pa.binary())], names=["block", "dense", "body"])
        for b in batches:
            held.append(b.column(0).to_numpy())
            if sum(map(len, held)) >= PACKED_AT_ONCE:
                yield from emit()
                held = []
        if sum(map(len, held)):
            yield from emit()

    def merge(parts: pa.Table) -> pa.Table:
        taken = np.zeros(ID_BLOCK, dtype=bool)
        for dense, body in zip(parts["dense"].to_pylist(), parts["body"].to_pylist()):
            if dense:
                taken |= np.unpackbits(np.frombuffer(body, dtype=np.uint8)).astype(bool)
            else:
                taken[np.frombuffer(body, dtype="<u2")] = True
        return pa.table({"block": parts["block"].slice(0, 1), "taken": [int(taken.sum())], "bits": pa.array([np.packbits(taken).tobytes()], pa.binary())})

    ids = ids_df.select(F.col(col).cast("bigint").alias("id")).where("id > 0")
    packed = ids.mapInArrow(pack, "block bigint, dense boolean, body binary")
    return packed.groupBy("block").applyInArrow(merge, "block bigint, taken bigint, bits binary")


def next_free_ids(ids_df: DataFrame, k, col: str = "order_id", chunk: int = 1_000_000) -> DataFrame:
    """The ``k`` (a number, or a Column holding one) smallest positive ids not in
    ``ids_df[col]`` (column ``id``).

    The taken ids are gathered as bitmaps of blocks (``id_blocks``). A running sum of the
    blocks' counts in block order says how many ids are free before each block, and so
    which blocks and which gaps between blocks the k smallest free ids lie in; only these
    blocks' bitmaps are opened, and gaps are cut into ``chunk``-sized pieces before they are
    expanded, so no task makes more than a block's or a chunk's ids."""
    spark = ids_df.sparkSession
    k = (F.lit(k) if isinstance(k, int) else k).cast("bigint")
    blocks = staged(id_blocks(ids_df, col), "id-blocks")
    start = F.col("block") * ID_BLOCK
    placed = keyed_scan(blocks.select("block", "taken"), [], ["block"],
                        [Scan("before", "sum", F.col("taken"), inclusive=False), Scan("next", "next", F.col("block"), inclusive=False)])
    placed = staged(placed.select("block", "next", (F.greatest(start - 1, F.lit(0)) - F.col("before")).alias("free"),
                                  (F.when(F.col("block") == 0, ID_BLOCK - 1).otherwise(ID_BLOCK) - F.col("taken")).alias("inside")), "placed-blocks")

    def open_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, need, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                free = np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8)) == 0) + block * ID_BLOCK
                yield pa.RecordBatch.from_arrays([pa.array(free[free > 0][:need])], names=["id"])

    wanted = placed.where((F.col("inside") > 0) & (F.col("free") < k)).select("block", F.least(k - F.col("free"), F.lit(ID_BLOCK)).alias("need"))
    inside = wanted.join(blocks.select("block", "bits"), "block").select("block", "need", "bits").mapInArrow(open_block, "id bigint")

    after = placed.select((start + ID_BLOCK).alias("s"), (F.col("free") + F.col("inside")).alias("free"),
                          ((F.col("next") - F.col("block") - 1) * ID_BLOCK).alias("size"))
    first = placed.agg(F.min("block").alias("block")).select(F.lit(1).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("free"),
                                                             F.when(F.col("block").isNotNull(), F.greatest(start - 1, F.lit(0))).alias("size"))
    gaps = after.unionByName(first).withColumn("take", F.least(F.coalesce("size", k), k - F.col("free"))).where("take > 0")
    pieces = gaps.select("s", "take", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("take") / chunk).cast("bigint") - 1)).alias("j"))
    pieces = pieces.select((F.col("s") + F.col("j") * chunk).alias("p"),
                           F.least(F.lit(chunk).cast("bigint"), F.col("take") - F.col("j") * chunk).alias("n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return inside.unionByName(pieces.repartition(n, "p").select(F.explode(F.sequence(F.col("p"), F.col("p") + F.col("n") - 1)).alias("id")))


def allocate_ids(batch: DataFrame, existing: DataFrame, order=("seq",), col: str = "order_id") -> DataFrame:
    """Give each row of ``batch`` (ordered by ``order``) the next smallest free id,
    all in one job instead of one read-then-insert per row (no collisions).
    The number of ids needed is a scalar subquery over the batch."""
    batch = staged(batch, "unnumbered")                      # counted and ranked
    k = batch.agg(F.count(F.lit(1))).scalar()
    free = dense_index(staged(next_free_ids(existing, k, col), "free-ids"), ["id"], "_i")
    ranked = dense_index(batch, list(order), "_i")
    return ranked.join(free.hint("merge"), "_i").withColumnRenamed("id", col).drop("_i")
