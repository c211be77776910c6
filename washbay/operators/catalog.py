"""Service catalogue maintenance.

A catalogue is (name, bike, sedan, suv, position, visible, description[, updated_at]).
List order is position ascending with missing positions last, then name; zero and
negative positions come first. Every operator returns a new table version; positions
are renumbered densely with the parallel ``dense_index`` (no single-partition window),
and rows that a request or a renumbering changed get ``updated_at`` = ``now`` where the
table has that column.

A batch equals its requests applied one by one in ``seq`` order. The first request that
succeeds renumbers the list with its own new row among the unplaced ones (by name); rows
that later requests add join the tail in order of arrival.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washbay.functions.columns import first_int, norm_bool, norm_text
from washbay.operators.filters import ntz
from washbay.plans.components import components
from washbay.plans.keyed import Scan, keyed_scan
from washbay.plans.ranking import dense_index
from washbay.plans.staging import staged

POS_LAST = 1_000_000_000   # fixed value: the browser's stand-in for a missing position
REPLAYED_ROWS = 8192       # rows of refused rename components a pandas group aims for
FIELDS = ("bike", "sedan", "suv", "visible", "description")


def _stamp(now):
    return ntz(now) if now is not None else F.current_timestamp().cast("timestamp_ntz")


def _placed(rows: DataFrame, order: list, now) -> DataFrame:
    """Dense positions in ``order``; ``changed`` marks moved rows, which are stamped."""
    ranked = dense_index(rows, order, "_rn")
    ranked = ranked.withColumn("changed", ~F.col("position").eqNullSafe(F.col("_rn").cast("int")))
    if "updated_at" in rows.columns:
        ranked = ranked.withColumn("updated_at", F.when(F.col("changed"), _stamp(now)).otherwise(F.col("updated_at")))
    return ranked.withColumn("position", F.col("_rn").cast("int")).drop("_rn")


def list_order(name: str = "name") -> list:
    return [F.col("position").isNull(), F.col("position"), F.col(name).isNull(), F.col(name)]


# W1
def renumber(cat: DataFrame, now=None) -> DataFrame:
    """Dense positions 1..n in list order; ``changed`` marks rows whose position moved."""
    return _placed(cat, list_order(), now)


# W4
def append_at_tail(cat: DataFrame, new: DataFrame, now=None) -> DataFrame:
    """Add the unlisted items of ``new`` without a position, one by one in name order."""
    fresh = new.join(cat.select("name"), "name", "left_anti").withColumn("position", F.lit(None).cast("int"))
    if "updated_at" in cat.columns:
        fresh = fresh.withColumn("updated_at", _stamp(now))
    fresh = staged(fresh, "fresh-items")
    late = F.col("name") > fresh.agg(F.min("name")).scalar()
    both = (cat.withColumn("_late", F.lit(False))
            .unionByName(fresh.select(*cat.columns, F.coalesce(late, F.lit(False)).alias("_late"))))
    return _placed(both, [F.col("_late"), *list_order()], now).drop("_late")


def move_clusters(items: DataFrame) -> DataFrame:
    """name, cluster, lo, hi for moved items (name, at: place in the list, n: number of moves;
    staged, as it is read by several scans): items of different clusters cannot meet, and no
    item of a cluster gets below lo or above hi before all of its moves are done.

    Merging the reaches needs only running values over the items in list order: items before
    and at a place can get as far right as the sum of their moves and the running maximum of
    their starts allow, and likewise to the left from the other end. Each is a keyed scan
    without a key, so the items are cut into pieces and never meet in one task; a scan that
    builds on another reads its staged rows."""
    n = F.col("n")

    def scan(rows: DataFrame, order: Column, s: Scan) -> DataFrame:
        return staged(keyed_scan(rows, [], [order], [s]), "move-scan")

    summed = scan(items, F.col("at"), Scan("total", "sum", n))
    right = scan(summed, F.col("at"), Scan("far", "max", F.col("at") - F.col("total") + n))
    both = scan(right, -F.col("at"), Scan("near", "max", F.col("total") - F.col("at")))
    both = both.select("name", "at", (F.col("total") - n - F.col("near")).alias("left"), (F.col("total") + F.col("far")).alias("right"))
    cut = scan(both, F.col("at"), Scan("before", "last", F.col("right"), inclusive=False))
    apart = (F.coalesce(F.col("left") > F.col("before") + 2, F.lit(False))).cast("bigint")
    numbered = keyed_scan(cut, [], ["at"], [Scan("cluster", "sum", apart)])
    return numbered.select("name", "cluster", (F.col("left") - 1).alias("lo"), (F.col("right") + 1).alias("hi"))


# W3
def move_items(cat: DataFrame, moves: DataFrame, now=None):
    """(catalogue, rejected moves). Moves (seq, name, direction up/down) are applied in
    ``seq`` order: the item swaps places with its neighbour in list order; at an edge
    nothing changes. Empty and unknown names and bad directions are rejected.

    Moves far apart cannot meet, so the moved items are cut into clusters whose reach does
    not touch (``move_clusters``), and the clusters are replayed in parallel, each over the
    rows within its reach. One chain of moves that touch each other is sequential by
    definition: every swap decides what the next one finds, so a chain is one group, as
    large as its moves and the rows that they can reach."""
    ranked = renumber(cat, now).drop("changed")
    m = moves.withColumn("_name", norm_text("name", 100))
    known = ranked.select(F.col("name").alias("_name"), F.col("position").alias("_at"))
    m = m.join(known, "_name", "left")
    reason = (F.when(F.col("_name") == "", F.lit("missing service name"))
               .when(~F.coalesce(F.col("direction").isin("up", "down"), F.lit(False)), F.lit("invalid direction"))
               .when(F.col("_at").isNull(), F.lit("service not found")))
    m = m.withColumn("reject_reason", reason)
    valid = m.filter(F.col("reject_reason").isNull()).select("seq", F.col("_name").alias("name"), "direction", "_at")
    items = valid.groupBy("name").agg(F.first("_at").cast("bigint").alias("at"), F.count(F.lit(1)).alias("n"))

    placed = staged(move_clusters(staged(items, "moved-items")), "move-clusters")
    reach = placed.groupBy("cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # the reaches are disjoint, so a row lies in the last one that starts at or before it, or in none
    spots = (reach.select(F.col("lo").alias("position"), F.lit(0).alias("kind"), F.struct("cluster", "hi").alias("of"), F.lit(None).cast("string").alias("name"))
             .unionByName(ranked.select(F.col("position").cast("bigint").alias("position"), F.lit(1).alias("kind"),
                                        F.lit(None).cast("struct<cluster:bigint,hi:bigint>").alias("of"), "name")))
    within = keyed_scan(spots, [], ["position", "kind"], [Scan("_in", "last", F.col("of"))])
    rows = within.where((F.col("kind") == 1) & (F.col("position") <= F.col("_in.hi"))).select("name", "position", "_in.cluster")
    steps = valid.join(placed.select("name", "cluster"), "name")
    both = (rows.select("cluster", F.lit(0).alias("kind"), "position", "name", F.lit(None).cast("string").alias("direction"))
            .unionByName(steps.select("cluster", F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("position"), "name", "direction")))

    def replay(pdf):
        r = pdf[pdf.kind == 0].sort_values("position")
        names, base = list(r.name), int(r.position.min())
        at = {n: i for i, n in enumerate(names)}
        for name, way in pdf[pdf.kind == 1].sort_values("position")[["name", "direction"]].itertuples(index=False):
            i = at[name]
            j = i - 1 if way == "up" else i + 1
            if 0 <= j < len(names):                        # a cluster's own ends are list ends or out of reach
                names[i], names[j] = names[j], names[i]
                at[names[i]], at[names[j]] = i, j
        return pd.DataFrame({"name": names, "_to": range(base, base + len(names))})

    moved = both.groupBy("cluster").applyInPandas(replay, "name string, _to int")
    out = ranked.join(moved, "name", "left").withColumn("position", F.coalesce("_to", "position")).drop("_to")
    rejected = m.filter(F.col("reject_reason").isNotNull()).select(*moves.columns, "reject_reason")
    return out.select(*cat.columns), rejected


# W6
def offers_for(cat: DataFrame, vehicle: str) -> DataFrame:
    """Bookable offers for a vehicle in list order: named rows with a price for it.
    For a Bike only one: the first whose name contains "basic" (any case), else
    the cheapest (ties: list order), found by a min_by aggregate, no sort."""
    col = {"Bike": "bike", "SUV": "suv"}.get(vehicle, "sedan")
    offers = cat.select("name", first_int(F.col(col).cast("string")).alias("price"),
                        F.coalesce(F.col("description").cast("string"), F.lit("")).alias("description"),
                        F.coalesce(F.col("position"), F.lit(POS_LAST)).alias("_pos")) \
                .filter((F.coalesce(F.col("name"), F.lit("")) != "") & F.col("price").isNotNull())
    if vehicle != "Bike":
        return offers.orderBy("_pos", "name").drop("_pos")
    basic = F.lower(F.col("name")).contains("basic")
    key = F.struct(F.when(basic, 0).otherwise(1), F.when(basic, F.col("_pos")).otherwise(F.col("price")),
                   F.col("_pos"), F.col("name"))
    best = offers.agg(F.min_by(F.struct("name", "price", "description"), key).alias("_b"))
    return best.filter(F.col("_b").isNotNull()).select("_b.*")


def _norm_batch(batch: DataFrame) -> DataFrame:
    cols = [F.col("seq"), norm_text("name", 100).alias("name")]
    if "original_name" in batch.columns:
        cols.append(norm_text(F.coalesce(F.nullif(F.col("original_name"), F.lit("")), F.col("name")), 100)
                    .alias("original_name"))
    cols += [first_int((F.col(c) if c in batch.columns else F.lit(None)).cast("string")).alias(c)
             for c in ("bike", "sedan", "suv")]
    cols += [norm_bool(F.col("visible") if "visible" in batch.columns else F.lit(None).cast("string"), True).alias("visible"),
             norm_text(F.col("description") if "description" in batch.columns else F.lit(None).cast("string"), 1000)
             .alias("description")]
    return batch.select(*cols)


def _last_per_name(b: DataFrame, key: str = "name") -> DataFrame:
    others = [c for c in b.columns if c != key]
    return b.groupBy(key).agg(F.max_by(F.struct(*others), F.col("seq")).alias("_r")).select(key, "_r.*")


def _with_stamp(cat: DataFrame) -> DataFrame:
    return cat if "updated_at" in cat.columns else cat.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))


def _upserted(cat: DataFrame, named: DataFrame, now) -> DataFrame:
    """Catalogue with the last request per name applied. ``_arrival``: first request of a
    new name; ``_sort``: the name that orders unplaced rows; positions are not yet renumbered."""
    first_seen = named.groupBy("name").agg(F.min("seq").alias("_arrival"))
    last = _last_per_name(named.select("seq", "name", *FIELDS)).drop("seq").join(first_seen, "name")
    j = cat.alias("c").join(last.alias("b"), "name", "full_outer")
    touched = F.col("b.visible").isNotNull()     # a batch row is present (visible is never NULL there)
    pick = {c: F.when(touched, F.col(f"b.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in FIELDS}
    return j.select("name", pick["bike"], pick["sedan"], pick["suv"], F.col("c.position").alias("position"),
                    pick["visible"], pick["description"],
                    F.when(touched, _stamp(now)).otherwise(F.col("c.updated_at")).alias("updated_at"),
                    F.when(F.col("c.name").isNull(), F.col("b._arrival")).alias("_arrival"), F.col("name").alias("_sort"))


def _relisted(rows: DataFrame, first, now) -> DataFrame:
    """Renumber after a batch whose first successful request has ``seq`` = ``first``."""
    rows = staged(rows.withColumn("_late", F.coalesce(F.col("_arrival") > first, F.lit(False))), "relisted")
    order = [F.col("_late"), F.col("position").isNull(), F.col("position"), F.when(F.col("_late"), F.col("_arrival")),
             F.col("_sort").isNull(), F.col("_sort")]
    return _placed(rows, order, now).drop("changed", "_arrival", "_sort", "_late")


# M1
def upsert_catalog(cat: DataFrame, batch: DataFrame, now=None):
    """(catalogue, rejected). Insert or overwrite every field but the position; the last
    change per name wins; new names are placed as described above; an empty name is rejected."""
    nb = _norm_batch(batch)
    rejected = nb.filter(F.col("name") == "").withColumn("reject_reason", F.lit("missing service name"))
    named = nb.filter(F.col("name") != "")
    merged = _upserted(_with_stamp(cat), named, now)
    return _relisted(merged, named.agg(F.min("seq")).scalar(), now).select(*cat.columns), rejected


def settled_renames(old: DataFrame, req: DataFrame):
    """(rows after the batch, refused components) of rename components (staged ``root, seq,
    original_name, name, fields, position, updated_at``).

    If no request of a component is refused, every request leaves its new name present and its
    old one absent, so whether a name is there before a request follows from the last
    earlier request that mentions it: one fill per name. Were a request refused, the first
    such would find both of its names present in this reckoning, so a component without
    one is settled by it, and a component with one is handed back in ``refused``. Each request
    then points at the request that last held its row (or at the row of the catalogue, or at
    nothing: a new row), and pointer jumping finds every row's origin and first rename in
    about log2(longest chain) rounds of joins on a request number."""
    base = old.select("root", "name", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("seq"), F.lit(True).alias("present"),
                      F.lit(None).cast("bigint").alias("node"))
    new = req.select("root", "name", F.lit(1).alias("kind"), "seq", F.lit(True).alias("present"), F.col("seq").alias("node"))
    away = req.where("original_name <> name").select("root", F.col("original_name").alias("name"), F.lit(1).alias("kind"), "seq",
                                                     F.lit(False).alias("present"), F.lit(None).cast("bigint").alias("node"))
    mentions = staged(base.unionByName(new).unionByName(away), "rename-mentions")
    seen = keyed_scan(mentions, ["name"], ["kind", "seq"], [Scan("was", "last", F.struct("present", "node"), inclusive=False)])
    to = seen.where("kind = 1 AND present").select("root", "seq", "name", F.col("was").alias("there"))
    of = seen.where("kind = 1 AND NOT present").select("seq", F.col("name").alias("old"), F.col("was").alias("here"))
    here, there = (F.coalesce(F.col(f"{c}.present"), F.lit(False)) for c in ("here", "there"))
    told = staged(to.join(of, "seq", "left").select(
        "root", "seq", "name", here.alias("renames"), (here & there).alias("refused"),
        F.when(here, F.col("here.node")).when(there, F.col("there.node")).alias("parent"),
        F.when(here & F.col("here.node").isNull(), F.col("old")).when(~here & there & F.col("there.node").isNull(), F.col("name")).alias("origin")), "rename-steps")
    refused = staged(told.where("refused").select("root").distinct(), "refused-components")

    calm = told.join(refused, "root", "left_anti")
    fresh = F.col("parent").isNull() & F.col("origin").isNull()
    chain = staged(calm.select("seq", "parent", "origin", F.when(fresh, F.struct("seq", "name")).alias("born"),
                               F.when(F.col("renames"), F.struct("seq", "name")).alias("moved")), "rename-chain")
    while not chain.where("parent IS NOT NULL").isEmpty():
        up = chain.select(F.col("seq").alias("parent"), *[F.col(c).alias(f"up_{c}") for c in ("parent", "origin", "born", "moved")])
        chain = staged(chain.join(up, "parent", "left").select(
            "seq", F.col("up_parent").alias("parent"), F.coalesce("up_origin", "origin").alias("origin"),
            F.coalesce("up_born", "born").alias("born"), F.coalesce("up_moved", "moved").alias("moved")), "rename-chain")

    last = (mentions.join(refused, "root", "left_anti").groupBy("name")
            .agg(F.max_by(F.struct("present", "node"), F.struct("kind", "seq")).alias("end")).where("end.present"))
    rows = old.select(F.col("name").alias("origin"), F.col("position"), F.col("updated_at"))
    named = last.where("end.node IS NOT NULL").select(F.col("end.node").alias("seq")).join(chain, "seq") \
                .join(req.select("seq", "name", *FIELDS), "seq").join(rows, "origin", "left")
    twice = F.col("origin").isNotNull() & F.col("moved").isNotNull()
    touched = named.select(
        "name", *FIELDS, "position", "updated_at", F.lit(True).alias("touched"),
        F.when(twice, F.col("moved.seq")).alias("first"), F.col("born.seq").alias("_arrival"),
        F.when(twice, F.concat_ws("\0", "origin", "moved.name")).otherwise(F.coalesce("born.name", "origin")).alias("_sort"))
    still = last.where("end.node IS NULL").select("name").join(old, "name").select(
        "name", *FIELDS, "position", "updated_at", F.lit(False).alias("touched"),
        F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("_arrival"), F.col("name").alias("_sort"))
    earliest = calm.agg(F.min("seq")).scalar()             # the first request that succeeds
    settled = touched.unionByName(still).withColumn("seq", F.when(F.col("touched"), earliest))
    return settled.select("seq", "name", *FIELDS, "position", "updated_at", "touched", "first", "_arrival", "_sort"), refused


# M2
def rename_items(cat: DataFrame, batch: DataFrame, now=None):
    """(catalogue, rejected). A request whose original name differs from the new one
    rewrites the key and fields of that row and keeps its position; when the original is
    absent at that moment it falls through to an upsert of the new name. A new name in use
    at that moment is rejected (the primary key would refuse it), as are empty names.

    Requests meet only through the names they mention, so the names of renames are grouped
    into connected components; requests on all other names are plain upserts (the last one
    per name). A component in which no request is refused is settled in parallel, whatever
    its size (``settled_renames``). A refused request leaves its names as they were, which
    later requests may or may not see, so a component with a refusal is sequential by
    definition: it is replayed in ``seq`` order within one group."""
    nb_all = _norm_batch(batch)
    empty = nb_all.filter(F.col("name") == "").withColumn("reject_reason", F.lit("missing service name"))
    nb = nb_all.filter(F.col("name") != "")
    renames = nb.filter(F.col("original_name") != F.col("name"))
    groups = components(renames.select(F.col("original_name").alias("a"), F.col("name").alias("b")))
    cur = _with_stamp(cat)
    grouped = cur.join(groups, cur["name"] == groups["node"], "left").drop("node")
    asked = nb.join(groups, nb["name"] == groups["node"], "left").drop("node")
    plain = _upserted(grouped.filter(F.col("root").isNull()).drop("root"), asked.filter(F.col("root").isNull()), now)

    cols = ["root", "kind", "seq", "original_name", "name", "bike", "sedan", "suv", "visible", "description", "position", "updated_at"]
    old = grouped.filter(F.col("root").isNotNull()).select(
        "root", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("original_name"),
        "name", *FIELDS, "position", "updated_at").select(*cols)
    req = asked.filter(F.col("root").isNotNull()).select(
        "root", F.lit(1).alias("kind"), F.col("seq").cast("bigint").alias("seq"), "original_name", "name", *FIELDS,
        F.lit(None).cast("int").alias("position"), F.lit(None).cast("timestamp_ntz").alias("updated_at")).select(*cols)
    old, req = staged(old, "rename-rows"), staged(req, "rename-requests")
    settled, refused = settled_renames(old, req)
    kinds = "bike int, sedan int, suv int, visible boolean, description string, position int, updated_at timestamp_ntz"
    schema = f"seq bigint, name string, {kinds}, touched boolean, first bigint, _arrival bigint, _sort string, reject_reason string"

    def replay(pdf):
        blank = {"touched": False, "first": None, "_arrival": None, "_sort": None, "reject_reason": None}
        rows, out = {}, []
        fields = ["bike", "sedan", "suv", "visible", "description"]
        for r in pdf.sort_values(["kind", "seq"]).astype(object).where(pdf.notna(), None).to_dict("records"):
            if r["kind"] == 0:
                rows[r["name"]] = {k: r[k] for k in ["name", *fields, "position", "updated_at"]} | blank | {"_sort": r["name"]}
                continue
            new, old_name = {k: r[k] for k in fields}, r["original_name"]
            if old_name != r["name"] and old_name in rows:
                if r["name"] in rows:
                    out.append({"seq": r["seq"], "name": r["name"], **new, **blank, "reject_reason": "name already in use"})
                    continue
                row = rows.pop(old_name)
                row["name"] = r["name"]
                if row["first"] is None and row["_arrival"] is None:
                    row["_sort"], row["first"] = f"{row['_sort']}\0{r['name']}", r["seq"]     # both names, told apart below
            else:
                row = rows.get(r["name"]) or {"name": r["name"], "position": None, "updated_at": None} | blank | {
                    "_arrival": r["seq"], "_sort": r["name"]}
            row.update(new)
            row["touched"] = True
            row.setdefault("seq", r["seq"])
            rows[r["name"]] = row
        table = pd.DataFrame([{"seq": None, **x} for x in [*rows.values(), *out]],
                             columns=["seq", "name", *fields, "position", "updated_at", "touched", "first", "_arrival", "_sort", "reject_reason"])
        for c in ("seq", "bike", "sedan", "suv", "position", "first", "_arrival"):
            table[c] = table[c].astype("Int64")
        table["visible"], table["touched"] = table["visible"].astype("boolean"), table["touched"].astype("boolean")
        table["updated_at"] = pd.to_datetime(table["updated_at"])
        return table

    # components have no name in common, so those of a bucket are replayed together: pandas groups cost more than their rows
    again = staged(old.unionByName(req).join(refused, "root", "left_semi"), "renames-refused")
    buckets = F.greatest(F.lit(1), F.ceil(again.agg(F.count(F.lit(1))).scalar() / F.lit(REPLAYED_ROWS)))
    n = int(cat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = again.withColumn("_bucket", F.pmod(F.xxhash64("root"), buckets)).repartition(n, "_bucket")
    replayed = staged(dealt.groupBy("_bucket").applyInPandas(replay, schema), "renames-replayed")
    done = replayed.filter(F.col("reject_reason").isNull()).select(*settled.columns).unionByName(settled)
    # the first request that succeeds (of either kind) renumbers the list
    first = F.least(done.filter("touched").agg(F.min("seq")).scalar(),
                    asked.filter(F.col("root").isNull()).agg(F.min("seq")).scalar())
    names = F.split("_sort", "\0")
    sort = F.when(F.col("first").isNotNull(), F.when(F.col("first") == first, F.element_at(names, 2)).otherwise(F.element_at(names, 1))) \
            .otherwise(F.col("_sort"))
    done = done.select("name", "bike", "sedan", "suv", "position", "visible", "description",
                       F.when(F.col("touched"), _stamp(now)).otherwise(F.col("updated_at")).alias("updated_at"),
                       "_arrival", sort.alias("_sort"))
    out = _relisted(plain.unionByName(done), first, now).select(*cat.columns)
    taken = replayed.filter(F.col("reject_reason").isNotNull()).select("seq", "name", *FIELDS, "reject_reason")
    return out, taken.unionByName(empty.select("seq", "name", *FIELDS, "reject_reason"))
