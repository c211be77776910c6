"""Conversation structure repair (operator 12).

``damaged`` plants the faults of the contract; ``repair_conversations`` finds the faults of
any conversations table, the cheapest edits that turn every conversation into
``(s?(ua)+)?`` (see ``audit``), and the digest of what they leave.

Conversations of at most ``piece`` rows and ``piece_bytes`` bytes (nearly all) are shuffled
once by conversation and repaired whole. A longer one is never one group: row numbers,
duplicates and neighbours come from skew-safe keyed scans, its letters are cut into pieces
of ``piece`` rows, each piece's best repairs from every state to every state are found in
parallel, the pieces are composed in order (sixteen audits a piece, the part that all four
running audits share is dropped), and the pieces' edits meet their rows again by (conversation, row). Only
the SHA-256, which is sequential by definition, sees a conversation's repaired lines in one
task, streamed in order and held one batch at a time.

Rows are taken by turn (NULLs first); equal turns by role, then text. A NULL role or text
counts as one space; a NULL conv_id is a conversation of its own and comes back as NULL;
empty texts are blank; repeated rows are duplicates; a conversation without rows has an
empty audit; an empty table gives an empty result; only conv_id, turn, role, text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washbay.llm import audit
from washbay.llm.common import group_bounds, map_sorted_groups, staged
from washbay.plans.keyed import Scan, keyed_scan

PIECE = 4096
PIECE_BYTES = 8 << 20
ROLE_OF = {"u": "user", "a": "assistant"}
_SOLID = r"[^\x20\x09-\x0D]"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_RESULT = ", ".join(f"{c} bigint" for c in COUNTS) + ", cost bigint, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, live`` after the planted faults, by crc32 of
    ``conv_id:turn`` modulo 20; a dropped row stays as one that is not ``live``, so that its
    conversation is not lost."""
    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    base = rows.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), fault.alias("fault"))
    return base.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") != 0).alias("live"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _lettered(rows: DataFrame, live: str | None) -> DataFrame:
    """The rows with their conversation key and, but for duplicates, their letter."""
    blank = ~F.col("text").rlike(_SOLID)
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return rows.select(
        "conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"),
        F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        (F.col(live) if live else F.lit(True)).alias("live")) \
        .select("*", F.when(blank, F.lit("-")).when(whole, letter).otherwise(F.upper(letter)).alias("letter"))


def _line(before: str, edit: str, role: str, given: str, text: str) -> list[str]:
    out = [f"{ROLE_OF[r]}:" for r in before]
    return out + ([f"{ROLE_OF[role] if edit == 'R' else given}:{text}"] if edit in "KR" and edit else [])


def _short(rows: DataFrame, id_type: str) -> DataFrame:
    """Conversations that fit into one group each."""
    def repair(table: pa.Table) -> pa.Table:
        d = table.to_pandas(types_mapper=None, integer_object_nulls=True)
        keys, live = d["c"].to_numpy(), d["live"].to_numpy(dtype=bool)
        first = group_bounds(keys)
        n = len(d)
        letter = d["letter"].to_numpy(dtype=object)
        blank = (letter == "-") & live
        twin = d["live"] & d.duplicated(["c", "role", "text", "live"])
        twin = twin.to_numpy(dtype=bool) & ~blank
        letter = np.where(twin, "-", letter)
        initial = np.array([r[:1] for r in d["role"]], dtype=object)
        turns, roles, texts = d["turn"].tolist(), d["role"].tolist(), d["text"].tolist()
        out = {k: [] for k in [*COUNTS, "cost", "audit", "repaired_sha256"]}
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            at = [i for i in range(a, b) if live[i]]
            known = {turns[i] for i in at if turns[i] is not None}
            out["gaps"].append(int(max(known) - min(known) + 1 - len(known)) if known else 0)
            out["blank"].append(int(blank[at].sum()))
            out["duplicate"].append(int(twin[at].sum()))
            word = "".join(letter[at])
            out["truncated"].append(sum(map(str.isupper, word)))
            out["illegal"].append(sum(initial[i] + initial[j] not in ("su", "ua", "au") for i, j in zip(at, at[1:])))
            cost, edits = audit.best(audit.repairs(word))
            lines = []
            for i, (before, edit, role) in zip([*at, None], audit.steps(edits, word)):
                lines += _line(before, edit, role, roles[i] if edit else "", texts[i] if edit else "")
            out["cost"].append(cost)
            out["audit"].append(edits)
            out["repaired_sha256"].append(hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert n == first[-1]
        return pa.table({"conv_id": table["conv_id"].take(pa.array(first[:-1])), **{
            k: pa.array(v, pa.string() if k in ("audit", "repaired_sha256") else pa.int64()) for k, v in out.items()}})

    cols = rows.select("c", "conv_id", "turn", "role", "text", "live", "letter")
    return map_sorted_groups(cols, ["c"], ["turn", "role", "text"], f"conv_id {id_type}, {_RESULT}", repair)


def _long(rows: DataFrame, piece: int) -> DataFrame:
    """c and results of conversations that are spread over many tasks (live rows only)."""
    order = ["turn", "role", "text"]
    text_key = F.sha2(F.col("text").cast("binary"), 256)       # of rows that meet their equals; compared beside the text's length
    twins = keyed_scan(rows.select("*", text_key.alias("h"), F.length("text").alias("size")), ["c", "role", "h", "size"], ["turn"],
                       [Scan("seen", "sum", F.lit(1).cast("bigint"))])
    letter = F.when(F.col("seen") > 1, F.lit("-")).otherwise(F.col("letter"))
    twin = (F.col("seen") > 1) & (F.col("letter") != "-")
    ranked = keyed_scan(twins.select("c", *order, F.substring("role", 1, 1).alias("initial"), (F.col("letter") == "-").alias("blank"),
                                     twin.alias("twin"), letter.alias("letter")), ["c"], order,
                        [Scan("at", "sum", F.lit(1).cast("bigint")), Scan("prev", "last", F.col("initial"), inclusive=False),
                         Scan("prev_turn", "last", F.col("turn"), inclusive=False)])
    ranked = staged(ranked.select("*", F.floor((F.col("at") - 1) / piece).cast("bigint").alias("piece")), "conversation-rows")

    def total(cond: Column) -> Column:
        return F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))

    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("prev_turn"))
    counts = ranked.groupBy("c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - total(new_turn), F.lit(0)).alias("gaps"), total(F.col("blank")).alias("blank"),
        total(F.col("twin")).alias("duplicate"), total(F.col("letter").rlike("[A-Z]")).alias("truncated"),
        total(F.col("prev").isNotNull() & ~F.concat("prev", "initial").isin("su", "ua", "au")).alias("illegal"))

    words = ranked.groupBy("c", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "letter"))).alias("l")) \
                  .select("c", "piece", F.array_join(F.col("l.letter"), "").alias("word"))          # at most `piece` letters

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cost, edits = [], []
            for word in b.column(2).to_pylist():
                cells = [x for q in range(audit.STATES) for x in audit.repairs(word, q)]
                cost.append([x[0] if x else None for x in cells])
                edits.append([x[1] if x else None for x in cells])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cost, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string()))],
                                             names=["c", "piece", "word", "cost", "edits"])

    solved = staged(words.mapInArrow(solve, "c string, piece bigint, word string, cost array<bigint>, edits array<string>"), "conversation-pieces")
    path = solved.repartition("c").sortWithinPartitions("c", "piece").select("c", "piece", "cost", "edits") \
                 .mapInArrow(_compose, "c string, piece bigint, entry int, leave int, cost bigint")
    chosen = solved.join(path, ["c", "piece"]).select(
        "c", "piece", "word", "entry", path["cost"], F.get("edits", F.col("entry") * audit.STATES + F.col("leave")).alias("edits"))
    chosen = staged(chosen, "conversation-edits")
    audits = chosen.groupBy("c").agg(F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("piece", "edits"))).alias("e")) \
                   .select("c", "cost", F.array_join(F.col("e.edits"), "").alias("audit"))             # the result's own string

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows_of = [(r["piece"] * piece + 1 + i, *s) for i, s in enumerate(audit.steps(r["edits"], r["word"], r["entry"]))]
                *mine, (end, tail, _, _) = rows_of               # inserts after the piece's last row go with that row
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["c"]] * len(mine)), pa.array([m[0] for m in mine], pa.int64()), pa.array([m[1] for m in mine], pa.string()),
                     pa.array([m[2] for m in mine], pa.string()), pa.array([m[3] for m in mine], pa.string()),
                     pa.array([""] * (len(mine) - 1) + [tail], pa.string())], names=["c", "at", "before", "edit", "new", "after"])

    steps = chosen.select("c", "piece", "word", "entry", "edits").mapInArrow(
        unroll, "c string, at bigint, before string, edit string, new string, after string")
    told = ranked.select("c", "at", "role", "text").join(steps.hint("merge"), ["c", "at"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, any_line = None, None, False
        for b in batches:
            done = {"c": [], "repaired_sha256": []}
            for r in b.to_pylist():
                if r["c"] != now:
                    if now is not None:
                        done["c"].append(now)
                        done["repaired_sha256"].append(sha.hexdigest())
                    now, sha, any_line = r["c"], hashlib.sha256(), False
                for line in _line(r["before"], r["edit"], r["new"], r["role"], r["text"]) + _line(r["after"], "", "", "", ""):
                    sha.update((("\n" if any_line else "") + line).encode())
                    any_line = True
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in done.items()})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"c": pa.array([now]), "repaired_sha256": pa.array([sha.hexdigest()])})

    digests = (told.repartition("c").sortWithinPartitions("c", "at").select("c", "role", "text", "before", "edit", "new", "after")
               .mapInArrow(digest, "c string, repaired_sha256 string"))
    return counts.join(audits, "c").join(digests, "c")


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after each piece on the best way through a conversation. Rows come
    sorted by (c, piece); a running audit is kept from where the running ones differ."""
    def close(c, heads, back):
        state = min((heads[s], s) for s in audit.ACCEPTS if s in heads)[1]
        out = []
        for number, cost, came in reversed(back):
            entry = came[state]
            out.append((c, number, entry, state, cost[entry * audit.STATES + state]))
            state = entry
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))],
                                          names=["c", "piece", "entry", "leave", "cost"])

    now, heads, back = None, {}, []
    for b in batches:
        for i in range(b.num_rows):
            c, number, cost, edits = (b.column(k)[i].as_py() for k in range(4))
            if c != now:
                if now is not None:
                    yield close(now, heads, back)
                now, heads, back = c, {audit.NOTHING: (0, "")}, []
            new, came = {}, {}
            for entry, (spent, tail) in heads.items():
                for state in range(audit.STATES):
                    k = entry * audit.STATES + state
                    if cost[k] is not None and (state not in new or (spent + cost[k], tail + edits[k]) < new[state]):
                        new[state], came[state] = (spent + cost[k], tail + edits[k]), entry
            tails = [t for _, t in new.values()]
            low, high = min(tails), max(tails)
            shared = next((j for j, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
            heads = {s: (spent, tail[shared:]) for s, (spent, tail) in new.items()}
            back.append((number, cost, came))
    if now is not None:
        yield close(now, heads, back)


def repair_conversations(rows: DataFrame, live: str | None = None, piece: int = PIECE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. ``rows``: conv_id, turn, role, text; ``live`` names a boolean column
    that is false where a row only stands for its conversation."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    base = staged(_lettered(rows, live), "conversations")
    sizes = base.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.max("conv_id").alias("conv_id"))
    big = staged(sizes.where((F.col("n") > piece) | (F.col("bytes") > piece_bytes)).select("c", "conv_id"), "long-conversations")
    if big.isEmpty():
        return _short(base, id_type)
    keys = big.select("c").hint("merge")                        # at most rows / piece of them, but not bounded
    short = _short(base.join(keys, "c", "left_anti"), id_type)
    found = _long(base.where("live").join(keys, "c").drop("conv_id", "live"), piece)
    nothing = {**{c: 0 for c in [*COUNTS, "cost"]}, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return short.unionByName(big.join(found, "c", "left").fillna(nothing).select(*short.columns))
