"""Operator 12 against plain strings: every cell of the DP holds whole audits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from washbay.llm import audit, conversations

SOLID = re.compile(r"[^\x20\x09-\x0D]")
EMPTY = hashlib.sha256(b"").hexdigest()


def plan(letters):
    """Cheapest (cost, audit, emitted) by widening all audits cell by cell, as strings."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}

    def closed(cells):
        for _ in range(4):
            for (last, (cost, text)) in list(cells.items()):
                r = nxt[last]
                cells[r] = min(cells.get(r, (10**9, "")), (cost + 3, text + "I"))
        return cells
    cells = closed({"": (0, "")})
    for x in letters:
        new = {}

        def put(last, value, new=new):
            new[last] = min(new.get(last, (10**9, "")), value)
        for last, (cost, text) in cells.items():
            put(last, (cost + 4, text + "D"))
            if x != "-":
                extra = 3 * x.isupper()
                if x.lower() == nxt[last] or (x.lower() == "s" and last == ""):
                    put(x.lower(), (cost + extra, text + "K"))
                put(nxt[last], (cost + extra + 3, text + "R"))
        cells = closed(new)
    return min(cells[s] for s in ("", "a") if s in cells)


def every_audit(letters, most):
    """All (cost, audit) up to a cost, with no DP at all."""
    out = []

    def go(i, last, cost, text):
        if cost > most or len(text) > len(letters) + 4:
            return
        if i == len(letters) and last in ("", "a"):
            out.append((cost, text))
        r = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        go(i, r, cost + 3, text + "I")
        if i < len(letters):
            x = letters[i]
            go(i + 1, last, cost + 4, text + "D")
            if x != "-":
                extra = 3 * x.isupper()
                if x.lower() == r or (x.lower() == "s" and last == ""):
                    go(i + 1, x.lower(), cost + extra, text + "K")
                go(i + 1, r, cost + extra + 3, text + "R")
    go(0, "", 0, "")
    return out


def brute(rows, plant=True):
    """rows: (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in rows:
        conv = convs.setdefault(c, [])
        sp = lambda v: " " if v is None else str(v)
        role, text = sp(role), sp(text)
        f = zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20 if plant else 9
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        role = "user" if f == 4 else role
        conv += [(turn, role, text)] * (2 if f == 3 else 1)
    out = []
    for c, conv in convs.items():
        conv.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, letters, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in conv:
            solid = SOLID.findall(text)
            x = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not solid:
                n["blank"] += 1
                x = "-"
            elif (role, text) in seen:
                n["duplicate"] += 1
                x = "-"
            elif solid[-1] not in ".!?":
                n["truncated"] += 1
                x = x.upper()
            seen.add((role, text))
            letters += x
        turns = {t for t, _, _ in conv if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(conv, conv[1:]))
        cost, text = plan(letters)
        lines, last, left = [], "", list(conv)
        for e in text:
            r = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
            name = {"u": "user", "a": "assistant"}[r]
            if e == "I":
                lines.append(f"{name}:")
                last = r
                continue
            _, role, body = left.pop(0)
            if e == "K":
                lines.append(f"{role}:{body}")
                last = role[:1]
            elif e == "R":
                lines.append(f"{name}:{body}")
                last = r
        out.append((c, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, text, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(rng, convs, most):
    texts = ["Fine.", "Cut off", "", " \t", "Why? ", "Yes!\n", "No. and", "a" * 30 + ".", "é…"]
    rows = []
    for c in range(convs):
        for turn in range(rng.randint(1, most)):
            rows.append((None if c == 3 else c, None if rng.random() < .05 else turn + (turn > 4) * rng.randint(0, 2),
                         rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "unknown"]),
                         rng.choice([None, *texts])))
    return rows + [(900, None, None, None), (901, 1, "user", "Hi."), (901, 1, "user", "Hi."), (901, 1, "assistant", "Yo.")]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def got(df):
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("mod", [(1 << 61) - 1, 3])
def test_audits_of_all_short_conversations(mod):
    """All words of four letters against the strings (mod 3: hashes collide all the time)."""
    for n in range(5):
        for word in itertools.product("suaxSU-", repeat=n):
            word = "".join(word)
            cost, text = audit.best(audit.repairs(word, 0, mod))
            assert (cost, text) == plan(word), word
    rng = random.Random(2)
    for _ in range(60):
        word = "".join(rng.choice("suaxSUA-") for _ in range(rng.randint(20, 200)))
        assert audit.best(audit.repairs(word, 0, mod)) == plan(word)


def test_string_dp_equals_all_audits():
    rng = random.Random(4)
    for _ in range(60):
        word = "".join(rng.choice("suaxU-") for _ in range(rng.randint(0, 5)))
        best = plan(word)
        assert best == min(every_audit(word, best[0])), word


@pytest.mark.parametrize("piece", [4096, 5, 1])
def test_repair(llm, piece):
    """Whole, in pieces of five rows and in pieces of one row."""
    rows = rows_of(random.Random(piece), 60, 14)
    df = llm.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(conversations.repair_conversations(conversations.damaged(df), "live", piece=piece)) == brute(rows)


def test_long_texts_take_the_streamed_path(llm):
    rows = [(1, i, ("user", "assistant")[i % 2], "word " * 5000 + ".") for i in range(6)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yo.")]
    df = llm.createDataFrame(rows, SCHEMA)
    assert got(conversations.repair_conversations(df, piece_bytes=20_000)) == brute(rows, plant=False)


def test_hot_conversation_in_many_tasks(llm):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Text {t}.", "Same.", "Cut"])) for t in range(3000)]
    rows += [(100 + i, 0, "user", "Hi.") for i in range(50)]
    df = llm.createDataFrame(rows, SCHEMA).repartition(4)
    assert got(conversations.repair_conversations(conversations.damaged(df), "live", piece=64)) == brute(rows)


def test_empty_clashing_and_dropped(llm):
    none = llm.createDataFrame([], SCHEMA)
    assert conversations.repair_conversations(conversations.damaged(none), "live").count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi.", "x", "y", 1), (gone + 1, None, None, None, None, None, None)]
    df = llm.createDataFrame(rows, SCHEMA + ", letter string, c string, live int")
    out = got(conversations.repair_conversations(conversations.damaged(df), "live"))
    assert out == brute([r[:4] for r in rows]) and (gone, 0, 0, 0, 0, 0, 0, "", EMPTY) in out
    assert got(conversations.repair_conversations(df)) == brute([r[:4] for r in rows], plant=False)
