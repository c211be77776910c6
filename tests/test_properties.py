"""Column rules versus the reference's browser/server normalisers written in plain
Python (JS semantics), on random strings with awkward white space and digits."""

import random
import re

import pytest
from pyspark.sql import functions as F

from washbay.functions import columns as C
from washbay.operators.intake import js_parse_int as spark_parse_int

JS_WS = "\t\n\x0b\f\r   " + "".join(chr(c) for c in range(0x2000, 0x200B)) + "    　﻿"
ALPHABET = list(" \t\n ﻿\u0085 abcYes0123456789:-+.%_#") + ["on", "off", "no", "TRUE"]


def js_trim(s):
    return s.strip(JS_WS)


def js_parse_int(s):
    if s is None:
        return None
    m = re.match(r"[+-]?\d+", js_trim(s))
    return int(m.group(0)) if m and re.fullmatch(r"[+-]?\d+", m.group(0)) else None


def ref_norm_text(v, n):
    return js_trim("" if v is None else str(v))[:n]


def ref_norm_phone(v):
    return re.sub(r"[^0-9]", "", v or "")[:15]


def ref_norm_time(v):
    s = js_trim("" if v is None else v)
    m = re.fullmatch(r"([01]?[0-9]|2[0-3]):([0-5][0-9])", s)
    return f"{int(m.group(1)):02d}:{m.group(2)}" if m else ""


def ref_first_int(v):
    if v is None or v == "":
        return None
    m = re.search(r"[0-9]+", v)
    return int(m.group(0)) if m and int(m.group(0)) < 2 ** 31 else None


def ref_norm_bool(v, default):
    if v is None or v == "":
        return default
    s = js_trim(v.lower())
    return True if s in ("1", "true", "yes", "y", "on") else False if s in ("0", "false", "no", "n", "off") else default


def ref_minutes(t):
    if not t:
        return None
    parts = t.split(":")
    h = js_parse_int(parts[0])
    m = js_parse_int(parts[1]) if len(parts) > 1 else None
    return None if h is None or m is None else h * 60 + m


@pytest.fixture(scope="module")
def samples():
    rnd = random.Random(1234)
    out = [None, ""]
    for _ in range(600):
        out.append("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 10))))
    out += ["9:05", " 23:59 ", "﻿7:07", "24:00", "12:5", "+91 98-765 43210", "x99999999999", "007"]
    return out


@pytest.mark.parametrize("rule,ref", [
    (lambda c: C.norm_text(c, 6), lambda v: ref_norm_text(v, 6)),
    (C.norm_phone, ref_norm_phone),
    (C.norm_time, ref_norm_time),
    (C.first_int, ref_first_int),
    (lambda c: C.norm_bool(c, True), lambda v: ref_norm_bool(v, True)),
    (lambda c: C.norm_bool(c, False), lambda v: ref_norm_bool(v, False)),
    (C.minutes_of_day, ref_minutes),
    (spark_parse_int, js_parse_int),
], ids=["norm_text", "norm_phone", "norm_time", "first_int", "bool_true", "bool_false", "minutes", "parse_int"])
def test_rule_matches_reference_loop(spark, samples, rule, ref):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(samples)], "i int, v string")
    got = {r.i: r.out for r in df.select("i", rule(F.col("v")).alias("out")).collect()}
    want = {i: ref(v) for i, v in enumerate(samples)}
    bad = {i: (samples[i], got[i], want[i]) for i in want if got[i] != want[i]}
    assert not bad, list(bad.values())[:5]
