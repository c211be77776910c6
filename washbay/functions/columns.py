"""Scalar rules as built-in Column expressions (no Python UDFs).

Every function takes column names or Columns and returns a Column, so the rules
compose inside one ``select`` and stay in whole-stage codegen. Text rules mirror
the browser/server normalisers of the reference: JS ``trim`` strips all white
space, JS ``Math.round`` rounds half up, PostgreSQL ``numeric::int`` rounds half
away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's -------------------------
HOME_VISIT = "Home Visit"          # place that carries the surcharge
WASH_CENTER = "Wash Center"        # default place
HOME_SURCHARGE = 50                # rupees added for a home visit
TRUE_WORDS = ["1", "true", "yes", "y", "on"]
FALSE_WORDS = ["0", "false", "no", "n", "off"]
OPEN_MINUTE, CLOSE_MINUTE = 600, 1200   # 10:00 .. 20:00 inclusive
RUPEE_PREFIX = "₹ "
MISSING_PRICE = "—"
# white space removed by JS String.prototype.trim: tab, LF, VT, FF, CR, space,
# no-break space, U+1680, U+2000–U+200A, line/paragraph separators, U+202F,
# U+205F, U+3000 and the byte-order mark
JS_SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
# ---------------------------------------------------------------------------

ISO_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
HH_MM = r"[0-9]{2}:[0-9]{2}"
GROUP_FORMATS = {"day": 10, "month": 7, "year": 4}   # prefix length of 'yyyy-MM-dd'


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _full(pattern: str) -> str:
    # Java's `$` also matches before a final newline; `\z` is the true end.
    return f"^(?:{pattern})\\z"


def js_trim(c) -> Column:
    """Strip leading/trailing white space of any kind (JS String.prototype.trim)."""
    return F.regexp_replace(_c(c), f"^[{JS_SPACE}]+|[{JS_SPACE}]+\\z", "")


# P1
def visit_ts(date="date", time="time", strict: bool = False) -> Column:
    """Text date + ``HH:MM`` → TIMESTAMP_NTZ; bad time → midnight; bad date → NULL.
    Impossible dates (2024-02-31) give NULL, or raise with ``strict=True``."""
    d, t = _c(date), _c(time)

    def cast(s):
        return s.cast("timestamp_ntz") if strict else s.try_cast("timestamp_ntz")

    day_ok = d.rlike(_full(ISO_DAY))
    return (F.when(day_ok & t.rlike(_full(HH_MM)), cast(F.concat(d, F.lit(" "), t)))
             .when(day_ok, cast(d)))


# P9 (also the fallback rule of P2)
def first_int(c) -> Column:
    """First run of digits as INT (sign ignored); NULL when none or out of range."""
    c = _c(c)
    return F.when(c.rlike("[0-9]"), F.regexp_extract(c, "([0-9]+)", 1).try_cast("int"))


# P2
def effective_price(price="price", service="service") -> Column:
    """Stored price, else the first digit run of the service name, else 0."""
    s = _c(service)
    return F.coalesce(_c(price).cast("int"),
                      F.when(s.rlike("[0-9]"), first_int(s)).otherwise(F.lit(0)))


# P3
def period_label(ts, group: str) -> Column:
    """``YYYY-MM-DD`` / ``YYYY-MM`` / ``YYYY`` label (time-zone free on NTZ)."""
    if group not in GROUP_FORMATS:
        raise ValueError(f"unknown group {group!r}; expected day, month or year")
    return F.substring(_c(ts).cast("string"), 1, GROUP_FORMATS[group])


# P4
def hour_of(ts) -> Column:
    return F.hour(_c(ts)).cast("int")


def dow_of(ts) -> Column:
    """0 = Sunday … 6 = Saturday (Spark's dayofweek is 1 = Sunday)."""
    return (F.dayofweek(F.to_date(_c(ts))) - 1).cast("int")


# P5
def norm_phone(c) -> Column:
    """Digits only, first 15."""
    return F.substring(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "[^0-9]", ""), 1, 15)


# P6
def norm_text(c, max_len: int = 500) -> Column:
    """NULL → '', trimmed, truncated to ``max_len`` characters."""
    return F.substring(js_trim(F.coalesce(_c(c).cast("string"), F.lit(""))), 1, max_len)


# P7
def norm_date(c) -> Column:
    """ISO date or ISO date-time → ``YYYY-MM-DD`` of that instant in UTC (as JS
    ``new Date(v).toISOString()`` on a UTC server: an explicit offset can move the
    day); anything else, or an impossible date, → ''."""
    s = js_trim(_c(c))
    iso = _full(ISO_DAY + r"(?:[T ]([0-9]{2}):([0-9]{2})(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(Z|([+-])([0-9]{2}):?([0-9]{2}))?)?")
    day = F.when(s.rlike(iso), F.substring(s, 1, 10).try_cast("date"))
    hh, mm = F.regexp_extract(s, iso, 1), F.regexp_extract(s, iso, 2)
    sign, oh, om = F.regexp_extract(s, iso, 4), F.regexp_extract(s, iso, 5), F.regexp_extract(s, iso, 6)
    local = F.concat(day.cast("string"), F.lit(" "), hh, F.lit(":"), mm).try_cast("timestamp_ntz")
    offset_min = (oh.try_cast("int") * 60 + om.try_cast("int")) * F.when(sign == "-", -1).otherwise(1)
    utc_day = F.to_date(F.timestamp_add("MINUTE", -offset_min, local))
    shifted = F.when((sign != "") & day.isNotNull(), utc_day).otherwise(day)
    return F.coalesce(shifted.cast("string"), F.lit(""))


# P8
def norm_time(c) -> Column:
    """24-hour ``H:MM``/``HH:MM`` → zero-padded ``HH:MM``, else ''."""
    s = js_trim(F.coalesce(_c(c), F.lit("")))
    pat = _full("([01]?[0-9]|2[0-3]):([0-5][0-9])")
    return F.when(s.rlike(pat), F.concat(F.lpad(F.regexp_extract(s, pat, 1), 2, "0"), F.lit(":"),
                                         F.regexp_extract(s, pat, 2))).otherwise(F.lit(""))


# P10
def norm_bool(c, default: bool = True) -> Column:
    """yes/no words → boolean; NULL, '' and unknown words → ``default``."""
    s = F.lower(js_trim(_c(c).cast("string")))
    return (F.when(s.isin(TRUE_WORDS), F.lit(True))
             .when(s.isin(FALSE_WORDS), F.lit(False))
             .otherwise(F.lit(default)))


# P11
def price_column_for(vehicle) -> Column:
    """Catalogue price column of a vehicle: Bike → bike, SUV → suv, else sedan."""
    v = _c(vehicle)
    return (F.when(v == "Bike", F.lit("bike")).when(v == "SUV", F.lit("suv"))
             .otherwise(F.lit("sedan")))


# P12
def home_surcharge(price, place) -> Column:
    return _c(price) + F.when(_c(place) == HOME_VISIT, F.lit(HOME_SURCHARGE)).otherwise(F.lit(0))


# P13
def minutes_of_day(time) -> Column:
    """``H:MM`` → minutes after midnight (parseInt of each part; NULL when unparsable)."""
    parts = F.split(_c(time), ":")
    # F.get: NULL for a missing part instead of an index error under ANSI mode
    h = F.regexp_extract(js_trim(F.get(parts, 0)), r"^[+-]?[0-9]+", 0).try_cast("int")
    m = F.regexp_extract(js_trim(F.get(parts, 1)), r"^[+-]?[0-9]+", 0).try_cast("int")
    return h * 60 + m


# P14
def expiry_date(start, validity_days) -> Column:
    return F.date_add(_c(start), _c(validity_days).cast("int"))


# P15
def expiry_months(start, months) -> Column:
    """start + n months rolling over like JS ``setMonth`` (31 Jan + 1 → 2 or 3 Mar)."""
    d = F.to_date(_c(start))
    return F.date_add(F.add_months(F.trunc(d, "MM"), _c(months).cast("int")), F.dayofmonth(d) - 1)


# P16
def price_label(v) -> Column:
    """``₹ n`` (n printed as JS prints a number: no ``.0`` on whole values) or
    ``—`` when the price is missing, empty or not a finite number."""
    v = _c(v)
    d = js_trim(v.cast("string")).try_cast("double")
    whole = d == F.floor(d)
    text = F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, F.lit(MISSING_PRICE)).otherwise(F.concat(F.lit(RUPEE_PREFIX), text))


# P17
def seconds_since(prev, now) -> Column:
    """Whole seconds between two timestamps, half away from zero (exact integer math)."""
    us = F.timestamp_diff("MICROSECOND", _c(prev), _c(now))
    return F.signum(us).cast("bigint") * idiv(F.abs(us) + 500000, F.lit(1000000))


def idiv(a, b) -> Column:
    """Integer division truncating toward zero (SQL ``a div b``), exact on BIGINT."""
    return F.call_function("div", _c(a), _c(b))
