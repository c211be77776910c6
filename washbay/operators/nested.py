"""Struct / map / array / JSON shapes (N1–N6), all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washbay.functions.columns import js_trim

PRICE_KEYS = ["bike", "hatchback", "sedan", "suv"]
# fixed values: vehicle labels of the public price map, in the reference's order
MAP_LABELS = [("Bike", "bike"), ("Hatch/Sedan", "sedan"), ("SUV", "suv")]


def _opt(df: DataFrame, name: str, dtype: str = "int") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


# N1
def with_price_struct(sheet: DataFrame) -> DataFrame:
    """Four price columns → ``prices`` struct (NULLs kept), package sheet shape."""
    prices = F.struct(*[_opt(sheet, k).alias(k) for k in PRICE_KEYS]).alias("prices")
    return sheet.select(_opt(sheet, "id", "string").alias("id"), "name", _opt(sheet, "description", "string").alias("description"),
                        prices, _opt(sheet, "created_at", "timestamp_ntz").alias("created_at"),
                        _opt(sheet, "updated_at", "timestamp_ntz").alias("updated_at"))


# N2
def catalog_as_packages(cat: DataFrame) -> DataFrame:
    """Catalogue rows in package shape: id = name, description '' when missing,
    hatchback falls back to sedan, both stamps = updated_at."""
    sedan = _opt(cat, "sedan")
    hatch = F.coalesce(_opt(cat, "hatchback"), sedan) if "hatchback" in cat.columns else sedan
    stamp = _opt(cat, "updated_at", "timestamp_ntz")
    return cat.select(
        F.col("name").cast("string").alias("id"), "name",
        F.coalesce(F.nullif(_opt(cat, "description", "string"), F.lit("")), F.lit("")).alias("description"),
        F.struct(_opt(cat, "bike").alias("bike"), hatch.alias("hatchback"), sedan.alias("sedan"),
                 _opt(cat, "suv").alias("suv")).alias("prices"),
        stamp.alias("created_at"), stamp.alias("updated_at"))


# N3
def price_map(cat: DataFrame) -> DataFrame:
    """One row per service: ``prices`` map of vehicle label → price (NULL kept)."""
    entries = []
    for label, col in MAP_LABELS:
        entries += [F.lit(label), _opt(cat, col)]
    return cat.select("name", F.create_map(*entries).alias("prices"))


# N4
def unpivot_prices(cat: DataFrame, cols=("bike", "sedan", "suv")) -> DataFrame:
    """Wide prices → (name, vehicle, price) rows; missing prices stay as NULL rows."""
    return cat.unpivot(["name"], list(cols), "vehicle", "price")


# N5
def gallery_array(c) -> Column:
    """JSON text → array<string>; malformed or missing → empty array."""
    c = F.col(c) if isinstance(c, str) else c
    arr = F.from_json(F.coalesce(c, F.lit("[]")), "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(arr, F.array().cast("array<string>"))


def gallery_json(arr) -> Column:
    """array<string> → JSON text (NULL stays NULL, so a patch keeps the old value)."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.when(arr.isNotNull(), F.to_json(arr))


# N6
def split_lines(c) -> Column:
    """Text → array of trimmed, non-empty lines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(c, "\n"), lambda x: js_trim(x)), lambda x: x != F.lit(""))
