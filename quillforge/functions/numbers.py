"""Numbers, units and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Rounded half up by floor, the same in every engine that has IEEE doubles."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def round_to_step(x: Column, step: float) -> Column:
    """Half up to a multiple of step, mirrored for negatives."""
    return F.signum(x) * F.floor(F.abs(x) / step + F.lit(0.5 + 1e-9)) * step


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part in percent of whole; null where the whole is zero."""
    return half_up(part / F.nullif(whole, F.lit(0)) * 100, digits)


def locale_number(text: Column) -> Column:
    """A number as written: 1,234.5 and 1,234 have thousands commas; 1,8 and 12,34 a decimal comma; others plain or null."""
    t = F.trim(text)
    grouped, comma, plain = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$", r"^[+-]?[0-9]+,[0-9]{1,2}$", r"^[+-]?[0-9]+(\.[0-9]+)?$"
    return F.when(t.rlike(grouped), F.regexp_replace(t, ",", "").cast("double")).when(t.rlike(comma), F.regexp_replace(t, ",", ".").cast("double")).when(t.rlike(plain), t.cast("double"))


# Operation, factor, digits after rounding (None: as it is).
UNITS = {
    "ps_to_kw": (0.73549875, 1),
    "hp_to_kw": (0.745699872, 1),
    "kw_to_ps": (1.35962, 0),
    "lb_to_kg": (0.45359237, 0),
    "in_to_mm": (25.4, 0),
    "cm_to_mm": (10.0, 0),
    "l_to_cc": (1000.0, 0),
    "kgm_to_nm": (9.80665, 0),
    "lbft_to_nm": (1.355817948, 0),
    "mph_to_kmh": (1.609344, 0),
    "miles_to_km": (1.609344, 0),
}


def convert(x: Column, operation: str) -> Column:
    """x in another unit; distance per volume becomes volume per 100 of distance by "kml_to_l100" (null for zero)."""
    if operation == "kml_to_l100":
        return half_up(F.lit(100.0) / F.nullif(x, F.lit(0.0)), 1)
    factor, digits = UNITS[operation]
    return half_up(x * factor, digits)


def last_digit(text: Column) -> Column:
    """The weight of the last digit that a decimal number states: 1.80 gives 0.01, 12 gives 1."""
    decimals = F.length(F.regexp_extract(text, r"\.([0-9]+)$", 1))
    return F.pow(F.lit(10.0), -decimals)


def intervals_overlap(value: Column, tolerance: Column) -> Column:
    """Aggregate: do all stated intervals value ± tolerance share a point?"""
    return F.max(value - tolerance) <= F.min(value + tolerance)


def full_year(text: Column) -> Column:
    """A year from two or four digits: 2 is 2002, 1998 is itself."""
    y = F.when(text.rlike(r"^[0-9]{1,4}$"), text.cast("int"))
    return F.when(y < 100, y + 2000).otherwise(y)


def year_month(text: Column) -> Column:
    """struct(year, month) of 2019-5[-3], 3-5-2019, 201905[03]; null parts where nothing fits or the month is not 1-12."""
    ymd = r"^([0-9]{4})[-/.]([0-9]{1,2})([-/.][0-9]{1,2})?$"
    dmy = r"^[0-9]{1,2}[-/.]([0-9]{1,2})[-/.]([0-9]{4})$"
    compact = r"^([0-9]{4})([0-9]{2})([0-9]{2})?$"
    y = F.when(text.rlike(ymd), F.regexp_extract(text, ymd, 1)).when(text.rlike(dmy), F.regexp_extract(text, dmy, 2)).when(text.rlike(compact), F.regexp_extract(text, compact, 1))
    m = F.when(text.rlike(ymd), F.regexp_extract(text, ymd, 2)).when(text.rlike(dmy), F.regexp_extract(text, dmy, 1)).when(text.rlike(compact), F.regexp_extract(text, compact, 2))
    y, m = y.cast("int"), m.cast("int")
    ok = m.between(1, 12)
    return F.struct(F.when(ok, y).alias("year"), F.when(ok, m).alias("month"))


# Definitions of power and their factors to the reference's metric horsepower.
POWER = {"kw": (1.35962, 1.34102), "hp": (1.0, 1.01387)}


def power_agrees(reference: Column, value: Column, unit: str) -> Column:
    """Does value in unit, under any of its definitions, lie within max(2, 1 percent) of the reference?"""
    gaps = [F.abs(value * k - reference) for k in POWER[unit]]
    return F.least(*gaps) <= F.greatest(F.lit(2.0), reference * 0.01)


def tolerance_equal(a: Column, b: Column, share: float, stated: Column | None = None) -> Column:
    """matched / veto / unknown: equal within a share of the first, or within half of the last digit that `stated` (the second
    as it was written, in the same unit) gives; null states nothing."""
    gap = F.abs(a) * share
    if stated is not None:
        gap = F.greatest(gap, last_digit(stated) / 2)
    return F.when(a.isNull() | b.isNull(), "unknown").when(F.abs(a - b) <= gap + 1e-9, "matched").otherwise("veto")


# Definitions of power by name and their factors to the reference's metric horsepower.
POWER_DEFINITIONS = {"kw_metric": ("kw", 1.35962), "kw_mechanical": ("kw", 1.34102), "hp_metric": ("hp", 1.0), "hp_mechanical": ("hp", 1.01387)}


def power_definition(reference: Column, value: Column, unit: Column) -> Column:
    """The definition of the unit under which value comes closest to the reference, if within max(2, 1 percent) of it; the
    first of equals, else null."""
    gaps = F.array(*[F.when(unit == of, F.struct(F.abs(value * k - reference).alias("gap"), F.lit(i).alias("place"), F.lit(name).alias("name"))) for i, (name, (of, k)) in enumerate(POWER_DEFINITIONS.items())])
    best = F.array_min(F.array_compact(gaps))
    return F.when(best["gap"] <= F.greatest(F.lit(2.0), reference * 0.01), best["name"])
