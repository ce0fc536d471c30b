"""Numbers from and to text, and comparisons of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parsed(text: Column) -> Column:
    """Double of a plain decimal text, else null; forms that only Spark knows, such as ``5d``, are no numbers."""
    return F.when(F.rlike(text, F.lit(_NUMBER)), text.try_cast("double"))


def parsed_or_zero(text: Column) -> Column:
    return F.coalesce(parsed(text), F.lit(0.0))


def parsed_local(text: Column) -> Column:
    """As spreadsheets show numbers: spaces (no-break ones too) group digits, a comma is the decimal point."""
    return parsed(F.regexp_replace(F.regexp_replace(text, r"[\s  ]", ""), ",", "."))


def parsed_lenient(text: Column) -> Column:
    """Keeps digits, the first point and a leading minus; null if no digit is left."""
    kept = F.regexp_replace(F.regexp_replace(text, ",", "."), r"[^0-9.]", "")
    head, tail = F.substring_index(kept, ".", 1), F.regexp_replace(F.regexp_replace(kept, r"^[^.]*\.?", ""), r"\.", "")
    sign = F.when(F.ltrim(text).startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(kept.rlike("[0-9]"), F.concat(sign, F.lit("0"), head, F.lit("."), tail, F.lit("0")).try_cast("double"))


def rounded(x: Column, digits: int = 0) -> Column:
    """Half away from zero on the scaled binary value: 1.005 to two digits is 1.0."""
    scale = F.lit(float(10**digits))
    return F.round(x * scale, 0) / scale


def integer_part(x: Column) -> Column:
    """Floor as a double, but a value within 5e-14 below an integer is that integer."""
    up = F.ceil(x).cast("double")
    return F.floor(F.when((up - x > 0) & (up - x < 5e-14), up).otherwise(x)).cast("double")


def as_text(x: Column) -> Column:
    """Six decimals at most, no exponent, no trailing zeros; zero is ``0``."""
    # From 2**52 / 10**6 on the scaled value has no fraction to round, and scaling would change the last digits.
    fixed = F.when(F.abs(x) < 4.5e9, rounded(x, 6)).otherwise(x).cast("decimal(38,6)").cast("string")
    short = F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
    return F.when(short == "-0", F.lit("0")).otherwise(short)


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9))


def changed(old: Column, new: Column, was_empty: Column | None = None) -> Column:
    """Differs by more than 1e-6 of the old value (absolutely, where that is next to zero), or replaces an empty cell."""
    far = F.when(F.abs(old) > 1e-9, F.abs((new - old) / old) > 1e-6).otherwise(F.abs(new - old) > 1e-9)
    return F.coalesce(far, F.lit(True)) if was_empty is None else was_empty | F.coalesce(far, F.lit(True))
