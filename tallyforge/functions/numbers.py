"""Amounts and other numbers as printed, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyforge.functions import fixed
from tallyforge.functions.text import SPACE, ascii_digits, strip


def parse_amount(col: Column) -> Column:
    """A printed amount as a double, or null: separators go, brackets negate, two digits after a gap are hundredths."""
    text = ascii_digits(strip(col.cast("string")))
    inner = strip(F.regexp_replace(text, r"\A[()]+|[()]+\z", ""))
    halves = rf"(?U)\A(\d{{1,3}}(?:,\d{{3}})*|\d+){SPACE}+(\d{{2}})\z"
    joined = F.when(~inner.contains(".") & inner.rlike(halves), F.regexp_replace(inner, halves, "$1.$2")).otherwise(inner)
    digits = F.regexp_replace(joined, r"[^0-9.\-]", "")
    number = digits.try_cast("double")
    signed = F.when(text.startswith("(") & text.endswith(")"), -number).otherwise(number)
    return F.when(text.isin(*fixed.NO_AMOUNT) | digits.isin("", "-", ".", "-."), None).otherwise(signed)


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= fixed.TOLERANCE


def is_numeric(col: Column) -> Column:
    """Nothing but a figure: separators, currency marks, a percent sign and a currency word are part of it."""
    text = strip(F.coalesce(col, F.lit("")))
    return (text != "") & text.rlike(fixed.NUMERIC_TEXT)


def printed_numbers(col: Column) -> Column:
    """Every number in a text as its rounded absolute value, and every pair of a number and two digits after a gap, joined."""
    text = ascii_digits(F.coalesce(col, F.lit("")))
    value = lambda s: F.round(F.abs(F.regexp_replace(s, ",", "").try_cast("double")), 2)
    plain = F.transform(F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), value)
    pairs = F.regexp_extract_all(text, F.lit(rf"(?U)\d[\d,]*{SPACE}+\d{{2}}(?!\d)"), F.lit(0))
    paired = F.transform(pairs, lambda s: value(F.regexp_replace(s, rf"(?U){SPACE}+", ".")))
    return F.array_compact(F.array_distinct(F.concat(plain, paired)))


def measured(col: Column) -> Column:
    """A cell of the run log as a number; blank and what is no number are null."""
    return strip(col.cast("string")).try_cast("double")


def ranked(col: Column) -> Column:
    """A cell for ranking: unmeasured is below every measure."""
    return F.coalesce(measured(col), F.lit(-1.0))


def percent(col: Column) -> Column:
    return F.round(col * 100, 2)


def elapsed(seconds: Column, extract_seconds: Column) -> Column:
    """Both passes together; unknown unless both are."""
    return measured(seconds) + measured(extract_seconds)


def fit_pixels(width: Column, height: Column, budget: Column) -> Column:
    """Width and height scaled down to at most ``budget`` pixels; unchanged if they fit or there is no budget."""
    scale = F.when(budget.isNotNull() & (width * height > budget), F.sqrt(budget / (width * height))).otherwise(F.lit(1.0))
    side = lambda c: F.greatest(F.lit(1), F.floor(c * scale)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))
