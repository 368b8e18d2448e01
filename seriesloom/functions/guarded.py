"""Arithmetic that keeps nulls as nulls and never divides by (nearly) zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_number(text: Column) -> Column:
    """Text cell to DOUBLE; a bad cell, an empty cell and NaN all become NULL."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number), number)


def tolerant_date(text: Column, formats=("yyyy-M-d", "yyyy/M/d", "yyyyMMdd")) -> Column:
    """First format that parses wins; NULL when none does. Months and days may be unpadded; a time
    of day behind a blank or a T, with or without a zone, is dropped."""
    trimmed = F.regexp_replace(F.trim(text), r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$", "")
    return F.coalesce(*[F.try_to_date(trimmed, fmt) for fmt in formats])


def fixed(value: Column, decimals: int) -> Column:
    """Number with a fixed count of decimals; NULL stays NULL (``format_string`` would spell it)."""
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value))


def safe_ratio(num: Column, den: Column, eps: float = 1e-10) -> Column:
    return F.when(F.abs(den) > eps, num / den)


def change_ratio(
    now: Column, before: Column, denominator: str = "abs", eps: float = 1e-10, closed: bool = False
) -> Column:
    """(now - before) over ``before``.

    denominator: ``"signed"`` (label features) or ``"abs"`` (factor features and whole panels).
    closed: accept ``|before| == eps`` too (the whole-panel variant uses eps=1e-4, closed).
    """
    if denominator not in ("abs", "signed"):
        raise ValueError("denominator is 'abs' or 'signed'")
    size = F.abs(before)
    usable = size >= eps if closed else size > eps
    return F.when(usable, (now - before) / (size if denominator == "abs" else before))


def clip(value: Column, low: Column | float, high: Column | float) -> Column:
    """Clip, NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))
