"""Calendar columns of a date."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_columns(d: Column) -> dict[str, Column]:
    """Year to ISO week, month and quarter dummies, cyclic month and quarter."""
    out = {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "quarter": F.quarter(d),
        "dayofweek": F.weekday(d),
        "dayofyear": F.dayofyear(d),
        "weekofyear": F.weekofyear(d),
    }
    # one dummy fewer than the levels
    for month in range(2, 13):
        out[f"month_{month}"] = (F.month(d) == month).cast("int")
    for quarter in range(2, 5):
        out[f"quarter_{quarter}"] = (F.quarter(d) == quarter).cast("int")
    for name, part, period in (("month", F.month(d), 12), ("quarter", F.quarter(d), 4)):
        angle = part * F.lit(2 * math.pi / period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def season_columns(d: Column) -> dict[str, Column]:
    """Heating season 15 November to 15 March, and the edges of the month."""
    key = F.month(d) * 100 + F.dayofmonth(d)
    return {
        "heating_season": ((key >= 1115) | (key <= 315)).cast("int"),
        "month_start": (F.dayofmonth(d) <= 5).cast("int"),
        "month_end": (F.dayofmonth(d) >= 25).cast("int"),
    }
