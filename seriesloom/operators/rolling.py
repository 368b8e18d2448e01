"""Lags, changes and trailing-window statistics.

All columns of one call share one partitioning and ordering, so Spark sorts each series once. Means,
deviations and quantiles of wide windows are those of ``trailing``; ``rolling_mean`` and ``rolling_std`` are
column expressions over a sliding frame, for narrow ones among other expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guarded import change_ratio, safe_ratio
from .align import by_day
from .trailing import mean, quantiles, std, trailing_features

# Lag days per kind of series.
TARGET_LAGS = (1, 2, 3, 5, 7, 14, 21, 30, 60, 90, 180, 365)
TIER_LAGS = {"core": (1, 2, 3, 7, 14, 30), "important": (1, 7, 30), "basic": (1,)}
MEAN_WINDOWS = (3, 5, 7, 14, 30, 60, 90)
STD_WINDOWS = (7, 14, 30, 60)
QUANTILE_WINDOWS = (30, 60, 90)
MOMENTUM_STEPS = (5, 10, 20)
YEAR_MONTH_WEEK_STEPS = {"yoy_365": 365, "mom_30": 30, "mom_90": 90, "wow_7": 7, "wow_14": 14}


def trailing(width: int, *keys: str) -> Window:
    return by_day(*keys).rowsBetween(-(width - 1), 0)


def default_min_periods(width: int) -> int:
    return max(1, width // 2)


def rolling_mean(value: str, width: int, min_periods: int | None = None) -> Column:
    w = trailing(width)
    need = default_min_periods(width) if min_periods is None else min_periods
    return F.when(F.count(value).over(w) >= need, F.avg(value).over(w))


def rolling_std(value: str, width: int, min_periods: int | None = None) -> Column:
    w = trailing(width)
    need = default_min_periods(width) if min_periods is None else min_periods
    return F.when(F.count(value).over(w) >= need, F.stddev_samp(value).over(w))


def lag_features(panel: DataFrame, lags: Sequence[int] = TARGET_LAGS) -> DataFrame:
    w = by_day()
    return panel.withColumns({f"lag_{k}": F.lag("value", k).over(w) for k in lags})


def tiered_lag_features(panel: DataFrame, tiers: DataFrame) -> DataFrame:
    """Long lag features where the tier of a series decides which lags it gets. Every lag is one
    window column; the tier picks from an array, so the panel is sorted and scanned once."""
    w = by_day()
    every = sorted({k for lags in TIER_LAGS.values() for k in lags})
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("value", k).over(w).alias("lag_value")) for k in every])
    wanted = None
    for name, lags in TIER_LAGS.items():
        chosen = F.array(*[F.lit(k) for k in lags])
        wanted = F.when(F.col("tier") == name, chosen) if wanted is None else wanted.when(F.col("tier") == name, chosen)
    return (
        panel.withColumn("_cells", cells)
        .join(tiers.select("series_id", "tier"), "series_id")
        .withColumn("_wanted", wanted)
        .select("series_id", "d", "tier", F.explode(F.filter("_cells", lambda c: F.array_contains("_wanted", c["lag"]))).alias("c"))
        .select("series_id", "d", "tier", F.concat(F.lit("lag"), F.col("c.lag").cast("string")).alias("feature_id"), F.col("c.lag_value").alias("value"))
    )


def differences(panel: DataFrame, steps: Sequence[int] = (1, 7)) -> DataFrame:
    w = by_day()
    return panel.withColumns({f"diff_{k}": F.col("value") - F.lag("value", k).over(w) for k in steps})


def changes(
    panel: DataFrame, steps: dict[str, int], denominator: str = "abs", eps: float = 1e-10, closed: bool = False
) -> DataFrame:
    w = by_day()
    return panel.withColumns(
        {name: change_ratio(F.col("value"), F.lag("value", k).over(w), denominator, eps, closed) for name, k in steps.items()}
    )


def momentum(panel: DataFrame) -> DataFrame:
    steps = {f"mom{k}": k for k in MOMENTUM_STEPS} | YEAR_MONTH_WEEK_STEPS
    return changes(panel, steps, "abs")


def mean_std_features(panel: DataFrame) -> DataFrame:
    wanted = {f"ma{n}": mean(n) for n in MEAN_WINDOWS} | {f"std{n}": std(n) for n in STD_WINDOWS}
    return trailing_features(panel, wanted)


def quantile_features(panel: DataFrame, widths: Sequence[int] = QUANTILE_WINDOWS) -> DataFrame:
    """Trailing P10, P90 and their spread, linear interpolation."""
    out = trailing_features(panel, {f"_q{n}": quantiles(n, (0.1, 0.9)) for n in widths})
    for n in widths:
        low, high = F.col(f"_q{n}_0"), F.col(f"_q{n}_1")
        out = out.withColumns({f"p10_{n}": low, f"p90_{n}": high, f"spread_{n}": high - low}).drop(f"_q{n}_0", f"_q{n}_1")
    return out


def level_ratios(panel: DataFrame) -> DataFrame:
    out = trailing_features(panel, {"_ma7": mean(7, 3), "_ma30": mean(30, 10)})
    return out.withColumns(
        {
            "ratio_ma7": safe_ratio(F.col("value"), F.col("_ma7")),
            "ratio_ma30": safe_ratio(F.col("value"), F.col("_ma30")),
            "ma7_ma30": safe_ratio(F.col("_ma7"), F.col("_ma30")),
        }
    ).drop("_ma7", "_ma30")


def return_volatility(panel: DataFrame) -> DataFrame:
    """Trailing standard deviation of one-step returns, 14 (at least 7) and 30 (at least 10)."""
    ret = panel.withColumn("ret", change_ratio(F.col("value"), F.lag("value", 1).over(by_day())))
    return trailing_features(ret, {"vol_14": std(14, 7, "ret"), "vol_30": std(30, 10, "ret")})


def lead_label(samples: DataFrame, column: str, step: int = 1, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Label = ``column`` some rows later, with the day it comes from; rows without one go."""
    w = by_day(*keys)
    return (
        samples.withColumns({"label": F.lead(column, step).over(w), "label_d": F.lead("d", step).over(w)})
        .filter(F.col("label").isNotNull())
    )


def to_long(wide: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id", "d")) -> DataFrame:
    """Feature columns to ``(series_id, d, feature_id, value)``."""
    return wide.select(*keys, *columns).unpivot(list(keys), list(columns), "feature_id", "value")
