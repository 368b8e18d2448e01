"""Technical indicators on a panel.

The window indicators are plain trailing windows. RSI and MACD are recursions over time, which no
window frame expresses; they run per series in Arrow batches, where a series is bounded by the
calendar, and pandas' compiled ``ewm`` carries the recursion.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import has_any
from ..functions.guarded import safe_ratio
from .align import by_day
from .trailing import mean, std, trailing_features

PRICE_WINDOWS = (5, 10, 20, 40, 60)


def pick_series(catalog: DataFrame, include: Sequence[str], exclude: Sequence[str] = (), first: int = 8) -> DataFrame:
    """The first ``first`` series in catalog order whose name has an include word and no
    exclude word (a top-k over the catalog, not a row cap)."""
    name = F.col("series_name")
    return catalog.filter(has_any(name, include) & ~has_any(name, exclude)).orderBy("ordinal", "series_id").limit(first)


def bollinger_position(panel: DataFrame, width: int = 20, n_std: float = 2.0) -> DataFrame:
    out = trailing_features(panel, {"_m": mean(width), "_s": std(width)})
    low, band = F.col("_m") - n_std * F.col("_s"), 2 * n_std * F.col("_s")
    return out.withColumn("bb_pos", F.when(band > 1e-10, (F.col("value") - low) / band)).drop("_m", "_s")


def price_ratios(panel: DataFrame) -> DataFrame:
    means = {f"_m{n}": mean(n) for n in PRICE_WINDOWS} | {"_a": mean(5, 3), "_b": mean(20, 10)}
    cols = {f"price_ma{n}": safe_ratio(F.col("value"), F.col(f"_m{n}")) for n in PRICE_WINDOWS}
    cols["ma5_ma20"] = safe_ratio(F.col("_a"), F.col("_b"))
    return trailing_features(panel, means).withColumns(cols).drop(*means)


def crossover(panel: DataFrame, first_row: int = 5) -> DataFrame:
    """+1 where the short mean crosses above the long mean, -1 below, else 0."""
    w = by_day()
    out = trailing_features(panel.withColumn("_i", F.row_number().over(w) - 1), {"_a": mean(5, 3), "_b": mean(20, 10)})
    out = out.withColumns({"_pa": F.lag("_a").over(w), "_pb": F.lag("_b").over(w)})
    a, b, pa, pb = (F.col(c) for c in ("_a", "_b", "_pa", "_pb"))
    flag = (
        F.when(F.col("_i") < first_row, 0)
        .when((pa <= pb) & (a > b), 1)
        .when((pa >= pb) & (a < b), -1)
        .otherwise(0)
    )
    return out.withColumn("crossover", flag).drop("_a", "_b", "_pa", "_pb", "_i")


def _wilder(x: np.ndarray, period: int) -> np.ndarray:
    """Mean of the first ``period`` values, then s = (s * (period - 1) + x) / period."""
    if len(x) < period:
        return np.empty(0)
    seeded = np.concatenate([[x[:period].mean()], x[period:]])
    return pd.Series(seeded).ewm(alpha=1.0 / period, adjust=False).mean().to_numpy()


def rsi_values(values: np.ndarray, period: int) -> np.ndarray:
    out = np.full(len(values), np.nan)
    step = np.diff(values)
    # a missing step is neither gain nor loss
    gain, loss = np.where(step > 0, step, 0.0), np.where(step < 0, -step, 0.0)
    g, lo = _wilder(gain, period), _wilder(loss, period)
    if len(g):
        quiet = lo < 1e-10
        out[period:] = np.where(quiet, 100.0, 100.0 - 100.0 / (1.0 + g / np.where(quiet, 1.0, lo)))
    return out


def recursive_indicators(panel: DataFrame, rsi_periods: Sequence[int] = (7, 14)) -> DataFrame:
    """RSI per period, MACD(12, 26, 9) line, signal and histogram. Forward fill first when the
    panel has gaps: the exponential means then see no nulls."""
    names = [f"rsi{p}" for p in rsi_periods] + ["macd", "macd_signal", "macd_hist"]

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d", ignore_index=True)
        v = pdf["value"].astype("float64")
        for p in rsi_periods:
            pdf[f"rsi{p}"] = rsi_values(v.to_numpy(), p)
        line = v.ewm(span=12, adjust=False).mean() - v.ewm(span=26, adjust=False).mean()
        signal = line.ewm(span=9, adjust=False).mean()
        pdf["macd"], pdf["macd_signal"], pdf["macd_hist"] = line, signal, line - signal
        return pdf

    schema = "series_id string, d date, value double, " + ", ".join(f"{n} double" for n in names)
    out = panel.select("series_id", "d", "value").groupBy("series_id").applyInPandas(per_series, schema)
    return out.select("series_id", "d", "value", *[F.nanvl(F.col(n), F.lit(None).cast("double")).alias(n) for n in names])
