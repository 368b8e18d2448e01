"""Autocorrelation and an ADF-style regression for many series at once.

All of it is JVM-side: windows for the lags, grouped sums of products, and the regression solved
from the (p+4)^2 sums of a series in its row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guarded import change_ratio
from .align import by_day, by_series

KEYS = ("version", "series_id")


def panel_versions(panel: DataFrame) -> DataFrame:
    """raw, diff and pct versions of a panel in one long table: one window, then an explode."""
    before = F.lag("value").over(by_day())
    v = F.col("value")
    forms = F.array(
        F.struct(F.lit("raw").alias("version"), v.alias("value")),
        F.struct(F.lit("diff").alias("version"), (v - before).alias("value")),
        F.struct(F.lit("pct").alias("version"), change_ratio(v, before, "abs", 1e-4, closed=True).alias("value")),
    )
    return panel.withColumn("_f", forms).select("series_id", "d", F.explode("_f").alias("f")).select("f.version", "series_id", "d", "f.value")


def _corr(x: Column, y: Column) -> Column:
    """Pearson correlation from moment sums; NULL instead of an error for constant input. Pairs
    with a missing side do not count."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    cov = F.covar_pop(a, b)
    sd = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(sd > 0, cov / sd)


def autocorrelation(panel: DataFrame, lags: Sequence[int] = (1, 7), keys: Sequence[str] = ("series_id",), min_count: int = 100) -> DataFrame:
    """Lag-k autocorrelation of the non-missing values, and the |r1| < 0.9 hint."""
    w = by_day(*keys)
    seen = panel.filter(F.col("value").isNotNull()).withColumns({f"_l{k}": F.lag("value", k).over(w) for k in lags})
    out = seen.groupBy(*keys).agg(F.count("value").alias("n"), *[_corr(F.col("value"), F.col(f"_l{k}")).alias(f"acf_{k}") for k in lags])
    return out.filter(F.col("n") >= min_count).withColumn("maybe_stationary", F.abs(f"acf_{lags[0]}") < 0.9)


def adf_sums(panel: DataFrame, max_lag: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per series the sums of products of the regression: step on constant, trend, previous level
    and ``max_lag`` earlier steps (missing ones count as 0). The level enters relative to the
    first value and the trend to its middle, which changes neither its coefficient nor its t
    value but keeps the sums well conditioned."""
    w = by_day(*keys)
    seen = by_series(panel.filter(F.col("value").isNotNull()), *keys).withColumns(
        {
            "_y": F.col("value") - F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_i": F.row_number().over(w) - 2,
            "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    )
    stepped = seen.withColumns({"_prev": F.lag("_y").over(w)}).withColumn("_dy", F.col("_y") - F.col("_prev"))
    lagged = stepped.withColumns({f"_d{k}": F.coalesce(F.lag("_dy", k).over(w), F.lit(0.0)) for k in range(1, max_lag + 1)})
    rows = lagged.filter(F.col("_dy").isNotNull())
    trend = (F.col("_i") - (F.col("_n") - 2) / 2).cast("double")
    x = [F.lit(1.0), trend, F.col("_prev"), *[F.col(f"_d{k}") for k in range(1, max_lag + 1)]]
    terms = [*x, F.col("_dy")]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    return rows.groupBy(*keys).agg(
        F.first("_n").alias("n"),
        F.array(*[F.sum(terms[i] * terms[j]) for i, j in pairs]).alias("sums"),
    )


# Verdict thresholds on the t value, strongest first.
THRESHOLDS = ((-3.45, "stationary 99%"), (-2.87, "stationary 95%"), (-2.57, "stationary 90%"))


# a regressor whose part outside the others is below this share of it depends on them
DEPENDENT = 1e-10


def adf_test(panel: DataFrame, max_lag: int = 5, keys: Sequence[str] = KEYS, min_count: int = 50, thresholds=THRESHOLDS) -> DataFrame:
    """t value of the previous level, its coefficient and the verdict. The other regressors are taken
    out of the sums one after another; what remains of level and step is a regression of one
    variable. Both are null for short series and where regressors depend on each other, the t value
    also where the fit leaves nothing."""
    width = max_lag + 4
    level, step = 2, width - 1
    place = {pair: k for k, pair in enumerate((i, j) for i in range(width) for j in range(i, width))}
    whole = F.array(*[F.get("sums", place[min(i, j), max(i, j)]) for i in range(width) for j in range(width)])

    def without(gram: Column, k: Column) -> Column:
        pivot = F.get(gram, k * (width + 1))

        def less(x: Column, at: Column) -> Column:
            return x - F.get(gram, F.floor(at / width).cast("int") * width + k) * F.get(gram, k * width + at % width) / pivot

        return F.when(pivot > DEPENDENT * F.get("squares", k), F.transform(gram, less))

    others = F.array(*[F.lit(k) for k in range(step) if k != level])
    squares = F.array(*[F.get("sums", place[i, i]) for i in range(width)])
    left = adf_sums(panel, max_lag, keys).withColumn("squares", squares).withColumn("left", F.aggregate(others, whole, without))
    own, shared, rest = (F.get("left", i * width + j) for i, j in ((level, level), (level, step), (step, step)))
    freedom = F.col("n") - 1 - step
    usable = (F.col("n") >= min_count) & (freedom > 0) & (own > DEPENDENT * F.get("squares", F.lit(level)))
    unexplained = rest - shared * shared / own
    some = unexplained > DEPENDENT * F.get("squares", F.lit(step))
    none = F.lit(None).cast("double")
    out = left.select(
        *keys,
        "n",
        F.nanvl(F.when(usable & some, shared / F.sqrt(unexplained * own / freedom)), none).alias("t_stat"),
        F.nanvl(F.when(usable, shared / own), none).alias("gamma"),
    )
    verdict = F.when(F.col("t_stat").isNull(), F.lit(None).cast("string"))
    for limit, text in thresholds:
        verdict = verdict.when(F.col("t_stat") < limit, text)
    return out.withColumn("verdict", verdict.otherwise("not stationary"))
