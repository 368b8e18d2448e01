"""Cleaning rules. Bounds are measured per series on the raw values and joined back; the rules
then apply in a fixed order: non-negative, clip, jump removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import has_any
from ..functions.guarded import change_ratio, clip
from .align import by_day, forward_fill


def with_jumps(panel: DataFrame) -> DataFrame:
    return panel.withColumn("_step", F.col("value") - F.lag("value").over(by_day()))


def cleaning_bounds(
    panel: DataFrame, k_iqr: float = 3.0, k_jump: float = 5.0, min_count: int = 100, fit_until: str | None = None
) -> DataFrame:
    """Per series: clip bounds from the quartiles and the largest allowed one-step jump. NULL
    bounds (too few values) switch the rule off. ``fit_until`` keeps later rows out of the
    statistics; by default the whole history is used."""
    stepped = panel if "_step" in panel.columns else with_jumps(panel)
    if fit_until is not None:
        stepped = stepped.filter(F.col("d") <= F.lit(fit_until).cast("date"))
    stats = stepped.groupBy("series_id").agg(
        F.count("value").alias("n"),
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"),
        F.stddev_samp("_step").alias("step_std"),
    )
    q1, q3 = F.get("q", 0), F.get("q", 1)
    enough = F.col("n") > min_count
    return stats.select(
        "series_id",
        F.when(enough, q1 - k_iqr * (q3 - q1)).alias("lower"),
        F.when(enough, q3 + k_iqr * (q3 - q1)).alias("upper"),
        F.when(enough & (F.col("step_std") > 0), k_jump * F.col("step_std")).alias("max_jump"),
    )


def flag_values(panel: DataFrame, catalog: DataFrame, inventory_words: list[str], **bounds) -> DataFrame:
    """The panel with one boolean per rule, all measured on the raw series."""
    stepped = with_jumps(panel)
    v = F.col("value")
    return (
        stepped.join(cleaning_bounds(stepped, **bounds), "series_id")
        .join(catalog.select("series_id", has_any(F.col("series_name"), inventory_words).alias("is_inventory")), "series_id")
        .withColumns(
            {
                "is_neg": F.coalesce(F.col("is_inventory") & (v < 0), F.lit(False)),
                "is_low": F.coalesce(v < F.col("lower"), F.lit(False)),
                "is_high": F.coalesce(v > F.col("upper"), F.lit(False)),
                "is_jump": F.coalesce(F.abs("_step") > F.col("max_jump"), F.lit(False)),
            }
        )
    )


def apply_flags(flagged: DataFrame) -> DataFrame:
    v = F.col("value")
    bounded = F.when(F.col("lower").isNull(), v).otherwise(clip(v, F.col("lower"), F.col("upper")))
    return flagged.withColumn("cleaned", F.when(~F.col("is_neg") & ~F.col("is_jump"), bounded))


def clean_panel(panel: DataFrame, catalog: DataFrame, inventory_words: list[str], **bounds) -> DataFrame:
    flagged = apply_flags(flag_values(panel, catalog, inventory_words, **bounds))
    return flagged.select("series_id", "d", F.col("cleaned").alias("value"))


def validation_report(panel: DataFrame, catalog: DataFrame, inventory_words: list[str], **bounds) -> DataFrame:
    """Per series: how many values each rule hits, and the bounds used."""
    flagged = apply_flags(flag_values(panel, catalog, inventory_words, **bounds))
    return flagged.groupBy("series_id").agg(
        F.count("value").alias("valid_before"),
        F.count("cleaned").alias("valid_after"),
        F.count_if("is_neg").alias("neg"),
        F.count_if("is_low").alias("low"),
        F.count_if("is_high").alias("high"),
        F.count_if("is_jump").alias("jump"),
        F.first("lower").alias("lower"),
        F.first("upper").alias("upper"),
    )


def validation_totals(report: DataFrame) -> DataFrame:
    rules = ("neg", "low", "high", "jump")
    return report.agg(
        *[F.sum(r).alias(f"{r}_values") for r in rules], *[F.count_if(F.col(r) > 0).alias(f"{r}_series") for r in rules]
    )


def limits(panel: DataFrame, method: Column | str, lower: float = 0.01, upper: float = 0.99, n_std: float = 3.0) -> DataFrame:
    """Winsorizing limits per series: percentiles or mean plus/minus ``n_std`` deviations."""
    stats = panel.groupBy("series_id").agg(
        F.percentile("value", F.array(F.lit(lower), F.lit(upper))).alias("q"),
        F.avg("value").alias("m"),
        F.stddev_samp("value").alias("s"),
    )
    wide = F.coalesce(F.col("s"), F.lit(0.0)) * n_std
    by_method = {
        "percentile": (F.get("q", 0), F.get("q", 1)),
        "std": (F.col("m") - wide, F.col("m") + wide),
    }
    low, high = by_method[method]
    return stats.select("series_id", low.alias("low"), high.alias("high"))


def winsorize(panel: DataFrame, method: str, **kw) -> DataFrame:
    joined = panel.join(limits(panel, method, **kw), "series_id")
    return joined.withColumn("value", clip(F.col("value"), F.col("low"), F.col("high"))).drop("low", "high")


def repair_jumps(panel: DataFrame, max_change: float = 0.5, near_zero: float = 1.0) -> DataFrame:
    """Jumps and near-zero values become gaps, gaps take the last good value, and what is left
    at the start takes the median of the filled series."""
    before = F.lag("value").over(by_day())
    bad = (F.abs(change_ratio(F.col("value"), before)) > max_change) | (F.col("value") < near_zero)
    holes = panel.withColumn("_bad", bad).withColumn(
        "_kept", F.when(~F.coalesce(F.col("_bad"), F.lit(False)), F.col("value"))
    )
    filled = forward_fill(holes, "_kept", "_filled")
    median = filled.groupBy("series_id").agg(F.percentile("_filled", F.lit(0.5)).alias("_median"))
    return filled.join(median, "series_id").select(
        "series_id", "d", F.coalesce("_filled", "_median").alias("value"), F.coalesce("_bad", F.lit(False)).alias("repaired")
    )


def apply_policy(panel: DataFrame, policy: DataFrame) -> DataFrame:
    """``policy(series_id, method)`` names the series to clean and how (percentile, std or fill);
    series without an entry pass unchanged. Each method runs only over its own series."""
    tagged = panel.join(policy, "series_id", "left").withColumn("method", F.coalesce("method", F.lit("none")))
    parts = [tagged.filter(F.col("method") == "none").select("series_id", "d", "value", "method")]
    for method in ("percentile", "std", "fill"):
        own = tagged.filter(F.col("method") == method).select("series_id", "d", "value")
        done = repair_jumps(own) if method == "fill" else winsorize(own, method)
        parts.append(done.select("series_id", "d", "value", F.lit(method).alias("method")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def outlier_analysis(panel: DataFrame, n_std: float = 3.0, near_zero: float = 1.0) -> DataFrame:
    v = F.col("value")
    seen = panel.filter(v.isNotNull()).join(limits(panel, "std", n_std=n_std), "series_id")
    outside = (v < F.col("low")) | (v > F.col("high"))
    return seen.groupBy("series_id").agg(
        F.count(v).alias("n"),
        F.count_if(outside).alias("outliers"),
        F.avg(outside.cast("double")).alias("outlier_share"),
        F.count_if(clip(v, F.col("low"), F.col("high")) != v).alias("changed_by_clip"),
        F.count_if(v < near_zero).alias("near_zero"),
    )


def outlier_rows(panel: DataFrame, n_std: float = 3.0) -> DataFrame:
    v = F.col("value")
    joined = panel.join(limits(panel, "std", n_std=n_std), "series_id")
    return joined.filter((v < F.col("low")) | (v > F.col("high"))).select("series_id", "d", "value")
