"""Cleaning rules over the supplier panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.guarded import clip
from ..operators import clean, rolling
from ..sources.tables import table
from .base import SUP, W, rounded, supplier_panel, with_

# suppliers stand in for inventory series when their number ends in 7
INVENTORY_WORDS = ["7"]


def _catalog(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("series_id"), F.substring("s_name", -1, 1).alias("series_name"))


def _net(spark, sf):
    """Daily quantity against the series' own usual level, so that negative values occur."""
    return supplier_panel(spark, sf).withColumn("value", F.col("value") - 12)


def non_negative_inventory(spark, sf):
    flagged = clean.flag_values(_net(spark, sf), _catalog(spark, sf), INVENTORY_WORDS)
    return flagged.select("series_id", "d", F.when(~F.col("is_neg"), F.col("value")).alias("value"))


def iqr_clip(spark, sf):
    bounds = clean.cleaning_bounds(_net(spark, sf))
    joined = _net(spark, sf).join(bounds, "series_id")
    v = F.col("value")
    return rounded(joined.select("series_id", "d", F.when(F.col("lower").isNull(), v).otherwise(clip(v, F.col("lower"), F.col("upper"))).alias("value")))


def jump_removal(spark, sf):
    flagged = clean.flag_values(_net(spark, sf), _catalog(spark, sf), INVENTORY_WORDS, k_jump=3.0)
    return flagged.filter("is_jump").select("series_id", "d", "value")


def cleaned_panel(spark, sf):
    return rounded(clean.clean_panel(_net(spark, sf), _catalog(spark, sf), INVENTORY_WORDS, k_jump=3.0))


def cleaned_panel_fitted_before(spark, sf):
    """Bounds measured only on the years before the cutoff."""
    return rounded(clean.clean_panel(_net(spark, sf), _catalog(spark, sf), INVENTORY_WORDS, k_jump=3.0, fit_until="1999-12-31"))


def validation_report(spark, sf):
    return rounded(clean.validation_report(_net(spark, sf), _catalog(spark, sf), INVENTORY_WORDS, k_jump=3.0))


def validation_totals(spark, sf):
    return clean.validation_totals(clean.validation_report(_net(spark, sf), _catalog(spark, sf), INVENTORY_WORDS, k_jump=3.0))


def winsorized_percentiles(spark, sf):
    return rounded(clean.winsorize(supplier_panel(spark, sf), "percentile"))


def winsorized_deviations(spark, sf):
    return rounded(clean.winsorize(supplier_panel(spark, sf), "std"))


def clipped_changes(spark, sf):
    changed = rolling.changes(supplier_panel(spark, sf), {"pct_1": 1, "pct_7": 7}, "signed")
    return rounded(changed.select("series_id", "d", *[clip(F.col(c), -0.5, 0.5).alias(c) for c in ("pct_1", "pct_7")]), 6)


def repaired_jumps(spark, sf):
    return clean.repair_jumps(supplier_panel(spark, sf), max_change=4.0, near_zero=5.0)


def cleaning_policy(spark, sf):
    """Each series by its own method: nations decide."""
    s = table(spark, sf, "supplier")
    method = F.when(F.col("s_nationkey") < 8, "percentile").when(F.col("s_nationkey") < 14, "std").when(F.col("s_nationkey") < 20, "fill")
    policy = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("series_id"), method.alias("method")).filter(F.col("method").isNotNull())
    return rounded(clean.apply_policy(supplier_panel(spark, sf), policy))


def outlier_analysis(spark, sf):
    return rounded(clean.outlier_analysis(supplier_panel(spark, sf), near_zero=3.0), 6)


def outlier_rows(spark, sf):
    return clean.outlier_rows(supplier_panel(spark, sf))


NET = SUP + ",\nnet AS (SELECT series_id, d, value - 12 AS value FROM sup)"


def _flags(k_jump: int, until: str = "") -> str:
    where = f"WHERE d <= DATE '{until}'" if until else ""
    return with_(NET) + f""", s AS (SELECT *, value - lag(value) OVER {W} AS step FROM net),
b AS (SELECT series_id, CASE WHEN count(value) > 100 THEN quantile_cont(value, 0.25) END AS q1, CASE WHEN count(value) > 100 THEN quantile_cont(value, 0.75) END AS q3,
  CASE WHEN count(value) > 100 AND stddev_samp(step) > 0 THEN {k_jump} * stddev_samp(step) END AS mj FROM s {where} GROUP BY 1),
f AS (SELECT s.series_id, d, value, q1 - 3 * (q3 - q1) AS lower, q3 + 3 * (q3 - q1) AS upper,
  coalesce(value < 0 AND series_id LIKE '%7', false) AS neg, coalesce(value < q1 - 3 * (q3 - q1), false) AS low, coalesce(value > q3 + 3 * (q3 - q1), false) AS high,
  coalesce(abs(step) > mj, false) AS jump FROM s JOIN b USING (series_id)),
c AS (SELECT *, CASE WHEN NOT neg AND NOT jump THEN CASE WHEN lower IS NULL THEN value ELSE least(greatest(value, lower), upper) END END AS cleaned FROM f)
"""


_POLICY = """, p AS (SELECT 'S' || s_suppkey AS series_id, CASE WHEN s_nationkey < 8 THEN 'percentile' WHEN s_nationkey < 14 THEN 'std' WHEN s_nationkey < 20 THEN 'fill' ELSE 'none' END AS method FROM supplier),
q AS (SELECT series_id, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS z, avg(value) - 3 * coalesce(stddev_samp(value), 0) AS lo, avg(value) + 3 * coalesce(stddev_samp(value), 0) AS hi FROM sup GROUP BY 1),
"""


def _repair(max_change: float, near_zero: float) -> str:
    return f"""k AS (SELECT *, coalesce(abs((value - lag(value) OVER {W}) / nullif(abs(lag(value) OVER {W}), 0)) > {max_change} OR value < {near_zero}, false) AS bad FROM sup),
l AS (SELECT *, last_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM k),
r AS (SELECT series_id, d, coalesce(filled, quantile_cont(filled, 0.5) OVER (PARTITION BY series_id)) AS value, bad AS repaired FROM l)
"""


_LIMITS = ", q AS (SELECT series_id, avg(value) - 3 * coalesce(stddev_samp(value), 0) AS lo, avg(value) + 3 * coalesce(stddev_samp(value), 0) AS hi FROM sup GROUP BY 1)\n"

QUERIES = {
    "non_negative_inventory": non_negative_inventory,
    "iqr_clip": iqr_clip,
    "jump_removal": jump_removal,
    "cleaned_panel": cleaned_panel,
    "cleaned_panel_fitted_before": cleaned_panel_fitted_before,
    "validation_report": validation_report,
    "validation_totals": validation_totals,
    "winsorized_percentiles": winsorized_percentiles,
    "winsorized_deviations": winsorized_deviations,
    "clipped_changes": clipped_changes,
    "repaired_jumps": repaired_jumps,
    "cleaning_policy": cleaning_policy,
    "outlier_analysis": outlier_analysis,
    "outlier_rows": outlier_rows,
}
_REPORT = _flags(3) + """, rep AS (SELECT series_id, count(value) AS valid_before, count(cleaned) AS valid_after, count(*) FILTER (neg) AS neg, count(*) FILTER (low) AS low, count(*) FILTER (high) AS high,
  count(*) FILTER (jump) AS jump, round(any_value(lower), 4) AS lower, round(any_value(upper), 4) AS upper FROM c GROUP BY 1)
"""
ORACLES = {
    "non_negative_inventory": _flags(5) + "SELECT series_id, d, CASE WHEN NOT neg THEN value END AS value FROM c",
    "iqr_clip": _flags(5) + "SELECT series_id, d, round(CASE WHEN lower IS NULL THEN value ELSE least(greatest(value, lower), upper) END, 4) AS value FROM c",
    "jump_removal": _flags(3) + "SELECT series_id, d, value FROM c WHERE jump",
    "cleaned_panel": _flags(3) + "SELECT series_id, d, round(cleaned, 4) AS value FROM c",
    "cleaned_panel_fitted_before": _flags(3, "1999-12-31") + "SELECT series_id, d, round(cleaned, 4) AS value FROM c",
    "validation_report": _REPORT + "SELECT * FROM rep",
    "validation_totals": _REPORT + "SELECT " + ", ".join(f"CAST(sum({r}) AS BIGINT) AS {r}_values, count(*) FILTER ({r} > 0) AS {r}_series" for r in ("neg", "low", "high", "jump")) + " FROM rep",
    "winsorized_percentiles": with_(SUP) + """, q AS (SELECT series_id, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS z FROM sup GROUP BY 1)
SELECT series_id, d, round(least(greatest(value, a), z), 4) AS value FROM sup JOIN q USING (series_id)""",
    "winsorized_deviations": with_(SUP) + _LIMITS + "SELECT series_id, d, round(least(greatest(value, lo), hi), 4) AS value FROM sup JOIN q USING (series_id)",
    "clipped_changes": with_(SUP) + f""", c AS (SELECT series_id, d, (value - lag(value, 1) OVER {W}) / nullif(lag(value, 1) OVER {W}, 0) AS a, (value - lag(value, 7) OVER {W}) / nullif(lag(value, 7) OVER {W}, 0) AS b FROM sup)
SELECT series_id, d, CASE WHEN a IS NOT NULL THEN round(least(greatest(a, -0.5), 0.5), 6) END AS pct_1, CASE WHEN b IS NOT NULL THEN round(least(greatest(b, -0.5), 0.5), 6) END AS pct_7 FROM c""",
    "repaired_jumps": with_(SUP) + ", " + _repair(4.0, 5.0) + "SELECT series_id, d, value, repaired FROM r",
    "cleaning_policy": with_(SUP) + _POLICY + _repair(0.5, 1.0) + """SELECT r.series_id, r.d, method, round(CASE method WHEN 'percentile' THEN least(greatest(sup.value, a), z)
  WHEN 'std' THEN least(greatest(sup.value, lo), hi) WHEN 'fill' THEN r.value ELSE sup.value END, 4) AS value FROM r JOIN sup USING (series_id, d) JOIN p USING (series_id) JOIN q USING (series_id)""",
    "outlier_analysis": with_(SUP) + _LIMITS + """SELECT series_id, count(value) AS n, count(*) FILTER (value < lo OR value > hi) AS outliers, round(avg(CASE WHEN value < lo OR value > hi THEN 1.0 ELSE 0.0 END), 6) AS outlier_share,
  count(*) FILTER (least(greatest(value, lo), hi) <> value) AS changed_by_clip, count(*) FILTER (value < 3) AS near_zero FROM sup JOIN q USING (series_id) GROUP BY 1""",
    "outlier_rows": with_(SUP) + _LIMITS + "SELECT series_id, d, value FROM sup JOIN q USING (series_id) WHERE value < lo OR value > hi",
}
