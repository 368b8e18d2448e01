"""Window features, calendar, resampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns, season_columns
from ..operators import align, resample, rolling, split, technical
from ..sources.tables import table
from .base import ORD, ORDD, SUP, SUPD, SUPPLY_HI, SUPPLY_LO, W, frame, mean_sql, orders_daily, orders_panel, ratio_sql, rounded, std_sql, supplier_daily, supplier_panel, with_

CUTOFF = "1999-12-31"


def target_lags(spark, sf):
    return rolling.lag_features(orders_daily(spark, sf))


def tiered_lags(spark, sf):
    """Lags by importance of the series: nations decide the tier of a supplier."""
    s = table(spark, sf, "supplier")
    tier = F.when(F.col("s_nationkey") < 5, "core").when(F.col("s_nationkey") < 12, "important").otherwise("basic")
    tiers = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("series_id"), tier.alias("tier"))
    long = rolling.tiered_lag_features(supplier_panel(spark, sf), tiers)
    return long.filter(F.col("value").isNotNull())


def step_differences(spark, sf):
    return rolling.differences(orders_daily(spark, sf))


def percent_changes(spark, sf):
    """The three denominators side by side, on a level that is at times zero or negative."""
    level = supplier_panel(spark, sf).withColumn("value", F.col("value") - 20)
    out = rolling.changes(level, {"signed_1": 1, "signed_7": 7}, "signed")
    out = rolling.changes(out, {"abs_1": 1, "abs_7": 7}, "abs")
    return rounded(rolling.changes(out, {"panel_1": 1}, "abs", 1e-4, closed=True), 6)


def moving_averages(spark, sf):
    return rounded(rolling.mean_std_features(orders_daily(spark, sf)), 3)


def moving_averages_with_gaps(spark, sf):
    """Minimum periods count values, not days: the panel on its spine without filling."""
    p = supplier_panel(spark, sf)
    grid = align.spine(p.select("series_id").distinct(), SUPPLY_LO, SUPPLY_HI).join(p, ["series_id", "d"], "left")
    return rounded(rolling.mean_std_features(grid), 3)


def moving_quantiles(spark, sf):
    return rounded(rolling.quantile_features(orders_daily(spark, sf)), 3)


def moving_quantiles_with_gaps(spark, sf):
    """The same of many series, with days that have no value."""
    p = supplier_panel(spark, sf)
    grid = align.spine(p.select("series_id").distinct(), SUPPLY_LO, SUPPLY_HI).join(p, ["series_id", "d"], "left")
    return rounded(rolling.quantile_features(grid), 3)


def moving_averages_suppliers(spark, sf):
    """Moments of many daily as-of series: long runs of equal values between deliveries."""
    return rounded(rolling.mean_std_features(supplier_daily(spark, sf)), 3)


def level_ratios(spark, sf):
    return rounded(rolling.level_ratios(orders_daily(spark, sf)), 6)


def momentum_features(spark, sf):
    return rounded(rolling.momentum(orders_daily(spark, sf)), 6)


def return_volatility(spark, sf):
    return rounded(rolling.return_volatility(orders_daily(spark, sf)), 6)


def filled_panels(spark, sf):
    """Forward and backward fill of the sparse panel."""
    p = orders_panel(spark, sf)
    grid = align.spine(p.select("series_id").distinct(), "1994-12-20", "2001-09-30").join(p, ["series_id", "d"], "left")
    out = align.forward_fill(grid, out="ffill")
    return align.backward_fill(out, out="bfill")


def lead_labels(spark, sf):
    return rolling.lead_label(supplier_panel(spark, sf), "value")


def bollinger_position(spark, sf):
    return rounded(technical.bollinger_position(orders_daily(spark, sf)), 6)


def price_to_average(spark, sf):
    return rounded(technical.price_ratios(orders_daily(spark, sf)), 6)


def crossover_flags(spark, sf):
    return technical.crossover(orders_daily(spark, sf))


def recursive_indicators(spark, sf):
    return rounded(technical.recursive_indicators(orders_daily(spark, sf)), 4)


def calendar_features(spark, sf):
    days = orders_panel(spark, sf).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return rounded(days.withColumns(calendar_columns(F.col("d")) | season_columns(F.col("d"))), 6)


def weekly_rows_rebuilt(spark, sf):
    """Weekly rows with copied holiday flags and calendar columns of the picked day."""
    days = supplier_panel(spark, sf).withColumn("flag", (F.dayofmonth("d") <= 7).cast("int"))
    return resample.rebuild_calendar(resample.weekly_sample(days), ["month", "dayofweek", "weekofyear"])


def resampled_means(spark, sf):
    out = None
    for freq in ("week", "month"):
        part = resample.resample_mean(supplier_panel(spark, sf), freq).withColumn("frequency", F.lit(freq))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6)


def interpolated_days(spark, sf):
    """Daily axis, inner gaps linear, trailing gaps keep the last value, leading gaps are zero."""
    return rounded(resample.interpolate(resample.resample_mean(supplier_panel(spark, sf), "day")), 4)


def point_budget(spark, sf):
    return resample.point_budget(orders_panel(spark, sf), 1000)


def embargo_split(spark, sf):
    return split.train_val_test(supplier_panel(spark, sf), CUTOFF).select("series_id", "d", "split")


def weekly_split_report(spark, sf):
    weekly = resample.weekly_sample(supplier_panel(spark, sf))
    return split.split_report(split.train_test(weekly, CUTOFF), ["series_id"])


def labelled_split(spark, sf):
    weekly = resample.weekly_sample(rolling.differences(supplier_panel(spark, sf), (1,)))
    return split.labelled_split(weekly.drop("value"), "diff_1", CUTOFF)


def tuning_holdout(spark, sf):
    train = split.train_test(supplier_panel(spark, sf), CUTOFF).filter(F.col("split") == "train")
    return split.time_holdout(train).groupBy("series_id", "is_holdout").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))


def _moving_sql() -> str:
    parts = [f"round({mean_sql(n)}, 3) AS ma{n}" for n in rolling.MEAN_WINDOWS] + [f"round({std_sql(n)}, 3) AS std{n}" for n in rolling.STD_WINDOWS]
    return ", ".join(parts)


def _abs_change(k: int, eps: str = "> 1e-10") -> str:
    p = f"lag(value, {k}) OVER {W}"
    return f"CASE WHEN abs({p}) {eps} THEN (value - {p}) / abs({p}) END"


def _quantile_sql() -> str:
    parts = []
    for n in rolling.QUANTILE_WINDOWS:
        ok = f"count(value) OVER {frame(n)} >= {n // 2}"
        lo, hi = (f"quantile_cont(value, {q}) OVER {frame(n)}" for q in (0.1, 0.9))
        parts += [f"round(CASE WHEN {ok} THEN {lo} END, 3) AS p10_{n}", f"round(CASE WHEN {ok} THEN {hi} END, 3) AS p90_{n}", f"round(CASE WHEN {ok} THEN {hi} - {lo} END, 3) AS spread_{n}"]
    return ", ".join(parts)


def _rsi(p: int) -> str:
    """Wilder recursion written as a fold over the ordered steps."""
    return f"""rsi{p} AS (SELECT series_id, i, CASE WHEN i < {p} THEN NULL ELSE g END AS g, l FROM (
  WITH RECURSIVE w AS (
    SELECT s.series_id, CAST({p} AS BIGINT) AS i, avg(gain) AS g, avg(loss) AS l FROM st s WHERE i BETWEEN 1 AND {p} GROUP BY 1
    UNION ALL
    SELECT w.series_id, w.i + 1, (w.g * {p - 1} + s.gain) / {p}, (w.l * {p - 1} + s.loss) / {p} FROM w JOIN st s ON s.series_id = w.series_id AND s.i = w.i + 1)
  SELECT * FROM w))"""


_RECURSIVE = with_(ORDD) + f""", st AS (SELECT series_id, d, value, row_number() OVER {W} - 1 AS i, greatest(value - lag(value) OVER {W}, 0) AS gain, greatest(lag(value) OVER {W} - value, 0) AS loss FROM ordd),
{_rsi(7)},
{_rsi(14)},
vs AS (SELECT series_id, d, value, row_number() OVER {W} - 1 AS i FROM ordd WHERE value IS NOT NULL),
ema AS (SELECT * FROM (WITH RECURSIVE e AS (
    SELECT series_id, d, i, value AS a, value AS b, CAST(0 AS DOUBLE) AS s FROM vs WHERE i = 0
    UNION ALL
    SELECT series_id, d, i, a, b, s + ((a - b) - s) * 2 / 10 FROM (SELECT e.series_id, t.d, t.i, e.a + (t.value - e.a) * 2 / 13 AS a, e.b + (t.value - e.b) * 2 / 27 AS b, e.s FROM e JOIN vs t ON t.series_id = e.series_id AND t.i = e.i + 1))
  SELECT * FROM e))
SELECT st.series_id, st.d, st.value,
  round(CASE WHEN st.i >= 7 THEN CASE WHEN r7.l < 1e-10 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + r7.g / r7.l) END END, 4) AS rsi7,
  round(CASE WHEN st.i >= 14 THEN CASE WHEN r14.l < 1e-10 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + r14.g / r14.l) END END, 4) AS rsi14,
  round(a - b, 4) AS macd, round(s, 4) AS macd_signal, round(a - b - s, 4) AS macd_hist
FROM st LEFT JOIN rsi7 r7 USING (series_id, i) LEFT JOIN rsi14 r14 USING (series_id, i) LEFT JOIN ema ON ema.series_id = st.series_id AND ema.d = st.d"""

_CALENDAR = """year(d)::INTEGER AS year, month(d)::INTEGER AS month, day(d)::INTEGER AS day, quarter(d)::INTEGER AS quarter, (isodow(d) - 1)::INTEGER AS dayofweek, dayofyear(d)::INTEGER AS dayofyear, week(d)::INTEGER AS weekofyear, """ + ", ".join(
    [f"(month(d) = {m})::INTEGER AS month_{m}" for m in range(2, 13)] + [f"(quarter(d) = {q})::INTEGER AS quarter_{q}" for q in range(2, 5)]
    + [f"round({fn}(2 * pi() * {part}(d) / {n}), 6) + 0 AS {part}_{fn}" for part, n in (("month", 12), ("quarter", 4)) for fn in ("sin", "cos")]
)

QUERIES = {
    "target_lags": target_lags,
    "tiered_lags": tiered_lags,
    "step_differences": step_differences,
    "percent_changes": percent_changes,
    "moving_averages": moving_averages,
    "moving_averages_with_gaps": moving_averages_with_gaps,
    "moving_quantiles": moving_quantiles,
    "moving_quantiles_with_gaps": moving_quantiles_with_gaps,
    "moving_averages_suppliers": moving_averages_suppliers,
    "level_ratios": level_ratios,
    "momentum_features": momentum_features,
    "return_volatility": return_volatility,
    "filled_panels": filled_panels,
    "lead_labels": lead_labels,
    "bollinger_position": bollinger_position,
    "price_to_average": price_to_average,
    "crossover_flags": crossover_flags,
    "recursive_indicators": recursive_indicators,
    "calendar_features": calendar_features,
    "weekly_rows_rebuilt": weekly_rows_rebuilt,
    "resampled_means": resampled_means,
    "interpolated_days": interpolated_days,
    "point_budget": point_budget,
    "embargo_split": embargo_split,
    "weekly_split_report": weekly_split_report,
    "labelled_split": labelled_split,
    "tuning_holdout": tuning_holdout,
}

_tiers = """, t AS (SELECT 'S' || s_suppkey AS series_id, CASE WHEN s_nationkey < 5 THEN 'core' WHEN s_nationkey < 12 THEN 'important' ELSE 'basic' END AS tier FROM supplier),
l AS (""" + " UNION ALL ".join(
    f"SELECT series_id, d, tier, 'lag{k}' AS feature_id, lag(value, {k}) OVER {W} AS value FROM sup JOIN t USING (series_id) WHERE tier IN ({', '.join(repr(n) for n, ks in rolling.TIER_LAGS.items() if k in ks)})"
    for k in (1, 2, 3, 7, 14, 30)
) + ")\n"
_WEEKLY = "wk AS (SELECT series_id, max(struct_pack(f := isodow(d) = 5, d := d)).d AS d FROM sup GROUP BY series_id, isoyear(d), week(d))"
ORACLES = {
    "target_lags": with_(ORDD) + "SELECT *, " + ", ".join(f"lag(value, {k}) OVER {W} AS lag_{k}" for k in rolling.TARGET_LAGS) + " FROM ordd",
    "tiered_lags": with_(SUP) + _tiers + "SELECT * FROM l WHERE value IS NOT NULL",
    "step_differences": with_(ORDD) + f"SELECT *, value - lag(value, 1) OVER {W} AS diff_1, value - lag(value, 7) OVER {W} AS diff_7 FROM ordd",
    "percent_changes": with_(SUP) + f""", v AS (SELECT series_id, d, value - 20 AS value FROM sup)
SELECT series_id, d, value, """ + ", ".join(f"round((value - lag(value, {k}) OVER {W}) / nullif(lag(value, {k}) OVER {W}, 0), 6) + 0 AS signed_{k}, round({_abs_change(k)}, 6) AS abs_{k}" for k in (1, 7))
    + f", round({_abs_change(1, '>= 0.0001')}, 6) AS panel_1 FROM v",
    "moving_averages": with_(ORDD) + f"SELECT *, {_moving_sql()} FROM ordd",
    "moving_averages_with_gaps": with_(SUPD) + f""", g AS (SELECT g.series_id, g.d, p.value FROM supd_grid g LEFT JOIN sup p USING (series_id, d))
SELECT *, {_moving_sql()} FROM g""",
    "moving_quantiles": with_(ORDD) + f"SELECT *, {_quantile_sql()} FROM ordd",
    "moving_quantiles_with_gaps": with_(SUPD) + f""", g AS (SELECT g.series_id, g.d, p.value FROM supd_grid g LEFT JOIN sup p USING (series_id, d))
SELECT *, {_quantile_sql()} FROM g""",
    "moving_averages_suppliers": with_(SUPD) + f"SELECT *, {_moving_sql()} FROM supd",
    "level_ratios": with_(ORDD) + f""", m AS (SELECT *, {mean_sql(7, 3)} AS a, {mean_sql(30, 10)} AS b FROM ordd)
SELECT series_id, d, value, round({ratio_sql('value', 'a')}, 6) AS ratio_ma7, round({ratio_sql('value', 'b')}, 6) AS ratio_ma30, round({ratio_sql('a', 'b')}, 6) AS ma7_ma30 FROM m""",
    "momentum_features": with_(ORDD) + "SELECT *, " + ", ".join(f"round({_abs_change(k)}, 6) AS {n}" for n, k in ({f"mom{k}": k for k in rolling.MOMENTUM_STEPS} | rolling.YEAR_MONTH_WEEK_STEPS).items()) + " FROM ordd",
    "return_volatility": with_(ORDD) + f""", r AS (SELECT *, {_abs_change(1)} AS ret FROM ordd)
SELECT series_id, d, value, round(ret, 6) AS ret, round({std_sql(14, 7, 'ret')}, 6) AS vol_14, round({std_sql(30, 10, 'ret')}, 6) AS vol_30 FROM r""",
    "filled_panels": with_(ORD) + """, g AS (SELECT series_id, CAST(unnest(generate_series(DATE '1994-12-20', DATE '2001-09-30', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT series_id FROM ord)),
j AS (SELECT g.series_id, g.d, ord.value FROM g LEFT JOIN ord USING (series_id, d))
SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffill,
  first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill FROM j""",
    "lead_labels": with_(SUP) + f"SELECT * FROM (SELECT *, lead(value) OVER {W} AS label, lead(d) OVER {W} AS label_d FROM sup) WHERE label IS NOT NULL",
    "bollinger_position": with_(ORDD) + f""", m AS (SELECT *, {mean_sql(20)} AS m, {std_sql(20)} AS s FROM ordd)
SELECT series_id, d, value, round(CASE WHEN 4 * s > 1e-10 THEN (value - (m - 2 * s)) / (4 * s) END, 6) AS bb_pos FROM m""",
    "price_to_average": with_(ORDD) + ", m AS (SELECT *, " + ", ".join(f"{mean_sql(n)} AS m{n}" for n in technical.PRICE_WINDOWS) + f", {mean_sql(5, 3)} AS a, {mean_sql(20, 10)} AS b FROM ordd)\nSELECT series_id, d, value, "
    + ", ".join(f"round({ratio_sql('value', f'm{n}')}, 6) AS price_ma{n}" for n in technical.PRICE_WINDOWS) + f", round({ratio_sql('a', 'b')}, 6) AS ma5_ma20 FROM m",
    "crossover_flags": with_(ORDD) + f""", m AS (SELECT *, {mean_sql(5, 3)} AS a, {mean_sql(20, 10)} AS b, row_number() OVER {W} - 1 AS i FROM ordd), l AS (SELECT *, lag(a) OVER {W} AS pa, lag(b) OVER {W} AS pb FROM m)
SELECT series_id, d, value, CAST(CASE WHEN i < 5 THEN 0 WHEN pa <= pb AND a > b THEN 1 WHEN pa >= pb AND a < b THEN -1 ELSE 0 END AS INTEGER) AS crossover FROM l""",
    "recursive_indicators": _RECURSIVE,
    "calendar_features": with_(ORD) + f""", days AS (SELECT d, count(*) AS n FROM ord GROUP BY 1)
SELECT d, n, {_CALENDAR}, (month(d) * 100 + day(d) >= 1115 OR month(d) * 100 + day(d) <= 315)::INTEGER AS heating_season, (day(d) <= 5)::INTEGER AS month_start, (day(d) >= 25)::INTEGER AS month_end FROM days""",
    "weekly_rows_rebuilt": with_(SUP, _WEEKLY) + """SELECT series_id, d, value, (day(d) <= 7)::INTEGER AS flag, month(d)::INTEGER AS month, (isodow(d) - 1)::INTEGER AS dayofweek, week(d)::INTEGER AS weekofyear FROM sup JOIN wk USING (series_id, d)""",
    "resampled_means": with_(SUP) + """, b AS (SELECT min(d) AS lo, max(d) AS hi FROM sup), s AS (SELECT DISTINCT series_id FROM sup),
wa AS (SELECT series_id, CAST(unnest(generate_series(lo + CAST(7 - isodow(lo) AS INTEGER), hi + CAST(7 - isodow(hi) AS INTEGER), INTERVAL 7 DAY)) AS DATE) AS d FROM s, b),
ma AS (SELECT series_id, last_day(CAST(unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS DATE)) AS d FROM s, b),
wm AS (SELECT series_id, d + CAST(7 - isodow(d) AS INTEGER) AS d, avg(value) AS value FROM sup GROUP BY 1, 2), mm AS (SELECT series_id, last_day(d) AS d, avg(value) AS value FROM sup GROUP BY 1, 2)
SELECT wa.series_id, wa.d, round(wm.value, 6) AS value, 'week' AS frequency FROM wa LEFT JOIN wm USING (series_id, d)
UNION ALL SELECT ma.series_id, ma.d, round(mm.value, 6), 'month' FROM ma LEFT JOIN mm USING (series_id, d)""",
    "interpolated_days": with_(SUP) + """, b AS (SELECT min(d) AS lo, max(d) AS hi FROM sup), a AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT series_id FROM sup), b),
p AS (SELECT a.series_id, a.d, x.d AS pd, x.value AS pv FROM a ASOF LEFT JOIN sup x ON a.series_id = x.series_id AND a.d >= x.d),
n AS (SELECT p.*, y.d AS nd, y.value AS nv FROM p ASOF LEFT JOIN sup y ON p.series_id = y.series_id AND p.d <= y.d)
SELECT series_id, d, round(coalesce(CASE WHEN pd = d THEN pv END, pv + (nv - pv) / (nd - pd) * (d - pd), pv, 0), 4) AS value FROM n""",
    "point_budget": with_(ORD) + """, n AS (SELECT 1000 // count(DISTINCT series_id) AS n FROM ord), k AS (SELECT d FROM (SELECT DISTINCT d FROM ord) ORDER BY d DESC LIMIT (SELECT n FROM n))
SELECT series_id, d, value FROM ord WHERE d IN (SELECT d FROM k)""",
    "embargo_split": with_(SUP) + f""", k AS (SELECT series_id, d, d <= DATE '{CUTOFF}' AS early FROM sup WHERE d <= DATE '{CUTOFF}' OR d >= DATE '{CUTOFF}' + 98),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, early ORDER BY d) AS r, count(*) OVER (PARTITION BY series_id, early) AS n FROM k)
SELECT series_id, d, CASE WHEN NOT early THEN 'test' WHEN r <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS split FROM r""",
    "weekly_split_report": with_(SUP, _WEEKLY) + f"""SELECT series_id, count(*) FILTER (d <= DATE '{CUTOFF}') AS train_rows, count(*) FILTER (d >= DATE '{CUTOFF}' + 98) AS test_rows, min(d) FILTER (d <= DATE '{CUTOFF}') AS train_start,
  max(d) FILTER (d <= DATE '{CUTOFF}') AS train_end, min(d) FILTER (d >= DATE '{CUTOFF}' + 98) AS test_start, max(d) FILTER (d >= DATE '{CUTOFF}' + 98) AS test_end,
  CAST(min(d) FILTER (d >= DATE '{CUTOFF}' + 98) - max(d) FILTER (d <= DATE '{CUTOFF}') AS INTEGER) AS gap_days FROM wk GROUP BY 1""",
    "labelled_split": with_(SUP, _WEEKLY) + f""", f AS (SELECT series_id, d, value - lag(value) OVER {W} AS diff_1 FROM sup), j AS (SELECT f.* FROM f JOIN wk USING (series_id, d)),
l AS (SELECT *, lead(diff_1) OVER {W} AS label, lead(d) OVER {W} AS label_d FROM j)
SELECT series_id, d, diff_1, label, label_d, CASE WHEN d <= DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS split FROM l
WHERE label IS NOT NULL AND ((d <= DATE '{CUTOFF}' AND label_d <= DATE '{CUTOFF}') OR d >= DATE '{CUTOFF}' + 98)""",
    "tuning_holdout": with_(SUP) + f""", r AS (SELECT series_id, d, row_number() OVER {W} > floor(0.9 * count(*) OVER (PARTITION BY series_id)) AS is_holdout FROM sup WHERE d <= DATE '{CUTOFF}')
SELECT series_id, is_holdout, count(*) AS n, min(d) AS lo, max(d) AS hi FROM r GROUP BY 1, 2""",
}
