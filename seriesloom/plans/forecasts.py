"""Stationarity, forecast metrics and boosted-tree jobs.

Forecasts on the supplier panel are naive (the last value); those of the tree jobs come from
models fitted on weekly samples of the orders panel."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import forest, metrics, model, resample, rolling, select, split, stationarity, tables
from ..operators.align import by_day
from ..session import cut_lineage, written
from ..sources.tables import table
from .base import ORDD, SUP, SUPD, W, orders_daily, rounded, supplier_daily, supplier_panel, with_

CUTOFF = "1999-12-31"


def _naive(spark, sf):
    """Last-value forecasts per supplier."""
    p = supplier_panel(spark, sf).withColumn("y_pred", F.lag("value").over(by_day()))
    return p.filter(F.col("y_pred").isNotNull()).select(F.col("series_id").alias("target_id"), "d", F.col("value").alias("y_true"), "y_pred")


def _split_naive(spark, sf):
    return split.train_test(_naive(spark, sf), CUTOFF)


def forecast_metrics(spark, sf):
    return rounded(metrics.forecast_metrics(_naive(spark, sf)), 6)


def overfit_gap(spark, sf):
    return rounded(metrics.overfit_gap(metrics.forecast_metrics(_split_naive(spark, sf), ["target_id", "split"])), 6)


def direction_hits(spark, sf):
    return metrics.direction_hits(_naive(spark, sf)).select("target_id", "d", "hit")


def error_percentiles(spark, sf):
    return metrics.error_percentiles(_naive(spark, sf))


def error_histogram(spark, sf):
    return metrics.error_histogram(_naive(spark, sf), 10.0)


def latest_predictions(spark, sf):
    return metrics.latest_rows(_naive(spark, sf), 10)


def _runs(spark, sf):
    """Old and new accuracy per supplier: before and after the cutoff; groups are nations."""
    gap = metrics.overfit_gap(metrics.forecast_metrics(_split_naive(spark, sf), ["target_id", "split"]))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("target_id"), F.col("s_nationkey").cast("string").alias("grp"))
    return gap.join(s, "target_id").select("target_id", "grp", F.round("train_mda", 4).alias("old_mda"), F.round("test_mda", 4).alias("new_mda"))


def run_comparison(spark, sf):
    return rounded(metrics.run_comparison(_runs(spark, sf), 0.55), 8)


def runs_by_change(spark, sf):
    return metrics.order_by_change(_runs(spark, sf).select("target_id", F.round(F.col("new_mda") - F.col("old_mda"), 5).alias("change")))


def dates_newest_first(spark, sf):
    """Date texts, some unusable, newest first and the unusable last."""
    o = table(spark, sf, "orders").groupBy("o_orderdate", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    day = F.to_date("o_orderdate").cast("string")
    return metrics.order_by_date_text(o.select(F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("about "), day)).otherwise(day).alias("day"), "o_orderstatus", "n"), "day")


def best_so_far(spark, sf):
    """Events as trials of a study per type, numbered in order of arrival."""
    e = table(spark, sf, "events").select(F.concat(F.col("event_type"), F.lit("-"), F.col("user_id").cast("string")).alias("study_id"), F.col("event_id").alias("number"), F.col("value").alias("mda"))
    return metrics.best_so_far(e)


def autocorrelation(spark, sf):
    return rounded(stationarity.autocorrelation(orders_daily(spark, sf)), 6)


def panel_versions(spark, sf):
    return rounded(stationarity.panel_versions(supplier_panel(spark, sf)), 6)


def stationarity_by_version(spark, sf):
    """Unit-root statistics of the raw, differenced and percentage panels of all suppliers."""
    return rounded(stationarity.adf_test(stationarity.panel_versions(supplier_panel(spark, sf))), 5)


def unit_root_sums(spark, sf):
    """The cross products the regression is solved from: series, observations, first sums."""
    sums = stationarity.adf_sums(supplier_panel(spark, sf), 1, ["series_id"])
    return sums.select("series_id", "n", *[F.round(F.get("sums", i), 2).alias(f"s{i}") for i in range(15)])


# ---- trees


def weekly_samples(spark, sf):
    """Weekly labelled rows and their long features for every priority."""
    daily = orders_daily(spark, sf)
    wide = rolling.lag_features(daily, (1, 2, 7, 14)).withColumns({"ma7": rolling.rolling_mean("value", 7), "ma30": rolling.rolling_mean("value", 30), "std14": rolling.rolling_std("value", 14)})
    names = ["lag_1", "lag_2", "lag_7", "lag_14", "ma7", "ma30", "std14"]
    weekly = cut_lineage(resample.weekly_sample(wide).withColumnRenamed("series_id", "target_id"))
    features = rolling.to_long(weekly, names, ("target_id", "d")).filter(F.col("value").isNotNull())
    labels = split.labelled_split(weekly.select("target_id", "d", F.col("value").alias("level")), "level", CUTOFF, keys=["target_id"])
    order = model.feature_index(features)
    return cut_lineage(model.assemble(features, labels.select("target_id", "d", "label", "split"), order)), order


SMALL = {"max_depth": 3, "max_iter": 4, "step_size": 0.2, "subsample": 0.8, "min_leaf": 5}


def tree_predictions(spark, sf):
    """One model over all priorities; both splits scored."""
    rows, _ = weekly_samples(spark, sf)
    return rounded(model.refit_and_score(rows, SMALL)[1], 2)


BOOSTED = {"n_trees": 8, "max_depth": 2, "step_size": 0.3, "subsample": 1.0, "min_leaf": 5, "reg_lambda": 1.0}
STUMP = BOOSTED | {"n_trees": 1, "max_depth": 1}
LAGS = (1, 7, 14, 28)


def supplier_samples(spark, sf):
    """Weekly rows of every supplier with the next week's level as label: as many targets as suppliers.
    Written once: scales, bins and rows of the trees all start from them."""
    daily = rolling.lag_features(supplier_daily(spark, sf), LAGS)
    weekly = resample.weekly_sample(daily).withColumnRenamed("series_id", "target_id")
    lags = [f"lag_{k}" for k in LAGS]
    rows = split.labelled_split(weekly, "value", CUTOFF, keys=["target_id"])
    features = F.array("value", *lags, F.col("value") - F.col("lag_7"))
    return written(rows.select("target_id", "d", "label", "split", features.alias("features")), "supplier-samples")


def stump_by_target(spark, sf):
    """One split per supplier: the nodes of a tree of depth one."""
    samples = supplier_samples(spark, sf)
    nodes = forest.fit(samples, forest.parameters(spark, forest.one_model_each(samples), STUMP))[1]
    return nodes.select(F.col("model_id").alias("target_id"), "node", "feature", "bin", F.round("gain", -6).alias("gain"), "n", F.round("value", 6).alias("value"))


def boosted_predictions(spark, sf):
    """Trees of depth two of every supplier, grown in the same jobs; all rows scored."""
    samples = supplier_samples(spark, sf)
    scored = forest.fit(samples, forest.parameters(spark, forest.one_model_each(samples), BOOSTED))[0]
    return rounded(scored.select("target_id", "d", "split", "y_true", "y_pred"), 6)


def tree_metrics_by_target(spark, sf):
    """One model per supplier, all in the same jobs; a target that cannot be trained has a reason. Suppliers
    of few weeks: those of the last nations are seen from the cutoff's year on only."""
    samples = supplier_samples(spark, sf)
    s = table(spark, sf, "supplier").filter("s_nationkey >= 20").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("target_id"), F.lit(True).alias("late"))
    samples = samples.join(s, "target_id", "left").filter("late is null or d >= '1999-06-01'").drop("late")
    return rounded(forest.train_targets(samples, BOOSTED), 6)


def halved_search(spark, sf):
    """Fifty draws of parameters for every priority, the better half of which grows on."""
    rows, _ = weekly_samples(spark, sf)
    samples = rows.filter(F.col("split") == "train").select("target_id", "d", "label", vector_to_array("features").alias("features"))
    held = split.time_holdout(samples, keys=["target_id"])
    samples = held.withColumn("split", F.when(F.col("is_holdout"), "holdout").otherwise("train")).drop("is_holdout")
    return rounded(forest.halving(samples, forest.draw_trials(samples, 50), (2, 4)), 6)


def parameter_search(spark, sf):
    """A few seeded trials around the small reference point, scored on the time holdout."""
    rows, _ = weekly_samples(spark, sf)
    trials = model.draw_trials(model.search_space(SMALL), 2)
    return rounded(metrics.best_so_far(model.search_parameters(rows.filter(F.col("split") == "train"), trials)), 4)


def tree_early_stopping(spark, sf):
    rows, _ = weekly_samples(spark, sf)
    held = split.time_holdout(rows.filter(F.col("split") == "train"), keys=["target_id"])
    fitted = model.fit_early_stopping(held, SMALL)
    return rounded(model.predictions(fitted, rows.filter(F.col("split") == "test")), 2)


def tree_feature_selection(spark, sf):
    """Importance above zero, at most four features per model."""
    rows, order = weekly_samples(spark, sf)
    fitted = model.fit(rows.filter(F.col("split") == "train"), SMALL)
    return select.cap_by_importance(model.feature_importance(spark, fitted, order, "all"), 4)


def model_summary(spark, sf):
    """Metrics, parameters, last predictions and features of every target, one row each."""
    pred = _naive(spark, sf)
    m = metrics.forecast_metrics(pred).select("target_id", F.round("mda", 6).alias("mda"), F.round("mae", 4).alias("mae"))
    s = table(spark, sf, "supplier")
    records = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("target_id"), F.create_map(F.lit("nation"), F.col("s_nationkey").cast("double")).alias("params"))
    feats = table(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target_id"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("feature_id"), F.col("l_partkey").alias("ordinal")).distinct()
    out = tables.model_summary(m, records, pred, feats)
    recent = F.array_join(F.transform("recent", lambda x: F.concat_ws(":", x["d"].cast("string"), x["y_true"].cast("int").cast("string"), x["y_pred"].cast("int").cast("string"))), ",")
    return out.select("target_id", "mda", "mae", F.try_element_at("params", F.lit("nation")).alias("nation"), "n_features", recent.alias("recent"), F.array_join("first_features", ",").alias("first_features"))


NAIVE = SUP + f""",
nv AS (SELECT * FROM (SELECT series_id AS target_id, d, value AS y_true, lag(value) OVER {W} AS y_pred FROM sup) WHERE y_pred IS NOT NULL)"""


def _metrics_sql(keys: str, source: str, name: str) -> str:
    return f"""{name}_s AS (SELECT *, y_true - lag(y_true) OVER (PARTITION BY {keys} ORDER BY d) AS dt, y_pred - lag(y_pred) OVER (PARTITION BY {keys} ORDER BY d) AS dp FROM {source}),
{name} AS (SELECT {keys}, count(*) AS n, coalesce(avg(CASE WHEN dt <> 0 THEN CASE WHEN sign(dt) = sign(dp) THEN 1.0 ELSE 0.0 END END), 0.5) AS mda,
  avg(CASE WHEN y_true <> 0 THEN abs(y_true - y_pred) / abs(y_true) END) AS mape, count(*) FILTER (y_true = 0) AS zero_actuals, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse
  FROM {name}_s GROUP BY {keys})"""


_SPLIT = f"sp AS (SELECT *, CASE WHEN d <= DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS split FROM nv WHERE d <= DATE '{CUTOFF}' OR d >= DATE '{CUTOFF}' + 98)"
_GAP = with_(NAIVE, _SPLIT, _metrics_sql("target_id, split", "sp", "m")) + """, gap AS (SELECT target_id, max(mda) FILTER (split = 'train') AS train_mda, max(mda) FILTER (split = 'test') AS test_mda,
  max(mape) FILTER (split = 'test') - max(mape) FILTER (split = 'train') AS mape_rise FROM m GROUP BY 1)
"""
_RUNS = _GAP + ", runs AS (SELECT target_id, CAST(s_nationkey AS VARCHAR) AS grp, round(train_mda, 4) AS old_mda, round(test_mda, 4) AS new_mda FROM gap JOIN supplier ON target_id = 'S' || s_suppkey)\n"


def _sums_sql() -> str:
    terms = ["1.0", "t", "prev", "d1", "dy"]
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    return with_(SUP) + f""", a AS (SELECT series_id, d, value - first_value(value) OVER {W} AS y, row_number() OVER {W} - 2 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM sup),
b AS (SELECT *, lag(y) OVER {W} AS prev, y - lag(y) OVER {W} AS dy, i - (n - 2) / 2 AS t FROM a), c AS (SELECT *, coalesce(lag(dy) OVER {W}, 0) AS d1 FROM b)
SELECT series_id, any_value(n) AS n, """ + ", ".join(f"round(sum({terms[i]}::DOUBLE * {terms[j]}), 2) AS s{k}" for k, (i, j) in enumerate(pairs)) + " FROM c WHERE dy IS NOT NULL GROUP BY 1"


def _unit_root_sql(max_lag: int = 5, min_count: int = 50) -> str:
    """Level and step freed from the other regressors, one after another."""
    over = "OVER (PARTITION BY version, series_id ORDER BY d)"
    terms = ["1.0::DOUBLE", "t", "prev", *(f"d{k}" for k in range(1, max_lag + 1)), "dy"]
    step = len(terms) - 1
    left = list(range(len(terms)))
    sums = ", ".join(f"sum({terms[i]} * {terms[j]}) AS s{i}_{j}" for i in left for j in left[i:])
    sql = with_(SUP) + f""", l AS (SELECT *, lag(value) OVER {W} AS p FROM sup),
pv AS (SELECT 'raw' AS version, series_id, d, value FROM l UNION ALL SELECT 'diff', series_id, d, value - p FROM l UNION ALL SELECT 'pct', series_id, d, CASE WHEN abs(p) >= 1e-4 THEN (value - p) / abs(p) END FROM l),
a AS (SELECT version, series_id, d, value - first_value(value) {over} AS y, row_number() {over} - 2 AS i, count(*) OVER (PARTITION BY version, series_id) AS n FROM pv WHERE value IS NOT NULL),
b AS (SELECT *, lag(y) {over} AS prev, y - lag(y) {over} AS dy, i - (n - 2) / 2 AS t FROM a),
c AS (SELECT *, {', '.join(f'coalesce(lag(dy, {k}) {over}, 0) AS d{k}' for k in range(1, max_lag + 1))} FROM b),
e AS (SELECT version, series_id, any_value(n) AS n, {sums} FROM c WHERE dy IS NOT NULL GROUP BY 1, 2),
e_ AS (SELECT *, {', '.join(f's{i}_{i} AS q{i}' for i in left)} FROM e)"""
    last, kept = "e_", ", ".join(f"q{i}" for i in left)
    for k in [i for i in left if i not in (2, step)]:
        left.remove(k)
        pivot = f"CASE WHEN s{k}_{k} > {stationarity.DEPENDENT} * q{k} THEN s{k}_{k} END"
        side = {i: f"s{min(i, k)}_{max(i, k)}" for i in left}
        sql += f""",
e{k} AS (SELECT version, series_id, n, {kept}, {', '.join(f's{i}_{j} - {side[i]} * {side[j]} / ({pivot}) AS s{i}_{j}' for i in left for j in left if i <= j)} FROM {last})"""
        last = f"e{k}"
    verdict = " ".join(f"WHEN t < {limit} THEN '{text}'" for limit, text in stationarity.THRESHOLDS)
    return sql + f""",
f AS (SELECT version, series_id, n, CASE WHEN n >= {min_count} AND s2_2 > {stationarity.DEPENDENT} * q2 THEN s2_{step} / s2_2 END AS g, s{step}_{step} - s2_{step} * s2_{step} / nullif(s2_2, 0) AS rss, s2_2, q{step} FROM {last}),
h AS (SELECT *, CASE WHEN rss > {stationarity.DEPENDENT} * q{step} THEN g * s2_2 / sqrt(rss * s2_2 / (n - 1 - {step})) END AS t FROM f)
SELECT version, series_id, n, round(t, 5) + 0 AS t_stat, round(g, 5) + 0 AS gamma, CASE WHEN t IS NULL THEN NULL {verdict} ELSE 'not stationary' END AS verdict FROM h"""


def _forest_sql(params: dict[str, float], keep: str = "true") -> str:
    """The same trees in SQL: CTEs ``sc`` (targets), ``t{tree}`` (rows with their prediction after so many
    trees) and ``s{tree}_{level}``, ``v{tree}`` (splits and leaves)."""
    depth, lam, step, leaf = params["max_depth"], float(params["reg_lambda"]), params["step_size"], params["min_leaf"]
    names = ["value", *(f"lag_{k}" for k in LAGS), "value - lag_7"]
    last = len(names)
    sql = with_(SUPD) + f""", wf AS (SELECT *, {', '.join(f'lag(value, {k}) OVER {W} AS lag_{k}' for k in LAGS)} FROM supd),
wk AS (SELECT * FROM wf QUALIFY row_number() OVER (PARTITION BY series_id, isoyear(d), week(d) ORDER BY (isodow(d) = 5) DESC, d DESC) = 1),
lb AS (SELECT *, lead(value) OVER {W} AS label, lead(d) OVER {W} AS label_d FROM wk),
sm AS (SELECT series_id AS target_id, d, label, CASE WHEN d <= DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS split, [{', '.join(f'({n})::DOUBLE' for n in names)}] AS f
  FROM lb WHERE label IS NOT NULL AND ((d <= DATE '{CUTOFF}' AND label_d <= DATE '{CUTOFF}') OR d >= DATE '{CUTOFF}' + 98) AND {keep}),
en AS (SELECT target_id, count(*) FILTER (split = 'train') AS n, min(label) FILTER (split = 'train') AS lo, max(label) FILTER (split = 'train') AS hi FROM sm GROUP BY 1),
un AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / {forest.RANGE} ELSE 1.0::DOUBLE END AS unit FROM en),
sc AS (SELECT target_id, any_value(n) AS n, any_value(unit) AS unit, any_value(lo) + any_value(unit) * (sum(floor((label - lo) / unit + 0.5::DOUBLE)::BIGINT)::BIGINT / any_value(n)) AS base
  FROM sm JOIN un USING (target_id) WHERE split = 'train' GROUP BY 1 HAVING any_value(n) >= {forest.MIN_ROWS}),
ce AS (SELECT target_id, i, f[i] AS v FROM sm, range(1, {last + 1}) AS r(i) WHERE split = 'train' AND f[i] IS NOT NULL),
ra AS (SELECT target_id, i, v, floor({forest.BINS} * (rank() OVER (PARTITION BY target_id, i ORDER BY v) - 1) / count(*) OVER (PARTITION BY target_id, i)) AS b FROM ce),
lo AS (SELECT target_id, i, list_sort(list(low)) AS lows FROM (SELECT target_id, i, b, min(v) AS low FROM ra GROUP BY ALL) GROUP BY ALL),
bi AS MATERIALIZED (SELECT target_id, d, list(CASE WHEN f[i] IS NULL OR lows IS NULL THEN 0 ELSE greatest(1, len(list_filter(lows, lambda e: e <= f[i]))) END ORDER BY i) AS bins
  FROM (SELECT target_id, d, f, r.i FROM sm, range(1, {last + 1}) AS r(i)) LEFT JOIN lo USING (target_id, i) GROUP BY 1, 2),
t0 AS MATERIALIZED (SELECT sm.target_id, sm.d, label, split, bins, unit, base AS pred FROM sm JOIN sc USING (target_id) JOIN bi ON bi.target_id = sm.target_id AND bi.d = sm.d)"""
    for t in range(params["n_trees"]):
        sql += f""",
x{t}_0 AS MATERIALIZED (SELECT *, floor((label - pred) / unit + 0.5::DOUBLE)::BIGINT AS g, 1::BIGINT AS node, true AS op FROM t{t})"""
        for k in range(depth):
            sql += f""",
h{t}_{k} AS (SELECT target_id, node, i, bins[i + 1] AS bin, sum(g)::BIGINT AS g, count(*) AS n FROM x{t}_{k}, range(0, {last}) AS r(i) WHERE split = 'train' AND op GROUP BY ALL),
c{t}_{k} AS (SELECT *, sum(g) OVER p AS gl, sum(n) OVER p AS nl, sum(g) OVER (PARTITION BY target_id, node, i) AS gt, sum(n) OVER (PARTITION BY target_id, node, i) AS nt FROM h{t}_{k}
  WINDOW p AS (PARTITION BY target_id, node, i ORDER BY bin ROWS UNBOUNDED PRECEDING)),
s{t}_{k} AS MATERIALIZED (SELECT target_id, node, i AS feature, bin, nt::BIGINT AS n, gl::DOUBLE * gl::DOUBLE / (nl + {lam}::DOUBLE) + (gt - gl)::DOUBLE * (gt - gl)::DOUBLE / (nt - nl + {lam}::DOUBLE) - gt::DOUBLE * gt::DOUBLE / (nt + {lam}::DOUBLE) AS gain
  FROM c{t}_{k} WHERE nl >= {leaf} AND nt - nl >= {leaf} AND gain >= 1 QUALIFY row_number() OVER (PARTITION BY target_id, node ORDER BY gain DESC, i, bin) = 1),
x{t}_{k + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (node, op), CASE WHEN s.node IS NULL THEN x.node ELSE 2 * x.node + (bins[feature + 1] > bin)::BIGINT END AS node, s.node IS NOT NULL AS op FROM x{t}_{k} x LEFT JOIN s{t}_{k} s ON s.target_id = x.target_id AND s.node = x.node)"""
        sql += f""",
v{t} AS MATERIALIZED (SELECT target_id, node, {step}::DOUBLE * any_value(unit) * sum(g)::BIGINT / (count(*) + {lam}::DOUBLE) AS value, count(*) AS n FROM x{t}_{depth} WHERE split = 'train' GROUP BY 1, 2),
t{t + 1} AS MATERIALIZED (SELECT x.target_id, d, label, split, bins, unit, pred + coalesce(value, 0) AS pred FROM x{t}_{depth} x LEFT JOIN v{t} v ON v.target_id = x.target_id AND v.node = x.node)"""
    return sql


_LATE = "(d >= DATE '1999-06-01' OR series_id NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey >= 20))"


QUERIES = {
    "forecast_metrics": forecast_metrics,
    "overfit_gap": overfit_gap,
    "direction_hits": direction_hits,
    "error_percentiles": error_percentiles,
    "error_histogram": error_histogram,
    "latest_predictions": latest_predictions,
    "run_comparison": run_comparison,
    "runs_by_change": runs_by_change,
    "dates_newest_first": dates_newest_first,
    "best_so_far": best_so_far,
    "autocorrelation": autocorrelation,
    "panel_versions": panel_versions,
    "unit_root_sums": unit_root_sums,
    "stationarity_by_version": stationarity_by_version,
    "tree_predictions": tree_predictions,
    "tree_metrics_by_target": tree_metrics_by_target,
    "stump_by_target": stump_by_target,
    "boosted_predictions": boosted_predictions,
    "halved_search": halved_search,
    "parameter_search": parameter_search,
    "tree_early_stopping": tree_early_stopping,
    "tree_feature_selection": tree_feature_selection,
    "model_summary": model_summary,
}
ORACLES = {
    "forecast_metrics": with_(NAIVE, _metrics_sql("target_id", "nv", "m")) + "SELECT target_id, n, round(mda, 6) AS mda, round(mape, 6) AS mape, zero_actuals, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM m",
    "overfit_gap": _GAP + "SELECT target_id, round(train_mda, 6) AS train_mda, round(test_mda, 6) AS test_mda, round(train_mda - test_mda, 6) AS mda_drop, round(mape_rise, 6) AS mape_rise FROM gap",
    "direction_hits": with_(NAIVE, _metrics_sql("target_id", "nv", "m")) + "SELECT target_id, d, CAST((dt > 0) = (dp > 0) AS INTEGER) AS hit FROM m_s WHERE dt IS NOT NULL",
    "error_percentiles": with_(NAIVE) + ", e AS (SELECT target_id, list_sort(list(abs(y_true - y_pred))) AS l FROM nv GROUP BY 1)\nSELECT target_id, " + ", ".join(f"l[CAST(floor(len(l) * {s}) AS BIGINT) + 1] AS p{round(s * 100)}" for s in (0.5, 0.75, 0.95)) + " FROM e",
    "error_histogram": with_(NAIVE) + "SELECT target_id, CAST(floor(abs(y_true - y_pred) / 10.0) AS BIGINT) AS bucket, count(*) AS n FROM nv GROUP BY 1, 2",
    "latest_predictions": with_(NAIVE) + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY d DESC) AS INTEGER) AS rank FROM nv) WHERE rank <= 10",
    "run_comparison": _RUNS + """SELECT grp, target_id, CAST(grouping(grp, target_id) AS BIGINT) AS level, count(*) AS n_targets, round(avg(old_mda), 8) AS avg_old, round(avg(new_mda), 8) AS avg_new, round(avg(new_mda - old_mda), 8) AS avg_change,
  count(*) FILTER (new_mda - old_mda > 0) AS improved, count(*) FILTER (new_mda >= 0.55) AS above_good FROM runs GROUP BY ROLLUP (grp, target_id)""",
    "runs_by_change": _RUNS + "SELECT target_id, round(new_mda - old_mda, 5) AS change FROM runs ORDER BY change DESC NULLS LAST, target_id",
    "dates_newest_first": """SELECT CASE WHEN o_orderstatus = 'P' THEN 'about ' ELSE '' END || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderdate, o_orderstatus
ORDER BY try_cast(day AS DATE) DESC NULLS LAST, day""",
    "best_so_far": """SELECT event_type || '-' || user_id AS study_id, event_id AS number, value AS mda, max(value) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM events""",
    "autocorrelation": with_(ORDD) + f""", l AS (SELECT *, lag(value, 1) OVER {W} AS a, lag(value, 7) OVER {W} AS b FROM ordd WHERE value IS NOT NULL)
SELECT series_id, count(value) AS n, round(corr(value, a), 6) AS acf_1, round(corr(value, b), 6) AS acf_7, abs(corr(value, a)) < 0.9 AS maybe_stationary FROM l GROUP BY 1 HAVING count(value) >= 100""",
    "panel_versions": with_(SUP) + f""", l AS (SELECT *, lag(value) OVER {W} AS p FROM sup)
SELECT 'raw' AS version, series_id, d, value FROM l UNION ALL SELECT 'diff', series_id, d, value - p FROM l UNION ALL SELECT 'pct', series_id, d, round(CASE WHEN abs(p) >= 1e-4 THEN (value - p) / abs(p) END, 6) FROM l""",
    "unit_root_sums": _sums_sql(),
    "stationarity_by_version": _unit_root_sql(),
    "stump_by_target": _forest_sql(STUMP) + """
SELECT target_id, node, feature::INTEGER AS feature, bin::INTEGER AS bin, round(gain, -6) AS gain, n, NULL::DOUBLE AS value FROM s0_0 UNION ALL SELECT target_id, node, NULL, NULL, NULL, n, round(value, 6) FROM v0""",
    "boosted_predictions": _forest_sql(BOOSTED) + f"""
SELECT target_id, d, split, label AS y_true, round(pred, 6) AS y_pred FROM t{BOOSTED['n_trees']}""",
    "tree_metrics_by_target": _forest_sql(BOOSTED, _LATE) + f""",
fp AS (SELECT target_id, d, split, label AS y_true, pred AS y_pred FROM t{BOOSTED['n_trees']}),
{_metrics_sql("target_id, split", "fp", "fm")}
SELECT target_id, split, n, round(mda, 6) AS mda, round(mape, 6) AS mape, zero_actuals, round(mae, 6) AS mae, round(rmse, 6) AS rmse, NULL AS reason FROM fm
UNION ALL SELECT target_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'training rows: ' || n FROM en WHERE n < {forest.MIN_ROWS}""",
    "model_summary": with_(NAIVE, _metrics_sql("target_id", "nv", "m")) + """, r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY d DESC) AS r FROM nv),
rc AS (SELECT target_id, string_agg(CAST(d AS VARCHAR) || ':' || CAST(y_true AS INTEGER) || ':' || CAST(y_pred AS INTEGER), ',' ORDER BY d) AS recent FROM r WHERE r <= 10 GROUP BY 1),
f AS (SELECT DISTINCT 'S' || l_suppkey AS target_id, l_partkey AS p FROM lineitem), fr AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY p) AS r, count(*) OVER (PARTITION BY target_id) AS n_features FROM f),
fh AS (SELECT target_id, any_value(n_features) AS n_features, string_agg('part_' || p, ',' ORDER BY p) AS first_features FROM fr WHERE r <= 20 GROUP BY 1)
SELECT m.target_id, round(mda, 6) AS mda, round(mae, 4) AS mae, CAST(s_nationkey AS DOUBLE) AS nation, n_features, recent, first_features FROM m JOIN supplier ON m.target_id = 'S' || s_suppkey JOIN rc USING (target_id) JOIN fh USING (target_id)""",
}
