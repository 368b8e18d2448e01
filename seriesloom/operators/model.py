"""Boosted-tree jobs on MLlib. Trials and targets are small tables; every fit is a Spark job."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import forecast_metrics
from .split import time_holdout

SEED = 42
# Reference point of a search when no earlier best parameters are known.
DEFAULTS = {"max_depth": 5, "max_iter": 20, "step_size": 0.1, "subsample": 0.8, "min_leaf": 5}


def feature_index(features: DataFrame) -> list[str]:
    """Feature ids in the fixed order of the vector. The list is as long as the vector is wide."""
    return [r["feature_id"] for r in features.select("feature_id").distinct().orderBy("feature_id").collect()]


def assemble(features: DataFrame, labels: DataFrame, names: Sequence[str], keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """Long features and labelled rows to ``(…keys, d, label, split…, features VECTOR)``. A group
    here is one row's features; a feature a row lacks counts as 0 (fill beforehand)."""
    position = {n: i for i, n in enumerate(names)}
    index = features.sparkSession.createDataFrame(list(position.items()), "feature_id string, i int")
    on = [*keys, "d"]
    cells = features.join(index, "feature_id").filter(F.col("value").isNotNull()).select(*on, "i", "value")
    rows = cells.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("c"))
    by_index = F.map_from_entries("c")
    padded = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.try_element_at(by_index, i), F.lit(0.0)))
    complete = F.when(F.size("c") == len(names), F.transform("c", lambda x: x["value"])).otherwise(padded)
    return labels.join(rows.select(*on, complete.alias("_v")), on).withColumn("features", array_to_vector("_v")).drop("_v")


def regressor(params: dict[str, float] | None = None) -> GBTRegressor:
    p = DEFAULTS | (params or {})
    return GBTRegressor(
        featuresCol="features", labelCol="label", predictionCol="y_pred", seed=SEED, maxDepth=int(p["max_depth"]), maxIter=int(p["max_iter"]),
        stepSize=float(p["step_size"]), subsamplingRate=float(p["subsample"]), minInstancesPerNode=int(p["min_leaf"]),
    )


def fit(train: DataFrame, params: dict[str, float] | None = None) -> GBTRegressionModel:
    return regressor(params).fit(train)


def fit_early_stopping(rows: DataFrame, params: dict[str, float] | None = None, tolerance: float = 0.01) -> GBTRegressionModel:
    """Stops adding trees when the rows with ``is_holdout`` no longer improve."""
    trees = regressor(params)
    return trees.fit(rows, {trees.validationIndicatorCol: "is_holdout", trees.validationTol: tolerance})


def predictions(model: GBTRegressionModel, rows: DataFrame, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    extra = [c for c in ("split",) if c in rows.columns]
    return model.transform(rows).select(*keys, "d", *extra, F.col("label").alias("y_true"), "y_pred", F.abs(F.col("label") - F.col("y_pred")).alias("abs_error"))


def search_space(reference: dict[str, float] | None = None) -> dict[str, tuple[float, float, bool]]:
    """(low, high, on log scale) per parameter, around a reference point when there is one."""
    r = DEFAULTS | (reference or {})
    return {
        "max_depth": (max(2, r["max_depth"] - 3), min(12, r["max_depth"] + 3), False),
        "max_iter": (max(5, r["max_iter"] // 2), r["max_iter"] * 2, False),
        "step_size": (max(0.005, r["step_size"] * 0.3), min(0.3, r["step_size"] * 3.0), True),
        "subsample": (max(0.5, r["subsample"] - 0.2), min(1.0, r["subsample"] + 0.2), False),
        "min_leaf": (max(1, r["min_leaf"] - 10), r["min_leaf"] + 30, False),
    }


# Narrow, regularised space for retraining.
REGULARISED_SPACE = {
    "max_depth": (3, 6, False), "max_iter": (10, 30, False), "step_size": (0.01, 0.1, True), "subsample": (0.6, 0.8, False), "min_leaf": (10, 40, False),
}


def draw_trials(space: dict[str, tuple[float, float, bool]], n: int, seed: int = SEED) -> list[dict[str, float]]:
    rng = random.Random(seed)
    whole = {"max_depth", "max_iter", "min_leaf"}
    trials = []
    for _ in range(n):
        trial = {}
        for name, (low, high, log) in space.items():
            x = math.exp(rng.uniform(math.log(low), math.log(high))) if log else rng.uniform(low, high)
            trial[name] = float(round(x)) if name in whole else x
        trials.append(trial)
    return trials


def trials_table(spark: SparkSession, study_id: str, trials: Sequence[dict[str, float]]) -> DataFrame:
    return spark.createDataFrame([(study_id, i, t) for i, t in enumerate(trials)], "study_id string, number int, params map<string,double>")


def search_parameters(
    train: DataFrame, trials: Sequence[dict[str, float]], study_id: str = "study", keys: Sequence[str] = ("target_id",), parallel: int = 2
) -> DataFrame:
    """Each trial: fit on the first 90 % of the training rows in time, directional accuracy on the
    rest. Returns the trials table; the driver only ever sees one metric row per trial. The
    cached rows are split once and shared by all fits."""
    rows = cut_lineage(time_holdout(train, keys=keys))
    fit_rows, held = rows.filter(~F.col("is_holdout")), rows.filter("is_holdout")

    def run(job: tuple[int, dict[str, float]]) -> tuple:
        number, params = job
        scored = predictions(fit(fit_rows, params), held, keys)
        m = forecast_metrics(scored, keys).agg(F.avg("mda").alias("mda"), F.avg("mape").alias("mape")).first()
        return study_id, number, params, m["mda"], m["mape"]

    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(run, enumerate(trials)))
    return train.sparkSession.createDataFrame(done, "study_id string, number int, params map<string,double>, mda double, mape double")


def best_parameters(trials: DataFrame) -> dict[str, float]:
    best = trials.orderBy(F.col("mda").desc_nulls_last(), "number").first()
    return dict(best["params"])


def refit_and_score(samples: DataFrame, params: dict[str, float], keys: Sequence[str] = ("target_id",)) -> tuple[GBTRegressionModel, DataFrame, DataFrame]:
    """Fit on all training rows; predictions of both splits and their metrics."""
    model = fit(samples.filter(F.col("split") == "train"), params)
    scored = predictions(model, samples, keys)
    return model, scored, forecast_metrics(scored, [*keys, "split"])


def feature_importance(spark: SparkSession, model: GBTRegressionModel, names: Sequence[str], target_id: str) -> DataFrame:
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(target_id, n, float(v)) for n, v in zip(names, values)], "target_id string, feature_id string, importance double")


def train_targets(
    samples: DataFrame, target_ids: Iterable[str], params: dict[str, float], min_rows: int = 50, parallel: int = 2,
    on_error: Callable[[str, Exception], None] | None = None,
) -> DataFrame:
    """One model per target, a bounded number at a time; targets with too few rows or a failing
    fit are skipped (and reported). Returns the metrics of all targets that trained."""

    def one(target: str) -> DataFrame | None:
        try:
            rows = cut_lineage(samples.filter(F.col("target_id") == target))
            if rows.filter(F.col("split") == "train").count() < min_rows:
                return None
            return cut_lineage(refit_and_score(rows, params)[2])
        except Exception as error:  # noqa: BLE001
            if on_error is not None:
                on_error(target, error)
            return None

    with ThreadPoolExecutor(parallel) as pool:
        parts = [m for m in pool.map(one, target_ids) if m is not None]
    if not parts:
        raise ValueError("no target could be trained")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
