"""Merging feature blocks and choosing features, in long form ``(…keys, d, feature_id, value)``."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .align import backward_fill, forward_fill
from .scan import top_per_group


def merge_blocks(blocks: dict[str, DataFrame]) -> DataFrame:
    """Feature families stacked under their names. Rows meet by key, never by position."""
    out = None
    for family, block in blocks.items():
        part = block.withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part)
    return out


def fill_features(features: DataFrame, keys: Sequence[str], allow_future: bool = False) -> DataFrame:
    """Forward fill per feature; ``allow_future`` also fills the start from later values."""
    out = forward_fill(features, keys=[*keys, "feature_id"])
    return backward_fill(out, keys=[*keys, "feature_id"]) if allow_future else out


def feature_stats(features: DataFrame, keys: Sequence[str], fit_until: str | None = None) -> DataFrame:
    rows = features if fit_until is None else features.filter(F.col("d") <= F.lit(fit_until).cast("date"))
    v = F.col("value")
    return rows.groupBy(*keys, "feature_id").agg(
        F.count(v).alias("n_values"),
        F.avg(v.isNull().cast("double")).alias("null_share"),
        F.stddev_samp(v).alias("std"),
        F.var_pop(v).alias("var"),
    )


def informative(stats: DataFrame, max_null_share: float = 0.5, min_std: float = 1e-10) -> DataFrame:
    """Not all null, not mostly null, not constant. A single value has no deviation and stays."""
    return stats.filter(
        (F.col("n_values") > 0) & (F.col("null_share") <= max_null_share) & (F.col("std").isNull() | (F.col("std") >= min_std))
    )


def drop_low_information(features: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    return keep_selected(features, informative(feature_stats(features, keys), **kw), [*keys, "feature_id"])


def enough_variance(stats: DataFrame, minimum: float = 1e-8) -> DataFrame:
    return stats.filter(F.col("var") >= minimum)


def keep_selected(features: DataFrame, selected: DataFrame, on: Sequence[str]) -> DataFrame:
    return features.join(selected.select(*on), list(on), "left_semi")


def common_features(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("feature_id").intersect(test.select("feature_id"))


def without(ids: DataFrame, banned: DataFrame, column: str) -> DataFrame:
    return ids.join(banned.select(column), column, "left_anti")


def family_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Features per family before and after a step, counted exactly on both sides."""
    ids = ["family", "feature_id"]
    both = before.select(*ids, F.lit(0).alias("kept")).unionByName(after.select(*ids, F.lit(1).alias("kept")))
    return (
        both.groupBy(*ids)
        .agg(F.max("kept").alias("kept"))
        .groupBy("family")
        .agg(F.count(F.lit(1)).alias("n_before"), F.sum("kept").alias("n_after"))
    )


def target_template(shared: DataFrame, own: DataFrame, target_ids: Sequence[str]) -> DataFrame:
    """Feature table per target: the shared features repeated for each target by an explode over
    the short target list (the output is that large by definition), plus the target's own."""
    repeated = shared.withColumn("target_id", F.explode(F.array(*[F.lit(t) for t in target_ids])))
    cols = ["target_id", "d", "feature_id", "value"]
    return repeated.select(*cols).unionByName(own.select(*cols))


# ---- redundancy inside a group of features


def unit_vectors(features: DataFrame, group: str, fit_until: str | None = None, min_variance: float = 1e-8) -> DataFrame:
    """One row per feature: its variance and its values, centred and scaled to length 1, in day
    order. A day the feature lacks counts as its mean. The vector is bounded by the calendar."""
    rows = features if fit_until is None else features.filter(F.col("d") <= F.lit(fit_until).cast("date"))
    stats = rows.groupBy(group, "feature_id").agg(F.avg("value").alias("m"), F.var_pop("value").alias("var"), F.count("value").alias("n"))
    stats = stats.filter(F.col("var") >= min_variance)
    days = rows.select(group, "d").distinct()
    grid = stats.join(days, group).join(rows.select(group, "feature_id", "d", "value"), [group, "feature_id", "d"], "left")
    z = F.coalesce((F.col("value") - F.col("m")) / F.sqrt(F.col("var") * F.col("n")), F.lit(0.0))
    vec = F.transform(F.array_sort(F.collect_list(F.struct(F.col("d"), z.alias("z")))), lambda x: x["z"])
    unit = F.pow(F.lit(10.0), F.floor(F.log10("var")) - 8)  # nine digits, so equal variances are equal whatever the order of the sums
    return grid.groupBy(group, "feature_id").agg(F.first("var").alias("var"), vec.alias("u")).withColumn("var", F.round(F.col("var") / unit) * unit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def correlated_pairs(vectors: DataFrame, group: str, threshold: float = 0.98) -> DataFrame:
    """Pairs (keep_first, other) of a group with |r| above the threshold, the one of higher
    variance first (ties by id).

    Not all pairs are formed. The angle between unit vectors is a metric, so two features closer
    than acos(threshold) also lie within that angle of each other as seen from a pivot (the
    feature of highest variance): only features in the same or the next angle cell can match,
    directly or, for r < -threshold, mirrored."""
    pivots = vectors.groupBy(group).agg(F.max_by("u", F.struct("var", "feature_id")).alias("pivot"))
    width = math.acos(threshold) + 1e-6
    angle = F.acos(F.least(F.greatest(dot(F.col("u"), F.col("pivot")), F.lit(-1.0)), F.lit(1.0)))
    placed = vectors.join(pivots, group).withColumn("angle", angle).drop("pivot")
    right = placed.select(
        group, F.floor(F.col("angle") / width).alias("cell"), F.col("feature_id").alias("other"), F.col("var").alias("var_o"), F.col("u").alias("u_o")
    )

    def cells(sign: int, a: Column) -> Column:
        at = F.floor(a / width)
        return F.transform(F.sequence(at - 1, at + 1), lambda c: F.struct(F.lit(sign).alias("sign"), c.alias("cell")))

    near = F.explode(F.concat(cells(1, F.col("angle")), cells(-1, F.lit(math.pi) - F.col("angle"))))
    left = placed.select(group, near.alias("n"), "feature_id", "var", "u").select(group, "n.cell", "n.sign", "feature_id", "var", "u")
    ahead = (F.col("var") > F.col("var_o")) | ((F.col("var") == F.col("var_o")) & (F.col("feature_id") < F.col("other")))
    joined = left.join(right, [group, "cell"]).filter(ahead)
    return joined.filter(F.col("sign") * dot(F.col("u"), F.col("u_o")) > threshold).select(
        group, F.col("feature_id").alias("keep_first"), "other", F.col("var"), "var_o"
    )


def _greedy(names: np.ndarray, variances: np.ndarray, vectors: np.ndarray, threshold: float) -> list:
    """Names kept in order of falling variance (ties by id): a kept feature strikes out every
    later one it correlates with, so the work is kept x all, never all pairs."""
    order = np.lexsort((names, -variances))
    names, vectors, alive, kept = names[order], vectors[order], np.ones(len(order), dtype=bool), []
    for i in range(len(order)):
        if alive[i]:
            kept.append(names[i])
            alive[i + 1 :] &= np.abs(vectors[i + 1 :] @ vectors[i]) <= threshold
    return kept


def _settle(vectors: DataFrame, group: str, threshold: float) -> DataFrame:
    """The greedy choice inside groups that fit a task; gives (group, feature_id)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = _greedy(pdf["feature_id"].to_numpy(), pdf["var"].to_numpy(), np.stack(pdf["u"].to_numpy()), threshold)
        return pd.DataFrame({group: pdf[group].iloc[0], "feature_id": kept})

    return vectors.groupBy(group).applyInPandas(run, f"{group} {dict(vectors.dtypes)[group]}, feature_id string")


def _settle_in_rounds(vectors: DataFrame, group: str, threshold: float, round_size: int) -> DataFrame:
    """The same choice for groups of any size. A round settles the next ``round_size`` features of
    a group among themselves (all earlier ones are decided, so what is kept is final) and strikes
    out, row by row, whatever correlates with those kept."""
    order = [F.col("var").desc(), F.col("feature_id")]
    rest, kept = cut_lineage(vectors), None
    while not rest.isEmpty():
        head = cut_lineage(top_per_group(rest, [group], order, round_size).drop("rank"))
        chosen = cut_lineage(_settle(head, group, threshold))
        kept = chosen if kept is None else kept.unionByName(chosen)
        leaders = head.join(chosen, [group, "feature_id"]).groupBy(group).agg(F.collect_list("u").alias("leaders"))
        struck = F.exists("leaders", lambda v: F.abs(dot(F.col("u"), v)) > threshold)
        rest = cut_lineage(
            rest.join(head.select(group, "feature_id"), [group, "feature_id"], "left_anti").join(leaders, group).filter(~struck).drop("leaders")
        )
    return vectors.select(group, "feature_id").limit(0) if kept is None else kept


def remove_redundant(
    features: DataFrame, group: str = "series_id", threshold: float = 0.98, min_variance: float = 1e-8,
    fit_until: str | None = None, task_cells: int = 16_000_000, round_size: int = 256,
) -> DataFrame:
    """Features left after the variance filter and the greedy redundancy pass: in order of
    falling variance a feature stays unless one that stayed correlates beyond the threshold.

    Exact copies are folded into their first id beforehand (they share every correlation, so the
    greedy pass drops them anyway). Groups whose vectors fit a task (``task_cells`` doubles) are
    settled in one, larger ones in rounds."""
    vectors = unit_vectors(features, group, fit_until, min_variance)
    single = cut_lineage(vectors.groupBy(group, "u", "var").agg(F.min("feature_id").alias("feature_id")))
    big = single.groupBy(group).agg(F.sum(F.size("u")).alias("cells")).filter(F.col("cells") > task_cells).select(group)
    kept = _settle(single.join(big, group, "left_anti"), group, threshold)
    if not big.isEmpty():
        kept = kept.unionByName(_settle_in_rounds(single.join(big, group, "left_semi"), group, threshold, round_size))
    return kept


# ---- importance caps


def cap_by_importance(importance: DataFrame, cap: int | Column, keys: Sequence[str] = ("target_id",)) -> DataFrame:
    """The most important features of a target, importance above zero, up to its cap."""
    w = Window.partitionBy(*keys).orderBy(F.col("importance").desc(), "feature_id")
    limit = F.lit(cap) if isinstance(cap, int) else cap
    return importance.filter(F.col("importance") > 0).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def cap_keeping_protected(features: DataFrame, importance: DataFrame, cap: int = 3200, slack: int = 500) -> DataFrame:
    """Catalog ``(feature_id, ftype)`` cut to ``cap`` features: protected types always stay, the
    factors fill the rest by importance. Nothing is cut while the catalog is within the slack."""
    sizes = features.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ftype") != "factor").alias("n_protected"))
    joined = features.join(importance, "feature_id", "left")
    order = [F.coalesce("importance", F.lit(0.0)).desc(), F.col("feature_id")]
    factors = top_per_group(joined.filter(F.col("ftype") == "factor"), ["ftype"], order, cap + slack, "place")
    n, n_protected = sizes.select("n").scalar(), sizes.select("n_protected").scalar()
    kept = factors.filter((n <= cap + slack) | (F.col("place") <= F.lit(cap) - n_protected))
    protected = features.filter(F.col("ftype") != "factor").select("feature_id", "ftype")
    return protected.unionByName(kept.select("feature_id", "ftype"))
