"""Boosted regression trees of many models at once.

Targets whose rows fit a task (``ALONE``) are brought there by one shuffle and all their trees grown in it. Models of
larger targets, of a search or with early stopping grow level by level, all at once: every model (a target, or a target under one draw of parameters) takes part in the same Spark jobs: a level
of all trees is one aggregate by (model, node, feature, bin), whose partial sums run where the rows lie, and
the rows meet the chosen splits by a join. The number of jobs follows the trees and their depth and never
the number of models; a model of any size is spread over the tasks that hold its rows.

Features are cut into bins by their ranks among a target's training rows, missing values into one of their
own. Gradients are whole numbers: residuals in 2^-30 of the range of the target's training labels. Sums are
exact, so splits do not depend on how rows are dealt and a rerun, or SQL, gives the same trees. Ties of gain
go to the first feature and the lower bin.

Samples are ``(target_id, d, label, split, features ARRAY<DOUBLE>)``; ``split`` is ``train`` for rows to learn
from, rows of other splits are only scored. Null, NaN and absent features are missing. Targets that cannot
be trained (too few training rows, labels that are missing or not finite) come back as rows with a reason;
rows without a target are left out. Labels that never change give models that predict them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .metrics import forecast_metrics

BINS, MIN_ROWS, SEED = 32, 50, 42
RANGE = 1 << 30
# The parameters of a model that names none.
DEFAULTS = {"n_trees": 20, "max_depth": 3, "step_size": 0.1, "subsample": 0.8, "min_leaf": 5, "reg_lambda": 1.0}
TYPES = {"n_trees": "int", "max_depth": "int", "step_size": "double", "subsample": "double", "min_leaf": "int", "reg_lambda": "double"}


def _kept(df: DataFrame, name: str) -> DataFrame:
    return written(df, f"forest-{name}")


def parameters(spark: SparkSession, models: DataFrame, params: dict[str, float] | None = None) -> DataFrame:
    """The same parameters for all ``models`` (``model_id, target_id``)."""
    chosen = DEFAULTS | (params or {})
    return models.select("model_id", "target_id", *[F.lit(chosen[k]).cast(t).alias(k) for k, t in TYPES.items()])


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def bin_edges(samples: DataFrame, bins: int = BINS) -> DataFrame:
    """``target_id, edges``: per feature the least value of each of its bins among the training rows."""
    cells = samples.filter(F.col("split") == "train").select("target_id", F.posexplode("features").alias("i", "v")).filter(_finite(F.col("v")))
    w = Window.partitionBy("target_id", "i")
    bin_ = F.floor(F.lit(bins) * (F.rank().over(w.orderBy("v")) - 1) / F.count(F.lit(1)).over(w))
    lows = cells.withColumn("bin", bin_).groupBy("target_id", "i", "bin").agg(F.min("v").alias("low"))
    lists = lows.groupBy("target_id", "i").agg(F.array_sort(F.collect_list("low")).alias("lows"))
    return lists.groupBy("target_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "lows"))).alias("edges"))


def _binned(features: Column, edges: Column) -> Column:
    """Bin numbers from 1, in the order of the values; 0 for missing ones and features never seen."""

    def place(x: Column, i: Column) -> Column:
        lows = F.try_element_at(edges, i)
        return F.when(_finite(x) & lows.isNotNull(), F.greatest(F.lit(1), F.size(F.filter(lows, lambda e: e <= x)))).otherwise(0)

    return F.transform(features, place)


def scales(samples: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Per target: ``n`` training rows, ``unit`` and ``base`` (the mean label), and ``reason`` where it cannot be trained."""
    label = F.col("label").cast("double")
    train = samples.withColumn("_l", F.when(F.col("split") == "train", label)).withColumn("_bad", (F.col("split") == "train") & ~F.coalesce(_finite(label), F.lit(False)))
    ends = train.groupBy("target_id").agg(F.count_if(F.col("split") == "train").alias("n"), F.count_if("_bad").alias("bad"), F.min("_l").alias("low"), F.max("_l").alias("high"))
    reason = F.when(F.col("n") < min_rows, F.concat(F.lit("training rows: "), F.col("n").cast("string"))).when(F.col("bad") > 0, "a label is missing or not finite")
    ends = ends.withColumn("reason", reason).withColumn("unit", F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / RANGE).otherwise(F.lit(1.0)))
    steps = train.join(ends.filter("reason is null").select("target_id", "low", "unit"), "target_id").filter(F.col("split") == "train")
    means = steps.groupBy("target_id").agg(F.sum(F.floor((F.col("_l") - F.col("low")) / F.col("unit") + 0.5)).alias("total"))
    base = F.col("low") + F.col("unit") * (F.col("total") / F.col("n"))
    return ends.join(means, "target_id", "left").select("target_id", "n", "reason", "unit", base.alias("base"))


def prepared(samples: DataFrame, params: DataFrame, bins: int = BINS, min_rows: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows of all models that can be trained, binned once per target, and the targets' ``scales``."""
    samples = samples.filter("target_id is not null")
    scale = _kept(scales(samples, min_rows), "scales")
    edges = _kept(bin_edges(samples, bins), "edges")
    good = scale.filter("reason is null").select("target_id", "unit", "base")
    rows = samples.join(good, "target_id").join(edges, "target_id", "left")
    rows = rows.select("target_id", "d", F.col("label").cast("double").alias("label"), "split", _binned(F.col("features"), F.col("edges")).alias("bins"), "unit", F.col("base").alias("pred"))
    return _kept(rows.join(params, "target_id").withColumn("tree", F.lit(0)), "rows"), scale


def _splits(rows: DataFrame, level: int) -> DataFrame:
    """The best split of every node of a level: ``model_id, tree, node, feature, bin, gain, n``."""
    open_ = rows.filter(F.col("learns") & F.col("open") & (F.col("max_depth") > level))
    cells = open_.select("model_id", "node", "g", "min_leaf", "reg_lambda", "tree", F.posexplode("bins").alias("feature", "bin"))
    same = [F.first(c).alias(c) for c in ("min_leaf", "reg_lambda", "tree")]
    sums = cells.groupBy("model_id", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"), *same)
    w = Window.partitionBy("model_id", "node", "feature")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"gl": F.sum("g").over(upto), "nl": F.sum("n").over(upto), "gt": F.sum("g").over(w), "nt": F.sum("n").over(w)})
    strength = lambda g, n: g.cast("double") * g.cast("double") / (n + F.col("reg_lambda"))
    gr, nr = F.col("gt") - F.col("gl"), F.col("nt") - F.col("nl")
    gain = strength(F.col("gl"), F.col("nl")) + strength(gr, nr) - strength(F.col("gt"), F.col("nt"))
    fit = sums.withColumn("gain", gain).filter((F.col("nl") >= F.col("min_leaf")) & (nr >= F.col("min_leaf")) & (F.col("gain") >= 1))
    best = fit.groupBy("model_id", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), F.col("nt").alias("n"))).alias("s"), F.first("tree").alias("tree"))
    return best.select("model_id", "tree", "node", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), F.col("s.gain").alias("gain"), F.col("s.n").alias("n"))


NODE = ["model_id", "tree", "node", "feature", "bin", "gain", "n", "value"]


def grow(rows: DataFrame, depth: int, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """One tree more for all models that ask for it, ``depth`` levels at most: the rows with new ``pred``, and
    the tree's nodes (``NODE``). The tree's number is a column, so all trees run the same compiled code."""
    draw = F.pmod(F.xxhash64("target_id", "d", "tree", F.lit(seed)), F.lit(1_000_000)) < F.col("subsample") * 1_000_000
    learns = (F.col("split") == "train") & (F.col("n_trees") > F.col("tree")) & ((F.col("subsample") >= 1) | draw)
    columns = rows.columns
    rows = rows.withColumns({"g": F.floor((F.col("label") - F.col("pred")) / F.col("unit") + 0.5), "learns": learns, "node": F.lit(1).cast("long"), "open": F.col("n_trees") > F.col("tree")})
    nodes = []
    for level in range(depth):
        found = _kept(_splits(rows, level), f"splits-{level}")
        nodes.append(found)
        at = found.select("model_id", "node", F.col("feature").alias("_f"), F.col("bin").alias("_b"))
        right = (F.get("bins", F.col("_f")) > F.col("_b")).cast("long")
        rows = rows.join(at, ["model_id", "node"], "left")
        rows = rows.withColumns({"open": F.col("_f").isNotNull(), "node": F.when(F.col("_f").isNotNull(), F.col("node") * 2 + right).otherwise(F.col("node"))}).drop("_f", "_b")
    value = F.first("step_size") * F.first("unit") * F.sum("g") / (F.count(F.lit(1)) + F.first("reg_lambda"))
    ends = rows.filter("learns").groupBy("model_id", "node")
    leaves = _kept(ends.agg(value.alias("value"), F.count(F.lit(1)).alias("n"), F.first("tree").alias("tree")), "leaves")
    out = rows.join(leaves.select("model_id", "node", "value"), ["model_id", "node"], "left")
    out = out.withColumns({"pred": F.col("pred") + F.coalesce("value", F.lit(0.0)), "tree": F.col("tree") + 1}).select(*columns)
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    table = leaves.select("model_id", "tree", "node", none("feature", "int"), none("bin", "int"), none("gain", "double"), "n", "value")
    for found in nodes:
        table = table.unionByName(found.select("model_id", "tree", "node", F.col("feature").cast("int").alias("feature"), F.col("bin").cast("int").alias("bin"), "gain", "n", none("value", "double")))
    return _kept(out, "rows"), table.select(*NODE)


def _errors(rows: DataFrame) -> DataFrame:
    """Mean squared error of every model on its holdout rows, in whole units."""
    off = F.floor((F.col("label") - F.col("pred")) / F.col("unit") + 0.5).cast("double")
    return rows.filter(F.col("split") == "holdout").groupBy("model_id").agg(F.avg(off * off).alias("error"))


ALONE = 1 << 17  # rows of a model that one task grows by itself


def _sums(at: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """Whole sums by place; products of floats are used only where they stay exact."""
    if len(g) and float(np.abs(g).max()) * len(g) >= 2.0**53:
        out = np.zeros(size, np.int64)
        np.add.at(out, at, g)
        return out
    return np.bincount(at, g, size).astype(np.int64)


def _places(features: np.ndarray, train: np.ndarray, bins: int) -> np.ndarray:
    """Bin numbers as ``bin_edges`` and ``_binned`` give them."""
    out = np.zeros(features.shape, np.int64)
    for i in range(features.shape[1]):
        x = features[:, i]
        there = np.isfinite(x)
        s = np.sort(x[there & train])
        if len(s):
            b = np.floor(bins * np.searchsorted(s, s) / len(s))
            lows = s[np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))]
            out[there, i] = np.maximum(1, np.searchsorted(lows, x[there], "right"))
    return out


def _scale(label: np.ndarray, train: np.ndarray, min_rows: int) -> tuple:
    """``n, reason, unit, base`` of one target, as ``scales`` gives them."""
    y = label[train]
    n = len(y)
    if n < min_rows:
        return n, f"training rows: {n}", None, None
    if not np.isfinite(y).all():
        return n, "a label is missing or not finite", None, None
    if not n:
        return n, None, 1.0, None
    low, high = float(y.min()), float(y.max())
    unit = (high - low) / RANGE if high > low else 1.0
    return n, None, unit, low + unit * (int(np.floor((y - low) / unit + 0.5).astype(np.int64).sum()) / n)


def _grown(label: np.ndarray, train: np.ndarray, places: np.ndarray, unit: float, base: float, draws: list | None, p: dict, bins: int) -> tuple[np.ndarray, list[tuple]]:
    """All trees of one model: predictions of its rows, and its nodes (``NODE`` without the model)."""
    pred, nodes, (rows, width) = np.full(len(label), base), [], places.shape
    codes, wide = places + np.arange(width) * (bins + 1), width * (bins + 1)
    strength = lambda g, n: g.astype(float) * g.astype(float) / (n + p["reg_lambda"])
    for tree in range(p["n_trees"]):
        learns = np.flatnonzero(train if p["subsample"] >= 1 else train & draws[tree])
        g = np.zeros(rows, np.int64)
        g[learns] = np.floor((label[learns] - pred[learns]) / unit + 0.5).astype(np.int64)
        node, open_ = np.ones(rows, np.int64), np.ones(rows, bool)
        for level in range(p["max_depth"]):
            held = learns[open_[learns]]
            if not len(held) or not width:
                break
            names, place = np.unique(node[held], return_inverse=True)
            at = (place[:, None] * wide + codes[held]).ravel()
            shape = len(names), width, bins + 1
            count = np.bincount(at, minlength=len(names) * wide).reshape(shape)
            gl, nl = _sums(at, np.repeat(g[held], width), len(names) * wide).reshape(shape).cumsum(2), count.cumsum(2)
            gt, nt = gl[:, :, -1:], nl[:, :, -1:]
            with np.errstate(all="ignore"):
                gain = strength(gl, nl) + strength(gt - gl, nt - nl) - strength(gt, nt)
                fits = (count > 0) & (nl >= p["min_leaf"]) & (nt - nl >= p["min_leaf"]) & (gain >= 1)
            gain = np.where(fits, gain, -np.inf).reshape(len(names), wide)
            best = gain.argmax(1)  # the first feature and the lower bin of equal gains
            top = gain[np.arange(len(names)), best]
            f, b = best // (bins + 1), best % (bins + 1)
            split = np.isfinite(top)
            nodes += [(tree, int(names[k]), int(f[k]), int(b[k]), float(top[k]), int(nt[k, f[k], 0]), None) for k in np.flatnonzero(split)]
            k = np.minimum(np.searchsorted(names, node), len(names) - 1)
            open_ = (names[k] == node) & split[k]
            node = np.where(open_, node * 2 + (places[np.arange(rows), f[k]] > b[k]), node)
        if len(learns):
            names, place = np.unique(node[learns], return_inverse=True)
            n = np.bincount(place)
            value = p["step_size"] * unit * _sums(place, g[learns], len(names)).astype(float) / (n + p["reg_lambda"])
            nodes += [(tree, int(names[k]), None, None, None, int(n[k]), float(value[k])) for k in range(len(names))]
            k = np.minimum(np.searchsorted(names, node), len(names) - 1)
            pred = pred + np.where(names[k] == node, value[k], 0.0)
    return pred, nodes


def _grown_alone(samples: DataFrame, params: DataFrame, bins: int, min_rows: int, seed: int) -> DataFrame:
    """Models whose rows fit a task: one shuffle brings a target's rows together, and the task that holds them finds
    scale and bins and grows all trees. Rows of three kinds: predictions (``kind`` 0), nodes (1) and scales (2)."""
    draws = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_trees") - 1, F.lit(0))), lambda k: F.pmod(F.xxhash64("target_id", "d", k, F.lit(seed)), F.lit(1_000_000)) < F.col("subsample") * 1_000_000)
    rows = samples.select("target_id", "d", F.col("label").cast("double").alias("label"), "split", F.col("features").cast("array<double>").alias("features")).repartition("target_id")
    rows = rows.join(params.select("target_id", "model_id", *TYPES), "target_id", "left").withColumn("draws", F.when(F.col("subsample") < 1, draws))
    rows = rows.sortWithinPartitions("target_id", "model_id")
    found = "kind int, model_id string, target_id {target_id}, d {d}, split string, y_true double, y_pred double, tree int, node long, feature int, bin int, gain double, n long, value double, reason string, unit double, base double"
    schema = found.format(**{c: samples.schema[c].dataType.simpleString() for c in ("target_id", "d")})

    def run(batches):
        kinds = {"kind": pa.int32(), "model_id": pa.string(), "split": pa.string(), "y_true": pa.float64(), "y_pred": pa.float64(), "tree": pa.int32(), "node": pa.int64(), "feature": pa.int32(), "bin": pa.int32(), "gain": pa.float64(), "n": pa.int64(), "value": pa.float64(), "reason": pa.string(), "unit": pa.float64(), "base": pa.float64()}
        order = [x.split()[0] for x in found.split(", ")]
        last, held = None, []  # of the target at hand

        def table(kind: int, rows: int, /, **columns) -> pa.RecordBatch:
            columns["kind"] = pa.array([kind] * rows, pa.int32())
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, kinds[c]) for c in order], order)

        def settled(part: pa.Table):
            """Everything of one model."""
            nonlocal last
            one = {c: part.column(c)[0].as_py() for c in ("model_id", *TYPES)}
            label = part.column("label").to_numpy()
            train = part.column("split").to_numpy() == "train"
            n, reason, unit, base = _scale(label, train, min_rows)
            name = part.column("target_id").slice(0, 1).combine_chunks()
            target = name[0].as_py()
            if target != last:
                yield table(2, 1, target_id=name, d=pa.nulls(1, kinds["d"]), n=pa.array([n], pa.int64()), reason=pa.array([reason], pa.string()), unit=pa.array([unit], pa.float64()), base=pa.array([base], pa.float64()))
                last = target
            if reason is not None or base is None or one["model_id"] is None:
                return
            features = pc.list_flatten(part.column("features")).to_numpy().reshape(len(label), -1)
            drawn = None if one["subsample"] >= 1 else list(np.array(part.column("draws").to_pylist(), bool).T)
            pred, nodes = _grown(label, train, _places(features, train, bins), unit, base, drawn, one, bins)
            ids = pa.array([one["model_id"]], pa.string())
            columns = {c: part.column(s).combine_chunks() for c, s in (("target_id", "target_id"), ("d", "d"), ("split", "split"), ("y_true", "label"))}
            yield table(0, len(label), model_id=ids.take(pa.array(np.zeros(len(label), np.int64))), y_pred=pa.array(pred), **columns)
            if nodes:
                parts = dict(zip(("tree", "node", "feature", "bin", "gain", "n", "value"), zip(*nodes)))
                empty = {c: pa.nulls(len(nodes), kinds[c]) for c in ("target_id", "d")}
                yield table(1, len(nodes), model_id=ids.take(pa.array(np.zeros(len(nodes), np.int64))), **empty, **{c: pa.array(v, kinds[c]) for c, v in parts.items()})

        def several(parts: list[pa.RecordBatch]):
            """Few large batches instead of one per model."""
            if parts:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

        done, ready = [], 0
        for batch in batches:
            kinds |= {c: batch.schema.field(c).type for c in ("target_id", "d")}
            if not batch.num_rows:
                continue
            full = pa.Table.from_batches([*held, batch])
            ids, models = (full.column(c).combine_chunks().dictionary_encode() for c in ("target_id", "model_id"))
            ids, models = ids.indices.to_numpy(), pc.fill_null(models.indices, -1).to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (models[1:] != models[:-1])) + 1
            full, at = full.combine_chunks(), [0, *cuts.tolist()]
            for a, b in zip(at[:-1], at[1:]):
                for x in settled(full.slice(a, b - a)):
                    done.append(x)
                    ready += x.num_rows
                if ready > 20_000:
                    yield from several(done)
                    done, ready = [], 0
            held = full.slice(at[-1]).to_batches()
        if held:
            done += settled(pa.Table.from_batches(held))
        yield from several(done)

    return rows.mapInArrow(run, schema)


def fit(samples: DataFrame, params: DataFrame, bins: int = BINS, min_rows: int = MIN_ROWS, patience: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions of all rows, the trees' nodes, and the targets' ``scales``.

    With ``patience``, rows with split ``holdout`` are watched: a model without a better error there for so
    many trees grows no more and its predictions are those of its best tree (``stopped_at``). Without it, targets
    whose rows fit a task are settled there, each in one go; the others grow level by level."""
    if patience is None:
        samples = samples.filter("target_id is not null")
        size = F.coalesce(F.size("features"), F.lit(-1))
        counts = samples.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"))
        wide = _kept(counts.filter((F.col("n") > ALONE) | (F.col("least") < 0) | (F.col("least") < F.col("most"))).select("target_id"), "wide")
        some = not wide.isEmpty()
        alone = _kept(_grown_alone(samples.join(wide, "target_id", "left_anti") if some else samples, params, bins, min_rows, seed), "alone")
        done = alone.filter("kind = 0").select("model_id", "target_id", "d", "split", "y_true", "y_pred", F.abs(F.col("y_true") - F.col("y_pred")).alias("abs_error"))
        found = done, alone.filter("kind = 1").select(*NODE), alone.filter("kind = 2").select("target_id", "n", "reason", "unit", "base")
        if some:
            found = tuple(x.unionByName(y) for x, y in zip(found, _by_levels(samples.join(wide, "target_id", "left_semi"), params, bins, min_rows, None, seed)))
        return found
    return _by_levels(samples, params, bins, min_rows, patience, seed)


def _by_levels(samples: DataFrame, params: DataFrame, bins: int, min_rows: int, patience: int | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, scale = prepared(samples, params, bins, min_rows)
    most, depth = (x or 0 for x in params.agg(F.max("n_trees"), F.max("max_depth")).first())
    nodes = None
    if patience is not None:
        best = _kept(_errors(rows).withColumn("best_tree", F.lit(0)), "best")
        rows = rows.withColumn("best_pred", F.col("pred"))
    for tree in range(most):
        rows, grown = grow(rows, depth, seed)
        nodes = grown if nodes is None else nodes.unionByName(grown)
        if patience is not None:
            now = best.join(_errors(rows).withColumnRenamed("error", "now"), "model_id")
            better = F.col("now") < F.col("error")
            best = _kept(now.select("model_id", F.least("now", "error").alias("error"), F.when(better, tree + 1).otherwise(F.col("best_tree")).alias("best_tree")), f"best-{tree}")
            rows = rows.join(best.select("model_id", "best_tree"), "model_id", "left")
            done = tree + 1 - F.col("best_tree") >= patience
            rows = rows.withColumns({
                "best_pred": F.when(F.col("best_tree").isNull() | (F.col("best_tree") == tree + 1), F.col("pred")).otherwise(F.col("best_pred")),
                "n_trees": F.when(done, F.least("n_trees", F.lit(tree + 1))).otherwise(F.col("n_trees")),
            }).drop("best_tree")
            if not best.filter(F.lit(tree + 1) - F.col("best_tree") < patience).limit(1).count():
                break
    if patience is not None:
        rows = rows.join(best.select("model_id", F.col("best_tree").alias("stopped_at")), "model_id", "left").withColumn("pred", F.col("best_pred"))
    if nodes is None:
        nodes = samples.sparkSession.createDataFrame([], "model_id string, tree int, node long, feature int, bin int, gain double, n long, value double")
    out = rows.withColumnsRenamed({"label": "y_true", "pred": "y_pred"}).withColumn("abs_error", F.abs(F.col("y_true") - F.col("y_pred")))
    extra = ["stopped_at"] if patience is not None else []
    return out.select("model_id", "target_id", "d", "split", "y_true", "y_pred", "abs_error", *extra), nodes, scale


def one_model_each(samples: DataFrame) -> DataFrame:
    """``model_id, target_id``: one model per target, of its name."""
    return samples.select(F.col("target_id").cast("string").alias("model_id"), "target_id").filter("target_id is not null").distinct()


def train_targets(samples: DataFrame, params: dict[str, float] | None = None, min_rows: int = MIN_ROWS, bins: int = BINS) -> DataFrame:
    """Metrics per target and split; a target that was not trained is one row with its ``reason``."""
    models = parameters(samples.sparkSession, one_model_each(samples), params)
    scored, _, scale = fit(samples, models, bins, min_rows)
    found = forecast_metrics(scored, ["target_id", "split"])
    left = scale.filter("reason is not null").select("target_id", "reason")
    return found.withColumn("reason", F.lit(None).cast("string")).unionByName(left, allowMissingColumns=True)


def feature_importance(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Gain per model and feature as a share of the model's."""
    listed = nodes.filter("feature is not null").groupBy("model_id", "feature").agg(F.sum("gain").alias("gain"))
    share = F.col("gain") / F.sum("gain").over(Window.partitionBy("model_id"))
    return listed.select(F.col("model_id").alias("target_id"), F.get(F.array(*[F.lit(n) for n in names]), F.col("feature")).alias("feature_id"), share.alias("importance"))


# ---- parameter search


# Low and high end of the drawn parameters, and whether on a log scale.
SPACE = {
    "n_trees": (8, 40, False), "max_depth": (2, 4, False), "step_size": (0.03, 0.3, True), "subsample": (0.6, 1.0, False), "min_leaf": (3, 30, False), "reg_lambda": (0.01, 10.0, True),
}


def draw_trials(samples: DataFrame, n: int, space: dict[str, tuple[float, float, bool]] = SPACE, seed: int = SEED, known: DataFrame | None = None) -> DataFrame:
    """``target_id, number`` and parameters: ``n`` draws per target, by hash of target, number and
    parameter. ``known`` (an earlier search's trials with ``rank``) starts the search warm: a target's best
    earlier parameters are its draw 0 and the others are drawn between half and twice their values."""
    targets = samples.select("target_id").filter("target_id is not null").distinct()
    rows = targets.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if known is not None:
        first = known.filter("rank = 1").select("target_id", *[F.col(k).alias(f"_{k}") for k in space])
        rows = rows.join(first, "target_id", "left")
    for name, (low, high, log) in space.items():
        u = F.pmod(F.xxhash64(F.col("target_id").cast("string"), "number", F.lit(name), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        lo, hi = F.lit(float(low)), F.lit(float(high))
        if known is not None:
            best = F.col(f"_{name}").cast("double")
            lo, hi = F.coalesce(F.greatest(lo, best / 2), lo), F.coalesce(F.least(hi, best * 2), hi)
        drawn = F.exp(F.log(lo) + u * (F.log(hi) - F.log(lo))) if log else lo + u * (hi - lo)
        if known is not None:
            drawn = F.when(F.col("number") == 0, F.coalesce(best, drawn)).otherwise(drawn)
        rows = rows.withColumn(name, (F.round(drawn) if TYPES[name] == "int" else F.round(drawn, 6)).cast(TYPES[name]))
    return rows.select("target_id", "number", *space)


def halving(samples: DataFrame, trials: DataFrame, rungs: Sequence[int] = (4, 8, 16), keep: float = 0.5, bins: int = BINS, min_rows: int = MIN_ROWS, seed: int = SEED) -> DataFrame:
    """Successive halving over ``trials`` (``target_id, number`` and parameters): all grow to the first
    rung, the better half of each target's (by directional accuracy on the holdout, then error and number) to
    the next, and so on. Trees of a rung are kept, not grown again. One row per trial: ``trees`` it was
    given, ``mda`` and ``mae`` when it was last scored, ``rank`` among its target's (survivors first)."""
    named = trials.withColumn("model_id", F.concat_ws("#", F.col("target_id").cast("string"), F.col("number").cast("string")))
    rows, _ = prepared(samples, named.drop("number"), bins, min_rows)
    depth = trials.agg(F.max("max_depth")).first()[0] or 0
    every = named.select("model_id", "target_id", "number", "n_trees")
    done, grown = None, 0
    by = Window.partitionBy("target_id").orderBy(F.col("mda").desc(), F.col("mae"), F.col("number"))
    for rung, upto in enumerate(rungs):
        for _ in range(grown, upto):
            rows, _ = grow(rows, depth, seed)
        grown = upto
        held = rows.filter(F.col("split") == "holdout").select("model_id", "d", F.col("label").alias("y_true"), F.col("pred").alias("y_pred"))
        score = forecast_metrics(held, ["model_id"]).select("model_id", F.round("mda", 9).alias("mda"), F.round("mae", 6).alias("mae"))
        place = F.row_number().over(by)
        alive = every.join(score, "model_id").withColumns({"place": place, "count": F.count(F.lit(1)).over(Window.partitionBy("target_id"))})
        last = rung == len(rungs) - 1
        alive = alive.withColumn("stays", F.lit(last) | (F.col("place") <= F.greatest(F.ceil(F.col("count") * keep), F.lit(1))))
        alive = _kept(alive.withColumns({"rung": F.lit(rung), "trees": F.least("n_trees", F.lit(upto))}), f"rung-{rung}")
        out = alive.filter(~F.col("stays") | F.lit(last))
        done = out if done is None else done.unionByName(out)
        if not last:
            every = alive.filter("stays").select("model_id", "target_id", "number", "n_trees")
            rows = _kept(rows.join(every.select("model_id"), "model_id", "left_semi"), f"left-{rung}")
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.col("rung").desc(), "place"))
    scored = done.withColumn("rank", rank).select("target_id", "number", "rung", "trees", "mda", "mae", "rank")
    return trials.join(scored, ["target_id", "number"])
