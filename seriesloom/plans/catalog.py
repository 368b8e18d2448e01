"""Series catalogs, feature catalogs, merging and selection.

``part`` is the series catalog; features come from the orders panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as rules
from ..functions.guarded import safe_ratio
from ..operators import business, profile, rolling, select, technical
from ..session import cut_lineage
from ..sources.tables import table
from .base import ORD, ORDD, SUP, W, mean_sql, orders_daily, ratio_sql, rounded, std_sql, supplier_panel, with_

RULES = [("metal", ["bolt", "gear", "plate"]), ("cold", ["cold", "ice"]), ("tone", ["red", "blue", "green"]), ("size", ["small", "large"])]
IMPORTANT = ["metal", "tone"]


def _catalog(spark, sf):
    return table(spark, sf, "part").select(F.format_string("ID%08d", "p_partkey").alias("series_id"), F.col("p_name").alias("series_name"), F.col("p_partkey").alias("ordinal"), "p_brand")


def _mapping(spark, sf):
    name = F.col("series_name")
    return _catalog(spark, sf).select("series_id", "series_name", rules.classify(name, RULES).alias("grp"), rules.has_any(name, ["GIZMO", "Ring"], True).alias("is_core"))


def series_classes(spark, sf):
    return _mapping(spark, sf).withColumn("tier", rules.tier(F.col("is_core"), F.col("grp"), IMPORTANT))


def class_summary(spark, sf):
    return profile.group_summary(_mapping(spark, sf)).withColumn("priority", rules.rule_priority(F.col("grp"), RULES)).orderBy("priority")


def keyword_choice(spark, sf):
    return technical.pick_series(_catalog(spark, sf), ["gear", "ring"], ["old", "small"], 8).select("series_id", "series_name")


ROLES = {
    "both": [("all", ["red", "gear"])],
    "either": [("any", ["gizmo", "anvil"])],
    "second_choice": [("all", ["no such word"]), ("all", ["bolt"])],
    "nothing": [("all", ["no such word"])],
}


def role_lookup(spark, sf):
    return business.find_series(_catalog(spark, sf), ROLES)


def _derived_ids(spark, sf):
    """Feature ids of every part: plain, lagged, averaged, target and calendar ones."""
    names = [("factor", ""), ("factor", "_lag7"), ("factor", "_MA30"), ("factor", "_STD7_ratio"), ("factor", "_P10_30d")]
    forms = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("suffix")) for f, s in names])
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))
    ids = _catalog(spark, sf).select("series_id", brand.alias("brand"), F.explode(forms).alias("f"))
    own = ids.select(F.concat("series_id", "f.suffix").alias("feature_id"), "f.family")
    other = ids.select(F.concat("brand", "f.suffix").alias("feature_id"), "f.family").distinct()
    target = ids.select(F.concat(F.lit("target"), F.coalesce(F.nullif("f.suffix", F.lit("")), F.lit("_diff_1"))).alias("feature_id"), F.lit("target").alias("family")).distinct()
    time = _catalog(spark, sf).select(F.concat(F.lit("week_"), (F.length("series_name")).cast("string")).alias("feature_id"), F.lit("time").alias("family")).distinct()
    return own.unionByName(other).unionByName(target).unionByName(time)


def feature_types(spark, sf):
    fid = F.col("feature_id")
    return _derived_ids(spark, sf).select("feature_id", "family", rules.base_id(fid).alias("base_id"), rules.feature_type(fid, F.col("family"), ["ID00000001", "ID00000002"]).alias("ftype"))


def model_columns(spark, sf):
    """Which features a single-target and a multi-target model may see."""
    ids = _derived_ids(spark, sf)
    return ids.select("feature_id", rules.is_model_feature(F.col("feature_id"), False).alias("single"), rules.is_model_feature(F.col("feature_id"), True).alias("many"))


def guarded_ratio(spark, sf):
    l = table(spark, sf, "lineitem")
    daily = l.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum(F.when(F.col("l_tax") > 0.07, F.col("l_quantity")).otherwise(0.0)).alias("t"))
    return daily.select("l_suppkey", F.round(safe_ratio(F.col("q"), F.col("t")), 6).alias("ratio"))


def common_feature_ids(spark, sf):
    """Products seen in both periods, and those only in the first."""
    o = supplier_panel(spark, sf).select(F.concat("series_id", F.lit("_"), F.month("d").cast("string")).alias("feature_id"), "d")
    train, test = o.filter(F.col("d") < "1998-01-01"), o.filter(F.col("d") >= "1998-01-01")
    both = select.common_features(train, test).withColumn("side", F.lit("both"))
    only = select.without(train.select("feature_id").distinct(), test, "feature_id").withColumn("side", F.lit("train only"))
    return both.unionByName(only)


def named_series_features(spark, sf):
    """Business features of named series, found by keywords in the priority names."""
    panel = orders_daily(spark, sf)
    catalog = panel.select("series_id").distinct().select("series_id", F.lower("series_id").alias("series_name"), F.substring("series_id", 1, 1).cast("int").alias("ordinal"))
    roles = {
        "mine_a": [("all", ["urgent"])], "mine_b": [("all", ["high"])], "mine_c": [("all", ["medium"])], "mine_d": [("all", ["low"])],
        "inventory": [("all", ["specified"])], "outflow": [("any", ["low", "urgent"])], "utilisation": [("all", ["low"])],
        "ore_price": [("all", ["settlement"]), ("all", ["high"])], "steel_price": [("all", ["medium"])], "profit": [("all", ["not"])],
        "scrap_spread": [("all", ["urgent"])], "arrivals": [("all", ["high"])], "shipments": [("all", ["low"])],
    }
    wide = business.roles_by_day(panel, business.find_series(catalog, roles), list(roles))
    return rounded(business.business_features(wide, ["mine_a", "mine_b", "mine_c", "mine_d"]), 4)


LAGS, MEANS = (1, 2, 7, 400), (3, 5, 7, 14, 30, 60)


def feature_blocks(spark, sf):
    """Lag, mean and constant families of the orders panel, long."""
    daily = orders_daily(spark, sf)
    lags = rolling.lag_features(daily, LAGS)
    means = daily.withColumns({f"ma{n}": rolling.rolling_mean("value", n) for n in MEANS})
    flat = daily.withColumns({"flat": F.lit(1.0), "copy": F.col("value"), "twin": F.col("value"), "late": F.when(F.col("d") >= "1999-01-01", F.col("value")), "never": F.lit(None).cast("double")})
    return select.merge_blocks(
        {
            "lag": rolling.to_long(lags, [f"lag_{k}" for k in LAGS]),
            "mean": rolling.to_long(means, [f"ma{n}" for n in MEANS]),
            "plain": rolling.to_long(flat, ["flat", "copy", "twin", "late", "never"]),
        }
    )


def merged_features(spark, sf):
    """Merged, stripped of uninformative features, filled forward."""
    kept = select.drop_low_information(feature_blocks(spark, sf), ["series_id"])
    return rounded(select.fill_features(kept, ["series_id"]).filter(F.col("value").isNotNull()), 3)


def merged_families(spark, sf):
    before = feature_blocks(spark, sf)
    return select.family_counts(before, select.drop_low_information(before, ["series_id"]))


def _filled(spark, sf):
    """The filled feature table, written to the shared folder once: several passes read it."""
    kept = select.drop_low_information(feature_blocks(spark, sf), ["series_id"])
    return cut_lineage(select.fill_features(kept, ["series_id"], allow_future=True))


def feature_variances(spark, sf):
    stats = select.enough_variance(select.feature_stats(_filled(spark, sf), ["series_id"]))
    # in units of a million squared dollars
    return stats.select("series_id", "feature_id", F.round(F.col("var") / 1e12, 6).alias("var"))


def correlated_features(spark, sf):
    """Pairs within a series correlated beyond 0.9."""
    vectors = cut_lineage(select.unit_vectors(_filled(spark, sf), "series_id"))
    pairs = select.correlated_pairs(vectors, "series_id", 0.9)
    return pairs.select("series_id", "keep_first", "other")


def without_redundant_features(spark, sf):
    return select.remove_redundant(_filled(spark, sf), "series_id", 0.9)


def features_per_target(spark, sf):
    """Shared features repeated per target, each target's own lags added, pruned to a list."""
    daily = orders_daily(spark, sf)
    total = daily.groupBy("d").agg(F.sum("value").alias("all_value"), F.max("value").alias("max_value"), F.min("value").alias("min_value"))
    shared = total.unpivot(["d"], ["all_value", "max_value", "min_value"], "feature_id", "value")
    own = rolling.to_long(rolling.lag_features(daily, (1, 7)), ["lag_1", "lag_7"]).withColumnsRenamed({"series_id": "target_id"})
    own = own.withColumn("feature_id", F.concat(F.lit("target_"), "feature_id"))
    targets = sorted(r.series_id for r in daily.select("series_id").distinct().collect())
    full = select.target_template(shared, own, targets)
    chosen = full.select("target_id", "feature_id").distinct().filter(~((F.col("target_id") < "3") & (F.col("feature_id") == "min_value")))
    return select.keep_selected(full, chosen, ["target_id", "feature_id"]).filter(F.col("value").isNotNull())


def importance_caps(spark, sf):
    """Most important brands per type, by revenue, with a cap per type."""
    l = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_quantity") - 10).alias("q"))
    imp = table(spark, sf, "part").join(l, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_type").alias("target_id"), F.col("p_name").alias("feature_id")).agg(F.sum("q").alias("importance"))
    return select.cap_by_importance(imp, F.when(F.col("target_id") < "M", 20).otherwise(12))


def protected_cap(spark, sf):
    """Catalog of typed features cut to a size, protected types kept."""
    typed = feature_types(spark, sf).select("feature_id", "ftype").distinct()
    importance = table(spark, sf, "lineitem").groupBy(F.concat(F.format_string("ID%08d", "l_partkey"), F.lit("_lag7")).alias("feature_id")).agg(F.sum("l_quantity").alias("importance"))
    return select.cap_keeping_protected(typed, importance, cap=120, slack=20)


CAT = """cat AS (SELECT printf('ID%08d', p_partkey) AS series_id, p_name AS series_name, p_partkey AS ordinal, p_brand FROM part),
map AS (SELECT series_id, series_name, CASE """ + " ".join(f"WHEN {' OR '.join(f'contains(series_name, {w!r})' for w in ws)} THEN '{g}'" for g, ws in RULES) + """ ELSE 'other' END AS grp,
  contains(lower(series_name), 'gizmo') OR contains(lower(series_name), 'ring') AS is_core FROM cat)"""
_BLOCKS = with_(ORDD) + ", w AS (SELECT *, " + ", ".join([f"lag(value, {k}) OVER {W} AS lag_{k}" for k in LAGS] + [f"{mean_sql(n)} AS ma{n}" for n in MEANS]) + """, CAST(1 AS DOUBLE) AS flat, value AS copy, value AS twin, CASE WHEN d >= DATE '1999-01-01' THEN value END AS late, CAST(NULL AS DOUBLE) AS never FROM ordd),
blocks AS (""" + " UNION ALL ".join(
    f"SELECT series_id, d, '{c}' AS feature_id, {c} AS value, '{fam}' AS family FROM w"
    for fam, cols in (("lag", [f"lag_{k}" for k in LAGS]), ("mean", [f"ma{n}" for n in MEANS]), ("plain", ["flat", "copy", "twin", "late", "never"])) for c in cols
) + """),
st AS (SELECT series_id, feature_id FROM blocks GROUP BY 1, 2 HAVING count(value) > 0 AND avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) <= 0.5 AND stddev_samp(value) >= 1e-10),
kept AS (SELECT b.* FROM blocks b JOIN st USING (series_id, feature_id)),
fwd AS (SELECT series_id, d, feature_id, family, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id, feature_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM kept),
filled AS (SELECT series_id, d, feature_id, family, first_value(value IGNORE NULLS) OVER (PARTITION BY series_id, feature_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM fwd),
fw AS (SELECT series_id, feature_id, var_pop(value) AS var, pow(10, floor(log10(greatest(var_pop(value), 1e-30))) - 8) AS unit FROM filled GROUP BY 1, 2),
fv AS (SELECT series_id, feature_id, round(var / unit) * unit AS var FROM fw)
"""
# variances are compared in nine digits, as sums differ in their last bits
_PAIRS = _BLOCKS + """, pr AS (SELECT a.series_id, a.feature_id AS fa, b.feature_id AS fb, corr(a.value, b.value) AS r FROM filled a JOIN filled b USING (series_id, d) WHERE a.feature_id < b.feature_id GROUP BY ALL),
pairs AS (SELECT pr.series_id, CASE WHEN va.var >= vb.var THEN fa ELSE fb END AS keep_first, CASE WHEN va.var >= vb.var THEN fb ELSE fa END AS other
  FROM pr JOIN fv va ON va.series_id = pr.series_id AND va.feature_id = fa JOIN fv vb ON vb.series_id = pr.series_id AND vb.feature_id = fb WHERE abs(r) > 0.9)
"""
_IDS = ("WITH " + CAT + """, s(family, suffix) AS (VALUES ('factor', ''), ('factor', '_lag7'), ('factor', '_MA30'), ('factor', '_STD7_ratio'), ('factor', '_P10_30d')),
ids AS (SELECT series_id || suffix AS feature_id, family FROM cat, s UNION ALL SELECT DISTINCT replace(p_brand, '#', '_') || suffix, family FROM cat, s
  UNION ALL SELECT DISTINCT 'target' || CASE WHEN suffix = '' THEN '_diff_1' ELSE suffix END, 'target' FROM s, (SELECT 1 FROM cat LIMIT 1) UNION ALL SELECT DISTINCT 'week_' || length(series_name), 'time' FROM cat),
""" + "bases AS (SELECT *, CASE WHEN feature_id LIKE 'ID%' THEN split_part(feature_id, '_', 1) " + " ".join(f"WHEN instr(feature_id, '{s}') > 1 THEN left(feature_id, instr(feature_id, '{s}') - 1)" for s in rules.DERIVED_SUFFIXES)
    + """ ELSE feature_id END AS base_id FROM ids),
typed AS (SELECT *, CASE WHEN starts_with(feature_id, 'target_') THEN 'target' WHEN family = 'time' THEN 'time' WHEN base_id IN ('ID00000001', 'ID00000002') THEN 'inventory' ELSE 'factor' END AS ftype FROM bases)
""")

QUERIES = {
    "series_classes": series_classes,
    "class_summary": class_summary,
    "keyword_choice": keyword_choice,
    "role_lookup": role_lookup,
    "feature_types": feature_types,
    "model_columns": model_columns,
    "guarded_ratio": guarded_ratio,
    "common_feature_ids": common_feature_ids,
    "named_series_features": named_series_features,
    "merged_features": merged_features,
    "merged_families": merged_families,
    "feature_variances": feature_variances,
    "correlated_features": correlated_features,
    "without_redundant_features": without_redundant_features,
    "features_per_target": features_per_target,
    "importance_caps": importance_caps,
    "protected_cap": protected_cap,
}


def _biz_sql() -> str:
    win = lambda n: f"(ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    mean = lambda c, n, k: f"CASE WHEN count({c}) OVER {win(n)} >= {k} THEN avg({c}) OVER {win(n)} END"
    lag = lambda c, k: f"lag({c}, {k}) OVER (ORDER BY d)"
    cols = {
        "biz_producer_total": "a + b + c + l", "biz_mine_a_share": ratio_sql("a", "a + b + c + l"), "biz_mine_b_share": ratio_sql("b", "a + b + c + l"), "biz_mine_c_share": ratio_sql("c", "a + b + c + l"),
        "biz_mine_d_share": ratio_sql("l", "a + b + c + l"), "biz_inventory_outflow": ratio_sql("n", "a"), "biz_util_change": f"l - {lag('l', 1)}", "biz_util_ma7": "u7", "biz_util_ma30": "u30", "biz_util_trend": ratio_sql("u7", "u30"),
        "biz_ore_return": "ret", "biz_spread": "c - b", "biz_price_ratio": ratio_sql("c", "b"), "biz_profit_change": f"n - {lag('n', 1)}", "biz_profit_ma7": mean("n", 7, 3), "biz_scrap_spread": "a",
        "biz_arrivals_change_7d": f"b - {lag('b', 7)}", "biz_shipments_change_7d": f"l - {lag('l', 7)}", "biz_ore_vol_30d": f"CASE WHEN count(ret) OVER {win(30)} >= 10 THEN stddev_samp(ret) OVER {win(30)} END",
    }
    return with_(ORDD) + f""", p AS (SELECT d, max(value) FILTER (series_id LIKE '1%') AS a, max(value) FILTER (series_id LIKE '2%') AS b, max(value) FILTER (series_id LIKE '3%') AS c,
  max(value) FILTER (series_id LIKE '4%') AS n, max(value) FILTER (series_id LIKE '5%') AS l FROM ordd GROUP BY 1),
x AS (SELECT *, {mean('l', 7, 3)} AS u7, {mean('l', 30, 10)} AS u30, CASE WHEN abs({lag('b', 1)}) > 1e-10 THEN (b - {lag('b', 1)}) / abs({lag('b', 1)}) END AS ret FROM p)
SELECT d, """ + ", ".join(f"round({e}, 4) AS {n}" for n, e in cols.items()) + " FROM x"


ORACLES = {
    "series_classes": "WITH " + CAT + " SELECT *, CASE WHEN is_core THEN 'core' WHEN grp IN ('metal', 'tone') THEN 'important' ELSE 'basic' END AS tier FROM map",
    "class_summary": "WITH " + CAT + " SELECT grp, count(*) AS total, count(*) FILTER (is_core) AS core, count(*) FILTER (NOT is_core) AS non_core, CASE grp " + " ".join(f"WHEN '{g}' THEN {i + 1}" for i, (g, _) in enumerate(RULES)) + f" ELSE {len(RULES) + 1} END AS priority FROM map GROUP BY 1",
    "keyword_choice": "WITH " + CAT + " SELECT series_id, series_name FROM cat WHERE (contains(series_name, 'gear') OR contains(series_name, 'ring')) AND NOT (contains(series_name, 'old') OR contains(series_name, 'small')) ORDER BY ordinal LIMIT 8",
    "role_lookup": "WITH " + CAT + """ SELECT * FROM (SELECT 'both' AS role, min(series_id) FILTER (contains(series_name, 'red') AND contains(series_name, 'gear')) AS series_id FROM cat
UNION ALL SELECT 'either', min(series_id) FILTER (contains(series_name, 'gizmo') OR contains(series_name, 'anvil')) FROM cat UNION ALL SELECT 'second_choice', min(series_id) FILTER (contains(series_name, 'bolt')) FROM cat) WHERE series_id IS NOT NULL""",
    "feature_types": _IDS + "SELECT feature_id, family, base_id, ftype FROM typed",
    "model_columns": _IDS + "SELECT feature_id, NOT starts_with(feature_id, 'target_') AS single, NOT (starts_with(feature_id, 'target_diff_') OR starts_with(feature_id, 'target_pct_')) AS many FROM ids",
    "guarded_ratio": "SELECT l_suppkey, round(CASE WHEN abs(sum(l_quantity) FILTER (l_tax > 0.07)) > 1e-10 THEN sum(l_quantity) / sum(l_quantity) FILTER (l_tax > 0.07) END, 6) AS ratio FROM lineitem GROUP BY 1",
    "common_feature_ids": with_(SUP) + """, t AS (SELECT DISTINCT series_id || '_' || month(d) AS feature_id FROM sup WHERE d < DATE '1998-01-01'), u AS (SELECT DISTINCT series_id || '_' || month(d) AS feature_id FROM sup WHERE d >= DATE '1998-01-01')
SELECT feature_id, CASE WHEN feature_id IN (SELECT feature_id FROM u) THEN 'both' ELSE 'train only' END AS side FROM t""",
    "named_series_features": _biz_sql(),
    "merged_features": _BLOCKS + "SELECT series_id, d, feature_id, round(value, 3) AS value, family FROM fwd WHERE value IS NOT NULL",
    "merged_families": _BLOCKS + "SELECT family, count(DISTINCT feature_id) AS n_before, (SELECT count(DISTINCT feature_id) FROM kept k WHERE k.family = blocks.family) AS n_after FROM blocks GROUP BY 1",
    "feature_variances": _BLOCKS + "SELECT series_id, feature_id, round(var / 1e12, 6) AS var FROM fv WHERE var >= 1e-8",
    "correlated_features": _PAIRS + "SELECT * FROM pairs",
    "without_redundant_features": _PAIRS + """, o AS (SELECT series_id, feature_id, row_number() OVER (PARTITION BY series_id ORDER BY var DESC, feature_id) AS i FROM fv WHERE var >= 1e-8),
rival AS (SELECT o.series_id, o.feature_id, o.i, list(p.keep_first) FILTER (p.keep_first IS NOT NULL) AS before FROM o LEFT JOIN pairs p ON p.series_id = o.series_id AND p.other = o.feature_id GROUP BY ALL),
g AS (SELECT * FROM (WITH RECURSIVE r AS (SELECT series_id, i, [feature_id] AS kept FROM rival WHERE i = 1
  UNION ALL SELECT r.series_id, v.i, CASE WHEN list_has_any(coalesce(v.before, []), r.kept) THEN r.kept ELSE list_append(r.kept, v.feature_id) END FROM r JOIN rival v ON v.series_id = r.series_id AND v.i = r.i + 1) SELECT * FROM r))
SELECT series_id, unnest(max_by(kept, i)) AS feature_id FROM g GROUP BY series_id""",
    "features_per_target": with_(ORDD) + f""", t AS (SELECT DISTINCT series_id AS target_id FROM ord), s AS (SELECT d, 'all_value' AS feature_id, sum(value) AS value FROM ordd GROUP BY 1 UNION ALL SELECT d, 'max_value', max(value) FROM ordd GROUP BY 1 UNION ALL SELECT d, 'min_value', min(value) FROM ordd GROUP BY 1),
f AS (SELECT target_id, d, feature_id, value FROM s, t UNION ALL SELECT series_id, d, 'target_lag_1', lag(value, 1) OVER {W} FROM ordd UNION ALL SELECT series_id, d, 'target_lag_7', lag(value, 7) OVER {W} FROM ordd)
SELECT * FROM f WHERE value IS NOT NULL AND NOT (target_id < '3' AND feature_id = 'min_value')""",
    "importance_caps": """WITH i AS (SELECT p_type AS target_id, p_name AS feature_id, sum(l_quantity - 10) AS importance FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY importance DESC, feature_id) AS INTEGER) AS rank FROM i WHERE importance > 0) SELECT * FROM r WHERE rank <= CASE WHEN target_id < 'M' THEN 20 ELSE 12 END""",
    "protected_cap": _IDS + """, u AS (SELECT DISTINCT feature_id, ftype FROM typed), i AS (SELECT printf('ID%08d', l_partkey) || '_lag7' AS feature_id, sum(l_quantity) AS importance FROM lineitem GROUP BY 1),
r AS (SELECT u.*, row_number() OVER (PARTITION BY ftype ORDER BY coalesce(importance, 0) DESC, feature_id) AS r FROM u LEFT JOIN i USING (feature_id))
SELECT feature_id, ftype FROM r WHERE (SELECT count(*) FROM u) <= 140 OR ftype <> 'factor' OR r <= 120 - (SELECT count(*) FROM u WHERE ftype <> 'factor')""",
}
