"""Named series side by side, and the features computed from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import has_all, has_any
from ..functions.guarded import change_ratio, safe_ratio

# A role is looked up by alternatives in order: (mode, words), mode "all" or "any".
Roles = dict[str, Sequence[tuple[str, Sequence[str]]]]


def find_series(catalog: DataFrame, roles: Roles) -> DataFrame:
    """(role, series_id): the first series by catalog order that matches. All roles come from one
    aggregate over the catalog; the words of an alternative must all match unless it says any."""
    name = F.col("series_name")
    cols = []
    for role, alternatives in roles.items():
        found = [
            F.min_by("series_id", F.when(has_any(name, words) if mode == "any" else has_all(name, words), F.struct("ordinal", "series_id")))
            for mode, words in alternatives
        ]
        cols.append(F.struct(F.lit(role).alias("role"), F.coalesce(*found).alias("series_id")))
    one = catalog.agg(F.array(*cols).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*").filter(F.col("series_id").isNotNull())


def roles_by_day(panel: DataFrame, found: DataFrame, roles: Sequence[str]) -> DataFrame:
    """One row per day, one column per role. ``found`` has one row per role, so it is tiny by
    construction; the panel is filtered to those series before the pivot."""
    picked = panel.join(F.broadcast(found), "series_id")
    return picked.groupBy("d").pivot("role", list(roles)).agg(F.first("value"))


def _by_day() -> Window:
    # one row per calendar day in the whole table
    return Window.partitionBy(F.lit(0)).orderBy("d")


def _mean(value: Column, width: int, need: int) -> Column:
    w = _by_day().rowsBetween(-(width - 1), 0)
    return F.when(F.count(value).over(w) >= need, F.avg(value).over(w))


def business_features(wide: DataFrame, producers: Sequence[str] = ()) -> DataFrame:
    """Features for the roles that are there: producer total and shares (null if one is missing),
    inventory over outflow, utilisation, price return and volatility, price spread and ratio,
    profit, pass-throughs, 7-day changes."""
    have, w = set(wide.columns), _by_day()
    back = lambda name, k: F.lag(name, k).over(w)
    out: dict[str, Column] = {}
    producers = [p for p in producers if p in have]
    if producers:
        total = F.col(producers[0])
        for p in producers[1:]:
            total = total + F.col(p)
        out["biz_producer_total"] = total
        out |= {f"biz_{p}_share": safe_ratio(F.col(p), total) for p in producers}
    if {"inventory", "outflow"} <= have:
        out["biz_inventory_outflow"] = safe_ratio(F.col("inventory"), F.col("outflow"))
    if "utilisation" in have:
        v = F.col("utilisation")
        ma7, ma30 = _mean(v, 7, 3), _mean(v, 30, 10)
        out |= {"biz_util_change": v - back("utilisation", 1), "biz_util_ma7": ma7, "biz_util_ma30": ma30, "biz_util_trend": safe_ratio(ma7, ma30)}
    if "ore_price" in have:
        out["biz_ore_return"] = change_ratio(F.col("ore_price"), back("ore_price", 1))
    if {"steel_price", "ore_price"} <= have:
        out["biz_spread"] = F.col("steel_price") - F.col("ore_price")
        out["biz_price_ratio"] = safe_ratio(F.col("steel_price"), F.col("ore_price"))
    if "profit" in have:
        out |= {"biz_profit_change": F.col("profit") - back("profit", 1), "biz_profit_ma7": _mean(F.col("profit"), 7, 3)}
    for role in ("scrap_spread", "scrap_arrivals"):
        if role in have:
            out[f"biz_{role}"] = F.col(role)
    for role in ("arrivals", "shipments"):
        if role in have:
            out[f"biz_{role}_change_7d"] = F.col(role) - back(role, 7)
    wide = wide.withColumns(out)
    if "ore_price" in have:
        w30 = w.rowsBetween(-29, 0)
        vol = F.when(F.count("biz_ore_return").over(w30) >= 10, F.stddev_samp("biz_ore_return").over(w30))
        wide = wide.withColumn("biz_ore_vol_30d", vol)
    return wide.drop(*[c for c in wide.columns if c != "d" and not c.startswith("biz_")])
