"""Keyword rules over series names, and rules over feature ids.

Rules are short parameter lists, so they become column expressions: no join at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_any(name: Column, words: Sequence[str], ignore_case: bool = False) -> Column:
    name, words = (F.lower(name), [w.lower() for w in words]) if ignore_case else (name, words)
    out = F.lit(False)
    for word in words:
        out = out | name.contains(word)
    return out


def has_all(name: Column, words: Sequence[str]) -> Column:
    out = F.lit(True)
    for word in words:
        out = out & name.contains(word)
    return out


def classify(name: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "other") -> Column:
    """Ordered (group, keywords) rules; the first rule with a matching keyword wins."""
    out = None
    for group, words in rules:
        hit = has_any(name, words)
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return F.lit(default) if out is None else out.otherwise(default)


def rule_priority(group: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Position of a group in the rule list; the default group comes last."""
    names = F.array(*[F.lit(g) for g, _ in rules])
    at = F.array_position(names, group)
    return F.when(at > 0, at).otherwise(F.lit(len(rules) + 1)).cast("int")


def tier(is_core: Column, group: Column, important_groups: Sequence[str]) -> Column:
    return (
        F.when(is_core, "core").when(group.isin(list(important_groups)), "important").otherwise("basic")
    )


# Suffixes that mark a derived feature, tried in this order.
DERIVED_SUFFIXES = (
    "_lag", "_MA", "_STD", "_P", "_MOM", "_yoy", "_mom", "_wow", "_pct", "_diff",
    "_ratio", "_RSI", "_MACD", "_ATR", "_BB", "_BBW", "_SMA", "_EMA",
)


def base_id(feature_id: Column, id_prefix: str = "ID", suffixes: Sequence[str] = DERIVED_SUFFIXES) -> Column:
    """Series a derived feature comes from: the id part when the feature starts with the
    id prefix, else everything before the first listed suffix that occurs."""
    cut = None
    for suffix in suffixes:
        at = F.instr(feature_id, suffix)
        piece = F.substring(feature_id, F.lit(1), at - 1)
        cut = F.when(at > 1, piece) if cut is None else cut.when(at > 1, piece)
    cut = feature_id if cut is None else cut.otherwise(feature_id)
    head = F.split_part(feature_id, F.lit("_"), F.lit(1))
    return F.when(head.startswith(id_prefix), head).otherwise(cut)


def feature_type(
    feature_id: Column, family: Column, inventory_ids: Sequence[str], id_prefix: str = "ID"
) -> Column:
    """target / time / inventory / factor. Calendar features are told by their family, so
    no calendar column is taken for a factor because of its spelling."""
    return (
        F.when(feature_id.startswith("target_"), "target")
        .when(family == "time", "time")
        .when(base_id(feature_id, id_prefix).isin(list(inventory_ids)), "inventory")
        .otherwise("factor")
    )


def is_model_feature(feature_id: Column, keep_target_lags: bool) -> Column:
    """Columns a model may see: no date, no label; target columns are dropped altogether
    (single target) or only as differences and percentages (many targets)."""
    banned = (
        feature_id.startswith("target_diff_") | feature_id.startswith("target_pct_")
        if keep_target_lags
        else feature_id.startswith("target_")
    )
    return ~(banned | feature_id.isin("data_date", "_y"))
