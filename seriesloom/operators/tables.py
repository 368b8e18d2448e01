"""Table-shaped texts and nested table shapes, as batch jobs over many tables at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guarded import fixed
from .scan import joined_text

MISSING = "-"


def shown(value: Column, decimals: int = 2) -> Column:
    return F.coalesce(fixed(value, decimals), F.lit(MISSING))


def table_line(cells: Sequence[Column]) -> Column:
    return F.concat(F.lit("|"), F.concat_ws("|", *[F.coalesce(c, F.lit(MISSING)) for c in cells]), F.lit("|"))


def markdown_tables(rows: DataFrame, keys: Sequence[str], order: str, columns: dict[str, Column]) -> DataFrame:
    """One markdown table per group: header, rule, a line per row in the order of an integer
    column (from 1)."""
    head = table_line([F.lit(h) for h in columns])
    rule = F.lit("|" + "|".join("-" for _ in columns) + "|")
    lines = rows.select(*keys, F.col(order).cast("long").alias("_o"), table_line(list(columns.values())).alias("_line"))
    heads = rows.select(*keys).distinct().select(*keys, F.lit(-1).cast("long").alias("_o"), F.concat(head, F.lit("\n"), rule).alias("_line"))
    return joined_text(heads.unionByName(lines), keys, "_o", "_line", "\n")


TABLE = r"(\|[^\n]*\|[^\S\n]*\n\|[-:\s|]+\|[^\S\n]*\n(?:\|[^\n]*\|[^\S\n]*(?:\n|\z))*)"


def markdown_rows(texts: DataFrame, key: str, text: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Cells of all markdown tables in a text: (key, table_no, row_no, field, value). A header that
    occurs twice keeps its last cell; surplus cells are dropped."""
    tables = texts.select(key, F.posexplode(F.regexp_extract_all(F.concat(F.col(text), F.lit("\n")), F.lit(TABLE), F.lit(1))).alias("table_no", "t"))
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def cells(line: Column) -> Column:
        bare = F.regexp_replace(line, r"^\|+|\|+$", "")
        return F.transform(F.split(bare, r"\|"), lambda c: F.trim(c))

    parsed = tables.select(key, "table_no", lines.alias("l")).select(
        key, "table_no", cells(F.get("l", 0)).alias("heads"), F.posexplode(F.slice("l", 3, F.greatest(F.size("l") - 2, F.lit(0)))).alias("row_no", "line")
    )
    pairs = parsed.select(key, "table_no", "row_no", "heads", cells(F.col("line")).alias("c")).select(
        key, "table_no", "row_no", "heads", F.posexplode("c").alias("i", "value")
    )
    field = F.get("heads", F.col("i"))
    last = ~F.array_contains(F.slice("heads", F.col("i") + 2, F.size("heads")), field)
    named = field
    for old, new in (rename or {}).items():
        named = F.when(field == old, new).otherwise(named)
    return pairs.filter(field.isNotNull() & last).select(key, "table_no", "row_no", named.alias("field"), "value")


def column_store_rows(stores: DataFrame, key: str, first_header: str = "date") -> DataFrame:
    """``columns ARRAY<STRUCT<id, value, indexName, unit, data ARRAY<STRING>>>`` to long cells
    (key, row_no, position, header, cell): columns by id, as many rows as the first column has,
    short columns padded."""
    ordered = stores.select(key, F.array_sort("columns", lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("cols"))
    n_rows = F.size(F.get("cols", 0)["data"])
    base = ordered.select(key, n_rows.alias("n"), F.posexplode("cols").alias("position", "c"))
    name = F.coalesce(F.nullif(F.col("c.indexName"), F.lit("")), F.col("c.value"))
    unit = F.trim(F.coalesce(F.col("c.unit"), F.lit("")))
    header = F.when(F.col("c.id") == 0, first_header).when(unit != "", F.concat(name, F.lit(" ("), unit, F.lit(")"))).otherwise(name)
    rows = base.filter(F.col("n") > 0).select(
        key, "position", header.alias("header"), F.col("c.data").alias("data"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("row_no")
    )
    return rows.select(key, "row_no", "position", "header", F.coalesce(F.get("data", F.col("row_no")), F.lit(MISSING)).alias("cell"))


def history_or_forecast(points: DataFrame) -> DataFrame:
    """History wins over forecast; points with neither go."""
    return points.filter(F.col("his").isNotNull() | F.col("ai").isNotNull()).select(
        "*", F.coalesce("his", "ai").alias("value"), F.when(F.col("his").isNotNull(), "actual").otherwise("forecast").alias("kind")
    )


def chart_rows(main: DataFrame, extra: DataFrame) -> DataFrame:
    """Each point of a chart beside the extra series of the same chart and date. A history row
    takes history from the extra series, a forecast row their forecast or else their history."""
    e = extra.select("chart_id", "d", F.col("item").alias("item"), F.col("his").alias("e_his"), F.col("ai").alias("e_ai"))
    joined = main.join(e, ["chart_id", "d"], "left")
    value = F.when(F.col("his").isNotNull(), F.col("e_his")).when(F.col("ai").isNotNull(), F.coalesce("e_ai", "e_his"))
    return joined.select(
        "chart_id", "d", "item", value.alias("item_value"), F.coalesce("his", "ai").alias("difference"),
        F.when(F.col("his").isNotNull(), "history").when(F.col("ai").isNotNull(), "forecast").otherwise(MISSING).alias("kind"),
    )


def scenario_panel(scenarios: DataFrame) -> DataFrame:
    """``(scenario_id, data MAP<STRING, MAP<STRING, DOUBLE>>)`` to (scenario_id, series_id, d, value).
    Which way round the map is nested shows in its first key: a date or a factor id."""
    by_date = F.try_to_date(F.get(F.map_keys("data"), 0), "yyyy-MM-dd").isNotNull()
    outer = scenarios.select("scenario_id", by_date.alias("by_date"), F.explode("data").alias("k1", "inner"))
    cells = outer.select("scenario_id", "by_date", "k1", F.explode("inner").alias("k2", "value"))
    return cells.select(
        "scenario_id",
        F.when(F.col("by_date"), F.col("k2")).otherwise(F.col("k1")).alias("series_id"),
        F.try_to_date(F.when(F.col("by_date"), F.col("k1")).otherwise(F.col("k2")), "yyyy-MM-dd").alias("d"),
        "value",
    )


def scenario_maps(panel: DataFrame, by_date: bool) -> DataFrame:
    """The reverse: one nested map per scenario. Meant for scenario sets held to a point budget."""
    outer, inner = ("d", "series_id") if by_date else ("series_id", "d")
    text = panel.withColumn("d", F.col("d").cast("string"))
    entries = text.groupBy("scenario_id", outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "value")))).alias("m"))
    return entries.groupBy("scenario_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(outer, F.map_entries("m").alias("e"))))).alias("x")).select(
        "scenario_id", F.transform_values("x", lambda k, v: F.map_from_entries(v)).alias("data")
    )


def model_summary(metrics: DataFrame, records: DataFrame, predictions: DataFrame, features: DataFrame, last: int = 10, first: int = 20) -> DataFrame:
    """One row per target: metrics, best parameters, its last predictions, and how many features
    it has with the first few of them."""
    from .metrics import latest_rows
    from .scan import top_per_group

    recent = latest_rows(predictions, last).groupBy("target_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("d"), F.col("y_true"), F.col("y_pred")))).alias("recent")
    )
    counts = features.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_features"))
    heads = top_per_group(features, ["target_id"], [F.col("ordinal"), F.col("feature_id")], first).groupBy("target_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "feature_id"))), lambda x: x["feature_id"]).alias("first_features")
    )
    out = metrics.join(records.select("target_id", "params"), "target_id", "left")
    for side in (recent, counts, heads):
        out = out.join(side, "target_id", "left")
    return out
