"""Table texts, nested table shapes and text hygiene. Their inputs are built by Spark from the
given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import tables as tb
from ..sources.tables import table
from .base import ORD, SUP, orders_panel, supplier_panel, with_


def _numbered(spark, sf):
    p = supplier_panel(spark, sf)
    return p.withColumn("row_no", F.row_number().over(Window.partitionBy("series_id").orderBy("d")))


def markdown_tables(spark, sf):
    """One markdown table per supplier."""
    cols = {"date": F.col("d").cast("string"), "quantity": tb.shown(F.when(F.col("value") > 5, F.col("value"))), "kind": F.when(F.col("value") > 40, "peak")}
    return tb.markdown_tables(_numbered(spark, sf), ["series_id"], "row_no", cols)


def markdown_cells(spark, sf):
    """The tables read back into cells, a header renamed."""
    return tb.markdown_rows(markdown_tables(spark, sf), "series_id", "text", {"date": "data_date"})


def _stores(spark, sf):
    """Per year a column store: months first, then one column per priority (its monthly totals)."""
    p = orders_panel(spark, sf).select("series_id", F.year("d").alias("y"), F.month("d").alias("m"), "value")
    monthly = p.groupBy("y", "series_id", "m").agg(F.sum("value").alias("v"))
    cells = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("m", c.alias("t")))), lambda x: x["t"])
    col = monthly.groupBy("y", "series_id").agg(cells(F.col("v").cast("bigint").cast("string")).alias("data"))
    n = F.substring("series_id", 1, 1).cast("int")
    cols = col.select("y", F.struct(n.alias("id"), F.col("series_id").alias("value"), F.when(n > 2, F.lower("series_id")).otherwise("").alias("indexName"), F.when(n == 3, " USD ").alias("unit"), "data").alias("c"))
    months = monthly.groupBy("y").agg(F.transform(F.array_sort(F.collect_set("m")), lambda x: x.cast("string")).alias("data"))
    head = months.select("y", F.struct(F.lit(0).alias("id"), F.lit("month").alias("value"), F.lit("").alias("indexName"), F.lit(None).cast("string").alias("unit"), "data").alias("c"))
    return cols.unionByName(head).groupBy("y").agg(F.collect_list("c").alias("columns"))


def column_store_rows(spark, sf):
    return tb.column_store_rows(_stores(spark, sf), "y", "date")


def _points(spark, sf):
    """Chart per priority: history up to 1999, forecasts (here the rounded level) from mid-1999."""
    p = orders_panel(spark, sf)
    return p.select(F.col("series_id").alias("chart_id"), "d", F.when(F.col("d") < "2000-01-01", F.col("value")).alias("his"), F.when((F.col("d") > "1999-06-30") & (F.dayofmonth("d") != 1), F.round("value", -3)).alias("ai"))


def history_or_forecast(spark, sf):
    return tb.history_or_forecast(_points(spark, sf))


def chart_rows(spark, sf):
    """Each point beside the regional series of its day: history to mid-2000, forecasts in June and July 2000 and later."""
    o = table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    e = o.groupBy(F.col("o_orderpriority").alias("chart_id"), day.alias("d"), F.col("o_orderstatus").alias("item")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    extra = e.select("chart_id", "d", "item", F.when(F.col("d") < "2000-08-01", F.col("n")).alias("his"), F.when(F.col("d") > "2000-05-31", F.col("n") * 10).alias("ai"))
    return tb.chart_rows(_points(spark, sf), extra)


def _scenarios(spark, sf):
    p = supplier_panel(spark, sf).withColumn("scenario_id", F.year("d"))
    return p.select("scenario_id", "series_id", "d", "value")


def scenario_cells(spark, sf):
    """Nested scenario maps of both orientations flattened."""
    by_factor = tb.scenario_maps(_scenarios(spark, sf).filter(F.col("scenario_id") < 1998), False)
    by_date = tb.scenario_maps(_scenarios(spark, sf).filter(F.col("scenario_id") >= 1998), True)
    return tb.scenario_panel(by_factor.unionByName(by_date))


def salvaged_json(spark, sf):
    """Event properties with text behind them, strings with brackets in them, and broken ones."""
    e = table(spark, sf, "events")
    text = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("  "), "props", F.lit(" and then } some [more")))
        .when(F.col("event_type") == "view", F.concat(F.lit('[{"a": "}]\\" ", "b": '), "props", F.lit("}] tail")))
        .when(F.col("event_type") == "error", F.concat(F.lit("{"), "props"))
        .otherwise(F.col("props"))
    )
    return e.select("event_id", tx.salvage_json(text).alias("json"))


def clean_texts(spark, sf):
    """Tool answers stripped, capped and freed of control characters; the same as log lines."""
    d = table(spark, sf, "documents")
    noisy = F.concat(F.lit(" \t"), F.col("text"), F.lit("\u0007\u001b[0m"))
    return d.select("doc_id", F.md5(tx.sanitize(noisy, 500)).alias("answer"), tx.escape_for_log(noisy, 100).alias("log_line"))


QUERIES = {
    "markdown_tables": markdown_tables,
    "markdown_cells": markdown_cells,
    "column_store_rows": column_store_rows,
    "history_or_forecast": history_or_forecast,
    "chart_rows": chart_rows,
    "scenario_cells": scenario_cells,
    "salvaged_json": salvaged_json,
    "clean_texts": clean_texts,
}
_MD = with_(SUP) + """, md AS (SELECT series_id, d, CAST(d AS VARCHAR) AS c1, CASE WHEN value > 5 THEN printf('%.2f', value) ELSE '-' END AS c2, CASE WHEN value > 40 THEN 'peak' ELSE '-' END AS c3 FROM sup)
"""
_PT = with_(ORD) + """, pt AS (SELECT series_id AS chart_id, d, CASE WHEN d < DATE '2000-01-01' THEN value END AS his, CASE WHEN d > DATE '1999-06-30' AND day(d) <> 1 THEN round(value, -3) END AS ai FROM ord)
"""
ORACLES = {
    "markdown_tables": _MD + """SELECT series_id, '|date|quantity|kind|' || chr(10) || '|-|-|-|' || chr(10) || string_agg('|' || c1 || '|' || c2 || '|' || c3 || '|', chr(10) ORDER BY d) AS text FROM md GROUP BY 1""",
    "markdown_cells": _MD + """, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS INTEGER) AS row_no FROM md)
SELECT series_id, 0 AS table_no, row_no, 'data_date' AS field, c1 AS value FROM n UNION ALL SELECT series_id, 0, row_no, 'quantity', c2 FROM n UNION ALL SELECT series_id, 0, row_no, 'kind', c3 FROM n""",
    "column_store_rows": with_(ORD) + """, mt AS (SELECT CAST(year(d) AS INTEGER) AS y, series_id, month(d) AS m, CAST(CAST(sum(value) AS BIGINT) AS VARCHAR) AS v FROM ord GROUP BY 1, 2, 3),
hd AS (SELECT y, m, CAST(row_number() OVER (PARTITION BY y ORDER BY m) - 1 AS INTEGER) AS row_no FROM (SELECT DISTINCT y, m FROM mt)),
cl AS (SELECT y, series_id, v, CAST(row_number() OVER (PARTITION BY y, series_id ORDER BY m) - 1 AS INTEGER) AS row_no FROM mt), cs AS (SELECT DISTINCT y, series_id FROM mt)
SELECT y, row_no, 0 AS position, 'date' AS header, CAST(m AS VARCHAR) AS cell FROM hd
UNION ALL SELECT hd.y, hd.row_no, CAST(left(cs.series_id, 1) AS INTEGER), CASE WHEN left(cs.series_id, 1) = '3' THEN lower(cs.series_id) || ' (USD)' WHEN left(cs.series_id, 1) > '2' THEN lower(cs.series_id) ELSE cs.series_id END, coalesce(cl.v, '-')
FROM hd JOIN cs USING (y) LEFT JOIN cl ON cl.y = hd.y AND cl.series_id = cs.series_id AND cl.row_no = hd.row_no""",
    "history_or_forecast": _PT + "SELECT *, coalesce(his, ai) AS value, CASE WHEN his IS NOT NULL THEN 'actual' ELSE 'forecast' END AS kind FROM pt WHERE his IS NOT NULL OR ai IS NOT NULL",
    "chart_rows": _PT + """, e AS (SELECT o_orderpriority AS chart_id, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS item, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2, 3),
x AS (SELECT chart_id, d, item, CASE WHEN d < DATE '2000-08-01' THEN n END AS h, CASE WHEN d > DATE '2000-05-31' THEN n * 10 END AS a FROM e)
SELECT chart_id, d, item, CASE WHEN his IS NOT NULL THEN h WHEN ai IS NOT NULL THEN coalesce(a, h) END AS item_value, coalesce(his, ai) AS difference, CASE WHEN his IS NOT NULL THEN 'history' WHEN ai IS NOT NULL THEN 'forecast' ELSE '-' END AS kind FROM pt LEFT JOIN x USING (chart_id, d)""",
    "scenario_cells": with_(SUP) + "SELECT CAST(year(d) AS INTEGER) AS scenario_id, series_id, d, value FROM sup",
    "salvaged_json": """SELECT event_id, CASE event_type WHEN 'view' THEN '[{"a": "}]\\" ", "b": ' || props || '}]' WHEN 'error' THEN '{' || props ELSE props END AS json FROM events""",
    "clean_texts": r"""WITH t AS (SELECT doc_id, ' ' || chr(9) || text || chr(7) || chr(27) || '[0m' AS raw FROM documents), s AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS bare,
  regexp_replace(replace(replace(replace(replace(replace(raw, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), chr(27), '\x1b'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS line FROM t)
SELECT doc_id, md5(regexp_replace(CASE WHEN length(bare) > 500 THEN regexp_replace(left(bare, 500), '\s+$', '') || '...' ELSE bare END, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g')) AS answer,
  CASE WHEN length(line) > 100 THEN left(line, 97) || '...' ELSE line END AS log_line FROM s""",
}
