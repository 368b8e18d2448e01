"""Panels the registered queries share, in Spark and in SQL.

``orders_panel``: daily order value per priority (few series, whole dollars).
``supplier_panel``: daily quantity per supplier (the number of series grows with the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import align_asof, to_panel
from ..sources.tables import table

# calendars from the first to the last day of the tables, or beyond
ORDERS_LO, ORDERS_HI = "1995-01-01", "2001-08-01"
SUPPLY_LO, SUPPLY_HI = "1995-01-01", "2001-11-30"


def orders_panel(spark: SparkSession, sf: str) -> DataFrame:
    return to_panel(
        table(spark, sf, "orders"), F.col("o_orderpriority"), F.to_date("o_orderdate"), F.floor(F.round(F.sum("o_totalprice"), 2))
    )


def orders_daily(spark: SparkSession, sf: str) -> DataFrame:
    return align_asof(orders_panel(spark, sf), ORDERS_LO, ORDERS_HI)


def supplier_panel(spark: SparkSession, sf: str) -> DataFrame:
    return to_panel(
        table(spark, sf, "lineitem"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.to_date("l_shipdate"), F.sum("l_quantity")
    )


def supplier_daily(spark: SparkSession, sf: str) -> DataFrame:
    return align_asof(supplier_panel(spark, sf), SUPPLY_LO, SUPPLY_HI)


def rounded(df: DataFrame, digits: int = 4, keep=()) -> DataFrame:
    """Doubles rounded for comparison; other columns, and those to keep, as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


ORD = """ord AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS d,
  CAST(floor(round(sum(o_totalprice), 2)) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)"""
SUP = """sup AS (SELECT 'S' || l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS d,
  CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)"""


def _daily(name: str, source: str, lo: str, hi: str) -> str:
    return f"""{name}_grid AS (SELECT series_id, CAST(unnest(generate_series(DATE '{lo}', DATE '{hi}', INTERVAL 1 DAY)) AS DATE) AS d
  FROM (SELECT DISTINCT series_id FROM {source})),
{name} AS (SELECT g.series_id, g.d, p.value FROM {name}_grid g ASOF LEFT JOIN {source} p ON g.series_id = p.series_id AND g.d >= p.d)"""


ORDD = ORD + ",\n" + _daily("ordd", "ord", ORDERS_LO, ORDERS_HI)
SUPD = SUP + ",\n" + _daily("supd", "sup", SUPPLY_LO, SUPPLY_HI)
W = "(PARTITION BY series_id ORDER BY d)"


def frame(width: int) -> str:
    return f"(PARTITION BY series_id ORDER BY d ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


def mean_sql(width: int, need: int | None = None, value: str = "value") -> str:
    need = max(1, width // 2) if need is None else need
    return f"CASE WHEN count({value}) OVER {frame(width)} >= {need} THEN avg({value}) OVER {frame(width)} END"


def std_sql(width: int, need: int | None = None, value: str = "value") -> str:
    need = max(1, width // 2) if need is None else need
    return f"CASE WHEN count({value}) OVER {frame(width)} >= {need} THEN stddev_samp({value}) OVER {frame(width)} END"


def ratio_sql(num: str, den: str, eps: str = "1e-10") -> str:
    return f"CASE WHEN abs({den}) > {eps} THEN ({num}) / ({den}) END"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
