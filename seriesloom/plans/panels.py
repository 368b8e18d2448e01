"""Sources, alignment and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guarded import clean_number, tolerant_date
from ..operators import align, profile, resample, rolling
from ..session import scratch_path
from ..sources import panel_csv, records
from ..sources.tables import table
from .base import ORD, ORDD, ORDERS_HI, ORDERS_LO, SUP, SUPD, SUPPLY_HI, SUPPLY_LO, frame, mean_sql, orders_daily, orders_panel, rounded, supplier_daily, supplier_panel, with_, W

PERIODS = [("1995", "1995-01-01", "1995-12-31"), ("1996-1998", "1996-01-01", "1998-12-31"), ("1998-2001", "1998-01-01", "2001-12-31"), ("2000", "2000-01-01", "2000-12-31")]
# stand-in for a table of movable holidays
HOLIDAYS = [f"{y}-02-{d:02d}" for y, d in ((1995, 1), (1996, 19), (1997, 7), (1998, 28), (1999, 16), (2000, 5), (2001, 24))]


def weekly_smoothed(spark: SparkSession, sf: str, panel=orders_daily) -> DataFrame:
    """Flagship: raw orders to a daily as-of panel, lags and a moving average, weekly sample."""
    daily = rolling.lag_features(panel(spark, sf), (1, 7)).withColumn("ma7", rolling.rolling_mean("value", 7, 3))
    return rounded(resample.weekly_sample(daily))


def weekly_smoothed_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return weekly_smoothed(spark, sf, supplier_daily)


def _weekly_sql(cte: str, name: str) -> str:
    return with_(cte) + f""", f AS (SELECT *, lag(value, 1) OVER {W} AS lag_1, lag(value, 7) OVER {W} AS lag_7, {mean_sql(7, 3)} AS ma7 FROM {name}),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, isoyear(d), week(d) ORDER BY (isodow(d) = 5) DESC, d DESC) AS r FROM f)
SELECT series_id, d, round(value, 4) AS value, round(lag_1, 4) AS lag_1, round(lag_7, 4) AS lag_7, round(ma7, 4) AS ma7 FROM r WHERE r = 1"""


def asof_alignment(spark, sf):
    return supplier_daily(spark, sf)


def exact_alignment(spark, sf):
    return align.align_exact(orders_panel(spark, sf), ORDERS_LO, ORDERS_HI)


def spine_cells(spark, sf):
    return align.spine(supplier_panel(spark, sf).select("series_id").distinct(), SUPPLY_LO, SUPPLY_HI).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("d").alias("lo"), F.max("d").alias("hi")
    )


def same_day_last(spark, sf):
    """Several orders of a priority on one day: the one with the largest key stays."""
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("value"), "o_orderkey")
    return align.last_per_day(rows, "o_orderkey")


def panel_csv_roundtrip(spark, sf):
    """Panel to dual-header CSV and back."""
    names = {r.series_id: "priority " + r.series_id for r in orders_panel(spark, sf).select("series_id").distinct().collect()}
    path = scratch_path(spark, "panel-csv")
    panel_csv.write_panel_csv(orders_panel(spark, sf), dict(sorted(names.items())), path)
    catalog, panel = panel_csv.read_panel_csv(spark, path, "orders")
    return align.enrich(panel.filter(F.col("value").isNotNull()), catalog)


def mixed_frequency_sources(spark, sf):
    """A daily, a monthly and a yearly table that share series: each comes whole from the first."""
    orders, lines = orders_panel(spark, sf), supplier_panel(spark, sf)

    def catalog_of(p: DataFrame, source: str) -> DataFrame:
        return p.select("series_id").distinct().withColumns({"series_name": F.concat(F.lit(source + " "), F.col("series_id")), "source": F.lit(source)})

    monthly = lines.groupBy("series_id", F.last_day("d").alias("d")).agg(F.sum("value").alias("value"))
    yearly = orders.unionByName(lines).groupBy("series_id", F.make_date(F.year("d"), F.lit(12), F.lit(31)).alias("d")).agg(F.sum("value").alias("value"))
    catalog, panel = align.first_source_wins([(catalog_of(orders, "daily"), orders), (catalog_of(monthly, "monthly"), monthly), (catalog_of(yearly, "yearly"), yearly)])
    return align.enrich(panel, catalog.select("series_id", "series_name", "source"))


def tolerant_dates(spark, sf):
    """Dates in four spellings, one of them unusable."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderstatus")
    text = F.when(k == "F", F.date_format(d, "yyyy/MM/dd")).when(k == "O", F.concat(d.cast("string"), F.lit(" 00:00:00"))).otherwise(F.concat(F.lit("n/a "), d.cast("string")))
    parsed = table(spark, sf, "orders").select("o_orderstatus", tolerant_date(text).alias("d")).filter(F.col("d").isNotNull())
    return parsed.groupBy("o_orderstatus", "d").agg(F.count(F.lit(1)).alias("n"))


def coerced_numbers(spark, sf):
    """Cells such as '12.5', 'nan', '' and text: what is no number is missing."""
    e = table(spark, sf, "events")
    cell = F.when(F.col("event_type") == "error", "nan").when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", F.concat(F.col("value").cast("string"), F.lit(" ?"))).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return e.select("event_type", clean_number(cell).alias("v")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), F.round(F.sum("v"), 2).alias("total")
    )


def holiday_windows(spark, sf):
    days = orders_panel(spark, sf).groupBy("d").agg(F.sum("value").alias("value"))
    holidays = spark.createDataFrame([(h,) for h in HOLIDAYS], "h string").select(F.to_date("h").alias("holiday"))
    return align.holiday_flags(days, holidays, align.HOLIDAY_WINDOWS)


def _periods(spark):
    return spark.createDataFrame(PERIODS, "period string, lo string, hi string").select("period", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))


def _sparse_grid(spark, sf):
    """The supplier panel on its spine without filling: real gaps."""
    p = supplier_panel(spark, sf)
    return align.spine(p.select("series_id").distinct(), SUPPLY_LO, SUPPLY_HI).join(p, ["series_id", "d"], "left")


def period_fill_rates(spark, sf):
    whole = profile.period_completeness(_sparse_grid(spark, sf), _periods(spark)).withColumn("scope", F.lit("all"))
    targets = table(spark, sf, "supplier").filter(F.col("s_acctbal") > 0).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("series_id"))
    some = profile.period_completeness(_sparse_grid(spark, sf), _periods(spark), targets).withColumn("scope", F.lit("targets"))
    return rounded(whole.unionByName(some), 6)


def series_profiles(spark, sf):
    return rounded(profile.series_profile(_sparse_grid(spark, sf)))


def well_observed_series(spark, sf):
    return profile.enough_observations(supplier_panel(spark, sf), 500).groupBy("series_id").agg(F.count("value").alias("n"))


def series_start_years(spark, sf):
    return profile.start_years(supplier_panel(spark, sf), "1995-01-10")


def source_ranges(spark, sf):
    """Status groups of orders as source files, rows in order of the key."""
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("source"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("pos"))
    return profile.source_range(rows)


def series_quartiles(spark, sf):
    return rounded(profile.quantile_table(supplier_panel(spark, sf), [0.01, 0.25, 0.5, 0.75, 0.99]))


def series_ranges(spark, sf):
    return profile.value_ranges(supplier_panel(spark, sf))


def weekly_compression(spark, sf):
    daily = supplier_daily(spark, sf)
    return rounded(profile.compression(daily, resample.weekly_days(daily)), 6)


def supplier_enrichment(spark, sf):
    """Panel totals with catalog and mapping columns attached."""
    catalog = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("series_id"), "s_name", "s_nationkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    totals = supplier_panel(spark, sf).groupBy("series_id").agg(F.sum("value").alias("total"))
    return align.enrich(totals, catalog).join(nations, "s_nationkey").drop("s_nationkey")


def targets_left_to_do(spark, sf):
    """Parts as targets, those with a finished record (here: with large lines) left out."""
    targets = table(spark, sf, "part").select(F.col("p_partkey").alias("target_id"), F.col("p_name").alias("target_name"))
    done = table(spark, sf, "lineitem").filter(F.col("l_quantity") >= 45).select(F.col("l_partkey").alias("target_id"))
    return records.not_done(targets, done)


def append_untested(spark, sf):
    """Results keyed by (version, series): fresh ones are added only where the key is new."""
    base = supplier_panel(spark, sf).groupBy(F.year("d").cast("string").alias("version"), "series_id").agg(F.max("value").alias("stat"))
    existing = base.filter(F.col("version") < "1999").withColumn("origin", F.lit("old"))
    fresh = base.filter(F.col("version") > "1996").withColumn("origin", F.lit("new"))
    return records.append_missing(existing, fresh, ["version", "series_id"])


def upsert_latest(spark, sf):
    """Newest row per key over an existing and an incoming table."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    bought = F.coalesce(F.col("event_type") == "purchase", F.lit(False))
    purchases, rest = rows.filter(bought), rows.filter(~bought)
    return records.upsert_latest(purchases, rest, "user_id", "event_id")


def run_record_scan(spark, sf):
    """Records written as JSON files, one per nation, and read back with a fixed schema."""
    s = table(spark, sf, "supplier")
    rec = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("target_id"), F.col("s_name").alias("target_name"), F.col("s_nationkey").cast("string").alias("grp"),
        F.lit(None).cast("timestamp").alias("trained_at"), F.lit(50).alias("trials"), F.abs("s_acctbal").alias("seconds"), F.lit(470).cast("long").alias("train_rows"), F.lit(10).alias("n_features"),
        (F.abs("s_acctbal") / 20000).alias("val_mda"), (F.abs("s_acctbal") / 15000).alias("test_mda"), F.lit(0.1).alias("test_mape"), F.lit(1.0).alias("test_rmse"),
        F.create_map(F.lit("max_depth"), F.lit(5.0), F.lit("step_size"), F.abs("s_acctbal") / 100000).alias("params"),
    )
    path = scratch_path(spark, "records")
    records.write_records(rec, path)
    back = records.read_records(spark, path)
    return back.select("target_id", "target_name", "grp", "trials", "train_rows", F.round("val_mda", 6).alias("val_mda"), F.round("test_mda", 6).alias("test_mda"), F.round(F.try_element_at("params", F.lit("step_size")), 6).alias("step_size"))


def outputs_by_target(spark, sf):
    """One folder per target and split, read back through the partition columns."""
    from ..operators.split import train_test

    rows = train_test(orders_panel(spark, sf).withColumnRenamed("series_id", "target_id"), "1999-12-31")
    path = scratch_path(spark, "targets")
    records.write_by_target(rows, path)
    return spark.read.parquet(path).groupBy("target_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("value").alias("total"))


GRID = with_(SUPD) + ", grid AS (SELECT g.series_id, g.d, p.value FROM supd_grid g LEFT JOIN sup p USING (series_id, d))\n"
_period_values = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS)
_holidays = ", ".join(f"(DATE '{h}')" for h in HOLIDAYS)

QUERIES = {
    "weekly_smoothed": weekly_smoothed,
    "weekly_smoothed_suppliers": weekly_smoothed_suppliers,
    "asof_alignment": asof_alignment,
    "exact_alignment": exact_alignment,
    "spine_cells": spine_cells,
    "same_day_last": same_day_last,
    "panel_csv_roundtrip": panel_csv_roundtrip,
    "mixed_frequency_sources": mixed_frequency_sources,
    "tolerant_dates": tolerant_dates,
    "coerced_numbers": coerced_numbers,
    "holiday_windows": holiday_windows,
    "period_fill_rates": period_fill_rates,
    "series_profiles": series_profiles,
    "well_observed_series": well_observed_series,
    "series_start_years": series_start_years,
    "source_ranges": source_ranges,
    "series_quartiles": series_quartiles,
    "series_ranges": series_ranges,
    "weekly_compression": weekly_compression,
    "supplier_enrichment": supplier_enrichment,
    "targets_left_to_do": targets_left_to_do,
    "append_untested": append_untested,
    "upsert_latest": upsert_latest,
    "run_record_scan": run_record_scan,
    "outputs_by_target": outputs_by_target,
}

ORACLES = {
    "weekly_smoothed": _weekly_sql(ORDD, "ordd"),
    "weekly_smoothed_suppliers": _weekly_sql(SUPD, "supd"),
    "asof_alignment": with_(SUPD) + "SELECT series_id, d, value FROM supd",
    "exact_alignment": with_(ORDD) + f""", j AS (SELECT g.series_id, g.d, p.value FROM ordd_grid g LEFT JOIN ord p USING (series_id, d))
SELECT series_id, d, last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM j""",
    "spine_cells": with_(SUPD) + "SELECT series_id, count(*) AS n_days, min(d) AS lo, max(d) AS hi FROM supd_grid GROUP BY 1",
    "same_day_last": "SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS d, max_by(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2",
    "panel_csv_roundtrip": with_(ORD) + """SELECT series_id, d, value, 'priority ' || series_id AS series_name, 'orders' AS source,
  CAST(dense_rank() OVER (ORDER BY series_id) AS INTEGER) AS ordinal FROM ord""",
    "mixed_frequency_sources": with_(ORD, SUP) + """SELECT series_id, d, value, 'daily ' || series_id AS series_name, 'daily' AS source FROM ord
UNION ALL SELECT series_id, last_day(d), sum(value), 'monthly ' || series_id, 'monthly' FROM sup GROUP BY 1, 2""",
    "tolerant_dates": "SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2",
    "coerced_numbers": """SELECT event_type, count(*) AS n, count(*) FILTER (event_type IN ('purchase', 'signup')) AS n_valid,
  round(sum(value) FILTER (event_type IN ('purchase', 'signup')), 2) AS total FROM events GROUP BY 1""",
    "holiday_windows": with_(ORD) + f""", days AS (SELECT d, sum(value) AS value FROM ord GROUP BY 1), h(h) AS (VALUES {_holidays})
SELECT d, value, CAST(EXISTS (SELECT 1 FROM h WHERE d >= h - 15 AND d < h) AS INTEGER) AS before_15d,
  CAST(EXISTS (SELECT 1 FROM h WHERE d >= h AND d < h + 7) AS INTEGER) AS during,
  CAST(EXISTS (SELECT 1 FROM h WHERE d >= h + 7 AND d <= h + 22) AS INTEGER) AS after_15d FROM days""",
    "period_fill_rates": GRID + f""", p(period, lo, hi) AS (VALUES {_period_values}),
t AS (SELECT 'S' || s_suppkey AS series_id FROM supplier WHERE s_acctbal > 0),
g AS (SELECT 'all' AS scope, * FROM grid UNION ALL SELECT 'targets', * FROM grid WHERE series_id IN (SELECT series_id FROM t))
SELECT scope, period, count(DISTINCT d) AS days, count(*) AS total_cells, count(value) AS valid_cells, round(count(value) / count(*), 6) AS completeness
FROM g JOIN p ON d BETWEEN lo AND hi GROUP BY 1, 2""",
    "series_profiles": GRID + """SELECT series_id, count(value) AS valid_count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
  min(value) AS min, max(value) AS max, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 4) AS missing_rate FROM grid GROUP BY 1""",
    "well_observed_series": with_(SUP) + "SELECT series_id, count(value) AS n FROM sup GROUP BY 1 HAVING count(value) > 500",
    "series_start_years": with_(SUP) + """, f AS (SELECT series_id, min(d) AS d FROM sup GROUP BY 1)
SELECT CAST(year(d) AS INTEGER) AS start_year, count(*) AS n_series, count(*) FILTER (d <= DATE '1995-01-10') AS live_at_reference FROM f GROUP BY 1""",
    "source_ranges": """WITH o AS (SELECT o_orderstatus AS source, CAST(o_orderdate AS DATE) AS d, o_orderkey AS pos,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS z FROM orders)
SELECT source, count(*) AS n_rows, min(d) AS min_date, max(d) AS max_date, arg_min(d, pos) > arg_max(d, pos) AS descending,
  string_agg(CAST(d AS VARCHAR), ',' ORDER BY pos) FILTER (a <= 3) AS first_dates, string_agg(CAST(d AS VARCHAR), ',' ORDER BY pos) FILTER (z <= 3) AS last_dates FROM o GROUP BY 1""",
    "series_quartiles": with_(SUP) + "SELECT series_id, " + ", ".join(f"round(quantile_cont(value, {q}), 4) AS q{round(q * 100)}" for q in (0.01, 0.25, 0.5, 0.75, 0.99)) + " FROM sup GROUP BY 1",
    "series_ranges": with_(SUP) + "SELECT series_id, min(value) AS min, max(value) AS max FROM sup GROUP BY 1",
    "weekly_compression": with_(SUPD) + """, w AS (SELECT series_id, max(struct_pack(f := isodow(d) = 5, d := d)).d AS d FROM supd GROUP BY series_id, isoyear(d), week(d))
SELECT (SELECT count(*) FROM supd) AS daily_rows, count(*) AS weekly_rows, min(d) AS weekly_start, max(d) AS weekly_end, round((SELECT count(*) FROM supd) / count(*), 6) AS ratio FROM w""",
    "supplier_enrichment": with_(SUP) + """SELECT series_id, sum(value) AS total, s_name, n_name FROM sup JOIN supplier ON series_id = 'S' || s_suppkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""",
    "targets_left_to_do": "SELECT p_partkey AS target_id, p_name AS target_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)",
    "append_untested": with_(SUP) + """, b AS (SELECT CAST(year(d) AS VARCHAR) AS version, series_id, max(value) AS stat FROM sup GROUP BY 1, 2)
SELECT *, CASE WHEN version < '1999' THEN 'old' ELSE 'new' END AS origin FROM b""",
    "upsert_latest": """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value
FROM events GROUP BY 1""",
    "run_record_scan": """SELECT 'S' || s_suppkey AS target_id, s_name AS target_name, CAST(s_nationkey AS VARCHAR) AS grp, 50 AS trials, 470 AS train_rows,
  round(abs(s_acctbal) / 20000, 6) AS val_mda, round(abs(s_acctbal) / 15000, 6) AS test_mda, round(abs(s_acctbal) / 100000, 6) AS step_size FROM supplier""",
    "outputs_by_target": with_(ORD) + """SELECT series_id AS target_id, CASE WHEN d <= DATE '1999-12-31' THEN 'train' ELSE 'test' END AS split, count(*) AS n, min(d) AS lo, max(d) AS hi, sum(value) AS total
FROM ord WHERE d <= DATE '1999-12-31' OR d >= DATE '1999-12-31' + 98 GROUP BY 1, 2""",
}
