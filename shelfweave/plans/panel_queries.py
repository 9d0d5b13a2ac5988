"""Queries on the panel itself: sources, quality, calendar, splits, exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfweave.functions.calendar import CALENDAR_COLUMNS, with_calendar
from shelfweave.functions.metrics import rounded
from shelfweave.operators import explore, quality, splits
from shelfweave.operators.accuracy import fact_sales
from shelfweave.operators.quantiles import exact_quantiles
from shelfweave.plans.catalog import (
    LABELS_SQL, PANEL_SQL, REPORT_YEAR, TRAIN_END, VAL_END, query,
)
from shelfweave.sources import panel as source
from shelfweave.sources import tables
from shelfweave.sources.panel import load_panel
from shelfweave.session import fresh_path

SPLIT_SQL = f"""CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train'
     WHEN date <= DATE '{VAL_END}' THEN 'validation' WHEN date > DATE '{VAL_END}' THEN 'test' END"""


@query("sales_panel", f"WITH {PANEL_SQL} SELECT date, store, item, sales FROM panel")
def sales_panel(spark, sf_dir):
    return source.derive_panel(spark, sf_dir)


@query("panel_table", f"WITH {PANEL_SQL} SELECT date, store, item, sales FROM panel")
def panel_table(spark, sf_dir):
    """The stored panel the other queries read; the first caller writes it."""
    return load_panel(spark, sf_dir)


@query("typed_csv_roundtrip", f"""WITH {PANEL_SQL}
SELECT date, CAST(store AS BIGINT) AS "Store", CAST(item AS BIGINT) AS "Item", sales AS "Sales",
       {LABELS_SQL} FROM panel""")
def typed_csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "sales-csv")
    tables.write_csv(fact_sales(load_panel(spark, sf_dir)), path)
    return tables.read_report_table(spark, "Sales", path)[0]


@query("typed_csv_rejects", f"""WITH {PANEL_SQL}
SELECT CASE WHEN isodow(date) = 7 THEN 'rejected' ELSE 'read' END AS outcome, COUNT(*) AS n FROM panel GROUP BY 1""")
def typed_csv_rejects(spark, sf_dir):
    """A file whose Sunday lines break the declared types: lines read, and lines set aside."""
    path = fresh_path(spark, "broken-csv")
    facts = fact_sales(load_panel(spark, sf_dir))
    tables.write_csv(facts.withColumn("Sales", F.when(F.weekday("date") == 6, "?").otherwise(F.col("Sales").cast("string"))), path)
    rows, rejects = tables.read_report_table(spark, "Sales", path)
    return rows.select(F.lit("read").alias("outcome")).unionByName(
        rejects.select(F.lit("rejected").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("write_splits", f"""WITH {PANEL_SQL}
SELECT {SPLIT_SQL} AS split, COUNT(*) AS n_rows, CAST(SUM(sales) AS BIGINT) AS units
FROM panel GROUP BY 1""")
def write_splits(spark, sf_dir):
    path = fresh_path(spark, "splits")
    source.write_splits(load_panel(spark, sf_dir), path, TRAIN_END, VAL_END)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("sales").alias("units")
    )


@query("series_history", f"""WITH {PANEL_SQL}
SELECT date, store, item, sales FROM panel WHERE store = 2 AND item = 15""")
def series_history(spark, sf_dir):
    return source.series_history(source.load_panel_by_store(spark, sf_dir), 2, 15)


@query("dim_tables", f"""WITH {PANEL_SQL}
SELECT 'Store' AS dim, CAST(store AS BIGINT) AS id FROM panel GROUP BY store
UNION ALL SELECT 'Item', CAST(item AS BIGINT) FROM panel GROUP BY item""")
def dim_tables(spark, sf_dir):
    panel = load_panel(spark, sf_dir)
    stores = source.dimension(panel, "store").select(F.lit("Store").alias("dim"), F.col("Store").alias("id"))
    items = source.dimension(panel, "item").select(F.lit("Item").alias("dim"), F.col("Item").alias("id"))
    return stores.unionByName(items)


@query("fact_sales", f"""WITH {PANEL_SQL}
SELECT date, CAST(store AS BIGINT) AS "Store", CAST(item AS BIGINT) AS "Item", sales AS "Sales",
       {LABELS_SQL} FROM panel""")
def fact_sales_query(spark, sf_dir):
    return fact_sales(load_panel(spark, sf_dir))


@query("panel_profile", f"""WITH {PANEL_SQL},
p AS (SELECT COUNT(*) AS n_rows, CAST(4 AS BIGINT) AS n_columns, MIN(date) AS first_date,
    MAX(date) AS last_date, COUNT(DISTINCT store) AS n_stores, COUNT(DISTINCT item) AS n_items,
    COUNT(DISTINCT date) AS n_dates, COUNT(DISTINCT store * 100000 + item) AS n_series,
    CAST(SUM((date IS NULL)::INT + (store IS NULL)::INT + (item IS NULL)::INT
             + (sales IS NULL)::INT) AS BIGINT) AS missing_cells,
    COUNT(*) - COUNT(DISTINCT (date, store, item)) AS duplicate_keys FROM panel)
SELECT *, n_stores * n_items * n_dates AS expected_rows,
       n_stores * n_items * n_dates - n_rows AS absent_rows FROM p""")
def panel_profile(spark, sf_dir):
    return quality.panel_profile(load_panel(spark, sf_dir))


@query("absent_ranges", f"""WITH {PANEL_SQL},
days AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS at FROM (SELECT DISTINCT date FROM panel)),
gone AS (SELECT s.store, s.item, d.date, d.at - ROW_NUMBER() OVER (PARTITION BY s.store, s.item ORDER BY d.at) AS run
         FROM (SELECT DISTINCT store, item FROM panel) s CROSS JOIN days d
         ANTI JOIN panel p ON p.store = s.store AND p.item = s.item AND p.date = d.date)
SELECT store, item, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS n_days FROM gone GROUP BY store, item, run""")
def absent_ranges(spark, sf_dir):
    return quality.absent_ranges(load_panel(spark, sf_dir))


@query("target_describe", f"""WITH {PANEL_SQL}
SELECT COUNT(sales) AS count, ROUND(AVG(sales), 2) AS mean, ROUND(STDDEV_SAMP(sales), 2) AS std,
       CAST(MIN(sales) AS DOUBLE) AS min, ROUND(quantile_cont(sales, 0.25), 2) AS q25,
       ROUND(quantile_cont(sales, 0.5), 2) AS q50, ROUND(quantile_cont(sales, 0.75), 2) AS q75,
       CAST(MAX(sales) AS DOUBLE) AS max FROM panel""")
def target_describe(spark, sf_dir):
    return quality.describe_target(load_panel(spark, sf_dir))


@query("exact_quantiles", """WITH v AS (
  SELECT 'l_extendedprice' AS name, l_extendedprice AS x FROM lineitem
  UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem),
p AS (SELECT UNNEST([0.01, 0.5, 0.99]::DOUBLE[]) AS prob)
SELECT name, prob, ROUND(CASE WHEN prob < 0.4 THEN quantile_cont(x, 0.01)
       WHEN prob < 0.9 THEN quantile_cont(x, 0.5) ELSE quantile_cont(x, 0.99) END, 6) AS quantile
FROM v CROSS JOIN p GROUP BY name, prob""")
def exact_quantiles_query(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(exact_quantiles(lines, ["l_extendedprice", "l_quantity"], [0.01, 0.5, 0.99]))


@query("split_summary", f"""WITH {PANEL_SQL}
SELECT {SPLIT_SQL} AS split, COUNT(*) AS n_rows, MIN(date) AS first_date, MAX(date) AS last_date,
       ROUND(AVG(sales), 6) AS mean_sales FROM panel GROUP BY 1""")
def split_summary(spark, sf_dir):
    return rounded(splits.split_summary(load_panel(spark, sf_dir), TRAIN_END, VAL_END))


@query("chrono_split", f"""WITH {PANEL_SQL}
SELECT date, store, item, sales, {SPLIT_SQL} AS split FROM panel""")
def chrono_split(spark, sf_dir):
    return splits.with_split(load_panel(spark, sf_dir), TRAIN_END, VAL_END)


@query("calendar_features", f"""WITH {PANEL_SQL}
SELECT date, store, item, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) - 1 AS INTEGER) AS dayofweek,
  CAST(dayofyear(date) AS INTEGER) AS dayofyear, CAST(week(date) AS INTEGER) AS weekofyear,
  CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, CAST(day(date) = 1 AS INTEGER) AS is_month_start,
  CAST(date = last_day(date) AS INTEGER) AS is_month_end,
  ROUND(SIN(2 * PI() * month(date) / 12), 6) + 0.0 AS month_sin,
  ROUND(COS(2 * PI() * month(date) / 12), 6) + 0.0 AS month_cos,
  ROUND(SIN(2 * PI() * (isodow(date) - 1) / 7), 6) + 0.0 AS dow_sin,
  ROUND(COS(2 * PI() * (isodow(date) - 1) / 7), 6) + 0.0 AS dow_cos,
  ROUND(SIN(2 * PI() * dayofyear(date) / 365.25), 6) + 0.0 AS doy_sin,
  ROUND(COS(2 * PI() * dayofyear(date) / 365.25), 6) + 0.0 AS doy_cos
FROM panel""")
def calendar_features(spark, sf_dir):
    featured = with_calendar(load_panel(spark, sf_dir)).select("date", "store", "item", *CALENDAR_COLUMNS)
    # adding 0.0 turns the negative zero a rounded sine may leave into zero
    return rounded(featured).withColumns({
        c: F.col(c) + F.lit(0.0) for c in CALENDAR_COLUMNS if c.endswith(("_sin", "_cos"))
    })


FOLDS_SQL = f"""{PANEL_SQL},
train AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date, store, item) - 1 AS pos FROM panel
          WHERE date <= DATE '{TRAIN_END}'),
n AS (SELECT COUNT(*) AS n, COUNT(*) // 4 AS size FROM train),
folds AS (SELECT j AS fold, n - (3 - j) * size AS start_pos, n - (3 - j) * size + size AS end_pos
          FROM n CROSS JOIN range(3) t(j))"""

FOLD_SQL = f"""WITH {FOLDS_SQL},
roles AS (SELECT CAST(fold AS INTEGER) AS fold,
            CASE WHEN pos < start_pos THEN 'train' ELSE 'test' END AS role, t.*
          FROM train t CROSS JOIN folds WHERE pos < end_pos)
SELECT fold, role, COUNT(*) AS n_rows, MIN(date) AS first_date, MAX(date) AS last_date,
       CAST(SUM(sales) AS BIGINT) AS units, CAST(SUM(store * 1000 + item) AS BIGINT) AS key_sum
FROM roles GROUP BY 1, 2"""


@query("time_series_folds", FOLD_SQL)
def time_series_folds(spark, sf_dir):
    train = splits.train_rows(load_panel(spark, sf_dir), TRAIN_END)
    labelled = splits.fold_rows(train, splits.expanding_folds(train, 3))
    return labelled.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.sum("sales").alias("units"),
        F.sum(F.col("store") * 1000 + F.col("item")).alias("key_sum"),
    )


@query("daily_total", f"""WITH {PANEL_SQL}
SELECT date, CAST(SUM(sales) AS BIGINT) AS units FROM panel GROUP BY 1""")
def daily_total(spark, sf_dir):
    return explore.daily_total(load_panel(spark, sf_dir))


@query("daily_history_year", f"""WITH {PANEL_SQL}
SELECT date, CAST(SUM(sales) AS BIGINT) AS units FROM panel
WHERE year(date) = {REPORT_YEAR} GROUP BY 1""")
def daily_history_year(spark, sf_dir):
    return explore.daily_history_of_year(load_panel(spark, sf_dir), REPORT_YEAR)


ROLLING_SQL = """CASE WHEN COUNT({v}) OVER w >= 30 THEN ROUND(AVG({v}) OVER w, 6) END AS rolling_mean"""


@query("rolling_30d", f"""WITH {PANEL_SQL},
d AS (SELECT date, CAST(SUM(sales) AS BIGINT) AS units FROM panel GROUP BY 1)
SELECT date, units, {ROLLING_SQL.format(v='units')} FROM d
WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rolling_30d(spark, sf_dir):
    return rounded(explore.rolling_daily_mean(load_panel(spark, sf_dir)))


@query("rolling_30d_series", f"""WITH {PANEL_SQL}
SELECT date, store, item, sales, {ROLLING_SQL.format(v='sales')} FROM panel
WINDOW w AS (PARTITION BY store, item ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rolling_30d_series(spark, sf_dir):
    return rounded(explore.rolling_series_mean(load_panel(spark, sf_dir)))


YEARLY_SQL = f"""WITH {PANEL_SQL},
y AS (SELECT CAST(year(date) AS INTEGER) AS year, CAST(SUM(sales) AS BIGINT) AS units,
             AVG(sales) AS mean_units FROM panel GROUP BY 1)"""


@query("yearly_total", f"{YEARLY_SQL} SELECT year, units, ROUND(units / 1e6, 2) AS units_millions FROM y")
def yearly_total(spark, sf_dir):
    return explore.yearly_total(load_panel(spark, sf_dir))


@query("yearly_growth", f"""{YEARLY_SQL}
SELECT MIN(year) AS first_year, MAX(year) AS last_year, COUNT(*) AS n_years,
       ROUND(POW(arg_max(units, year) / arg_min(units, year)::DOUBLE, 1.0 / (COUNT(*) - 1)) - 1, 6)
       AS growth FROM y""")
def yearly_growth(spark, sf_dir):
    return rounded(explore.yearly_growth(load_panel(spark, sf_dir)))


@query("yearly_mean", f"{YEARLY_SQL} SELECT year, ROUND(mean_units, 6) AS mean_units FROM y")
def yearly_mean(spark, sf_dir):
    return rounded(explore.yearly_mean(load_panel(spark, sf_dir)))


def _labelled_mean(*columns: str) -> str:
    names = ", ".join(f'"{c}"' for c in columns)
    return f"""WITH {PANEL_SQL}, f AS (SELECT sales, {LABELS_SQL} FROM panel)
SELECT {names}, ROUND(AVG(sales), 6) AS mean_units FROM f GROUP BY ALL"""


@query("monthly_seasonality", _labelled_mean("MonthNum", "Month"))
def monthly_seasonality(spark, sf_dir):
    return rounded(explore.monthly_seasonality(load_panel(spark, sf_dir)))


@query("weekday_seasonality", _labelled_mean("DayNum", "Day"))
def weekday_seasonality(spark, sf_dir):
    return rounded(explore.weekday_seasonality(load_panel(spark, sf_dir)))


@query("weekend_by_month", _labelled_mean("MonthNum", "Month", "IsWeekend"))
def weekend_by_month(spark, sf_dir):
    return rounded(explore.weekend_by_month(load_panel(spark, sf_dir)))


@query("store_ranking", f"""WITH {PANEL_SQL}
SELECT store, CAST(SUM(sales) AS BIGINT) AS units FROM panel GROUP BY 1""")
def store_ranking(spark, sf_dir):
    return explore.ranking(load_panel(spark, sf_dir), "store")


@query("item_ranking", f"""WITH {PANEL_SQL}
SELECT item, CAST(SUM(sales) AS BIGINT) AS units FROM panel GROUP BY 1""")
def item_ranking(spark, sf_dir):
    return explore.ranking(load_panel(spark, sf_dir), "item")


@query("peak_trough_ratios", f"""WITH {PANEL_SQL},
m AS (SELECT 'month' AS view, AVG(sales) AS m FROM panel GROUP BY month(date)
      UNION ALL SELECT 'weekday', AVG(sales) FROM panel GROUP BY isodow(date)
      UNION ALL SELECT 'series', AVG(sales) FROM panel GROUP BY store, item)
SELECT view, ROUND(MIN(m), 6) AS trough, ROUND(MAX(m), 6) AS peak,
       ROUND(MAX(m) / MIN(m), 6) AS ratio FROM m GROUP BY 1""")
def peak_trough_ratios(spark, sf_dir):
    return rounded(explore.peak_trough_ratios(load_panel(spark, sf_dir)))


def _stores(panel) -> list[int]:
    """The columns of a pivot: every store of the dimension."""
    return sorted(r["Store"] for r in source.dimension(panel, "store").collect())


STORES = list(range(1, 11))  # those of the fixture, for the twins
PIVOT_SQL = ", ".join(
    f"ROUND(AVG(sales) FILTER (store = {s}), 6) AS store_{s}" for s in STORES
)


@query("store_month_pivot", f"""WITH {PANEL_SQL}
SELECT CAST(month(date) AS INTEGER) AS month, {PIVOT_SQL} FROM panel GROUP BY 1""")
def store_month_pivot(spark, sf_dir):
    panel = load_panel(spark, sf_dir)
    return rounded(explore.store_month_pivot(panel, _stores(panel)))


@query("store_month_totals", f"""WITH {PANEL_SQL}
SELECT CAST(month(date) AS INTEGER) AS month, CAST(GROUPING(month(date)) AS INTEGER) AS is_total,
       {PIVOT_SQL}, ROUND(AVG(sales), 6) AS all_stores FROM panel GROUP BY ROLLUP (month(date))""")
def store_month_totals(spark, sf_dir):
    panel = load_panel(spark, sf_dir)
    return rounded(explore.store_month_pivot(panel, _stores(panel), totals=True))


def histogram_sql(values: str, bins: int) -> str:
    """Histogram of the CTE ``values`` (column x) with bin edges lo + i * step."""
    return f"""b AS (SELECT MIN(x) AS lo, MAX(x) AS hi, (MAX(x) - MIN(x)) / {bins} AS step FROM {values}),
bins AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * step AS f,
           CASE WHEN i + 1 >= {bins} THEN hi ELSE lo + (i + 1) * step END AS t
         FROM b CROSS JOIN range({bins}) r(i))
SELECT bin, ROUND(f, 6) AS bin_from, ROUND(t, 6) AS bin_to,
       CAST((SELECT COUNT(*) FROM {values} WHERE x >= f AND (x < t OR (bin = {bins - 1} AND x <= t)))
            AS BIGINT) AS n FROM bins"""


@query("series_mean_histogram", f"""WITH {PANEL_SQL},
v AS (SELECT AVG(sales) AS x FROM panel GROUP BY store, item), {histogram_sql('v', 50)}""")
def series_mean_histogram(spark, sf_dir):
    means = explore.series_mean(load_panel(spark, sf_dir))
    return rounded(explore.histogram(means, "mean_units", 50))


@query("recent_history", f"""WITH {PANEL_SQL}
SELECT date, store, item, sales FROM panel
QUALIFY ROW_NUMBER() OVER (PARTITION BY store, item ORDER BY date DESC) <= 365""")
def recent_history(spark, sf_dir):
    return explore.recent_history(load_panel(spark, sf_dir))
