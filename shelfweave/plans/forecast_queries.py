"""Queries on learned means, the baseline forecast, accuracy, reports and requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfweave.functions.metrics import evaluate, rounded
from shelfweave.functions.scoring import clip_at_zero, demand_level, iso_text, round_units
from shelfweave.operators import accuracy, grid, learned, semantic
from shelfweave.operators.ml_stages import CATEGORIES, NUMERIC
from shelfweave.operators.quantiles import exact_quantiles
from shelfweave.operators.semantic import FilterContext
from shelfweave.operators.splits import expanding_folds, test_rows, train_rows, validation_rows
from shelfweave.plans.catalog import (
    LABELS_SQL, PANEL_SQL, PLAN_SQL, REPORT_YEAR, SCORED_SQL, SHORT_TRAIN_END, SMAPE_SQL,
    TRAIN_END, VAL_END, features_sql, learned_sql, query,
)
from shelfweave.plans.panel_queries import FOLDS_SQL, histogram_sql
from shelfweave.session import fresh_path, input_state
from shelfweave.sources import keyed_maps, requests
from shelfweave.sources.panel import load_panel, load_true_panel
from shelfweave.streaming import request_log
from shelfweave.streaming.request_log import running_metrics

MEANS = learned.AGGREGATE_COLUMNS
MEANS_SQL = ", ".join(f"ROUND({m}, 6) AS {m}" for m in MEANS)


# (application, table folder, window) -> state of the order lines, learned means
_LEARNED: dict[tuple[str, str, str], tuple] = {}


def fitted(spark, sf_dir, train_end=TRAIN_END):
    """The panel and the means of its training window, learned once per application and state of the order lines."""
    panel = load_panel(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, train_end)
    state = input_state(spark, f"{sf_dir}/lineitem.parquet")
    if _LEARNED.get(key, (None,))[0] != state:
        _LEARNED[key] = (state, learned.learn_demand(train_rows(panel, train_end)))
    return panel, _LEARNED[key][1]


def scored_test(spark, sf_dir):
    panel, state = fitted(spark, sf_dir)
    return learned.baseline_forecast(test_rows(panel, VAL_END), state)


def scored_plan(spark, sf_dir):
    panel, state = fitted(spark, sf_dir)
    return learned.baseline_forecast(grid.plan_grid(panel), state)


# ---- learned means -------------------------------------------------------------------------

def _register_mean(name: str, table: str, keys: list[str]) -> None:
    out = [f"CAST({'dow' if k == 'dayofweek' else k} AS INTEGER) AS {k}" for k in keys]
    sql = f"WITH {learned_sql()} SELECT {', '.join(out)}, ROUND(m, 6) AS {name} FROM {table}"

    @query(name, sql)
    def build(spark, sf_dir):
        train = train_rows(load_panel(spark, sf_dir), TRAIN_END)
        return rounded(learned.mean_table(train, name))


for _name, _table in zip(MEANS, ("si", "sid", "im", "sm")):
    _register_mean(_name, _table, learned.MEAN_KEYS[_name])


@query("fold_means", f"""WITH {FOLDS_SQL},
x AS (SELECT CAST(fold AS INTEGER) AS fold, t.*, isodow(date) - 1 AS dow, month(date) AS month FROM train t JOIN folds ON pos < start_pos)
SELECT fold, 'store_item_dow_mean' AS name, store, item, CAST(dow AS INTEGER) AS position, ROUND(AVG(sales), 6) AS mean FROM x GROUP BY fold, store, item, dow
UNION ALL SELECT fold, 'store_item_mean', store, item, NULL, ROUND(AVG(sales), 6) FROM x GROUP BY fold, store, item
UNION ALL SELECT fold, 'item_month_mean', NULL, item, CAST(month AS INTEGER), ROUND(AVG(sales), 6) FROM x GROUP BY fold, item, month
UNION ALL SELECT fold, 'store_month_mean', store, NULL, CAST(month AS INTEGER), ROUND(AVG(sales), 6) FROM x GROUP BY fold, store, month""")
def fold_means(spark, sf_dir):
    """All learned means of three folds, from one state of monthly sums and the rows of the months that the folds cut."""
    train = train_rows(load_panel(spark, sf_dir), TRAIN_END)
    state, parts = learned.demand_state(train), []
    for fold in expanding_folds(train, 3):
        known = state.learn_before(train, fold.start)
        for name, (*_, last) in learned.MEAN_KEYS.items():
            means = known.means(spark, name)
            held = {c: F.col(c) if c in means.columns else F.lit(None).cast("int") for c in ("store", "item")}
            position = F.col(last) if last not in held else F.lit(None).cast("int")
            parts.append(means.select(
                F.lit(fold.index).alias("fold"), F.lit(name).alias("name"), *[v.alias(c) for c, v in held.items()],
                position.alias("position"), F.col(name).alias("mean")))
    return rounded(reduce(DataFrame.unionByName, parts))


@query("demand_aggregates", f"""WITH {learned_sql()},
test AS (SELECT * FROM panel WHERE date > DATE '{VAL_END}'), {features_sql('test')}
SELECT date, store, item, sales, {MEANS_SQL} FROM feat""")
def demand_aggregates(spark, sf_dir):
    panel, state = fitted(spark, sf_dir)
    featured = learned.demand_features(test_rows(panel, VAL_END), state)
    return rounded(featured.select("date", "store", "item", "sales", *MEANS))


@query("fallback_cascade", f"""WITH {learned_sql(SHORT_TRAIN_END)},
later AS (SELECT date, store, item FROM panel WHERE date > DATE '{SHORT_TRAIN_END}'
          UNION ALL SELECT date, CAST(store + 90 AS INTEGER), item FROM panel
          UNION ALL SELECT date, store, CAST(item + 900 AS INTEGER) FROM panel
          UNION ALL SELECT date, CAST(store + 90 AS INTEGER), CAST(item + 900 AS INTEGER) FROM panel),
{features_sql('later')}
SELECT date, store, item, {MEANS_SQL} FROM feat""")
def fallback_cascade(spark, sf_dir):
    panel, state = fitted(spark, sf_dir, SHORT_TRAIN_END)
    ids = panel.select("date", "store", "item")
    # one scan: every later row, and every row again with an unseen store, item, or both
    shifts = F.array(*[
        F.struct(F.lit(s).alias("s"), F.lit(i).alias("i")) for s, i in ((0, 0), (90, 0), (0, 900), (90, 900))
    ])
    rows = (
        ids.withColumn("shift", F.explode(shifts))
        .filter((F.col("date") > F.lit(SHORT_TRAIN_END).cast("date"))
                | (F.col("shift.s") + F.col("shift.i") > 0))
        .select("date", (F.col("store") + F.col("shift.s")).alias("store"),
                (F.col("item") + F.col("shift.i")).alias("item"))
    )
    return rounded(learned.demand_features(rows, state).select("date", "store", "item", *MEANS))


@query("baseline_forecast", f"""WITH {SCORED_SQL}
SELECT date, store, item, sales, ROUND(forecast, 6) AS forecast FROM scored""")
def baseline_forecast(spark, sf_dir):
    return rounded(scored_test(spark, sf_dir).select("date", "store", "item", "sales", "forecast"))


@query("demand_level", f"""WITH {SCORED_SQL},
x AS (SELECT *, forecast / NULLIF(store_item_mean, 0) AS rf, sales / NULLIF(store_item_mean, 0) AS ra
      FROM scored)
SELECT date, store, item, round_even(GREATEST(forecast, 0.0), 2)::DOUBLE AS predicted_sales,
  CASE WHEN store_item_mean <= 0 THEN 'Unknown' WHEN rf < 0.8 THEN 'Low' WHEN rf > 1.2 THEN 'High'
       ELSE 'Normal' END AS forecast_level,
  CASE WHEN store_item_mean <= 0 THEN 'Unknown' WHEN ra < 0.8 THEN 'Low' WHEN ra > 1.2 THEN 'High'
       ELSE 'Normal' END AS actual_level FROM x""")
def demand_level_query(spark, sf_dir):
    scored = scored_test(spark, sf_dir)
    clipped, mean = clip_at_zero(F.col("forecast")), F.col("store_item_mean")
    return scored.select(
        "date", "store", "item", round_units(clipped).alias("predicted_sales"),
        demand_level(clipped, mean).alias("forecast_level"),
        demand_level(F.col("sales").cast("double"), mean).alias("actual_level"),
    )


# ---- accuracy ------------------------------------------------------------------------------

METRICS_SQL = f"""COUNT(*) AS n_rows, ROUND(AVG({SMAPE_SQL}), 6) AS smape,
  ROUND(SQRT(AVG(POW(forecast - sales, 2))), 6) AS rmse, ROUND(AVG(ABS(forecast - sales)), 6) AS mae,
  ROUND(1 - AVG(POW(forecast - sales, 2)) / VAR_POP(sales), 6) AS r2,
  ROUND((AVG(forecast) - AVG(sales)) / AVG(sales) * 100, 6) AS bias_pct"""


@query("forecast_metrics", f"""WITH {learned_sql()},
held AS (SELECT *, CASE WHEN date <= DATE '{VAL_END}' THEN 'validation' ELSE 'test' END AS split
         FROM panel WHERE date > DATE '{TRAIN_END}'),
{features_sql('held')}, scored AS (SELECT *, store_item_dow_mean AS forecast FROM feat)
SELECT split, {METRICS_SQL} FROM scored GROUP BY 1""")
def forecast_metrics(spark, sf_dir):
    panel, state = fitted(spark, sf_dir)
    held = validation_rows(panel, TRAIN_END, VAL_END).withColumn("split", F.lit("validation")).unionByName(
        test_rows(panel, VAL_END).withColumn("split", F.lit("test"))
    )
    return rounded(evaluate(learned.baseline_forecast(held, state), ["split"]))


@query("smape_by_store", f"""WITH {SCORED_SQL}
SELECT store, ROUND(AVG({SMAPE_SQL}), 6) AS smape FROM scored GROUP BY 1""")
def smape_by_store(spark, sf_dir):
    return rounded(accuracy.smape_by(scored_test(spark, sf_dir), "store"))


@query("smape_spread", f"""WITH {SCORED_SQL},
s AS (SELECT AVG({SMAPE_SQL}) AS smape FROM scored GROUP BY store)
SELECT ROUND(MIN(smape), 6) AS best, ROUND(MAX(smape), 6) AS worst,
       ROUND(MAX(smape) - MIN(smape), 6) AS spread FROM s""")
def smape_spread(spark, sf_dir):
    return rounded(accuracy.smape_spread(scored_test(spark, sf_dir)))


@query("forecast_vs_actual_daily", f"""WITH {SCORED_SQL}
SELECT date, CAST(SUM(sales) AS BIGINT) AS actual, ROUND(SUM(forecast), 6) AS forecast
FROM scored GROUP BY 1""")
def forecast_vs_actual_daily(spark, sf_dir):
    return rounded(accuracy.actual_vs_forecast_daily(scored_test(spark, sf_dir)))


@query("residual_histogram", f"""WITH {SCORED_SQL},
v AS (SELECT forecast - sales AS x FROM scored), {histogram_sql('v', 60)}""")
def residual_histogram(spark, sf_dir):
    return rounded(accuracy.residual_histogram(scored_test(spark, sf_dir)))


TEST_FACT_SQL = f"""test_fact AS (
  SELECT date, CAST(store AS BIGINT) AS "Store", CAST(item AS BIGINT) AS "Item", sales AS "Actual",
         forecast AS "Forecast", ABS(sales - forecast) AS "AbsError", {SMAPE_SQL} AS "SmapePct",
         {LABELS_SQL} FROM scored)"""


@query("fact_test_forecast", f"""WITH {SCORED_SQL}, {TEST_FACT_SQL}
SELECT * REPLACE (ROUND("Forecast", 6) AS "Forecast", ROUND("AbsError", 6) AS "AbsError",
                  ROUND("SmapePct", 6) AS "SmapePct") FROM test_fact""")
def fact_test_forecast(spark, sf_dir):
    return rounded(accuracy.fact_test_forecast(scored_test(spark, sf_dir)))


# ---- horizon, plan and report queries --------------------------------------------------------

@query("future_grid", f"""WITH {PLAN_SQL} SELECT date, store, item FROM grid""")
def future_grid(spark, sf_dir):
    return grid.plan_grid(load_panel(spark, sf_dir))


@query("forecast_daily", f"""WITH {PLAN_SQL}
SELECT date, ROUND(SUM(forecast), 6) AS forecast_units FROM plan GROUP BY 1""")
def forecast_daily(spark, sf_dir):
    return rounded(scored_plan(spark, sf_dir).groupBy("date").agg(F.sum("forecast").alias("forecast_units")))


def _plan_fact(spark, sf_dir):
    return {"Forecast": accuracy.fact_forecast(scored_plan(spark, sf_dir))}


@query("forecast_by_store", f"""WITH {PLAN_SQL}
SELECT CAST(store AS BIGINT) AS "Store", ROUND(SUM(forecast), 6) AS forecast_units FROM plan GROUP BY 1""")
def forecast_by_store(spark, sf_dir):
    result = semantic.evaluate(_plan_fact(spark, sf_dir), ["forecast_units"], REPORT_YEAR, by=("Store",))
    return rounded(result).orderBy(F.desc("forecast_units"), "Store")


@query("order_plan_by_month", f"""WITH {PLAN_SQL}
SELECT CAST(month(date) AS BIGINT) AS "MonthNum", CAST(GROUPING(month(date)) AS INTEGER) AS is_total,
       ROUND(SUM(forecast), 6) AS forecast_units, ROUND(AVG(forecast), 6) AS avg_daily_forecast
FROM plan GROUP BY ROLLUP (month(date))""")
def order_plan_by_month(spark, sf_dir):
    return rounded(semantic.order_plan(_plan_fact(spark, sf_dir)["Forecast"]))


@query("history_plus_forecast", f"""WITH {PLAN_SQL},
recent AS (SELECT * FROM panel
           QUALIFY ROW_NUMBER() OVER (PARTITION BY store, item ORDER BY date DESC) <= 365)
SELECT date, store, item, CAST(sales AS DOUBLE) AS units, 'history' AS series FROM recent
UNION ALL SELECT date, store, item, ROUND(forecast, 6), 'forecast' FROM plan""")
def history_plus_forecast(spark, sf_dir):
    from shelfweave.operators.explore import recent_history
    panel, state = fitted(spark, sf_dir)
    plan = learned.baseline_forecast(grid.plan_grid(panel), state)
    return rounded(grid.history_plus_forecast(recent_history(panel), plan))


@query("forecast_arrays", f"""WITH {PLAN_SQL}
SELECT store, item, COUNT(*) AS n_days, MIN(date) AS first_date,
       string_agg(printf('%s=%.2f', strftime(date, '%Y-%m-%d'), round_even(forecast, 2)), ',' ORDER BY date)
       AS forecast FROM plan GROUP BY 1, 2""")
def forecast_arrays(spark, sf_dir):
    arrays = grid.forecast_arrays(scored_plan(spark, sf_dir).select("date", "store", "item", "forecast"))
    text = F.transform(
        "forecast",
        lambda p: F.format_string("%s=%.2f", iso_text(p["date"]), F.bround(p["forecast"], 2)),
    )
    return arrays.select(
        "store", "item", F.size("forecast").cast("bigint").alias("n_days"),
        F.get("forecast", F.lit(0))["date"].alias("first_date"), F.array_join(text, ",").alias("forecast"),
    )


def _facts(spark, sf_dir):
    panel, state = fitted(spark, sf_dir)
    plan = learned.baseline_forecast(grid.plan_grid(panel), state)
    return {
        "Sales": accuracy.fact_sales(panel), "Forecast": accuracy.fact_forecast(plan),
        "TestForecast": accuracy.fact_test_forecast(
            learned.baseline_forecast(test_rows(panel, VAL_END), state)
        ),
    }


SALES_MEASURES = ["total_units", "avg_daily_units", "units_year", "units_prior_year", "yoy_growth"]
FORECAST_MEASURES = ["forecast_units", "avg_daily_forecast"]
ACCURACY_MEASURES = ["actual_units", "forecast_units_test", "smape_pct", "mae_units", "forecast_bias"]


def sales_measures_sql(slicer: str = "TRUE") -> str:
    this, prior = f"year(date) = {REPORT_YEAR}", f"year(date) = {REPORT_YEAR - 1}"
    return f"""CAST(SUM(sales) FILTER ({slicer}) AS BIGINT) AS total_units,
  ROUND(AVG(sales) FILTER ({slicer}), 6) AS avg_daily_units,
  CAST(SUM(sales) FILTER ({this}) AS BIGINT) AS units_year,
  CAST(SUM(sales) FILTER ({prior}) AS BIGINT) AS units_prior_year,
  ROUND((SUM(sales) FILTER ({this}) - SUM(sales) FILTER ({prior}))
        / SUM(sales) FILTER ({prior})::DOUBLE, 6) AS yoy_growth"""


@query("measures_sales", f"WITH {PANEL_SQL} SELECT {sales_measures_sql()} FROM panel")
def measures_sales(spark, sf_dir):
    facts = {"Sales": accuracy.fact_sales(load_panel(spark, sf_dir))}
    return rounded(semantic.evaluate(facts, SALES_MEASURES, REPORT_YEAR))


@query("measures_sales_by_year", f"""WITH {PANEL_SQL},
t AS (SELECT CAST(SUM(sales) FILTER (year(date) = {REPORT_YEAR}) AS BIGINT) AS units_year FROM panel)
SELECT CAST(year(date) AS BIGINT) AS "Year", CAST(SUM(sales) AS BIGINT) AS total_units,
       ROUND(AVG(sales), 6) AS avg_daily_units, ANY_VALUE(units_year) AS units_year
FROM panel CROSS JOIN t GROUP BY 1""")
def measures_sales_by_year(spark, sf_dir):
    facts = {"Sales": accuracy.fact_sales(load_panel(spark, sf_dir))}
    names = ["total_units", "avg_daily_units", "units_year"]
    return rounded(semantic.evaluate(facts, names, REPORT_YEAR, by=("Year",)))


@query("measures_forecast", f"""WITH {PLAN_SQL}
SELECT ROUND(SUM(forecast), 6) AS forecast_units, ROUND(AVG(forecast), 6) AS avg_daily_forecast FROM plan""")
def measures_forecast(spark, sf_dir):
    return rounded(semantic.evaluate(_plan_fact(spark, sf_dir), FORECAST_MEASURES, REPORT_YEAR))


ACCURACY_SQL = f"""CAST(SUM("Actual") AS BIGINT) AS actual_units,
  ROUND(SUM("Forecast"), 6) AS forecast_units_test, ROUND(AVG("SmapePct"), 6) AS smape_pct,
  ROUND(AVG("AbsError"), 6) AS mae_units,
  ROUND((SUM("Forecast") - SUM("Actual")) / SUM("Actual"), 6) AS forecast_bias"""


@query("measures_accuracy", f"WITH {SCORED_SQL}, {TEST_FACT_SQL} SELECT {ACCURACY_SQL} FROM test_fact")
def measures_accuracy(spark, sf_dir):
    facts = {"TestForecast": accuracy.fact_test_forecast(scored_test(spark, sf_dir))}
    return rounded(semantic.evaluate(facts, ACCURACY_MEASURES, REPORT_YEAR))


SLICERS = FilterContext(stores=(1, 2, 3), items=(5, 6, 7, 8), sales_years=(1997, 1998), forecast_months=(11, 12))
SLICE_SQL = "store IN (1, 2, 3) AND item IN (5, 6, 7, 8)"


@query("sliced_measures", f"""WITH {PLAN_SQL},
test AS (SELECT * FROM panel WHERE date > DATE '{VAL_END}'), {features_sql('test', 'test_feat')},
scored AS (SELECT *, store_item_dow_mean AS forecast FROM test_feat WHERE {SLICE_SQL} AND store <> 3), {TEST_FACT_SQL},
s AS (SELECT store, {sales_measures_sql('year(date) IN (1997, 1998)')}
      FROM panel WHERE {SLICE_SQL} GROUP BY 1),
f AS (SELECT store, ROUND(SUM(forecast), 6) AS forecast_units,
             ROUND(AVG(forecast), 6) AS avg_daily_forecast
      FROM plan WHERE {SLICE_SQL} AND month(date) IN (11, 12) AND store <> 2 GROUP BY 1),
a AS (SELECT "Store" AS store, {ACCURACY_SQL} FROM test_fact GROUP BY 1)
SELECT CAST(coalesce(s.store, f.store, a.store) AS BIGINT) AS "Store", s.* EXCLUDE (store), f.* EXCLUDE (store), a.* EXCLUDE (store)
FROM s FULL JOIN f ON f.store = s.store FULL JOIN a ON a.store = coalesce(s.store, f.store)""")
def sliced_measures(spark, sf_dir):
    """All measures per store; store 2 has no forecast here and store 3 no test rows, and both stay."""
    facts = _facts(spark, sf_dir)
    facts["Forecast"] = facts["Forecast"].filter("Store <> 2")
    facts["TestForecast"] = facts["TestForecast"].filter("Store <> 3")
    parts = [
        semantic.evaluate(facts, names, REPORT_YEAR, SLICERS, by=("Store",))
        for names in (SALES_MEASURES, FORECAST_MEASURES, ACCURACY_MEASURES)
    ]
    return rounded(parts[0].join(parts[1], "Store", "full").join(parts[2], "Store", "full"))


# Dimensions of their own: store 10 and item 50 are missing, store 11 and item 51 have no facts.
@query("star_join", f"""WITH {PLAN_SQL},
test AS (SELECT * FROM panel WHERE date > DATE '{VAL_END}'), {features_sql('test', 'test_feat')},
facts AS (SELECT 'Sales' AS fact, store, item, CAST(sales AS DOUBLE) AS units FROM panel
  UNION ALL SELECT 'Forecast', store, item, forecast FROM plan
  UNION ALL SELECT 'TestForecast', store, item, store_item_dow_mean FROM test_feat)
SELECT fact, CAST(COUNT(*) FILTER (store <> 10 AND item <> 50) AS BIGINT) AS n_rows,
  ROUND(SUM(units) FILTER (store <> 10 AND item <> 50), 6) AS units,
  CAST(COUNT(*) FILTER (store = 10) AS BIGINT) AS orphan_store_rows,
  CAST(COUNT(*) FILTER (item = 50) AS BIGINT) AS orphan_item_rows FROM facts GROUP BY 1""")
def star_join(spark, sf_dir):
    """The six relations: each fact against stores and items, with what a dimension lacks counted."""
    dims = {
        "Stores": spark.range(1, 12).filter("id <> 10").select(F.col("id").alias("Store")),
        "Items": spark.range(1, 52).filter("id <> 50").select(F.col("id").alias("Item")),
    }
    parts = []
    for name, fact in _facts(spark, sf_dir).items():
        units = F.col("Sales").cast("double") if name == "Sales" else F.col("Forecast")
        joined = semantic.star_join(fact, dims).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(units).alias("units"))
        lost = [semantic.orphans(fact, dims[d], key).agg(F.count(F.lit(1))).scalar() for d, key in semantic.DIM_KEYS.items()]
        parts.append(joined.select(
            F.lit(name).alias("fact"), "n_rows", "units", lost[0].alias("orphan_store_rows"), lost[1].alias("orphan_item_rows")))
    return rounded(reduce(DataFrame.unionByName, parts))


# ---- the true keys ---------------------------------------------------------------------------

def _true_keys(sql: str) -> str:
    """The same statement over the panel on supplier and part keys."""
    return sql.replace("1 + l_suppkey % 10", "l_suppkey").replace("1 + l_partkey % 50", "l_partkey")


def _scored_true(spark, sf_dir):
    panel = load_true_panel(spark, sf_dir)
    state = learned.learn_demand(train_rows(panel, TRAIN_END))
    return learned.baseline_forecast(test_rows(panel, VAL_END), state)


@query("true_baseline_forecast", _true_keys(f"""WITH {SCORED_SQL}
SELECT date, store, item, sales, ROUND(forecast, 6) AS forecast FROM scored"""))
def true_baseline_forecast(spark, sf_dir):
    """Baseline on the true keys: large lookups, many series without a training row."""
    return rounded(_scored_true(spark, sf_dir).select("date", "store", "item", "sales", "forecast"))


@query("true_smape_by_store", _true_keys(f"""WITH {SCORED_SQL}
SELECT store, ROUND(AVG({SMAPE_SQL}), 6) AS smape FROM scored GROUP BY 1"""))
def true_smape_by_store(spark, sf_dir):
    return rounded(accuracy.smape_by(_scored_true(spark, sf_dir), "store"))


@query("true_recent_history", _true_keys(f"""WITH {PANEL_SQL}
SELECT date, store, item, sales FROM panel
QUALIFY ROW_NUMBER() OVER (PARTITION BY store, item ORDER BY date DESC) <= 365"""))
def true_recent_history(spark, sf_dir):
    from shelfweave.operators.explore import recent_history
    return recent_history(load_true_panel(spark, sf_dir))


# ---- requests --------------------------------------------------------------------------------

def _request_texts(spark, sf_dir):
    """Panel keys as request texts; the weekday decides which defect a request has."""
    panel = load_panel(spark, sf_dir)
    dow, day = F.weekday("date"), F.col("date")
    return panel.select(
        F.expr("(datediff(date, DATE'1990-01-01') * 1000L + store) * 1000 + item").alias("request_id"),
        F.when(dow == 0, F.date_format(day, "dd/MM/yyyy")).when(dow == 1, F.date_format(day, "yyyy-M-d"))
        .when(dow == 6, F.lit(None)).otherwise(iso_text(day)).alias("date"),
        F.when(dow == 2, F.lit("x")).when(dow == 3, F.lit("99")).otherwise(F.col("store").cast("string"))
        .alias("store"),
        F.when(dow == 4, F.lit("0")).otherwise(F.col("item").cast("string")).alias("item"),
    )


@query("validate_requests", f"""WITH {PANEL_SQL},
r AS (SELECT *, isodow(date) - 1 AS dow,
        (datediff('day', DATE '1990-01-01', date) * 1000::BIGINT + store) * 1000 + item AS request_id FROM panel)
SELECT request_id,
  CASE WHEN dow IN (0, 6) OR (dow = 1 AND (month(date) < 10 OR day(date) < 10)) THEN NULL ELSE date END AS date,
  CASE WHEN dow = 2 THEN NULL WHEN dow = 3 THEN 99 ELSE store END AS store,
  CASE WHEN dow = 4 THEN 0 ELSE item END AS item,
  CASE WHEN dow = 6 THEN 'missing date' WHEN dow = 0 THEN 'bad date'
       WHEN dow = 1 AND (month(date) < 10 OR day(date) < 10) THEN 'bad date'
       WHEN dow = 2 THEN 'bad store' WHEN dow = 3 THEN 'store out of range'
       WHEN dow = 4 THEN 'item out of range' END AS reject_reason FROM r""")
def validate_requests(spark, sf_dir):
    checked = requests.check_requests(_request_texts(spark, sf_dir))
    return checked.select("request_id", "date", "store", "item", "reject_reason")


@query("parse_requests", f"""WITH {PANEL_SQL},
r AS (SELECT *, isodow(date) - 1 AS dow, CASE WHEN isodow(date) = 6 THEN 'bad json' WHEN isodow(date) = 7 THEN 'bad date'
        WHEN isodow(date) = 4 AND item = 1 THEN 'bad periods'
        WHEN isodow(date) = 5 AND item > 30 THEN 'too many periods' END AS reason FROM panel)
SELECT date AS asked, store AS asked_store, item AS asked_item,
  CAST(CASE WHEN dow IN (0, 5) THEN 1 ELSE store END AS INTEGER) AS store,
  CAST(CASE WHEN dow IN (0, 2, 5) THEN 1 ELSE item END AS INTEGER) AS item,
  CASE WHEN reason IS NOT NULL THEN NULL WHEN dow = 0 THEN DATE '2018-01-01' ELSE date END AS first_date,
  CAST(CASE WHEN reason IS NOT NULL THEN NULL WHEN dow <= 1 THEN 1 WHEN dow = 2 THEN 7 WHEN dow = 3 THEN item - 1
            WHEN dow = 4 THEN item + 370 END AS BIGINT) AS n_days,
  reason AS reject_reason FROM r""")
def parse_requests(spark, sf_dir):
    panel = load_panel(spark, sf_dir)
    dow, day = F.weekday("date"), iso_text(F.col("date"))
    ids = {"store": F.col("store"), "item": F.col("item")}

    def body(**fields):
        return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))

    text = (
        F.when(dow == 0, "{}").when(dow == 1, body(date=day, **ids))
        .when(dow == 2, body(start_date=day, store=ids["store"]))
        .when(dow == 3, body(start_date=day, periods=F.col("item") - 1, **ids))
        # whole numbers in another notation
        .when(dow == 4, body(start_date=day, periods=F.col("item") + 370.0,
                             store=F.col("store").cast("double"), item=F.col("item").cast("double")))
        # half an object, and an object with something behind it
        .when(dow == 5, F.when(F.col("item") % 2 == 0, "{\"store\": ").otherwise(
            F.concat(body(date=day, **ids), F.lit(" and more")))).otherwise(body(date=F.date_format("date", "yyyy/MM/dd"), **ids))
    )
    texts = panel.select(
        F.col("date").alias("asked"), F.col("store").alias("asked_store"),
        F.col("item").alias("asked_item"), text.alias("body"),
    )
    return requests.parse_json_requests(texts, max_periods=400).select(
        "asked", "asked_store", "asked_item", "store", "item", "first_date", "n_days", "reject_reason")


@query("export_feature_maps", f"""WITH {learned_sql()}
SELECT 'store_item_mean' AS name, store || '|' || item AS map_key, ROUND(m, 6) AS mean FROM si
UNION ALL SELECT 'store_item_dow_mean', store || '|' || item || '|' || dow, ROUND(m, 6) FROM sid
UNION ALL SELECT 'item_month_mean', item || '|' || month, ROUND(m, 6) FROM im
UNION ALL SELECT 'store_month_mean', store || '|' || month, ROUND(m, 6) FROM sm""")
def export_feature_maps(spark, sf_dir):
    _, state = fitted(spark, sf_dir)
    entries = keyed_maps.mean_entries(state, spark)
    maps = keyed_maps.keyed_maps(entries, keyed_maps.shard_counts(entries))
    return rounded(maps.select("name", F.explode("entries").alias("map_key", "mean")))


def asked_rows(panel: DataFrame) -> DataFrame:
    """Every panel row, again with an unseen store, an unseen item, and a date past the panel."""
    moves = F.array(*[
        F.struct(F.lit(d).alias("d"), F.lit(s).alias("s"), F.lit(i).alias("i"))
        for d, s, i in ((0, 0, 0), (0, 90, 0), (0, 0, 900), (4000, 0, 0))])
    return panel.select("date", "store", "item", F.explode(moves).alias("m")).select(
        F.date_add("date", F.col("m.d")).alias("date"), (F.col("store") + F.col("m.s")).alias("store"),
        (F.col("item") + F.col("m.i")).alias("item"))


# the rows of asked_rows
PARITY_SQL = ", ".join(f"ROUND(AVG({m}), 6) AS joined_{m}, ROUND(AVG({m}), 6) AS mapped_{m}" for m in MEANS)


@query("path_parity", f"""WITH {learned_sql(SHORT_TRAIN_END)},
asked AS (SELECT date, store, item FROM panel UNION ALL SELECT date, CAST(store + 90 AS INTEGER), item FROM panel
  UNION ALL SELECT date, store, CAST(item + 900 AS INTEGER) FROM panel
  UNION ALL SELECT CAST(date + INTERVAL 4000 DAY AS DATE), store, item FROM panel), {features_sql('asked')}
SELECT store, COUNT(*) AS n_rows, {PARITY_SQL}, 0.0::DOUBLE AS max_abs_diff FROM feat GROUP BY 1""")
def path_parity(spark, sf_dir):
    """All four learned means over both lookup paths: their averages, and the largest difference of a row."""
    panel, state = fitted(spark, sf_dir, SHORT_TRAIN_END)
    entries = keyed_maps.mean_entries(state, spark)
    shards = keyed_maps.shard_counts(entries)
    asked = asked_rows(panel)
    joined = learned.demand_features(asked, state).select(
        "date", "store", "item", *[F.col(m).alias(f"joined_{m}") for m in MEANS])
    # the second path runs on the rows of the first, so the two need no join to be compared
    both = keyed_maps.with_mapped_means(joined, keyed_maps.keyed_maps(entries, shards), shards, state.global_mean)
    gap = F.greatest(*[F.abs(F.col(f"joined_{m}") - F.col(m)) for m in MEANS])
    return rounded(both.groupBy("store").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(f"joined_{m}").alias(f"joined_{m}") for m in MEANS],
        *[F.avg(m).alias(f"mapped_{m}") for m in MEANS], F.max(gap).alias("max_abs_diff"),
    ))


# ---- preprocessing -----------------------------------------------------------------------------

MEDIAN_SQL = {
    "store": "store", "item": "item", "year": "year(date)", "day": "day(date)",
    "dayofyear": "dayofyear(date)", "weekofyear": "week(date)",
    "month_sin": "SIN(2 * PI() * month(date) / 12)", "month_cos": "COS(2 * PI() * month(date) / 12)",
    "dow_sin": "SIN(2 * PI() * (isodow(date) - 1) / 7)", "dow_cos": "COS(2 * PI() * (isodow(date) - 1) / 7)",
    "doy_sin": "SIN(2 * PI() * dayofyear(date) / 365.25)", "doy_cos": "COS(2 * PI() * dayofyear(date) / 365.25)",
    **{m: m for m in MEANS},
}
ZERO = "+ 0.0"


@query("impute_median", f"""WITH {learned_sql()}, {features_sql('train')}
{' UNION ALL '.join(f"SELECT '{n}' AS name, ROUND(MEDIAN({e}), 6) {ZERO} AS median FROM feat"
                    for n, e in MEDIAN_SQL.items())}""")
def impute_median(spark, sf_dir):
    panel, state = fitted(spark, sf_dir)
    train = learned.demand_features(train_rows(panel, TRAIN_END), state)
    return rounded(
        exact_quantiles(train, NUMERIC, [0.5]).select("name", F.col("quantile").alias("median"))
    ).withColumn("median", F.col("median") + F.lit(0.0))


@query("one_hot", f"""WITH {PANEL_SQL}
SELECT date, store, item,
  array_to_string(list_transform(range(1, 13), lambda m: CAST(m = month(date) AS INTEGER)), '') AS month,
  array_to_string(list_transform(range(0, 7), lambda d: CAST(d = isodow(date) - 1 AS INTEGER)), '')
  AS dayofweek FROM panel""")
def one_hot(spark, sf_dir):
    from pyspark.ml.feature import OneHotEncoder
    from pyspark.ml.functions import vector_to_array

    from shelfweave.functions.calendar import with_calendar
    from shelfweave.operators.ml_stages import CategoryIndexer

    rows = CategoryIndexer().transform(
        with_calendar(load_panel(spark, sf_dir)).select("date", "store", "item", *CATEGORIES)
    )
    encoder = OneHotEncoder(
        inputCols=[f"{c}_index" for c in CATEGORIES], outputCols=[f"{c}_onehot" for c in CATEGORIES],
        handleInvalid="keep", dropLast=True,
    )
    encoded = encoder.fit(rows).transform(rows)

    def text(name):
        bits = F.transform(vector_to_array(f"{name}_onehot"), lambda x: x.cast("int").cast("string"))
        return F.array_join(bits, "").alias(name)

    return encoded.select("date", "store", "item", *[text(c) for c in CATEGORIES])


@query("request_metrics", """WITH w AS (
  SELECT date_trunc('hour', ts) AS window_start, event_type AS path, COUNT(*) AS requests,
         SUM(CAST(value AS DECIMAL(18,6))) AS total FROM events GROUP BY 1, 2),
r AS (SELECT *, CAST(SUM(requests) OVER x AS BIGINT) AS requests_so_far, SUM(total) OVER x AS total_so_far
      FROM w WINDOW x AS (PARTITION BY path ORDER BY window_start ROWS UNBOUNDED PRECEDING))
SELECT window_start, path, requests, requests_so_far,
  FLOOR(total::DOUBLE / requests * 1e6 + 0.5) / 1e6 AS mean_latency_ms,
  FLOOR(total_so_far::DOUBLE / requests_so_far * 1e6 + 0.5) / 1e6 AS mean_latency_so_far FROM r""")
def request_metrics(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "ts", F.col("event_type").alias("path"), F.col("value").alias("latency_ms")
    )
    # two-decimal latencies often end on a tie: round by floor so both engines settle it alike
    return running_metrics(log).withColumns({
        c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in ("mean_latency_ms", "mean_latency_so_far")
    })


# Rows held back arrive after the rest of the first half; the state has let go of most of their windows by then.
STREAM_CUT = "2024-01-16"
STREAM_LOG_SQL = f"""log AS (SELECT ts, event_type AS path, value AS latency, user_id % 5 AS n_scored, event_type = 'error' AS failed,
    ts >= TIMESTAMP '{STREAM_CUT}' OR event_id % 50 = 0 AS second FROM events)"""


def _counted_events(spark, sf_dir) -> str:
    """Events as a request log in two deliveries, counted by a stream that is started again in between; the folder it wrote."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = events.select(
        "ts", F.col("event_type").alias("path"), F.col("value").alias("latency_ms"),
        (F.col("user_id") % 5).alias("n_scored"), (F.col("event_type") == "error").alias("failed"),
        ((F.col("ts") >= F.lit(STREAM_CUT).cast(dict(events.dtypes)["ts"])) | (F.col("event_id") % 50 == 0)).alias("second"))
    arriving, out = fresh_path(spark, "log"), fresh_path(spark, "counted")
    for delivery in (~F.col("second"), F.col("second")):
        log.filter(delivery).select(*[F.col(n).cast(t) for n, t in (c.split(" ") for c in request_log.LOG.split(", "))]).write.mode(
            "append").parquet(arriving)
        for stream in request_log.count_stream(spark, arriving, out, late="1 day"):
            stream.awaitTermination()
    return out


@query("stream_metrics", f"""WITH {STREAM_LOG_SQL},
w AS (SELECT date_trunc('millisecond', MAX(ts)) - INTERVAL 1 DAY AS closed FROM log WHERE NOT second)
SELECT path, COUNT(*) AS requests, COUNT(*) FILTER (failed) AS errors,
  CAST(COALESCE(SUM(n_scored) FILTER (NOT failed), 0) AS BIGINT) AS n_scored, CAST(SUM(CAST(latency AS DECIMAL(18,6))) AS DOUBLE) AS total_latency_ms,
  COUNT(*) FILTER (second AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= closed) AS late
FROM log CROSS JOIN w GROUP BY path""")
def stream_metrics_query(spark, sf_dir):
    """Counters per path of a stream that is stopped and started again, late requests counted."""
    counted = request_log.counted(spark, _counted_events(spark, sf_dir))
    return counted.withColumn("total_latency_ms", F.col("total_latency_ms").cast("double"))


@query("service_record", """SELECT COUNT(*) FILTER (event_type = 'error') AS errors,
  CAST(SUM(user_id % 5) FILTER (event_type <> 'error') AS BIGINT) AS n_scored,
  COUNT(*) FILTER (event_type LIKE 'c%') AS predict_requests, COUNT(*) FILTER (event_type = 'click') AS batch_requests,
  FLOOR(SUM(CAST(value AS DECIMAL(18,6))) FILTER (event_type LIKE 'c%')::DOUBLE / COUNT(*) FILTER (event_type LIKE 'c%') * 1e6 + 0.5) / 1e6
    AS mean_latency_ms FROM events""")
def service_record(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("path"), F.col("value").alias("latency_ms"),
        (F.col("user_id") % 5).alias("n_scored"), (F.col("event_type") == "error").alias("failed"))
    record = request_log.service_record(request_log.path_counters(log), predict="c", batch="click")
    return record.withColumn("mean_latency_ms", F.floor(F.col("mean_latency_ms") * 1e6 + 0.5) / 1e6)
