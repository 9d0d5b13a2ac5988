"""Queries whose results come from a fitted model; a twin exists where it follows from the tables alone."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfweave.functions.calendar import with_calendar
from shelfweave.functions.metrics import rounded
from shelfweave.operators import accuracy, reports, semantic
from shelfweave.operators.boosting import BoostingParams, boost
from shelfweave.operators.grid import day_range
from shelfweave.operators.splits import test_rows, train_rows
from shelfweave.plans import scoring, training
from shelfweave.plans.catalog import PANEL_SQL, REPORT_YEAR, TRAIN_END, VAL_END, features_sql, learned_sql, query
from shelfweave.plans.forecast_queries import MEDIAN_SQL, _request_texts, asked_rows
from shelfweave.session import fresh_path, input_state
from shelfweave.sources import keyed_maps, portable_forest, requests, tables
from shelfweave.sources.panel import load_panel
from shelfweave.streaming.scorer import publish_model, score_stream

# A small budget that runs in seconds on one machine; training.GRIDS holds the full search.
SMALL = {
    "gbt_squared": {"maxIter": 10, "maxDepth": 4, "stepSize": 0.2, "maxBins": 64},
    "gbt_absolute": {"maxIter": 10, "maxDepth": 4, "stepSize": 0.2, "maxBins": 64},
    "random_forest": {"numTrees": 20, "maxDepth": 6, "maxBins": 64},
}
SMALL_SEARCH = training.Budget(
    grids={
        "gbt_squared": {"maxIter": [4, 6], "maxDepth": [3, 4], "stepSize": [0.1, 0.3], "maxBins": [64]},
        "random_forest": {"numTrees": [10, 20], "maxDepth": [4, 6], "maxBins": [64]},
    },
    draws=2, folds=2, parallelism=4,
)

# Three boosted candidates, eight draws and two folds as in the full search; only the rounds are few.
ROUNDS = [2, 3]
TUNED = training.Budget(
    grids={
        "gbt_squared": {**training.GRIDS["gbt_squared"], "maxIter": ROUNDS, "maxDepth": [3, 4, 5], "maxBins": [64]},
        "leaf_boosting": {**training.HIST_GRIDS["leaf_boosting"], "rounds": ROUNDS, "max_depth": [3, 5], "max_bins": [64]},
        "hist_boosting": {**training.HIST_GRIDS["hist_boosting"], "rounds": ROUNDS, "max_depth": [4], "max_bins": [64]},
    },
    draws=training.N_DRAWS, folds=training.N_FOLDS, parallelism=4,
)

_TRAINED: dict[tuple[str, str, str], training.Trained] = {}


def trained(spark, sf_dir) -> training.Trained:
    """The candidates fitted on this table as it is now, kept for the life of the application."""
    key = (spark.sparkContext.applicationId, sf_dir, input_state(spark, f"{sf_dir}/lineitem.parquet"))
    if key not in _TRAINED:
        _TRAINED[key] = training.train_candidates(load_panel(spark, sf_dir), TRAIN_END, VAL_END, SMALL)
    return _TRAINED[key]


# The 38 slots by their formulas, in slot order.
SLOT_SQL = {
    **MEDIAN_SQL,
    **{f"month_onehot_{m}": f"CAST(month(date) = {m} AS DOUBLE)" for m in range(1, 13)},
    **{f"dayofweek_onehot_{d}": f"CAST(isodow(date) - 1 = {d} AS DOUBLE)" for d in range(7)},
    "is_weekend": "CAST(isodow(date) >= 6 AS DOUBLE)", "is_month_start": "CAST(day(date) = 1 AS DOUBLE)",
    "is_month_end": "CAST(date = last_day(date) AS DOUBLE)",
}
SLOTS_SQL = ", ".join(f"ROUND(CAST({e} AS DOUBLE), 6) + 0.0 AS s{i:02d}_{n}" for i, (n, e) in enumerate(SLOT_SQL.items()))


@query("feature_vector", f"""WITH {learned_sql()}, test AS (SELECT * FROM panel WHERE date > DATE '{VAL_END}'),
{features_sql('test')}
SELECT date, store, item, {SLOTS_SQL} FROM feat""")
def feature_vector(spark, sf_dir):
    """The fitted pipeline's vector of every test row, a column per slot: its place and its name."""
    model, rows = trained(spark, sf_dir).best, test_rows(load_panel(spark, sf_dir), VAL_END)
    names = training.slot_names(PipelineModel(model.stages[:-1]).transform(rows))
    vectors = training.slot_rows(model, rows)
    return vectors.select("date", "store", "item", *[
        (F.round(F.col("slots")[i], 6) + F.lit(0.0)).alias(f"s{i:02d}_{n}") for i, n in enumerate(names)])


@query("model_comparison")
def model_comparison(spark, sf_dir):
    path = fresh_path(spark, "comparison")
    tables.write_comparison(trained(spark, sf_dir).comparison, path)
    table = trained(spark, sf_dir).comparison
    return spark.read.schema(table.schema).option("header", True).csv(path).orderBy("val_smape", "model")


@query("champion")
def champion(spark, sf_dir):
    panel = load_panel(spark, sf_dir)
    return rounded(training.champion_report(trained(spark, sf_dir), panel, VAL_END))


@query("model_metadata")
def model_metadata(spark, sf_dir):
    path = fresh_path(spark, "metadata")
    record = training.metadata_record(trained(spark, sf_dir), load_panel(spark, sf_dir), TRAIN_END, VAL_END)
    tables.write_metadata(spark, record, path)
    return tables.read_metadata(spark, path)


@query("model_roundtrip", f"""WITH {PANEL_SQL}
SELECT 2 * COUNT(*) AS n_rows, 0.0::DOUBLE AS max_abs_diff FROM panel""")
def model_roundtrip(spark, sf_dir):
    """Largest difference between a model and a copy saved over its own folder, over all rows and unseen stores."""
    model, panel = trained(spark, sf_dir).best, load_panel(spark, sf_dir)
    path = fresh_path(spark, "model")
    model.write().overwrite().save(path)
    PipelineModel.load(path).write().overwrite().save(path)
    keys = ["date", "store", "item"]
    rows = panel.select(*keys).unionByName(panel.select("date", (F.col("store") + 90).alias("store"), "item"))
    before = training.predict(model, rows).select(*keys, F.col("forecast").alias("before"))
    after = training.predict(PipelineModel.load(path), before)
    return after.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.abs(F.col("before") - F.col("forecast"))).alias("max_abs_diff"),
    )


@query("portable_artifacts", f"""WITH {learned_sql()}
SELECT unnest(['store_item_mean', 'store_item_dow_mean', 'item_month_mean', 'store_month_mean']) AS name,
  unnest([(SELECT COUNT(m) FROM si), (SELECT COUNT(m) FROM sid), (SELECT COUNT(m) FROM im), (SELECT COUNT(m) FROM sm)]) AS entries,
  38 AS slots""")
def portable_artifacts(spark, sf_dir):
    """Export what the champion learned, read it back, and size each map."""
    path = fresh_path(spark, "portable")
    rows = test_rows(load_panel(spark, sf_dir), VAL_END)
    training.export_portable(trained(spark, sf_dir).best, rows, path)
    maps, record = keyed_maps.read_artifacts(spark, path)
    sizes = maps.groupBy("name").agg(F.sum(F.size("entries")).alias("entries"))
    return sizes.withColumn("slots", record.select(F.size("feature_order")).scalar())


@query("feature_importance")
def feature_importance(spark, sf_dir):
    rows = test_rows(load_panel(spark, sf_dir), VAL_END)
    return training.feature_importance(trained(spark, sf_dir).best, rows, top=12)


@query("demand_drivers")
def demand_drivers(spark, sf_dir):
    panel = load_panel(spark, sf_dir)
    return rounded(training.shapley_drivers(trained(spark, sf_dir).best, test_rows(panel, VAL_END)))


# Both say what holds for any fitted model; the twins count the rows from the tables.
CANDIDATES_SQL = "(SELECT unnest(['gbt_absolute', 'gbt_squared', 'random_forest']) AS model)"


@query("forecast_parity", f"""WITH {PANEL_SQL}
SELECT model, 4 * COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_apart, 0.0::DOUBLE AS max_abs_diff
FROM panel, {CANDIDATES_SQL} GROUP BY 1""")
def forecast_parity(spark, sf_dir):
    """Forecasts of every candidate by its pipeline and by its exported artifacts alone.

    Over all panel rows, unseen stores, unseen items and later dates: rows, those more than 1e-9 apart, the largest difference.
    """
    panel = load_panel(spark, sf_dir)
    parts = []
    for name, model in sorted(trained(spark, sf_dir).models.items()):
        path = fresh_path(spark, "portable")
        training.export_portable(model, panel, path)
        maps, record = keyed_maps.read_artifacts(spark, path)
        # the second path runs on the rows of the first, so the two need no join to be compared
        piped = training.predict(model, asked_rows(panel)).select("date", "store", "item", F.col("forecast").alias("piped"))
        both = portable_forest.portable_forecast(
            piped, maps, keyed_maps.map_rows(maps), record.first(), portable_forest.read_forest(spark, path))
        gap = F.abs(F.col("piped") - F.col("forecast"))
        parts.append(both.agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if(~F.coalesce(gap <= 1e-9, F.lit(False))).alias("n_apart"), F.round(F.max(gap), 9).alias("max_abs_diff")))
    return reduce(DataFrame.unionByName, parts)


@query("attribution_sums", f"""WITH {PANEL_SQL}
SELECT model, COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_apart, CAST(0 AS BIGINT) AS n_unused
FROM panel, {CANDIDATES_SQL} WHERE date > DATE '{VAL_END}' GROUP BY 1""")
def attribution_sums(spark, sf_dir):
    """Contributions of all 38 slots to every test forecast of every candidate.

    Rows, those whose base and contributions miss the forecast by more than 1e-9, and contributions of slots without a gain.
    """
    rows = test_rows(load_panel(spark, sf_dir), VAL_END).select("date", "store", "item")
    parts = []
    for name, model in sorted(trained(spark, sf_dir).models.items()):
        gains = F.array(*[F.lit(float(g)) for g in model.stages[-1].featureImportances.toArray()])
        told = training.attributed(model, rows)
        total = F.aggregate("contributions", F.col("base"), lambda a, x: a + x)
        unused = F.size(F.filter(F.arrays_zip("contributions", gains.alias("gains")),
                                 lambda x: (x["contributions"] != 0) & (x["gains"] == 0)))
        parts.append(told.agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if(~F.coalesce(F.abs(total - F.col("forecast")) <= 1e-9, F.lit(False))).alias("n_apart"),
            F.sum(unused).alias("n_unused")))
    return reduce(DataFrame.unionByName, parts)


@query("report_drivers")
def report_drivers(spark, sf_dir):
    """The impact measure per driver, as the report ranks it."""
    table = reports.demand_drivers(demand_drivers(spark, sf_dir))
    impact = semantic.evaluate({"DemandDrivers": table}, ["impact"], REPORT_YEAR, by=("Feature",))
    return impact.orderBy(F.desc("impact"), "Feature")


@query("report_comparison")
def report_comparison(spark, sf_dir):
    """The comparison as its typed import, summed by model."""
    path = fresh_path(spark, "report-comparison")
    tables.write_csv(reports.model_comparison(trained(spark, sf_dir).comparison), path)
    rows, _ = tables.read_report_table(spark, "ModelComparison", path)
    return reports.comparison_by_model(rows)


@query("report_metrics")
def report_metrics(spark, sf_dir):
    return reports.model_metrics(model_metadata(spark, sf_dir))


@query("random_search")
def random_search(spark, sf_dir):
    train = train_rows(load_panel(spark, sf_dir), TRAIN_END)
    return rounded(training.search(train, SMALL_SEARCH))


TUNED_SQL = """SELECT unnest(['gbt_squared', 'hist_boosting', 'leaf_boosting']) AS model, CAST(16 AS BIGINT) AS n_fits,
  true AS cv_is_best, true AS champion_is_best, CAST(0 AS BIGINT) AS n_missing"""


@query("tuned_training", TUNED_SQL)
def tuned_training(spark, sf_dir):
    """The whole search over all training rows: scored draws, best point refitted, champion.

    Per candidate the scored fits, whether its ``cv_smape`` is the least mean over the folds of any draw, whether the
    champion has the least validation SMAPE, and its empty metrics.
    """
    panel = load_panel(spark, sf_dir)
    done = training.tune(panel, TRAIN_END, VAL_END, TUNED)
    means = done.scores.groupBy("model", "params").agg(F.avg("smape").alias("mean"), F.count("smape").alias("n"))
    best = means.groupBy("model").agg(F.min("mean").alias("least"), F.sum("n").alias("n_fits"))
    table = done.comparison.join(best, "model")
    least = done.comparison.agg(F.min("val_smape")).scalar()
    winner = done.comparison.filter(F.col("model") == done.champion).select("val_smape").scalar()
    return table.select(
        "model", "n_fits", (F.abs(F.col("cv_smape") - F.col("least")) < 1e-9).alias("cv_is_best"),
        (winner == least).alias("champion_is_best"),
        sum((F.col(c).isNull().cast("long") for c in done.comparison.columns), F.lit(0).cast("long")).alias("n_missing"))


SPLIT_SQL = f"""WITH {PANEL_SQL},
t AS (SELECT *, isodow(date) - 1 AS dow, month(date) AS month FROM panel WHERE date <= DATE '{TRAIN_END}'),
l AS (SELECT 0 AS slot, store AS v, sales FROM t UNION ALL SELECT 1, item, sales FROM t
  UNION ALL SELECT 2, dow, sales FROM t UNION ALL SELECT 3, month, sales FROM t),
b AS (SELECT slot, v, COUNT(*) AS n, SUM(sales) AS s FROM l GROUP BY 1, 2),
c AS (SELECT slot, v, SUM(n) OVER x AS ln, SUM(s) OVER x AS ls, SUM(n) OVER (PARTITION BY slot) AS n,
    SUM(s) OVER (PARTITION BY slot) AS s FROM b WINDOW x AS (PARTITION BY slot ORDER BY v)),
g AS (SELECT slot, v, ln, n, s / n AS mean, ls - ln * (s / n) AS left_sum FROM c WHERE n > ln)
SELECT CAST(slot AS INTEGER) AS slot, CAST(v AS DOUBLE) AS split, CAST(ln AS DOUBLE) AS left_rows, CAST(n - ln AS DOUBLE) AS right_rows,
  ROUND(mean, 6) AS start, ROUND(left_sum / (ln + 2), 6) AS left_value, ROUND(-left_sum / (n - ln + 2), 6) AS right_value
FROM g ORDER BY left_sum * left_sum / (ln + 2) + left_sum * left_sum / (n - ln + 2) DESC, slot, v LIMIT 1"""


@query("boosted_split", SPLIT_SQL)
def boosted_split(spark, sf_dir):
    """The first split that boosting finds among all of four slots over the training rows, with an L2 term of 2."""
    rows = with_calendar(train_rows(load_panel(spark, sf_dir), TRAIN_END)).select("sales", F.array(*[
        F.col(c).cast("double") for c in ("store", "item", "dayofweek", "month")]).alias("slots"))
    forest = boost(rows, BoostingParams(rounds=1, rate=1.0, max_depth=1, l2=2.0, min_rows=1))
    first, start = forest.filter("tree = 1"), forest.filter("tree = 0").select(F.col("value")[0]).scalar()
    return rounded(first.select(
        F.col("slot")[0].alias("slot"), F.col("split")[0].alias("split"), F.col("cover")[1].alias("left_rows"),
        F.col("cover")[2].alias("right_rows"), start.alias("start"), F.col("value")[1].alias("left_value"),
        F.col("value")[2].alias("right_value")))


@query("score_batch")
def score_batch(spark, sf_dir):
    """One row per request of a CSV batch: its forecast, or why it was rejected; unknown ids go through the fallback."""
    path = fresh_path(spark, "batch")
    tables.write_csv(_request_texts(spark, sf_dir), path)
    checked = requests.check_requests(requests.read_requests_csv(spark, path), ranges=None)
    return rounded(scoring.score_all(trained(spark, sf_dir).best, checked))


# What any fitted model must satisfy, counted per reason; the twin derives the counts from the requests alone.
BATCH_SQL = f"""WITH {PANEL_SQL},
r AS (SELECT CASE isodow(date) WHEN 7 THEN 'missing date' WHEN 1 THEN 'bad date' WHEN 3 THEN 'bad store'
        WHEN 2 THEN CASE WHEN month(date) < 10 OR day(date) < 10 THEN 'bad date' END END AS reason FROM panel)
SELECT coalesce(reason, 'scored') AS outcome, COUNT(*) AS n_requests,
  CAST(COUNT(*) FILTER (reason IS NULL) AS BIGINT) AS n_forecasts, CAST(0 AS BIGINT) AS n_negative,
  CAST(0 AS BIGINT) AS n_misrounded FROM r GROUP BY 1"""


@query("score_batch_outcomes", BATCH_SQL)
def score_batch_outcomes(spark, sf_dir):
    """Requests, forecasts and broken promises per outcome of the batch."""
    path = fresh_path(spark, "batch")
    tables.write_csv(_request_texts(spark, sf_dir), path)
    checked = requests.check_requests(requests.read_requests_csv(spark, path), ranges=None)
    rows = scoring.score_all(trained(spark, sf_dir).best, checked)
    return rows.groupBy(F.coalesce("reject_reason", F.lit("scored")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.count("forecast").alias("n_forecasts"),
        F.count_if(F.col("forecast") < 0).alias("n_negative"),
        F.count_if(F.col("predicted_sales") != F.bround("forecast", 2)).alias("n_misrounded"),
    )


@query("score_summary")
def score_summary(spark, sf_dir):
    rows = test_rows(load_panel(spark, sf_dir), VAL_END).select("date", "store", "item")
    return rounded(scoring.score_summary(scoring.score(trained(spark, sf_dir).best, rows)))


@query("horizon_forecast")
def horizon_forecast(spark, sf_dir):
    """Ninety days ahead for every series, starting the day after its own last sale."""
    last = load_panel(spark, sf_dir).groupBy("store", "item").agg(F.max("date").alias("last"))
    rows = last.select(
        F.explode(day_range(F.date_add("last", 1), F.lit(90))).alias("date"), "store", "item"
    )
    return rounded(scoring.score(trained(spark, sf_dir).best, rows))


@query("fact_forecast")
def fact_forecast(spark, sf_dir):
    plan = scoring.plan_forecast(trained(spark, sf_dir).best, load_panel(spark, sf_dir), 90)
    return rounded(accuracy.fact_forecast(plan))


@query("stream_score")
def stream_score(spark, sf_dir):
    """Write the panel's keys as request files, score them as a stream, read the sink."""
    arriving, store, out = (fresh_path(spark, n) for n in ("requests", "models", "scored"))
    texts = _request_texts(spark, sf_dir)
    texts.write.parquet(arriving)
    publish_model(trained(spark, sf_dir).best, store, version=1)
    stream = score_stream(spark, arriving, store, out)
    stream.awaitTermination()
    scored = spark.read.parquet(f"{out}/scored").select(
        "request_id", "date", "store", "item", "forecast", "predicted_sales", "demand_level", "model_version")
    rejected = spark.read.parquet(f"{out}/rejected").select("request_id", "reject_reason")
    return rounded(scored.unionByName(rejected, allowMissingColumns=True))


# Promises of the model queries that hold whatever was learned; the twin counts rows from the panel.
PROMISES_SQL = f"""WITH {PANEL_SQL},
n AS (SELECT (SELECT COUNT(*) FROM panel WHERE date > DATE '{VAL_END}') AS test_rows,
             (SELECT COUNT(DISTINCT (store, item)) FROM panel) AS series)
SELECT unnest(['feature_vector', 'horizon_forecast', 'fact_forecast', 'model_comparison', 'feature_importance']) AS name,
       unnest([test_rows, 90 * series, 90 * series, 3, 12]) AS n_rows, CAST(0 AS BIGINT) AS n_broken FROM n"""


@query("model_promises", PROMISES_SQL)
def model_promises(spark, sf_dir):
    """Rows of the model queries, and rows that break what each promises."""
    comparison = trained(spark, sf_dir).comparison
    best = comparison.filter(F.col("model") == trained(spark, sf_dir).champion).select("val_smape").scalar()
    broken = {
        "feature_vector": (lambda *at: training.slot_rows(trained(*at).best, test_rows(load_panel(*at), VAL_END)),
                           (F.size("slots") != 38) | F.exists("slots", lambda x: x.isNull() | F.isnan(x))),
        "horizon_forecast": (horizon_forecast, (F.col("forecast") < 0) | (F.abs(F.col("predicted_sales") - F.col("forecast")) > 0.00501)),
        "fact_forecast": (fact_forecast, F.col("Forecast") < 0),
        "model_comparison": (lambda *_: comparison, (F.col("val_smape") < best) | (
            F.abs(F.col("overfit_gap") - F.col("val_smape") + F.col("train_smape")) > 1e-9)),
        "feature_importance": (feature_importance, ~F.col("importance").between(0, 1)),
    }
    parts = [
        build(spark, sf_dir).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"),
                                 F.count_if(~F.coalesce(~wrong, F.lit(False))).alias("n_broken"))
        for name, (build, wrong) in broken.items()]
    return reduce(DataFrame.unionByName, parts)
