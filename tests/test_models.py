import datetime as dt

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from shelfweave.operators import reports
from shelfweave.operators.ml_stages import FLAGS, NUMERIC, MedianImputer, slot_names
from shelfweave.operators.splits import expanding_folds, test_rows as rows_after, train_rows
from shelfweave.plans import scoring, training
from shelfweave.schemas import REPORT_TABLES
from shelfweave.sources import tables
from shelfweave.streaming.request_log import stream_metrics, windowed_metrics
from shelfweave.streaming.scorer import ModelSource, publish_model, score_stream
from tests.conftest import requests_of

TRAIN_END, VAL_END = "2017-10-31", "2017-11-30"
PARAMS = {
    "gbt_squared": {"maxIter": 12, "maxDepth": 4, "stepSize": 0.3, "maxBins": 64},
    "random_forest": {"numTrees": 10, "maxDepth": 6, "maxBins": 64},
}


@pytest.fixture(scope="module")
def seasonal(spark):
    """A year and a half with a summer peak, weekends above weekdays, two stores, two items."""
    day = F.date_add(F.lit("2016-07-01").cast("date"), F.col("id").cast("int"))
    rows = (
        spark.range(550).select(day.alias("date"))
        .withColumn("store", F.explode(F.array(F.lit(1), F.lit(2))))
        .withColumn("item", F.explode(F.array(F.lit(1), F.lit(2))))
    )
    season = -10 * F.cos(F.dayofyear("date") * 2 * F.pi() / 365.25)
    units = F.col("store") * 20 + F.col("item") * 3 + season + 6 * (F.weekday("date") >= 5).cast("int")
    return rows.withColumn("sales", F.round(units).cast("bigint")).cache()


@pytest.fixture(scope="module")
def trained(seasonal):
    return training.train_candidates(seasonal, TRAIN_END, VAL_END, PARAMS)


def test_vector_has_38_named_slots_in_order(trained, seasonal):
    head = PipelineModel(trained.best.stages[:-1])
    vectors = head.transform(seasonal.filter("date = '2017-07-01'"))
    names = slot_names(vectors)
    assert len(names) == 38 and names[:16] == NUMERIC and names[-3:] == FLAGS
    row = dict(zip(names, vectors.select(vector_to_array("features").alias("f")).first().f))
    assert row["month_onehot_7"] == 1.0 and sum(v for k, v in row.items() if k.startswith("month_onehot")) == 1.0
    assert row["dayofweek_onehot_5"] == 1.0 and row["is_month_start"] == 1.0


def test_missing_date_gives_zero_categories_and_medians(trained, spark):
    rows = spark.createDataFrame([(None, None, None)], "date DATE, store INT, item INT")
    head = PipelineModel(trained.best.stages[:-1])
    vectors = head.transform(rows)
    row = dict(zip(slot_names(vectors), vectors.select(vector_to_array("features").alias("f")).first().f))
    assert sum(v for k, v in row.items() if "onehot" in k) == 0.0
    assert row["store"] == 1.5 and trained.best.stages[1].values["store"] == 1.5


def test_imputer_is_the_exact_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,), (None,), (float("nan"),)], "a DOUBLE")
    filled = MedianImputer(inputCols=["a"]).fit(df).transform(df)
    assert sorted(r.a for r in filled.collect()) == [1.0, 2.0, 6.0, 6.0, 10.0, 20.0]


def test_champion_has_the_lowest_validation_smape(trained):
    rows = trained.comparison.collect()
    assert trained.champion == min(rows, key=lambda r: (r.val_smape, r.model)).model == rows[0].model
    for r in rows:
        assert r.overfit_gap == pytest.approx(r.val_smape - r.train_smape)
        assert 0 <= r.val_smape <= 200 and r.fit_seconds > 0


def test_model_beats_the_mean_baseline(trained, seasonal):
    test = rows_after(seasonal, VAL_END)
    report = training.champion_report(trained, seasonal, VAL_END).first()
    mean = train_rows(seasonal, TRAIN_END).agg(F.avg("sales")).first()[0]
    flat = test.agg(F.avg(F.abs(F.col("sales") - mean))).first()[0]
    assert report.model == trained.champion and report.mae < 0.5 * flat


def test_reloaded_model_scores_the_same(trained, seasonal, tmp_path):
    rows = rows_after(seasonal, VAL_END)
    path = str(tmp_path / "model")
    trained.best.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert loaded.stages[0].learned.global_mean == trained.best.stages[0].learned.global_mean
    keys = ["date", "store", "item", "forecast"]
    assert sorted(map(tuple, training.predict(loaded, rows).select(*keys).collect())) == sorted(
        map(tuple, training.predict(trained.best, rows).select(*keys).collect()))
    # saved over the folder it came from, the model is still whole
    loaded.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert sorted(map(tuple, training.predict(again, rows).select(*keys).collect())) == sorted(
        map(tuple, training.predict(loaded, rows).select(*keys).collect()))


def test_single_request_and_unseen_entity(trained, spark):
    scored = scoring.score(trained.best, requests_of(spark, ("2018-01-15", 1, 1), ("2018-01-15", 99, 999)))
    rows = scored.collect()
    assert len(rows) == 2 and all(r.forecast >= 0 and r.demand_level in ("Low", "Normal", "High") for r in rows)
    assert all(r.predicted_sales == pytest.approx(r.forecast, abs=0.0051) for r in rows)
    summary = scoring.score_summary(scored).first()
    assert (summary.n_rows, summary.total_units) == (2, pytest.approx(sum(r.forecast for r in rows)))


def test_extra_columns_pass_and_missing_ones_raise(trained, spark):
    rows = requests_of(spark, ("2018-01-15", 1, 1)).withColumn("note", F.lit("x"))
    assert scoring.score(trained.best, rows).first().note == "x"
    with pytest.raises(ValueError, match=r"\['store'\]"):
        scoring.score(trained.best, rows.drop("store"))


def test_summer_above_winter(trained, spark):
    rows = requests_of(spark, ("2018-01-16", 1, 1), ("2018-07-17", 1, 1))
    check = scoring.seasonal_check(
        scoring.score(trained.best, rows), F.month("date") == 7, F.month("date") == 1).first()
    assert check.summer_above_winter


def test_importance_and_drivers_rank_named_slots(trained, seasonal):
    importance = training.feature_importance(trained.best, seasonal).collect()
    assert len(importance) == 38 and sum(r.importance for r in importance) == pytest.approx(1.0)
    assert training.feature_importance(trained.best, seasonal, top=12).count() == 12
    drivers = training.ablation_drivers(
        trained.best, train_rows(seasonal, TRAIN_END), rows_after(seasonal, VAL_END)).collect()
    unused = {r.feature for r in importance if r.importance == 0}
    assert len(drivers) == 38 and all(r.mean_abs_attribution == 0 for r in drivers if r.feature in unused)
    assert drivers[0].mean_abs_attribution > 0
    assert "mean" in drivers[0].feature or drivers[0].feature == "store"


def test_one_ablation_by_hand(trained, seasonal):
    rows = seasonal.filter("date = '2017-12-05'")
    train = train_rows(seasonal, TRAIN_END)
    got = {r.feature: r.mean_abs_attribution for r in training.ablation_drivers(trained.best, train, rows).collect()}
    features, fill, *rest = trained.best.stages
    tail = PipelineModel(rest)
    mean = fill.transform(features.transform(train)).agg(F.avg("store_item_dow_mean")).first()[0]
    base = fill.transform(features.transform(rows))
    before = {(r.store, r.item): r.prediction for r in tail.transform(base).collect()}
    after = {(r.store, r.item): r.prediction for r in
             tail.transform(base.withColumn("store_item_dow_mean", F.lit(mean))).collect()}
    assert got["store_item_dow_mean"] == pytest.approx(sum(abs(before[k] - after[k]) for k in before) / len(before))


def test_random_draws_are_distinct_and_repeatable():
    grid = training.GRIDS["gbt_squared"]
    draws = training.draw_params(grid, 8)
    assert draws == training.draw_params(grid, 8) and len({str(d) for d in draws}) == 8
    assert all(point[k] in grid[k] for point in draws for k in grid)
    small = {"a": [1, 2], "b": [3]}
    assert sorted(map(str, training.draw_params(small, 8))) == sorted(map(str, [{"a": 1, "b": 3}, {"a": 2, "b": 3}]))


@pytest.mark.parametrize("name", sorted(training.GRIDS))
def test_full_grid_points_are_accepted(trained, seasonal, name):
    point = training.draw_params(training.GRIDS[name], 1)[0]
    size = "numTrees" if name == "random_forest" else "maxIter"
    vectors = PipelineModel(trained.best.stages[:-1]).transform(seasonal.filter("date < '2016-10-01'"))
    small = {**point, size: 2, "maxDepth": 3}
    fitted = training.regressor(name, **small).fit(vectors)
    assert fitted.getNumTrees == 2


def test_search_scores_every_draw_on_every_fold(seasonal):
    budget = training.Budget(
        grids={"random_forest": {"numTrees": [3, 5], "maxDepth": [3], "maxBins": [64]}}, draws=8, folds=2)
    scores = training.search(train_rows(seasonal, TRAIN_END), budget).cache()
    assert scores.count() == 4 and scores.filter("smape < 0 OR smape > 200 OR smape IS NULL").count() == 0
    best = training.best_params(scores).first()
    means = {r.params: r.m for r in scores.groupBy("params").agg(F.avg("smape").alias("m")).collect()}
    assert best.cv_smape == pytest.approx(min(means.values()))


def test_tuning_refits_the_best_point_of_each_candidate(seasonal):
    budget = training.Budget(
        grids={"random_forest": {"numTrees": [3], "maxDepth": [2, 5], "maxBins": [64]},
               "gbt_squared": {"maxIter": [2], "maxDepth": [3], "maxBins": [64]}}, draws=2, folds=2)
    tuned = training.tune(seasonal, TRAIN_END, VAL_END, budget)
    rows = {r.model: r for r in tuned.comparison.collect()}
    assert set(rows) == {"random_forest", "gbt_squared"} and all(r.cv_smape > 0 for r in rows.values())
    assert tuned.models["random_forest"].stages[-1].getOrDefault("maxDepth") == 5
    assert tuned.champion == min(rows.values(), key=lambda r: r.val_smape).model


def test_each_fold_learns_its_own_means(seasonal):
    rows = train_rows(seasonal, TRAIN_END)
    means = []
    for fold in expanding_folds(rows, 2):
        model = Pipeline(stages=training.feature_stages()[:1]).fit(fold.train(rows)).stages[0]
        assert model.learned.global_mean == pytest.approx(fold.train(rows).agg(F.avg("sales")).first()[0])
        means.append(model.learned.global_mean)
    assert means[0] != means[1]


def test_metadata_record_is_rounded(trained, seasonal, spark, tmp_path):
    record = training.metadata_record(trained, seasonal, TRAIN_END, VAL_END)
    tables.write_metadata(spark, record, str(tmp_path / "m"))
    row = tables.read_metadata(spark, str(tmp_path / "m")).first()
    assert len(row) == 11 and row.best_model == trained.champion
    assert row.val_smape == pytest.approx(record["val_smape"], abs=5.1e-5) and row.val_smape == round(row.val_smape, 4)
    assert row.n_training_rows == train_rows(seasonal, TRAIN_END).count()


def test_report_side_tables(trained, seasonal, spark, tmp_path):
    record = training.metadata_record(trained, seasonal, TRAIN_END, VAL_END)
    tables.write_metadata(spark, record, str(tmp_path / "m"))
    facts = dict(reports.model_metrics(tables.read_metadata(spark, str(tmp_path / "m"))).collect())
    assert len(facts) == 7 and facts["Best Model"] == trained.champion
    table = reports.model_comparison(trained.comparison)
    assert table.schema.simpleString() == REPORT_TABLES["ModelComparison"].simpleString()
    twice = reports.comparison_by_model(table.unionByName(table)).collect()
    assert twice[0].Model == trained.champion
    assert twice[0]["Test MAE"] == pytest.approx(2 * table.filter(F.col("Model") == trained.champion).first()["Test MAE"])
    names = spark.createDataFrame(
        [("month_onehot_7", 1.0), ("store_item_mean", 2.0)], "feature STRING, mean_abs_attribution DOUBLE")
    assert {r.Feature for r in reports.demand_drivers(names).collect()} == {"month 7", "store item mean"}


def text_requests(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id BIGINT, date STRING, store STRING, item STRING").coalesce(1)


def test_stream_scores_rejects_and_picks_up_a_new_model(trained, seasonal, spark, tmp_path):
    arriving, store, out = (str(tmp_path / n) for n in ("in", "models", "out"))
    text_requests(spark, (1, "2018-01-15", "1", "1"), (2, "2018-01-15", "99", "1")).write.parquet(arriving)
    publish_model(trained.best, store, 1)
    score_stream(spark, arriving, store, out).awaitTermination()
    other = next(m for n, m in trained.models.items() if n != trained.champion)
    publish_model(other, store, 2)
    text_requests(spark, (3, "2018-01-16", "2", "2"), (4, "16/01/2018", "1", "1")).write.mode("append").parquet(arriving)
    score_stream(spark, arriving, store, out).awaitTermination()
    score_stream(spark, arriving, store, out).awaitTermination()  # nothing new: nothing repeated
    scored = spark.read.parquet(f"{out}/scored").collect()
    assert sorted((r.request_id, r.model_version) for r in scored) == [(1, 1), (3, 2)]
    rejected = spark.read.parquet(f"{out}/rejected").collect()
    assert sorted((r.request_id, r.reject_reason) for r in rejected) == [(2, "store out of range"), (4, "bad date")]


def test_without_a_model_the_stream_says_so(spark, tmp_path):
    (tmp_path / "versions").mkdir()
    with pytest.raises(RuntimeError, match="no model"):
        ModelSource(str(tmp_path)).current(spark)


def test_streamed_request_metrics_equal_the_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=7 * i), "predict" if i % 3 else "batch", float(i)) for i in range(60)]
    rows.append((start + dt.timedelta(days=3), "predict", 1.0))  # pushes the watermark past the rest
    schema = "ts TIMESTAMP, path STRING, latency_ms DOUBLE"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    query = (
        stream_metrics(log).writeStream.outputMode("append").format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    columns = ["window_start", "path", "requests", "mean_latency_ms"]
    want = windowed_metrics(spark.createDataFrame(rows[:-1], schema)).select(*columns).collect()
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


LATE_LOG = [("2024-01-01 00:10:00", "/predict", 10.0, 1, False), ("2024-01-01 00:20:00", "/predict/batch", 30.0, 5, False),
            ("2024-01-01 09:00:00", "/predict", 20.0, 1, True), (None, "/health", 1.0, None, None), ("2024-01-01 09:10:00", None, 2.0, 0, False)]
LATER_LOG = [("2024-01-01 00:30:00", "/predict", 60.0, 2, False),  # its window has been closed
             ("2024-01-01 08:59:00", "/predict", 40.0, 3, False), ("2024-01-01 10:00:00", "/health", 1.0, None, False)]


def test_counters_go_on_after_a_restart_and_count_late_requests(spark, tmp_path):
    from shelfweave.streaming import request_log

    arriving, out = str(tmp_path / "log"), str(tmp_path / "out")
    frames = [spark.createDataFrame([tuple(r) for r in part], "at STRING, path STRING, latency_ms DOUBLE, n_scored BIGINT, failed BOOLEAN")
              .select(F.col("at").cast("timestamp").alias("ts"), "path", "latency_ms", "n_scored", "failed") for part in (LATE_LOG, LATER_LOG)]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(arriving)
        for stream in request_log.count_stream(spark, arriving, out):
            stream.awaitTermination()
    for stream in request_log.count_stream(spark, arriving, out):  # nothing new
        stream.awaitTermination()
    counted = request_log.counted(spark, out)
    batch = request_log.path_counters(frames[0].unionByName(frames[1]))
    assert sorted(map(str, counted.drop("late").collect())) == sorted(map(str, batch.collect()))
    assert {r.path: r.late for r in counted.collect()} == {"/predict": 1, "/predict/batch": 0, "/health": 1, None: 0}
    assert request_log.counted_windows(spark, out).agg(F.sum("requests")).first()[0] == 6
    record = request_log.service_record(counted).first().asDict()
    assert record == {"errors": 1, "n_scored": 11, "predict_requests": 5, "batch_requests": 1, "mean_latency_ms": 32.0}


def test_service_record_of_an_empty_log(spark):
    from shelfweave.streaming import request_log

    record = request_log.service_record(request_log.path_counters(spark.createDataFrame([], request_log.LOG))).first()
    assert tuple(record) == (0, 0, 0, 0, None)
