import pytest
from pyspark.sql import functions as F

from shelfweave.operators import joins
from shelfweave.operators.learned import (
    AGGREGATE_COLUMNS, MEAN_KEYS, baseline_forecast, demand_features, learn_demand, mean_table,
)
from shelfweave.operators.ml_stages import DemandFeatures
from tests.conftest import closed_form, requests_of


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_closed_form_means(spark, panel):
    state = learn_demand(panel)
    row = demand_features(requests_of(spark, ("2017-01-07", 2, 1)), state).first()
    assert row.store_item_dow_mean == 26.0  # a Saturday of store 2, item 1
    week_share = panel.filter("store = 2 AND item = 1").agg(F.avg("sales")).first()[0]
    assert row.store_item_mean == pytest.approx(week_share)


@pytest.mark.parametrize("name", AGGREGATE_COLUMNS)
def test_profiles_hold_the_direct_means(spark, panel, name):
    keys = MEAN_KEYS[name]
    direct = panel.withColumn("month", F.month("date")).withColumn("dayofweek", F.weekday("date"))
    want = rows_of(direct.groupBy(*keys).agg(F.avg("sales").alias(name)), *keys, name)
    assert rows_of(learn_demand(panel).means(spark, name), *keys, name) == want  # sums of integers are exact
    assert rows_of(mean_table(panel, name), *keys, name) == want


def test_fit_needs_target_and_keys(panel):
    with pytest.raises(ValueError, match="target"):
        learn_demand(panel.drop("sales"))
    with pytest.raises(ValueError, match=r"\['store'\]"):
        learn_demand(panel.drop("store"))
    with pytest.raises(ValueError, match="target"):
        DemandFeatures(labelCol="sales").fit(panel.drop("sales"))


def test_learns_from_fit_rows_only(spark):
    panel = closed_form(spark)
    early = panel.filter("date < '2017-02-01'")
    late = panel.filter("date >= '2017-02-01'").withColumn("sales", F.col("sales") * 100)
    model = DemandFeatures(labelCol="sales").fit(early)
    before = model.learned
    want = early.agg(F.avg("sales")).first()[0]
    seen = model.transform(late).agg(F.max("store_item_dow_mean")).first()[0]
    assert model.learned == before
    assert before.global_mean == pytest.approx(want)
    assert seen <= early.agg(F.max("sales")).first()[0]


def test_fallback_order(spark, panel):
    state = learn_demand(panel.filter("weekday(date) < 5"))
    rows = demand_features(requests_of(
        spark, ("2018-06-01", 99, 999), ("2018-06-02", 1, 1), ("2017-01-02", 1, 999), ("2017-01-02", 99, 1)
    ), state)
    got = {(r.store, r.item): r for r in rows.collect()}
    unseen = got[(99, 999)]
    assert [unseen[c] for c in AGGREGATE_COLUMNS] == pytest.approx([state.global_mean] * 4)
    saturday = got[(1, 1)]  # weekday never seen: the filled series mean, not the global one
    assert saturday.store_item_dow_mean == saturday.store_item_mean == 11.0
    assert got[(1, 999)].store_month_mean == pytest.approx(11.5)
    assert got[(1, 999)].item_month_mean == pytest.approx(state.global_mean)
    assert got[(99, 1)].item_month_mean == pytest.approx(16.0)


def test_null_keys_and_future_dates_never_give_null_means(spark, panel):
    state = learn_demand(panel)
    rows = requests_of(spark, ("2030-12-25", 1, 1)).unionByName(
        spark.createDataFrame([(None, None, None)], "date DATE, store INT, item INT")
    )
    out = demand_features(rows, state)
    assert out.count() == 2
    assert out.filter(" OR ".join(f"{c} IS NULL" for c in AGGREGATE_COLUMNS)).count() == 0


def test_missing_and_nan_sales_are_skipped_null_keys_dropped(spark):
    train = spark.createDataFrame(
        [("2017-01-02", 1, 1, 10.0), ("2017-01-09", 1, 1, float("nan")), ("2017-01-16", 1, 1, None),
         ("2017-01-02", None, 1, 40.0)],
        "date STRING, store INT, item INT, sales DOUBLE",
    )
    state = learn_demand(train)
    assert state.global_mean == 25.0  # the row without a store still counts globally
    assert rows_of(state.means(spark, "store_item_mean"), "store", "item", "store_item_mean") == [(1, 1, 10.0)]
    assert rows_of(state.means(spark, "item_month_mean"), "item", "month", "item_month_mean") == [(1, 1, 25.0)]


def test_joins_keep_every_row_and_its_own_columns(spark, panel):
    state = learn_demand(panel)
    tagged = panel.withColumn("row_id", F.monotonically_increasing_id()).cache()
    out = baseline_forecast(tagged, state)
    assert rows_of(out, "row_id", "store", "item") == rows_of(tagged, "row_id", "store", "item")


def test_large_lookups_give_the_same_result_without_broadcast(spark, panel, monkeypatch):
    state = learn_demand(panel.filter("date < '2017-01-20'"))
    crowd = panel.unionByName(panel.filter("store = 1 AND item = 1").withColumn("n", F.explode(
        F.sequence(F.lit(1), F.lit(50)))).drop("n"))  # one series holds most rows, as exact copies
    want = rows_of(demand_features(crowd, state), "date", "store", "item", *AGGREGATE_COLUMNS)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    merged = demand_features(crowd, state)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert rows_of(merged, "date", "store", "item", *AGGREGATE_COLUMNS) == want


def test_a_crowded_series_is_split_over_tasks(spark, panel, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    series = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.pmod(F.hash("id"), F.lit(500)))
    # copies of one row make up a third of the facts
    facts = spark.range(0, 120_000, 1, 16).select(
        F.lit("2017-01-02").cast("date").alias("date"), (series / 50).cast("int").alias("store"),
        (series % 50).cast("int").alias("item"),
    )
    state = learn_demand(facts.distinct().withColumn("sales", F.col("store") * 100 + F.col("item")))
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        out = baseline_forecast(facts, state).filter("forecast = store * 100 + item")
        out = out.groupBy("store", "item").count()
        assert sum(r["count"] for r in out.collect()) == 120_000
        assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_feature_names_follow_the_columns(panel):
    model = DemandFeatures(labelCol="sales").fit(panel)
    request = panel.select("date", "store", "item")
    assert model.feature_names(request.columns) == model.transform(request).columns


def means_of(state, spark):
    return {n: sorted(tuple(r) for r in state.means(spark, n).select(*MEAN_KEYS[n], n).collect()) for n in AGGREGATE_COLUMNS}


def test_merged_state_equals_relearning_at_every_cut(spark):
    import datetime as dt

    from shelfweave.operators.learned import demand_state
    from shelfweave.operators.splits import expanding_folds, key_before

    panel = closed_form(spark, days=100).withColumn("sales", F.col("sales") + F.dayofmonth("date"))
    undated = panel.limit(2).withColumn("date", F.lit(None).cast("date"))
    panel = panel.unionByName(undated).cache()
    state = demand_state(panel)
    cuts = [fold.start for fold in expanding_folds(panel, 4)]
    cuts += [(dt.date(2017, 2, 1), 1, 1), (dt.date(2017, 1, 31), 2, 2), (dt.date(2016, 1, 1), 1, 1), (dt.date(2030, 1, 1), 1, 1)]
    for cut in cuts:
        merged, again = state.learn_before(panel, cut), learn_demand(panel.filter(key_before(cut)))
        assert means_of(merged, spark) == means_of(again, spark)
        assert merged.global_mean == again.global_mean


def test_a_new_day_merges_into_the_state(spark):
    import datetime as dt

    from shelfweave.operators.learned import demand_state

    panel = closed_form(spark, days=60)
    day = F.lit("2017-02-20").cast("date")
    state = demand_state(panel.filter(F.col("date") < day))
    state.add(panel.filter(F.col("date") >= day))
    end = (dt.date(2017, 3, 31), 1, 1)
    assert means_of(state.learn_before(panel, end), spark) == means_of(learn_demand(panel), spark)


def test_learning_from_state_reads_only_the_cut_month(spark, tmp_path):
    import datetime as dt

    from shelfweave.operators.learned import demand_state

    path = str(tmp_path / "panel")
    closed_form(spark, days=100).write.parquet(path)
    panel = spark.read.parquet(path)
    state = demand_state(panel)
    older = panel.filter(F.col("date") < F.lit("2017-03-01").cast("date"))
    # what was read of earlier months cannot matter: without them the same means come out
    rest = panel.join(older, ["date", "store", "item"], "left_anti")
    cut = (dt.date(2017, 3, 15), 2, 1)
    assert means_of(state.learn_before(rest, cut), spark) == means_of(state.learn_before(panel, cut), spark)
