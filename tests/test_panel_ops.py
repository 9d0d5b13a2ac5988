import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfweave.operators import explore, grid, quality, splits
from shelfweave.operators.quantiles import exact_quantiles, medians
from shelfweave.schemas import PANEL
from tests.conftest import closed_form

KEY = ("date", "store", "item")


def random_panel(spark, n, seed=0):
    rng = random.Random(seed)
    keys = {(dt.date(2017, 1, 1) + dt.timedelta(days=rng.choice([0] * 8 + list(range(30)))),
             rng.choice([1] * 6 + [2, 3, 4]), rng.randrange(1, 40)) for _ in range(n)}
    return spark.createDataFrame([(*k, rng.randrange(100)) for k in sorted(keys)], PANEL)


def test_profile_counts_gaps_duplicates_and_missing(spark):
    d = dt.date
    rows = spark.createDataFrame(
        [(d(2017, 1, 1), 1, 1, 5), (d(2017, 1, 1), 1, 1, 5), (d(2017, 1, 2), 2, 1, None),
         (d(2017, 1, 3), None, 2, 7)], PANEL,
    )
    got = quality.panel_profile(rows).first().asDict()
    assert got == {
        "n_rows": 4, "n_columns": 4, "first_date": d(2017, 1, 1), "last_date": d(2017, 1, 3), "n_stores": 2,
        "n_items": 2, "n_dates": 3, "n_series": 2, "missing_cells": 2, "duplicate_keys": 1,
        "expected_rows": 12, "absent_rows": 8,
    }


def test_complete_panel_has_no_gap(panel):
    got = quality.panel_profile(panel).first()
    assert (got.n_rows, got.absent_rows, got.duplicate_keys) == (240, 0, 0)
    sketched = quality.panel_profile(panel, approximate=True).first()
    assert (sketched.n_stores, sketched.n_series) == (2, 4) and abs(sketched.n_dates - 60) <= 6


def test_describe_matches_numpy(spark):
    rows = random_panel(spark, 300)
    values = [r.sales for r in rows.collect()]
    got = quality.describe_target(rows).first()
    want = [np.mean(values), np.std(values, ddof=1), min(values), *np.quantile(values, [0.25, 0.5, 0.75]), max(values)]
    assert got["count"] == len(values)
    assert list(got[1:]) == pytest.approx([round(float(w), 2) for w in want], abs=0.0051)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=200),
       st.lists(st.floats(0, 1), min_size=1, max_size=3, unique=True))
def test_quantiles_are_exact(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x DOUBLE").withColumn(
        "y", F.lit(3.0))
    got = {(r.name, r.prob): r.quantile for r in exact_quantiles(df, ["x", "y"], probs).collect()}
    for p in probs:
        assert got[("x", p)] == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-9)
        assert got[("y", p)] == 3.0


def test_quantiles_with_a_crowded_value_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.when(F.col("id") < 1000, 5.0).otherwise(F.col("id") / 7).alias("x"))
        values = [r.x for r in df.collect()]
        got = {r.prob: r.quantile for r in exact_quantiles(df, ["x"], [0.1, 0.5, 0.999]).collect()}
        assert got == pytest.approx({p: float(np.quantile(values, p)) for p in got})
        assert medians(df, ["x"]) == pytest.approx({"x": float(np.median(values))})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_split_boundaries_are_inclusive_and_open_ended(spark):
    rows = closed_form(spark, days=60)
    got = {r.split: (str(r.first_date), str(r.last_date)) for r in
           splits.split_summary(rows, "2017-01-10", "2017-01-20").collect()}
    assert got == {"train": ("2017-01-01", "2017-01-10"), "validation": ("2017-01-11", "2017-01-20"),
                   "test": ("2017-01-21", "2017-03-01")}
    assert splits.train_rows(rows, "2017-01-10").count() + splits.validation_rows(
        rows, "2017-01-10", "2017-01-20").count() + splits.test_rows(rows, "2017-01-20").count() == rows.count()


@pytest.mark.parametrize("n,k,seed", [(300, 2, 0), (301, 3, 1), (40, 5, 2), (9, 8, 3)])
def test_folds_match_positions_in_key_order(spark, n, k, seed):
    rows = random_panel(spark, n, seed).cache()
    keys = sorted(tuple(r[c] for c in KEY) for r in rows.collect())
    total, size = len(keys), len(keys) // (k + 1)
    folds = splits.expanding_folds(rows, k)
    labelled = splits.fold_rows(rows, folds).collect()
    for j, fold in enumerate(folds):
        start = total - (k - j) * size
        train = sorted(tuple(r[c] for c in KEY) for r in fold.train(rows).collect())
        test = sorted(tuple(r[c] for c in KEY) for r in fold.test(rows).collect())
        assert train == keys[:start] and test == keys[start:start + size]
        for role, want in (("train", train), ("test", test)):
            assert sorted(tuple(r[c] for c in KEY) for r in labelled if (r.fold, r.role) == (j, role)) == want


def test_too_few_rows_for_folds(spark):
    with pytest.raises(ValueError, match="folds"):
        splits.expanding_folds(random_panel(spark, 3), 7)


def test_fold_filter_reaches_the_scan(spark, tmp_path):
    rows = random_panel(spark, 200)
    rows.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = splits.expanding_folds(stored, 2)[0].train(stored)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(date" in plan


def test_rolling_mean_needs_thirty_rows(panel):
    got = explore.rolling_daily_mean(panel).orderBy("date").collect()
    assert [r.rolling_mean is None for r in got[:31]] == [True] * 29 + [False] * 2
    assert got[29].rolling_mean == pytest.approx(sum(r.units for r in got[:30]) / 30)
    series = explore.rolling_series_mean(panel).filter("rolling_mean IS NOT NULL").count()
    assert series == 4 * (60 - 29)


def test_growth_uses_the_years_present(spark):
    rows = spark.createDataFrame(
        [(dt.date(y, 5, 1), 1, 1, u) for y, u in ((2013, 100), (2014, 150), (2015, 400))], PANEL)
    assert explore.yearly_growth(rows).first()[:] == (2013, 2015, 3, pytest.approx(1.0))
    assert explore.yearly_growth(rows.filter("year(date) = 2013")).first().growth is None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.integers(1, 12))
def test_histogram_matches_numpy(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values], "x DOUBLE")
    got = explore.histogram(df, "x", bins).orderBy("bin").collect()
    counts, edges = np.histogram([float(v) for v in values], bins=bins)
    assert [r.n for r in got] == counts.tolist()
    assert [r.bin_from for r in got] + [got[-1].bin_to] == pytest.approx(edges.tolist())


def test_recent_history_keeps_the_last_rows_of_each_series(panel):
    got = explore.recent_history(panel, rows=7)
    assert got.groupBy("store", "item").count().filter("count != 7").count() == 0
    assert str(got.agg(F.min("date")).first()[0]) == "2017-02-23"
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_pivot_totals_are_means_over_rows(panel):
    rows = {(r.month, r.is_total): r for r in explore.store_month_pivot(panel, [1, 2], totals=True).collect()}
    assert rows[(None, 1)].all_stores == pytest.approx(panel.agg(F.avg("sales")).first()[0])
    plain = {r.month: r for r in explore.store_month_pivot(panel, [1, 2]).collect()}
    assert rows[(1, 0)].store_2 == pytest.approx(plain[1].store_2)


def test_future_grid_and_arrays(spark, panel):
    plan = grid.plan_grid(panel, 90)
    assert plan.count() == 4 * 90
    assert [str(d) for d in plan.agg(F.min("date"), F.max("date")).first()] == ["2017-03-02", "2017-05-30"]
    scored = plan.withColumn("forecast", F.col("store") * 1.0)
    arrays = grid.forecast_arrays(scored)
    back = grid.explode_arrays(arrays)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, scored.select(*back.columns).collect()))
    lines = grid.history_plus_forecast(panel, scored)
    assert dict(lines.groupBy("series").count().collect()) == {"history": 240, "forecast": 360}


def test_folds_keep_rows_without_ids(spark):
    days = [dt.date(2017, 1, d) for d in (1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2)] * 2
    rows = [(d, None if i % 5 == 0 else i % 3, None if i % 7 == 0 else i, 1) for i, d in enumerate(days)]
    ragged = spark.createDataFrame(rows, "date DATE, store INT, item INT, sales BIGINT")
    for fold in splits.expanding_folds(ragged, 2):
        train, test = fold.train(ragged).count(), fold.test(ragged).count()
        assert train + test == (16 if fold.index == 0 else 24) and test == 8


@pytest.mark.parametrize("periods,days", [(7, 7), (365, 365), (1000, 1000), (0, 0), (-3, 0)])
def test_horizon_of_any_length(spark, panel, periods, days):
    series = panel.select("store", "item").distinct()
    assert grid.future_grid(series, dt.date(2018, 1, 1), periods).count() == 4 * days


def test_absent_ranges_add_up_to_the_absent_rows(spark):
    rows = random_panel(spark, 700, seed=3)
    ranges = quality.absent_ranges(rows)
    profile = quality.panel_profile(rows).first()
    unseen = profile.n_stores * profile.n_items - profile.n_series
    assert sum(r.n_days for r in ranges.collect()) + unseen * profile.n_dates == profile.absent_rows
    held, days = {}, sorted({r.date for r in rows.collect()})
    for r in rows.collect():
        held.setdefault((r.store, r.item), set()).add(r.date)
    got = {}
    for r in ranges.collect():
        assert r.first_date not in held[r.store, r.item]
        run = [d for d in days if r.first_date <= d <= r.last_date]
        assert len(run) == r.n_days and got.setdefault((r.store, r.item), set()).isdisjoint(run)
        got[r.store, r.item].update(run)
        # a run cannot be made longer
        near = [i for i in (days.index(r.first_date) - 1, days.index(r.last_date) + 1) if 0 <= i < len(days)]
        assert all(days[i] in held[r.store, r.item] for i in near)
    assert all(got.get(s, set()) == set(days) - d for s, d in held.items())


def test_absent_ranges_of_awkward_panels(spark):
    d = dt.date
    rows = spark.createDataFrame(
        [(d(2017, 1, 1), 1, 1, 5), (d(2017, 1, 1), 1, 1, 5), (d(2017, 1, 9), 1, 1, 5), (d(2017, 1, 4), 2, 1, 1),
         (None, 2, 1, 1), (d(2017, 1, 9), None, 1, 1)], PANEL)
    got = sorted(map(tuple, quality.absent_ranges(rows).collect()))
    assert got == [(1, 1, d(2017, 1, 4), d(2017, 1, 4), 1), (2, 1, d(2017, 1, 1), d(2017, 1, 1), 1), (2, 1, d(2017, 1, 9), d(2017, 1, 9), 1)]
    assert quality.absent_ranges(spark.createDataFrame([], PANEL)).count() == 0


def test_undated_rows_are_counted(spark, tmp_path):
    from shelfweave.sources.panel import write_splits

    rows = spark.createDataFrame([(dt.date(2017, 1, 1), 1, 1, 5), (None, 1, 1, 7), (None, 2, 1, 9)], PANEL)
    got = {r.split: (r.n_rows, r.mean_sales) for r in splits.split_summary(rows, "2017-01-10", "2017-01-20").collect()}
    assert got == {"train": (1, 5.0), "undated": (2, 8.0)}
    write_splits(rows, str(tmp_path / "s"), "2017-01-10", "2017-01-20")
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 3 and stored.filter("split = 'undated'").count() == 2
