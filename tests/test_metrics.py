import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfweave.functions import metrics
from shelfweave.functions.scoring import clip_at_zero, demand_level, round_units
from shelfweave.operators.accuracy import fact_test_forecast, smape_by, smape_spread
from shelfweave.operators.ml_stages import SmapeEvaluator


def smape(spark, pairs):
    df = spark.createDataFrame([(float(a), float(f)) for a, f in pairs], "sales DOUBLE, prediction DOUBLE")
    return SmapeEvaluator(labelCol="sales", predictionCol="prediction").evaluate(df)


def test_smape_fixed_points(spark):
    assert smape(spark, [(10, 10), (20, 20), (30, 30)]) == 0.0
    assert smape(spark, [(0, 0), (10, 10)]) == 0.0
    assert smape(spark, [(10, 20)]) == pytest.approx(smape(spark, [(20, 10)]))
    assert smape(spark, [(10, 0)]) == pytest.approx(200.0)
    assert SmapeEvaluator().isLargerBetter() is False


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 500)), min_size=1, max_size=30))
def test_smape_is_bounded_and_symmetric(spark, pairs):
    value = smape(spark, pairs)
    assert 0.0 <= value <= 200.0 + 1e-9
    assert value == pytest.approx(smape(spark, [(f, a) for a, f in pairs]))


def test_all_metrics_in_one_pass(spark):
    y, f = [3.0, 5.0, 8.0, 0.0], [2.0, 5.0, 10.0, 0.0]
    df = spark.createDataFrame(list(zip(y, f)), "sales DOUBLE, forecast DOUBLE")
    got = metrics.evaluate(df).first()
    mean = sum(y) / 4
    square = sum((a - b) ** 2 for a, b in zip(y, f))
    assert got.n_rows == 4
    assert got.rmse == pytest.approx(math.sqrt(square / 4))
    assert got.mae == pytest.approx(0.75)
    assert got.r2 == pytest.approx(1 - square / sum((a - mean) ** 2 for a in y))
    assert got.bias_pct == pytest.approx((sum(f) - sum(y)) / sum(y) * 100)


def test_metrics_are_blank_when_undefined(spark):
    got = metrics.evaluate(spark.createDataFrame([(0.0, 1.0)], "sales DOUBLE, forecast DOUBLE")).first()
    assert got.r2 is None and got.bias_pct is None and got.smape == 200.0


def test_clip_round_and_level(spark):
    rows = spark.createDataFrame(
        [(-3.0, 10.0), (7.99, 10.0), (8.0, 10.0), (12.0, 10.0), (12.001, 10.0), (5.0, 0.0),
         (float("nan"), 10.0), (0.125, 1.0), (5.0, None)],
        "raw DOUBLE, mean DOUBLE",
    )
    clipped = clip_at_zero(F.col("raw"))
    got = [
        tuple(r) for r in rows.select(round_units(clipped), demand_level(clipped, F.col("mean"))).collect()
    ]
    assert [g[1] for g in got] == [
        "Low", "Low", "Normal", "Normal", "High", "Unknown", "Unknown", "Low", "Unknown"
    ]
    assert got[0][0] == 0.0 and got[7][0] == 0.12  # ties go to even


def test_level_uses_the_unrounded_forecast(spark):
    rows = spark.createDataFrame([(0.7999, 1.0)], "raw DOUBLE, mean DOUBLE")
    assert rows.select(round_units("raw"), demand_level(F.col("raw"), F.col("mean"))).first()[:] == (0.8, "Low")


def test_per_store_smape_and_row_errors(spark):
    rows = spark.createDataFrame(
        [("2017-01-07", 1, 1, 10, 20.0), ("2017-01-07", 2, 1, 10, 10.0), ("2017-01-08", 2, 1, 0, 0.0)],
        "date STRING, store INT, item INT, sales BIGINT, forecast DOUBLE",
    ).withColumn("date", F.col("date").cast("date"))
    assert dict(smape_by(rows, "store").collect()) == {1: pytest.approx(200 / 3), 2: 0.0}
    assert smape_spread(rows).first()[:] == pytest.approx((0.0, 200 / 3, 200 / 3))
    fact = fact_test_forecast(rows).orderBy("date", "Store").first()
    assert (fact.AbsError, fact.SmapePct, fact.Day) == (10.0, pytest.approx(200 / 3), "Sat")
