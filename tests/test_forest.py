"""Exported ensembles against Spark ML, and attribution against the sum over all coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from shelfweave.operators import attribution
from shelfweave.sources import portable_forest

ENSEMBLES = {
    "squared": (GBTRegressor, {"maxIter": 6, "maxDepth": 3, "stepSize": 0.4}),
    "absolute": (GBTRegressor, {"maxIter": 4, "maxDepth": 4, "lossType": "absolute"}),
    "forest": (RandomForestRegressor, {"numTrees": 5, "maxDepth": 5}),
}


@pytest.fixture(scope="module")
def points(spark):
    """Five slots, the last one a category of two; the target mixes them."""
    rng = np.random.default_rng(8)
    rows = [(*[float(v) for v in rng.normal(size=4).round(2)], float(rng.integers(2))) for _ in range(400)]
    raw = spark.createDataFrame(
        [(*r, r[0] * 3 + (r[1] > 0) * r[2] * 2 + (8 if r[4] else 0) + r[3]) for r in rows], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DOUBLE, y DOUBLE")
    nominal = {"ml_attr": {"type": "binary", "name": "e"}}
    raw = raw.withColumn("e", F.col("e").alias("e", metadata=nominal))
    ready = VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(raw)
    return ready.withColumn("slots", vector_to_array("features")).cache()


@pytest.fixture(scope="module", params=sorted(ENSEMBLES))
def fitted(request, points):
    kind, params = ENSEMBLES[request.param]
    model = kind(labelCol="y", seed=1, **params).fit(points)
    return model, portable_forest.forest_table(points.sparkSession, model)


def test_walking_the_arrays_is_the_model(fitted, points, spark, tmp_path):
    model, forest = fitted
    portable_forest.write_forest(forest, str(tmp_path))
    back = portable_forest.read_forest(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, forest.collect()))
    scored = model.transform(points).select("slots", "prediction")
    both = portable_forest.with_walk(scored, F.col("slots"), back, "walked")
    worst = both.agg(F.max(F.abs(F.col("walked") - F.col("prediction")))).first()[0]
    assert worst < 1e-12 and both.columns == ["slots", "prediction", "walked"]
    # the category is split on, and some row takes each way
    assert any(4 in t.slot for t in back.collect())


def worth(tree, row, known, at=0):
    """Expected value below a node when only the slots in ``known`` are known."""
    left, right = tree.left[at], tree.right[at]
    if left == at:
        return tree.value[at]
    if tree.slot[at] in known:
        return worth(tree, row, known, left if row[tree.slot[at]] <= tree.split[at] else right)
    share = tree.cover[left] / tree.cover[at]
    return share * worth(tree, row, known, left) + (1 - share) * worth(tree, row, known, right)


def all_coalitions(trees, row):
    n, out = len(row), np.zeros(len(row))
    value = lambda known: sum(t.weight * worth(t, row, known) for t in trees)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            weight = factorial(size) * factorial(n - 1 - size) / factorial(n)
            for known in combinations(others, size):
                out[i] += weight * (value({*known, i}) - value(set(known)))
    return value(set()), out


def test_contributions_equal_the_sum_over_all_coalitions(fitted, points):
    _, forest = fitted
    trees = forest.collect()
    rows = attribution.attribute(points.select("slots").limit(12), forest).collect()
    for r in rows:
        base, parts = all_coalitions(trees, r.slots)
        assert r.base == pytest.approx(base) and r.contributions == pytest.approx(list(parts), abs=1e-9)


def test_contributions_add_up_and_rank(fitted, points):
    model, forest = fitted
    scored = model.transform(points).select("slots", "prediction", F.lit("x").alias("note"))
    told = attribution.attribute(scored, forest)
    assert told.columns == ["slots", "prediction", "note", "base", "contributions"]
    rows = told.collect()
    assert len(rows) == 400 and max(abs(r.base + sum(r.contributions) - r.prediction) for r in rows) < 1e-9
    impact = attribution.mean_impact(told, list("abcde")).collect()
    means = np.abs([r.contributions for r in rows]).mean(0)
    assert {r.feature: r.mean_abs_attribution for r in impact} == pytest.approx(dict(zip("abcde", means)))
    assert [r.mean_abs_attribution for r in impact] == pytest.approx(sorted(means, reverse=True)) and impact[0].feature in "ae"
    assert attribution.attribute(scored.limit(0), forest).count() == 0


def test_a_tree_without_a_split(spark):
    one = spark.createDataFrame(
        [(0, 2.0, 3, [0], [0.0], [0], [0], [7.0], [9.0])], portable_forest.FOREST_SCHEMA)
    rows = spark.createDataFrame([([1.0, 2.0],)], "slots ARRAY<DOUBLE>")
    told = attribution.attribute(rows, one).first()
    assert told.base == 14.0 and told.contributions == [0.0, 0.0]
    assert portable_forest.with_walk(rows, F.col("slots"), one, "walked").first().walked == 14.0
