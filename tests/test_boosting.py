"""Histogram boosting against a finder that tries every split of every row set."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from shelfweave.operators import attribution, boosting
from shelfweave.operators.boosting import BoostingParams, HistBoostingModel
from shelfweave.plans import training
from shelfweave.sources import portable_forest

SLOTS = 4


def data(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 6, n), rng.integers(0, 30, n), rng.normal(size=n).round(1), rng.integers(0, 2, n)], 1).astype(float)
    y = (x[:, 0] * 2 + (x[:, 1] > 12) * 9 + np.where(x[:, 3] > 0, x[:, 2] * 3, 0) + rng.normal(size=n)).round(2)
    return x, y


def framed(spark, x, y):
    return spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "slots ARRAY<DOUBLE>, sales DOUBLE").repartition(3)


def best(x, left, rows, p):
    """(gain, slot, value) of the best split of a set of rows, by trying all of them."""
    found = (0.0, 0, 0.0)
    g, n = left[rows].sum(), len(rows)
    for s in range(x.shape[1]):
        for v in np.unique(x[:, s])[:-1]:
            at = x[rows, s] <= v
            a, b = at.sum(), n - at.sum()
            if min(a, b) >= max(1, p.min_rows):
                ga, gb = left[rows][at].sum(), left[rows][~at].sum()
                gain = ga**2 / (a + p.l2) + gb**2 / (b + p.l2) - g**2 / (n + p.l2)
                if gain > found[0] + 1e-9:
                    found = (gain, s, v)
    return found


def grown(x, left, p):
    """Best-first growth: (slots, splits, rows) of nodes in the order in which they were split, and the forecast of each row."""
    leaves, splits = [(np.arange(len(x)), 0)], []
    while len(leaves) < p.max_leaves:
        tried = [(best(x, left, rows, p) if depth < p.max_depth else (0.0, 0, 0.0), i) for i, (rows, depth) in enumerate(leaves)]
        (gain, s, v), i = max(tried, key=lambda t: t[0][0])
        if gain <= 1e-9:
            break
        rows, depth = leaves.pop(i)
        at = x[rows, s] <= v
        leaves += [(rows[at], depth + 1), (rows[~at], depth + 1)]
        splits.append((s, v, len(rows)))
    out = np.zeros(len(x))
    for rows, _ in leaves:
        out[rows] = left[rows].sum() / (len(rows) + p.l2)
    return splits, out, len(leaves)


@pytest.mark.parametrize("p", [
    BoostingParams(rounds=3, rate=0.5, max_depth=3, max_leaves=6, max_bins=128, min_rows=1),
    BoostingParams(rounds=2, rate=1.0, max_depth=6, max_leaves=9, max_bins=128, min_rows=25, l2=4.0),
    BoostingParams(rounds=5, rate=0.3, max_depth=1, max_leaves=31, max_bins=128, min_rows=1),
])
def test_every_split_is_the_best_there_is(spark, p):
    x, y = data()
    trees = boosting.boost(framed(spark, x, y), p).orderBy("tree").collect()
    left = y - y.mean()
    assert len(trees) == p.rounds + 1 and trees[0].value == [pytest.approx(y.mean())]
    for tree in trees[1:]:
        splits, forecast, n_leaves = grown(x, left, p)
        inner = [i for i, child in enumerate(tree.left) if child != i]
        got = sorted((tree.slot[i], tree.split[i], int(tree.cover[i])) for i in inner)
        assert got == sorted(splits) and len(tree.slot) - len(inner) == n_leaves <= p.max_leaves
        left = left - p.rate * forecast
    scored = boosting.score_forest(framed(spark, x, y), spark.createDataFrame(trees, portable_forest.FOREST_SCHEMA))
    assert scored.agg(F.avg((F.col("sales") - F.col("forecast"))**2)).first()[0] == pytest.approx((left**2).mean())


def test_one_forest_for_scoring_walking_and_attribution(spark):
    x, y = data(300)
    rows = framed(spark, x, y)
    forest = boosting.boost(rows, BoostingParams(rounds=8, max_depth=4, rows_share=0.7, slots_share=0.75, min_rows=5))
    again = boosting.boost(rows, BoostingParams(rounds=8, max_depth=4, rows_share=0.7, slots_share=0.75, min_rows=5))
    assert forest.collect() == again.collect()  # the drawn rows and slots follow the seed
    assert all(0 < len(set(t.slot)) for t in forest.collect())
    both = portable_forest.with_walk(boosting.score_forest(rows, forest), F.col("slots"), forest, "walked")
    told = attribution.attribute(both, forest).collect()
    for r in told:
        assert r.forecast == pytest.approx(r.walked) == pytest.approx(r.base + sum(r.contributions))


def test_few_bins_and_many_rounds(spark):
    x, y = data(2000)
    p = BoostingParams(rounds=30, max_depth=3, max_bins=16, min_rows=5)
    errors = []
    forest = boosting.boost(framed(spark, x, y), p)
    for rounds in (1, 10, 30):
        scored = boosting.score_forest(framed(spark, x, y), forest.filter(F.col("tree") <= rounds))
        errors.append(scored.agg(F.avg((F.col("sales") - F.col("forecast"))**2)).first()[0])
    assert errors[0] > 2 * errors[1] > 2 * errors[2] > 0


def test_as_a_stage_it_is_saved_exported_and_searched(spark, tmp_path):
    x, y = data(400)
    rows = framed(spark, x, y).select(array_to_vector("slots").alias("features"), "sales", "slots")
    for name, grid in training.HIST_GRIDS.items():
        point = {**training.draw_params(grid, 1)[0], "rounds": 2, "max_bins": 32}
        model = training.regressor(name, **point).fit(rows)
        model.write().overwrite().save(str(tmp_path / name))
        back = HistBoostingModel.load(str(tmp_path / name))
        scored = back.transform(model.transform(rows), {back.predictionCol: "again"})
        walked = portable_forest.with_walk(scored, F.col("slots"), portable_forest.forest_table(spark, back), "walked")
        gap = F.greatest(F.abs(F.col("again") - F.col("prediction")), F.abs(F.col("walked") - F.col("prediction")))
        assert walked.agg(F.max(gap)).first()[0] < 1e-9 and len(model.trees) == 3


def test_awkward_rows(spark):
    rows = spark.createDataFrame(
        [([1.0, 2.0], 4.0), ([1.0, 2.0], 4.0), (None, 9.0), ([3.0, 2.0], None), ([1.0, 2.0], 10.0)], "slots ARRAY<DOUBLE>, sales DOUBLE")
    trees = boosting.boost(rows, BoostingParams(rounds=2, min_rows=1)).orderBy("tree").collect()
    assert [t.value for t in trees] == [[6.0], [0.0], [0.0]] and trees[0].cover == [3.0]  # nothing tells the rows apart
    assert boosting.boost(rows.limit(0)).collect()[0].value == [0.0]
    assert boosting.score_forest(rows.limit(0), spark.createDataFrame(trees, portable_forest.FOREST_SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        boosting.boost(rows, BoostingParams(max_bins=300))
