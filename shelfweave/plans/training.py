"""Candidate models, random search over expanding folds, champion selection, attribution."""

from __future__ import annotations

import datetime as dt
import random
import time
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from math import prod
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweave.functions import metrics
from shelfweave.operators import attribution
from shelfweave.operators.boosting import HistBoosting
from shelfweave.operators.ml_stages import (
    CATEGORIES, FLAGS, DemandFeatures, SmapeEvaluator, preprocessing_stages, slot_names,
)
from shelfweave.operators.splits import expanding_folds, test_rows, train_rows, with_split
from shelfweave.session import shared_root
from shelfweave.sources.keyed_maps import export_artifacts
from shelfweave.sources.portable_forest import forest_table, write_forest

SEED = 42
N_DRAWS = 8
N_FOLDS = 2

# The search grids. Rounds, rate, depth, row and column sampling and leaf size
# carry over; leaf counts and L2 terms have no counterpart in Spark ML.
GRIDS = {
    "gbt_squared": {
        "maxIter": [300, 500, 800], "stepSize": [0.03, 0.05, 0.1], "maxDepth": [6, 8, 10],
        "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["0.8", "all"],
        "minInstancesPerNode": [1, 5, 10],
    },
    "gbt_absolute": {
        "maxIter": [300, 500, 800], "stepSize": [0.03, 0.05, 0.1], "maxDepth": [8, 12],
        "subsamplingRate": [0.8, 1.0], "featureSubsetStrategy": ["0.8", "all"],
        "minInstancesPerNode": [20, 50, 100],
    },
    "random_forest": {
        "numTrees": [300, 500, 800], "maxDepth": [8, 10, 12], "subsamplingRate": [0.8, 1.0],
        "minInstancesPerNode": [20, 50, 100],
    },
}
# The grids of histogram boosting, which has all axes; depth 8 where the grid says unbounded, as trees are
# grown in passes per level.
HIST_GRIDS = {
    "leaf_boosting": {
        "rounds": [300, 500, 800], "rate": [0.03, 0.05, 0.1], "max_leaves": [31, 64, 128], "max_depth": [8, 12],
        "rows_share": [0.8, 1.0], "slots_share": [0.8, 1.0], "min_rows": [20, 50, 100], "l2": [0.0, 0.1, 1.0],
    },
    "hist_boosting": {
        "rounds": [300, 500, 800], "rate": [0.03, 0.05, 0.1], "max_leaves": [31, 63, 127], "max_depth": [8],
        "min_rows": [20, 50, 100], "l2": [0.0, 0.1, 1.0],
    },
}
MAX_BINS = 255

# Vectors of this many rows fit a task's memory with room to spare.
ROWS_PER_PARTITION = 500_000


def regressor(name: str, **params):
    """A candidate regressor by name."""
    common = {"featuresCol": "features", "labelCol": "sales", "seed": SEED, "maxBins": MAX_BINS}
    if name == "gbt_squared":
        return GBTRegressor(lossType="squared", checkpointInterval=10, **{**common, **params})
    if name == "gbt_absolute":
        return GBTRegressor(lossType="absolute", checkpointInterval=10, **{**common, **params})
    if name == "random_forest":
        return RandomForestRegressor(**{**common, **params})
    if name in ("leaf_boosting", "hist_boosting"):
        return HistBoosting(labelCol="sales", **{"max_bins": MAX_BINS, "seed": SEED, **params})
    raise ValueError(f"unknown candidate '{name}'")


@dataclass(frozen=True)
class Budget:
    """How much to search; the defaults are the full search."""

    grids: dict[str, dict[str, list]] = field(default_factory=lambda: GRIDS)
    draws: int = N_DRAWS
    folds: int = N_FOLDS
    parallelism: int = 4


def draw_params(grid: dict[str, list], draws: int, seed: int = SEED) -> list[dict]:
    """Distinct random grid points; the grid itself is never expanded."""
    sizes = [len(v) for v in grid.values()]
    picks = random.Random(seed).sample(range(prod(sizes)), min(draws, prod(sizes)))
    points = []
    for pick in picks:
        point = {}
        for (name, values), size in zip(grid.items(), sizes):
            pick, position = divmod(pick, size)
            point[name] = values[position]
        points.append(point)
    return points


def feature_stages() -> list:
    return [DemandFeatures(labelCol="sales"), *preprocessing_stages()]


@contextmanager
def _held(df: DataFrame):
    """Keep assembled vectors in memory or on disk while several fits read them."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def _spread(df: DataFrame, copies: int = 1) -> DataFrame:
    """Even partitions: one per core at least, more when ``copies`` of the rows are many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() * copies // ROWS_PER_PARTITION)))


def _vectors(prepared: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    return prepared.transform(_spread(df)).select(
        "features", *keep, F.col("sales").cast("double").alias("sales")
    )


def _in_threads(spark: SparkSession, task, work: list, parallelism: int) -> list:
    """Submit Spark jobs from a few driver threads; each job itself runs on the cluster."""
    with ThreadPool(max(1, min(parallelism, len(work)))) as pool:
        return pool.map(inheritable_thread_target(spark)(task), work)


def search(train: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Score every drawn grid point of every candidate on every expanding fold.

    Returns (model, params, fold, smape). The features of a fold are learned from that
    fold's own past once and shared by all its fits.
    """
    shared_root(train.sparkSession)  # tree fits cut their lineage there
    work = [
        (name, tuple(point.items()))
        for name, grid in budget.grids.items() for point in draw_params(grid, budget.draws)
    ]
    evaluator = SmapeEvaluator(labelCol="sales", predictionCol="prediction")
    scores = []
    for fold in expanding_folds(train, budget.folds):
        past = fold.train(train)
        prepared = Pipeline(stages=feature_stages()).fit(past)
        with _held(_vectors(prepared, past)) as fit_rows, \
                _held(_vectors(prepared, fold.test(train))) as check_rows:
            fit_rows.count()

            def score(entry, index=fold.index, rows=fit_rows, check=check_rows):
                name, point = entry
                model = regressor(name, **dict(point)).fit(rows)
                return name, _text(point), index, evaluator.evaluate(model.transform(check))

            scores += _in_threads(train.sparkSession, score, work, budget.parallelism)
    return train.sparkSession.createDataFrame(scores, "model STRING, params STRING, fold INT, smape DOUBLE")


def _text(point) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(dict(point).items()))


def best_params(scores: DataFrame) -> DataFrame:
    """Per candidate the grid point with the lowest mean fold SMAPE, ties by text."""
    means = scores.groupBy("model", "params").agg(F.avg("smape").alias("cv_smape"))
    return means.groupBy("model").agg(
        F.min(F.struct("cv_smape", "params")).alias("b")
    ).select("model", "b.params", "b.cv_smape")


def tune(
    panel: DataFrame, train_end: str, val_end: str, budget: Budget = Budget()
) -> Trained:
    """Search on the training rows, refit each candidate's best point, pick the champion.

    Candidates of the search run side by side; refits run one after another, so their times are undisturbed.
    """
    scores = search(train_rows(panel, train_end), budget)
    best = {r["model"]: r for r in best_params(scores).collect()}  # one row per candidate
    drawn = {
        name: {_text(point.items()): point for point in draw_params(grid, budget.draws)}
        for name, grid in budget.grids.items()
    }
    done = train_candidates(
        panel, train_end, val_end, {name: drawn[name][r["params"]] for name, r in best.items()},
        {name: r["cv_smape"] for name, r in best.items()}, parallelism=1,
    )
    return replace(done, scores=scores)


@dataclass
class Trained:
    """Fitted candidates sharing one set of learned features, with their comparison table."""

    models: dict[str, PipelineModel]
    comparison: DataFrame
    champion: str
    scores: DataFrame | None = None

    @property
    def best(self) -> PipelineModel:
        return self.models[self.champion]


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Raw forecasts next to the keys of the scored rows."""
    return model.transform(df).withColumnRenamed("prediction", "forecast")


def train_candidates(
    panel: DataFrame, train_end: str, val_end: str, params: dict[str, dict],
    cv_smape: dict[str, float] | None = None, parallelism: int = 3,
) -> Trained:
    """Fit each candidate on the training rows; validation SMAPE alone picks the champion.

    Features are learned once from the training rows and shared. Boosting leaves gaps
    between its many short jobs, so candidates are fitted side by side; pass
    ``parallelism=1`` for undisturbed fit times. All candidates are measured in one pass.
    """
    spark = panel.sparkSession
    shared_root(spark)
    prepared = Pipeline(stages=feature_stages()).fit(train_rows(panel, train_end))
    splits = with_split(panel, train_end, val_end).dropna(subset=["split"])
    with _held(_vectors(prepared, splits, "split")) as held:
        held.count()
        train = held.filter(F.col("split") == "train")

        def timed_fit(entry):
            begun = time.time()
            fitted = regressor(entry[0], **entry[1]).fit(train)
            return entry[0], fitted, time.time() - begun

        results = _in_threads(spark, timed_fit, list(params.items()), parallelism)
        fits = {name: fitted for name, fitted, _ in results}
        seconds = {name: taken for name, _, taken in results}
        scored = held
        for name, fitted in fits.items():
            scored = fitted.transform(scored, {fitted.predictionCol: name})
        measured = scored.groupBy("split").agg(*[
            column.alias(f"{name}:{metric}") for name in fits
            for metric, column in metrics.metric_columns(F.col("sales"), F.col(name)).items()
        ])
        by_split = {r["split"]: r for r in measured.collect()}  # three rows
    records = [
        _comparison_record(name, by_split, (cv_smape or {}).get(name), seconds[name]) for name in fits
    ]
    comparison = spark.createDataFrame(records, COMPARISON).orderBy("val_smape", "model")
    return Trained(
        {name: PipelineModel([*prepared.stages, fit]) for name, fit in fits.items()},
        comparison, comparison.first()["model"],
    )


COMPARISON = "model STRING, cv_smape DOUBLE, " + "".join(
    f"{prefix}_{m} DOUBLE, " for prefix in ("val", "test") for m in metrics.METRICS
) + "train_smape DOUBLE, overfit_gap DOUBLE, fit_seconds DOUBLE"


def _comparison_record(name: str, by_split: dict, cv_smape: float | None, seconds: float) -> tuple:
    """One comparison row: metrics per split, and validation minus training SMAPE as the gap."""
    def at(split: str, metric: str):
        row = by_split.get(split)
        return None if row is None else row[f"{name}:{metric}"]

    val, train = at("validation", "smape"), at("train", "smape")
    gap = None if val is None or train is None else val - train
    values = [at(split, m) for split in ("validation", "test") for m in metrics.METRICS]
    return (name, cv_smape, *values, train, gap, seconds)


def champion_report(trained: Trained, panel: DataFrame, val_end: str) -> DataFrame:
    """The winner's metrics on the test window."""
    scored = predict(trained.best, test_rows(panel, val_end))
    return metrics.evaluate(scored).select(F.lit(trained.champion).alias("model"), "*")


def metadata_record(trained: Trained, panel: DataFrame, train_end: str, val_end: str) -> dict:
    best = trained.comparison.filter(F.col("model") == trained.champion).first()
    return {
        "best_model": trained.champion, "val_smape": best["val_smape"],
        **{f"test_{m}": best[f"test_{m}"] for m in metrics.METRICS},
        "train_end_date": train_end, "val_end_date": val_end,
        "trained_at_utc": dt.datetime.now(dt.timezone.utc).isoformat(),
        "n_training_rows": train_rows(panel, train_end).count(),
    }


def export_portable(model: PipelineModel, sample: DataFrame, path: str) -> None:
    """Write what a fitted pipeline learned as keyed maps, one record and node arrays; see keyed_maps, portable_forest."""
    features, fill = model.stages[:2]
    names = slot_names(PipelineModel(model.stages[:-1]).transform(sample))
    export_artifacts(
        features.learned, sample.sparkSession, path, fill.values, CATEGORIES, FLAGS, names
    )
    write_forest(forest_table(sample.sparkSession, model.stages[-1]), path)


def slot_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``slots``, the fitted pipeline's feature vector as an array."""
    ready = PipelineModel(model.stages[:-1]).transform(_beside(rows))
    return ready.select("_row.*", vector_to_array("features").alias("slots"))


def _beside(rows: DataFrame) -> DataFrame:
    """``rows`` with a copy of themselves, since imputation replaces columns."""
    return rows.withColumn("_row", F.struct(*rows.columns))


def attributed(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``slots``, the raw ``forecast``, ``base`` and ``contributions``; see attribution."""
    ready = PipelineModel(model.stages[:-1]).transform(_beside(rows))
    scored = model.stages[-1].transform(ready).select(
        "_row.*", vector_to_array("features").alias("slots"), F.col("prediction").alias("forecast"))
    return attribution.attribute(scored, forest_table(rows.sparkSession, model.stages[-1]))


def shapley_drivers(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Mean absolute contribution of every slot to the forecasts of ``rows``, largest first."""
    ready = slot_rows(model, rows)
    names = slot_names(PipelineModel(model.stages[:-1]).transform(rows))
    scored = attribution.attribute(ready.select("slots"), forest_table(rows.sparkSession, model.stages[-1]))
    return attribution.mean_impact(scored, names)


def feature_importance(model: PipelineModel, sample: DataFrame, top: int | None = None) -> DataFrame:
    """Gain importance per slot with its name; 38 numbers come from the fitted model."""
    names = slot_names(PipelineModel(model.stages[:-1]).transform(sample))
    values = model.stages[-1].featureImportances.toArray().tolist()
    table = sample.sparkSession.createDataFrame(
        list(zip(names, values)), "feature STRING, importance DOUBLE"
    ).orderBy(F.desc("importance"), "feature")
    return table if top is None else table.limit(top)


def ablation_drivers(model: PipelineModel, train: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean absolute change of the forecast when one slot is set to its training mean.

    One pass scores every row unchanged and once per slot. Slots no tree splits on cannot
    change a forecast and are reported as 0 unscored. This is an ablation score, not a
    Shapley value.
    """
    head, tail = PipelineModel(model.stages[:-1]), model.stages[-1]
    used = [i for i, v in enumerate(tail.featureImportances.toArray()) if v > 0]
    prepared = head.transform(_spread(rows, len(used))).select("features")
    names = slot_names(prepared)
    means = head.transform(train).agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    neutral = F.array(*[F.lit(float(v)) for v in means])

    base = tail.transform(prepared).select(
        vector_to_array("features").alias("_slots"), F.col("prediction").alias("_base")
    )
    variants = base.withColumn("slot", F.explode(F.array(*[F.lit(i) for i in used]))).select(
        "slot", "_base",
        array_to_vector(F.transform(
            "_slots", lambda x, i: F.when(i == F.col("slot"), F.get(neutral, i)).otherwise(x)
        )).alias("features"),
    )
    measured = tail.transform(variants).groupBy("slot").agg(
        F.avg(F.abs(F.col("prediction") - F.col("_base"))).alias("_change")
    )
    slots = rows.sparkSession.createDataFrame(list(enumerate(names)), "slot INT, feature STRING")
    return slots.join(F.broadcast(measured), "slot", "left").select(
        "feature", F.coalesce("_change", F.lit(0.0)).alias("mean_abs_attribution")
    ).orderBy(F.desc("mean_abs_attribution"), "feature")
