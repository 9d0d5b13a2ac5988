"""Report side tables that describe the models: metrics, drivers, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfweave.schemas import REPORT_TABLES

# Report label -> column of the metadata record.
METRIC_LABELS = {
    "Best Model": "best_model", "Test SMAPE": "test_smape", "Validation SMAPE": "val_smape",
    "Test RMSE": "test_rmse", "Test MAE": "test_mae", "Test R2": "test_r2",
    "Trained At (UTC)": "trained_at_utc",
}
# Report label -> column of the comparison table.
COMPARISON_LABELS = {
    "Model": "model", "Test SMAPE": "test_smape", "Test RMSE": "test_rmse", "Test MAE": "test_mae",
    "Test R2": "test_r2", "Val SMAPE": "val_smape", "Train SMAPE": "train_smape",
    "Overfit Gap": "overfit_gap", "Training Time (s)": "fit_seconds",
}


def model_metrics(metadata: DataFrame) -> DataFrame:
    """The metadata record as (Metric, Value) text rows."""
    texts = metadata.select(*[
        F.col(column).cast("string").alias(label) for label, column in METRIC_LABELS.items()
    ])
    return texts.unpivot([], [f"`{label}`" for label in METRIC_LABELS], "Metric", "Value")


def model_comparison(comparison: DataFrame) -> DataFrame:
    return comparison.select(*[
        F.col(column).alias(label) if label == "Model" else F.bround(column, 4).alias(label)
        for label, column in COMPARISON_LABELS.items()
    ])


def comparison_by_model(table: DataFrame) -> DataFrame:
    """Summed metrics per model, best validation SMAPE first."""
    sums = [F.sum(f"`{c}`").alias(c) for c in REPORT_TABLES["ModelComparison"].names if c != "Model"]
    return table.groupBy("Model").agg(*sums).orderBy("Val SMAPE", "Model")


def demand_drivers(drivers: DataFrame) -> DataFrame:
    """Drivers under readable names; a category slot reads like ``month 7``."""
    name = F.regexp_replace(F.regexp_replace("feature", "_onehot_", " "), "_", " ")
    return drivers.select(name.alias("Feature"), F.col("mean_abs_attribution").alias("MeanAbsShap"))
