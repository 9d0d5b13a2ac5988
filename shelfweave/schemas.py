"""Explicit schemas: nothing in the package infers types from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "date": T.DateType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "string": T.StringType(),
}


def _struct(**columns: str) -> T.StructType:
    """A schema from name=type pairs; needs no running session, unlike a DDL string."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


PANEL = _struct(date="date", store="int", item="int", sales="bigint")
PANEL_KEYS = ["date", "store", "item"]

# Requests arrive as text so that a bad value can be reported instead of failing a cast.
REQUEST_TEXT = _struct(request_id="bigint", date="string", store="string", item="string")
REQUEST_JSON = _struct(
    start_date="string", date="string", periods="string", store="string", item="string",
)

_LABELS = {
    "Year": "bigint", "MonthNum": "bigint", "Month": "string", "DayNum": "bigint",
    "Day": "string", "IsWeekend": "string",
}

# Report imports, columns in file order.
REPORT_TABLES = {
    "Sales": _struct(date="date", Store="bigint", Item="bigint", Sales="bigint", **_LABELS),
    "Forecast": _struct(date="date", Store="bigint", Item="bigint", Forecast="double", **_LABELS),
    "TestForecast": _struct(
        date="date", Store="bigint", Item="bigint", Actual="bigint", Forecast="double",
        AbsError="double", SmapePct="double", **_LABELS,
    ),
    "Stores": _struct(Store="bigint"),
    "Items": _struct(Item="bigint"),
    "ModelMetrics": _struct(Metric="string", Value="string"),
    "DemandDrivers": _struct(Feature="string", MeanAbsShap="double"),
    "ModelComparison": _struct(Model="string", **{
        name: "double" for name in (
            "Test SMAPE", "Test RMSE", "Test MAE", "Test R2", "Val SMAPE", "Train SMAPE",
            "Overfit Gap", "Training Time (s)",
        )
    }),
}

MODEL_METADATA = _struct(
    best_model="string", val_smape="double", test_smape="double", test_rmse="double",
    test_mae="double", test_r2="double", test_bias_pct="double", train_end_date="string",
    val_end_date="string", trained_at_utc="string", n_training_rows="bigint",
)


def require_columns(df: DataFrame, needed, what: str) -> None:
    """Raise at plan time when columns are missing, naming them in sorted order."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")
