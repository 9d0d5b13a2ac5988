"""Spark ML stages: learned features, median imputation, SMAPE evaluation, feature vector."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweave.functions.calendar import CALENDAR_COLUMNS
from shelfweave.functions.metrics import smape
from shelfweave.operators.learned import (
    AGGREGATE_COLUMNS, LearnedDemand, demand_features, learn_demand,
)
from shelfweave.operators.quantiles import medians
from shelfweave.session import fresh_path

# The column groups of the feature vector, in slot order.
NUMERIC = [
    "store", "item", "year", "day", "dayofyear", "weekofyear",
    "month_sin", "month_cos", "dow_sin", "dow_cos", "doy_sin", "doy_cos",
    "store_item_mean", "store_item_dow_mean", "item_month_mean", "store_month_mean",
]
CATEGORIES = {"month": list(range(1, 13)), "dayofweek": list(range(7))}
FLAGS = ["is_weekend", "is_month_start", "is_month_end"]


class StageRecord(MLWriter):
    """Writes a stage's params and a small dict next to whatever tables ``also`` copies."""

    def __init__(self, stage, extra, also=None):
        super().__init__()
        self.stage, self.extra, self.also = stage, extra, also

    def saveImpl(self, path):
        DefaultParamsWriter.saveMetadata(
            self.stage, path, self.sparkSession, extraMetadata={"state": self.extra}
        )
        if self.also:
            self.also(self.sparkSession, path)


class StageRecordReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls._restore(metadata["state"], path)
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class DemandFeatures(Estimator, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns mean demand from the rows it is fitted on and nothing else."""

    @keyword_only
    def __init__(self, *, labelCol="sales"):
        super().__init__()
        self._setDefault(labelCol="sales")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DemandFeaturesModel:
        return DemandFeaturesModel(learn_demand(dataset, self.getLabelCol()))


class DemandFeaturesModel(Model, MLReadable, MLWritable):
    """Adds calendar columns and learned means to request rows."""

    def __init__(self, learned: LearnedDemand | None = None):
        super().__init__()
        self.learned = learned

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return demand_features(dataset, self.learned)

    def feature_names(self, input_columns: list[str]) -> list[str]:
        new = [c for c in [*CALENDAR_COLUMNS, *AGGREGATE_COLUMNS] if c not in input_columns]
        return [*input_columns, *new]

    def write(self) -> MLWriter:
        state = {"global_mean": self.learned.global_mean, "rows": self.learned.rows}
        return StageRecord(self, state, lambda spark, path: self.learned.copy_to(spark, f"{path}/tables"))

    @classmethod
    def read(cls) -> MLReader:
        return StageRecordReader(cls)

    @classmethod
    def _restore(cls, state: dict, path: str) -> DemandFeaturesModel:
        # the tables are copied, so that the model outlives its folder and may be saved to it again
        spark = SparkSession.active()
        stored = LearnedDemand(f"{path}/tables", state["global_mean"], state["rows"])
        return cls(stored.copy_to(spark, fresh_path(spark, "loaded")))


class MedianImputer(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fills missing numeric values with the exact median of the fitted rows."""

    inputCols = Param(Params._dummy(), "inputCols", "columns to fill", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        return MedianImputerModel(medians(dataset, self.getOrDefault(self.inputCols)))


class MedianImputerModel(Model, MLReadable, MLWritable):
    def __init__(self, values: dict[str, float] | None = None):
        super().__init__()
        self.values = values or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({
            c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(v))
            for c, v in self.values.items()
        })

    def write(self) -> MLWriter:
        return StageRecord(self, self.values)

    @classmethod
    def read(cls) -> MLReader:
        return StageRecordReader(cls)

    @classmethod
    def _restore(cls, state: dict, path: str) -> MedianImputerModel:
        return cls(state)


class CategoryIndexer(Model, DefaultParamsReadable, DefaultParamsWritable):
    """0-based category indexes that carry their full domain, so encoding needs no data pass."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for name, domain in CATEGORIES.items():
            meta = {"ml_attr": {"type": "nominal", "name": name, "vals": [str(v) for v in domain]}}
            index = F.coalesce(F.col(name) - domain[0], F.lit(len(domain))).cast("double")
            dataset = dataset.withColumn(f"{name}_index", index.alias(f"{name}_index", metadata=meta))
        return dataset


def preprocessing_stages() -> list:
    """Imputed numbers, one-hot month and weekday, flags: 38 slots in that order."""
    encoder = OneHotEncoder(
        inputCols=[f"{c}_index" for c in CATEGORIES], outputCols=[f"{c}_onehot" for c in CATEGORIES],
        handleInvalid="keep", dropLast=True,
    )
    assembler = VectorAssembler(
        inputCols=[*NUMERIC, *[f"{c}_onehot" for c in CATEGORIES], *FLAGS], outputCol="features"
    )
    return [MedianImputer(inputCols=NUMERIC), CategoryIndexer(), encoder, assembler]


def slot_names(vectors: DataFrame, column: str = "features") -> list[str]:
    """Slot names of an assembled vector, read from its column metadata."""
    attrs = vectors.schema[column].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [name for _, name in slots]


class SmapeEvaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """SMAPE as a model selection metric; smaller is better."""

    @keyword_only
    def __init__(self, *, labelCol="sales", predictionCol="prediction"):
        super().__init__()
        self._setDefault(labelCol="sales", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        pair = F.col(self.getLabelCol()), F.col(self.getPredictionCol())
        return dataset.agg(smape(*pair)).first()[0]

    def isLargerBetter(self) -> bool:
        return False
