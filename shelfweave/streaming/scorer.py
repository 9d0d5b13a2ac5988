"""Score arriving request files; a newly published model is used without a restart."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfweave.plans.scoring import score
from shelfweave.schemas import REQUEST_TEXT
from shelfweave.sources.requests import (
    EntityRange, check_requests, rejected_requests, valid_requests,
)

MARKER = "version BIGINT, path STRING"


def publish_model(model: PipelineModel, store: str, version: int) -> None:
    """Save a model and then its marker, so a reader never sees a half-written model."""
    spark = SparkSession.active()
    path = f"{store}/model-{version}"
    model.write().overwrite().save(path)
    spark.createDataFrame([(version, path)], MARKER).coalesce(1).write.mode("append").json(
        f"{store}/versions"
    )


class ModelSource:
    """Loads the newest published model and keeps it until a newer marker appears."""

    def __init__(self, store: str):
        self.store, self.version, self.model = store, None, None

    def current(self, spark: SparkSession) -> PipelineModel:
        newest = (
            spark.read.schema(MARKER).json(f"{self.store}/versions")
            .orderBy(F.desc("version")).first()
        )
        if newest is None:
            raise RuntimeError(f"no model published in {self.store}")
        if newest["version"] != self.version:
            self.model = PipelineModel.load(newest["path"])
            self.version = newest["version"]
        return self.model


def score_stream(
    spark: SparkSession, requests_dir: str, model_store: str, out_dir: str,
    ranges: EntityRange | None = EntityRange(), files_per_batch: int = 100, trigger: dict | None = None,
) -> StreamingQuery:
    """Validate and score request files as they arrive.

    ``trigger`` is what ``DataStreamWriter.trigger`` takes, such as ``{"processingTime": "10 seconds"}`` for a
    stream that keeps running; without it the files present are processed and the stream ends.

    Each micro-batch overwrites its own folder, so a batch that is repeated after a
    failure replaces its earlier output instead of adding to it.
    """
    arriving = (
        spark.readStream.schema(REQUEST_TEXT).option("maxFilesPerTrigger", files_per_batch)
        .parquet(requests_dir)
    )
    models = ModelSource(model_store)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        model = models.current(batch.sparkSession)
        checked = check_requests(batch, ranges).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            scored = score(model, valid_requests(checked)).withColumn(
                "model_version", F.lit(models.version)
            )
            scored.write.mode("overwrite").parquet(f"{out_dir}/scored/batch={batch_id}")
            rejected_requests(checked).write.mode("overwrite").parquet(
                f"{out_dir}/rejected/batch={batch_id}"
            )
        finally:
            checked.unpersist()

    return (
        arriving.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{out_dir}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    )
