"""Request counts and latency from a request log, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A served request: when, which path, how long, rows scored, whether it failed.
LOG = "ts TIMESTAMP, path STRING, latency_ms DOUBLE, n_scored BIGINT, failed BOOLEAN"


def _mean(total: Column, n: Column) -> Column:
    return F.try_divide(total.cast("double"), n)


def windowed_metrics(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Requests and mean latency per time window and path; ``log`` has ts, path, latency_ms.

    Latency is summed as a decimal, so the result does not depend on the order of the rows.
    """
    return (
        log.groupBy(F.window("ts", width), "path")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum(F.col("latency_ms").cast("decimal(18,6)")).alias("total_latency_ms"),
        )
        .select(
            F.col("window.start").alias("window_start"), "path", "requests", "total_latency_ms",
            _mean(F.col("total_latency_ms"), F.col("requests")).alias("mean_latency_ms"),
        )
    )


def running_metrics(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Adds, per path, the request count and mean latency up to each window.

    The running sums see one row per window of time, however many requests fell into it.
    """
    so_far = (
        Window.partitionBy("path").orderBy("window_start")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return windowed_metrics(log, width).select(
        "window_start", "path", "requests", "mean_latency_ms",
        F.sum("requests").over(so_far).alias("requests_so_far"),
        _mean(F.sum("total_latency_ms").over(so_far), F.sum("requests").over(so_far))
        .alias("mean_latency_so_far"),
    )


def stream_metrics(log: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The windowed metrics over a streaming log; windows close once the watermark passes."""
    return windowed_metrics(log.withWatermark("ts", late), width)


def path_counters(log: DataFrame) -> DataFrame:
    """Per path: requests, errors, rows scored by requests that did not fail, and the sum of latencies."""
    failed = F.coalesce("failed", F.lit(False))
    return log.groupBy("path").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("errors"),
        F.coalesce(F.sum(F.when(~failed, F.col("n_scored"))), F.lit(0)).alias("n_scored"),
        F.sum(F.col("latency_ms").cast("decimal(18,6)")).alias("total_latency_ms"),
    )


def service_record(counters: DataFrame, predict: str = "/predict", batch: str = "/predict/batch") -> DataFrame:
    """One row over all paths: errors, rows scored, prediction and batch requests, mean latency of predictions.

    A path predicts if it begins with ``predict``; a batch is one request and one latency, whatever its rows. The mean is
    NULL before the first prediction.
    """
    predicts = F.coalesce(F.startswith("path", F.lit(predict)), F.lit(False))
    asked = F.sum(F.when(predicts, F.col("requests")))
    return counters.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("errors", "n_scored")],
        F.coalesce(asked, F.lit(0)).alias("predict_requests"),
        F.coalesce(F.sum(F.when(F.col("path") == batch, F.col("requests"))), F.lit(0)).alias("batch_requests"),
        _mean(F.sum(F.when(predicts, F.col("total_latency_ms"))), asked).alias("mean_latency_ms"),
    )


def count_stream(
    spark: SparkSession, log_dir: str, out_dir: str, width: str = "1 hour", late: str = "1 hour",
    files_per_batch: int | None = None, trigger: dict | None = None,
) -> list[StreamingQuery]:
    """Keep the counters of an arriving log: running totals per path, and windows of time that close.

    Totals hold a row of state per path and know no lateness. Windows leave the state once the watermark passes, and
    rows behind it enter no window; ``counted`` tells how many. Each micro-batch overwrites its own
    folder with the rows that it changed, so a repeated batch counts nothing twice, and a stream started again on
    the same ``out_dir`` goes on where it stopped.
    """
    reader = spark.readStream.schema(LOG)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    log = reader.parquet(log_dir)

    def kept(name: str, changed: DataFrame) -> StreamingQuery:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={batch_id}")

        return (
            changed.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{out_dir}/{name}-checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    return [kept("totals", path_counters(log)), kept("windows", stream_metrics(log, width, late))]


def _newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key: the row of its newest batch."""
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")


def counted_windows(spark: SparkSession, out_dir: str) -> DataFrame:
    """The windows of ``count_stream``, open ones as far as they are."""
    return _newest(spark, f"{out_dir}/windows", ["window_start", "path"])


def counted(spark: SparkSession, out_dir: str) -> DataFrame:
    """The totals of ``count_stream`` per path, with ``late``: requests that are in no window, as they came too late or undated."""
    seen = counted_windows(spark, out_dir).groupBy(F.col("path").alias("_path")).agg(F.sum("requests").alias("_seen"))
    totals = _newest(spark, f"{out_dir}/totals", ["path"])
    return totals.join(seen, F.col("path").eqNullSafe(F.col("_path")), "left").select(
        *totals.columns, (F.col("requests") - F.coalesce("_seen", F.lit(0))).alias("late"))
