"""Typed CSV tables and the records written next to a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfweave.schemas import MODEL_METADATA, REPORT_TABLES
from shelfweave.session import fresh_path, store_table

CORRUPT = "_corrupt"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, sep=",", encoding="UTF-8", escape='"').csv(path)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Declared types, quoted CSV with a header; unparsable lines are kept in ``_corrupt``.

    A header that differs from the declared columns in name or order raises when the file is read.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .options(
            header=True, sep=",", encoding="UTF-8", escape='"', mode="PERMISSIVE",
            columnNameOfCorruptRecord=CORRUPT, enforceSchema=False,
        )
        .csv(path)
    )


def read_report_table(spark: SparkSession, name: str, path: str) -> tuple[DataFrame, DataFrame]:
    """One of the eight report imports, and the lines that break its types as column ``line``."""
    # parsed once with all columns: a parser asked for fewer would not see what breaks a line
    table = store_table(read_typed_csv(spark, path, REPORT_TABLES[name]), fresh_path(spark, "import"))
    broken = F.col(CORRUPT).isNotNull()
    return table.filter(~broken).drop(CORRUPT), table.filter(broken).select(F.col(CORRUPT).alias("line"))


def write_forecast_csv(scored: DataFrame, path: str) -> None:
    """The request columns and the rounded forecast, as offered for download."""
    write_csv(
        scored.select("date", "store", "item", F.bround("forecast", 2).alias("predicted_sales")), path
    )


def write_metadata(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON record with the metrics rounded to four places."""
    fields = [record.get(f.name) for f in MODEL_METADATA.fields]
    row = spark.createDataFrame([tuple(fields)], MODEL_METADATA)
    doubles = {f.name: F.bround(f.name, 4) for f in MODEL_METADATA if f.dataType == T.DoubleType()}
    row.withColumns(doubles).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_METADATA).json(path)


def write_comparison(comparison: DataFrame, path: str) -> None:
    doubles = {n: F.bround(n, 4) for n, t in comparison.dtypes if t == "double"}
    write_csv(comparison.withColumns(doubles), path)
