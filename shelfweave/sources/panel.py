"""Reading, deriving and writing panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweave.operators.splits import with_every_split
from shelfweave.schemas import PANEL, PANEL_KEYS, require_columns
from shelfweave.session import fresh_path, input_state, remove_path


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A panel from parquet or from a CSV with a header."""
    reader = spark.read.schema(PANEL)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def panel_from_lineitem(lineitem: DataFrame, stores: int | None = 10, items: int | None = 50) -> DataFrame:
    """Daily units per store and item from order lines; suppliers and parts fold into the ids, or are them (None)."""
    require_columns(lineitem, ["l_shipdate", "l_suppkey", "l_partkey", "l_quantity"], "lineitem")
    return (
        lineitem.groupBy(
            F.col("l_shipdate").cast("date").alias("date"),
            _folded("l_suppkey", stores).alias("store"),
            _folded("l_partkey", items).alias("item"),
        )
        .agg(F.sum("l_quantity").cast("bigint").alias("sales"))
    )


def _folded(key: str, n: int | None):
    return (F.col(key) if n is None else F.col(key) % n + 1).cast("int")


def derive_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_from_lineitem(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def write_panel(panel: DataFrame, path: str) -> None:
    """A panel table in which every file holds a range of keys, dates first, sorted inside.

    A date filter then finds its rows in few files and skips the others by their statistics. The ranges run
    over the whole key, so a crowded day spans several files.
    """
    panel.repartitionByRange(*PANEL_KEYS).sortWithinPartitions(*PANEL_KEYS).write.mode("overwrite").parquet(path)


# (application, table folder, layout) -> state of the order lines, path
_TABLES: dict[tuple[str, str, str], tuple[str, str]] = {}


def _kept(spark: SparkSession, sf_dir: str, layout: str, write) -> str:
    """The table that ``write`` made for the present order lines; changed ones replace it."""
    key = (spark.sparkContext.applicationId, sf_dir, layout)
    state = input_state(spark, f"{sf_dir}/lineitem.parquet")
    if _TABLES.get(key, ("",))[0] != state:
        path = fresh_path(spark, layout)
        write(path)
        if key in _TABLES:
            remove_path(spark, _TABLES[key][1])
        _TABLES[key] = (state, path)
    return _TABLES[key][1]


def load_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of a table folder, written once per application and state of the order lines.

    The order lines are the large input: they are scanned and shuffled a single time.
    """
    return read_panel(spark, _kept(
        spark, sf_dir, "panel", lambda path: write_panel(derive_panel(spark, sf_dir), path)))


def load_true_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel on the true supplier and part keys: as many series as the order lines have, most of them sparse."""
    def write(path):
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        write_panel(panel_from_lineitem(lines, stores=None, items=None), path)

    return read_panel(spark, _kept(spark, sf_dir, "true-panel", write))


def load_panel_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel partitioned by store, for reading single series."""
    path = _kept(spark, sf_dir, "panel-by-store",
                 lambda path: write_panel_by_store(load_panel(spark, sf_dir), path))
    return read_panel(spark, path).select(*PANEL.names)


def write_panel_by_store(panel: DataFrame, path: str) -> None:
    """Store-partitioned parquet for reading single series; a large store spans several files."""
    panel.hint("rebalance", "store").write.mode("overwrite").partitionBy("store").parquet(path)


def series_history(panel: DataFrame, store: int, item: int) -> DataFrame:
    """One series in date order; on a store-partitioned table this reads one partition."""
    return panel.filter((F.col("store") == store) & (F.col("item") == item)).orderBy("date")


def dimension(panel: DataFrame, key: str) -> DataFrame:
    return panel.select(F.col(key).cast("bigint").alias(key.capitalize())).distinct()


def write_splits(
    panel: DataFrame, path: str, train_end: str, val_end: str, fmt: str = "parquet"
) -> None:
    """Train, validation and test as partitions of one table, and a fourth for rows without a date."""
    writer = (
        with_every_split(panel, train_end, val_end)
        .hint("rebalance", "split").write.mode("overwrite").partitionBy("split")
    )
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
