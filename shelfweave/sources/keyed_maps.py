"""Learned means as keyed maps, and features looked up from such maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweave.functions.calendar import with_calendar
from shelfweave.functions.scoring import map_key
from shelfweave.operators.joins import lookup_join
from shelfweave.operators.learned import MEAN_KEYS, LearnedDemand

# Spark searches a map entry by entry, so a map row stays near this many entries and a larger
# table is spread over more rows by key hash.
ENTRIES_PER_MAP = 64

RECORD_SCHEMA = (
    "global_mean DOUBLE, medians MAP<STRING, DOUBLE>, categories MAP<STRING, ARRAY<INT>>, "
    "flags ARRAY<STRING>, feature_order ARRAY<STRING>"
)


def mean_entries(learned: LearnedDemand, spark: SparkSession) -> DataFrame:
    """All learned means as (name, map_key, mean), keys like ``store|item|weekday``."""
    parts = [
        learned.means(spark, name).select(
            F.lit(name).alias("name"), map_key(*keys).alias("map_key"), F.col(name).alias("mean")
        )
        for name, keys in MEAN_KEYS.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropna(subset=["mean"])


def shard_counts(entries: DataFrame) -> dict[str, int]:
    """Rows each named map is spread over, from counted entries (four rows reach the driver)."""
    counted = entries.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["name"]: -(-r["n"] // ENTRIES_PER_MAP) for r in counted}


def map_rows(maps: DataFrame) -> dict[str, int]:
    """``shard_counts`` of maps that were read back."""
    return {r["name"]: r["n"] for r in maps.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def keyed_maps(entries: DataFrame, shards: dict[str, int]) -> DataFrame:
    """(name, shard, entries MAP): each mean table as maps of bounded size, sharded by key hash."""
    shard = F.coalesce(
        *[F.when(F.col("name") == n, _shard(F.col("map_key"), s)) for n, s in shards.items()],
        F.lit(0),
    )
    return (
        entries.withColumn("shard", shard).groupBy("name", "shard")
        .agg(F.map_from_entries(F.collect_list(F.struct("map_key", "mean"))).alias("entries"))
    )


def export_artifacts(
    learned: LearnedDemand, spark: SparkSession, path: str, medians: dict[str, float],
    categories: dict[str, list[int]], flags: list[str], feature_order: list[str],
) -> None:
    """Maps as JSON lines plus one record of medians, categories and column order."""
    slots = len(medians) + sum(len(c) for c in categories.values()) + len(flags)
    if slots != len(feature_order):
        raise ValueError(f"{slots} slots are described, but {len(feature_order)} are named")
    entries = mean_entries(learned, spark)
    keyed_maps(entries, shard_counts(entries)).write.mode("overwrite").json(f"{path}/maps")
    spark.createDataFrame(
        [(learned.global_mean, medians, categories, flags, feature_order)],
        RECORD_SCHEMA,
    ).coalesce(1).write.mode("overwrite").json(f"{path}/record")


def read_artifacts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The exported maps and the record."""
    maps = spark.read.schema("name STRING, shard INT, entries MAP<STRING, DOUBLE>").json(f"{path}/maps")
    return maps, spark.read.schema(RECORD_SCHEMA).json(f"{path}/record")


def with_mapped_means(
    df: DataFrame, maps: DataFrame, shards: dict[str, int], global_mean: float
) -> DataFrame:
    """The four learned means looked up in keyed maps, same fallback order as the joins."""
    rows = with_calendar(df)
    base = rows.columns
    for name, keys in MEAN_KEYS.items():
        # the maps are unfolded to one row per entry, so a fact carries a key and not a whole map
        entries = maps.filter(F.col("name") == name).select(F.explode("entries").alias("_key", f"_{name}"))
        rows = rows.withColumn("_key", map_key(*keys))
        rows = lookup_join(rows, entries, ["_key"], shards.get(name, 1) * ENTRIES_PER_MAP).drop("_key")
    fallback = F.lit(global_mean).cast("double")
    series = F.coalesce(F.col("_store_item_mean"), fallback)
    return rows.select(
        *base,
        series.alias("store_item_mean"),
        F.coalesce(F.col("_store_item_dow_mean"), series).alias("store_item_dow_mean"),
        F.coalesce(F.col("_item_month_mean"), fallback).alias("item_month_mean"),
        F.coalesce(F.col("_store_month_mean"), fallback).alias("store_month_mean"),
    )
