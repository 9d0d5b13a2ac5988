"""Mean demand learned from training rows, and the fallback cascade for rows to score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweave.functions.calendar import as_date, as_id, with_calendar
from shelfweave.operators.joins import lookup_join
from shelfweave.operators.splits import key_before
from shelfweave.schemas import require_columns
from shelfweave.session import fresh_path

# Learned mean -> its key columns.
MEAN_KEYS = {
    "store_item_mean": ["store", "item"],
    "store_item_dow_mean": ["store", "item", "dayofweek"],
    "item_month_mean": ["item", "month"],
    "store_month_mean": ["store", "month"],
}
AGGREGATE_COLUMNS = list(MEAN_KEYS)


def _target(df: DataFrame, name: str) -> Column:
    """The target with NaN as NULL, because averages must skip both."""
    kind = dict(df.dtypes)[name]
    return F.nanvl(F.col(name), F.lit(None)) if kind in ("double", "float") else F.col(name)


def _mean(total: Column | None = None, n: Column | None = None) -> Column:
    total, n = F.col("total") if total is None else total, F.col("n") if n is None else n
    return F.try_divide(total, n)


def training_view(train: DataFrame, target: str = "sales", *kept: str) -> DataFrame:
    """The key parts and the target of the training rows, typed; nothing else is read."""
    date = as_date(train)
    return train.select(
        as_id(train, "store").alias("store"), as_id(train, "item").alias("item"),
        F.month(date).alias("month"), F.weekday(date).alias("dayofweek"),
        _target(train, target).alias("_y"), *kept,
    )


def mean_table(train: DataFrame, name: str, target: str = "sales") -> DataFrame:
    """One learned mean as a tall table: key columns and the mean."""
    keys = MEAN_KEYS[name]
    return training_view(train, target).dropna(subset=keys).groupBy(*keys).agg(
        F.avg("_y").alias(name)
    )


def profiles(train: DataFrame, target: str = "sales") -> DataFrame:
    """All learned means as one table with a row per series, item and store.

    One scan is summed up to cells of (store, item, month, weekday), at most 84 per series and
    combined map-side, so a crowded series costs no more than any other. Three grouping
    sets expand the cells, not the rows. A row then folds the (at most 12) positions of its
    entity into a map, which lets scoring do with three joins instead of four. A series
    mean is the quotient of its weekday sums. Rows with a NULL key are harmless: a join
    never matches them, and their sums still count towards the global mean.
    """
    return _profiles_of(training_view(train, target).groupBy("store", "item", "month", "dayofweek").agg(
        F.sum("_y").alias("_total"), F.count("_y").alias("_n")
    ))


def _profiles_of(cells: DataFrame) -> DataFrame:
    """``profiles`` from sums and counts; cells of one key may be spread over any number of rows."""
    sets = [["store", "item", "dayofweek"], ["item", "month"], ["store", "month"]]
    tall = cells.groupingSets(sets, "store", "item", "month", "dayofweek").agg(
        F.grouping("item").alias("_no_item"), F.grouping("store").alias("_no_store"),
        F.sum("_total").alias("total"), F.sum("_n").alias("n"),
    )
    position = F.coalesce("month", "dayofweek")
    return (
        tall.withColumn(
            "profile",
            F.when(F.col("_no_store") == 1, "items").when(F.col("_no_item") == 1, "stores")
            .otherwise("series"),
        )
        .groupBy("profile", "store", "item").agg(
            F.sum("total").cast("double").alias("total"), F.sum("n").alias("n"),
            F.map_from_entries(F.collect_list(
                F.when(position.isNotNull(), F.struct(position, _mean(F.col("total").cast("double"))))
            )).alias("means"),
        )
        .select("store", "item", "total", "n", "means", "profile")
    )


# Learned mean -> the profile that holds it.
_HOLDERS = {
    "store_item_mean": "series", "store_item_dow_mean": "series",
    "item_month_mean": "items", "store_month_mean": "stores",
}


PROFILE_SCHEMA = "store INT, item INT, total DOUBLE, n BIGINT, means MAP<INT, DOUBLE>"


@dataclass(frozen=True)
class LearnedDemand:
    """The learned state: the written profiles, their counted rows and the global mean."""

    path: str
    global_mean: float | None
    rows: dict[str, int]

    def profile(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.schema(PROFILE_SCHEMA).parquet(f"{self.path}/profile={name}")

    def means(self, spark: SparkSession, name: str) -> DataFrame:
        """One learned mean as a tall table of its keys and the mean."""
        keys = MEAN_KEYS[name]
        entity = [k for k in keys if k in ("store", "item")]
        rows = self.profile(spark, _HOLDERS[name]).dropna(subset=entity)
        if entity == keys:
            return rows.select(*keys, _mean().alias(name))
        return rows.select(*entity, F.explode("means").alias(keys[-1], name))

    def copy_to(self, spark: SparkSession, path: str) -> LearnedDemand:
        stored = spark.read.schema(f"{PROFILE_SCHEMA}, profile STRING").parquet(self.path)
        _write_profiles(stored, path)
        return LearnedDemand(path, self.global_mean, self.rows)


def _write_profiles(df: DataFrame, path: str) -> None:
    df.hint("rebalance", "profile").write.mode("overwrite").partitionBy("profile").parquet(path)


def learn_demand(train: DataFrame, target: str = "sales") -> LearnedDemand:
    """Learn the lookup tables from training rows only; nothing later changes them."""
    require_columns(train, ["date", "store", "item"], "training data")
    if target not in train.columns:
        raise ValueError(f"learning demand means requires the target column '{target}'")
    return _stored_means(profiles(train, target))


def _stored_means(learned: DataFrame) -> LearnedDemand:
    spark = learned.sparkSession
    path = fresh_path(spark, "learned")
    _write_profiles(learned, path)
    stored = spark.read.schema(f"{PROFILE_SCHEMA}, profile STRING").parquet(path)
    sizes = stored.groupBy("profile").agg(
        F.count(F.lit(1)).alias("rows"), _mean(F.sum("total"), F.sum("n")).alias("mean")
    )
    summary = {r["profile"]: r for r in sizes.collect()}  # three rows
    return LearnedDemand(
        path, summary["stores"]["mean"] if summary else None,  # store rows cover every training row
        {name: r["rows"] for name, r in summary.items()},
    )


CELL_SCHEMA = "store INT, item INT, dayofweek INT, _total DOUBLE, _n BIGINT, ym INT"


@dataclass(frozen=True)
class DemandState:
    """Sums and counts per (series, month, weekday) in a table with a folder per month.

    Both add up, so states merge by appending: a new day appends its cells, and learning up to any key
    takes whole months from here and reads only the rows of the month that the key cuts. Sums are doubles:
    whole units stay exact up to 2^53. Rows without a date form a month of their own, which comes first.
    """

    path: str
    target: str = "sales"

    def add(self, rows: DataFrame) -> None:
        """Merge further rows; the same rows twice count twice."""
        date = as_date(rows)
        view = training_view(rows.withColumn("_ym", _year_month(date)), self.target, "_ym")
        cells = view.groupBy("store", "item", "dayofweek", "_ym").agg(
            F.sum("_y").cast("double").alias("_total"), F.count("_y").alias("_n"))
        cells.withColumnRenamed("_ym", "ym").hint("rebalance", "ym").write.mode("append").partitionBy("ym").parquet(self.path)

    def learn_before(self, panel: DataFrame, key: tuple) -> LearnedDemand:
        """The means of all rows whose (date, store, item) sorts before ``key``, as ``learn_demand`` gives them.

        ``panel`` holds the rows that this state was made of; of it only the month of the key is read.
        """
        day = F.lit(key[0]).cast("date")
        stored = panel.sparkSession.read.schema(CELL_SCHEMA).parquet(self.path)
        rows = panel.filter(key_before(key))
        if key[0] is None:  # the key cuts the rows without a date, which come first
            whole, rows = F.lit(False), rows.filter(F.col("date").isNull())
        else:
            whole = F.col("ym").isNull() | (F.col("ym") < _year_month(day))
            rows = rows.filter(F.col("date") >= F.trunc(day, "month"))
        months = stored.filter(whole).select(
            "store", "item", (F.col("ym") % 12 + 1).alias("month"), "dayofweek", "_total", "_n")
        cut = training_view(rows, self.target).groupBy("store", "item", "month", "dayofweek").agg(
            F.sum("_y").cast("double").alias("_total"), F.count("_y").alias("_n"))
        return _stored_means(_profiles_of(months.unionByName(cut)))


def _year_month(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def demand_state(rows: DataFrame, target: str = "sales") -> DemandState:
    """The state of the rows, from one scan of them."""
    require_columns(rows, ["date", "store", "item", target], "training data")
    state = DemandState(fresh_path(rows.sparkSession, "state"), target)
    state.add(rows)
    return state


def with_learned(
    df: DataFrame, learned: LearnedDemand, columns: list[str] = AGGREGATE_COLUMNS
) -> DataFrame:
    """Add learned means to rows that carry the calendar columns; only needed profiles are joined.

    Series mean, item-month mean and store-month mean fall back to the global mean; the
    weekday mean falls back to the already filled series mean.
    """
    spark, fallback = df.sparkSession, F.lit(learned.global_mean).cast("double")
    joined = df
    for name, keys in (("series", ["store", "item"]), ("items", ["item"]), ("stores", ["store"])):
        if not any(_HOLDERS[c] == name for c in columns):
            continue
        lookup = learned.profile(spark, name).select(
            *keys, _mean().alias(f"_{name}_mean"), F.col("means").alias(f"_{name}_means")
        )
        joined = lookup_join(joined, lookup, keys, learned.rows.get(name, 0))

    def entry(name: str, position: str) -> Column:
        return F.try_element_at(F.col(f"_{name}_means"), F.col(position))

    series = F.coalesce(F.col("_series_mean"), fallback)
    filled = {
        "store_item_mean": series,
        "store_item_dow_mean": F.coalesce(entry("series", "dayofweek"), series),
        "item_month_mean": F.coalesce(entry("items", "month"), fallback),
        "store_month_mean": F.coalesce(entry("stores", "month"), fallback),
    }
    return joined.select(*df.columns, *[filled[c].alias(c) for c in columns])


def demand_features(df: DataFrame, learned: LearnedDemand) -> DataFrame:
    """Request rows plus 15 calendar and 4 learned columns; other input columns pass through."""
    return with_learned(with_calendar(df), learned)


def baseline_forecast(df: DataFrame, learned: LearnedDemand) -> DataFrame:
    """Use the weekday mean of the series as the forecast; this needs one join only."""
    rows = with_learned(with_calendar(df), learned, ["store_item_mean", "store_item_dow_mean"])
    return rows.withColumn("forecast", F.col("store_item_dow_mean"))
