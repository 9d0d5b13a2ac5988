"""Fitted tree ensembles as plain node arrays, and forecasts that need nothing else.

A tree is one row of arrays, an entry per node: the slot it splits on, the split value, the places of its children, its
value and its cover (training rows that reached it). A leaf is its own child, so walking on from it stays there.
Together with the keyed maps and the record of medians, categories and slot order, the arrays are all that a forecast
needs: ``portable_forecast`` uses neither the fitted pipeline nor Spark ML.

All of it has the size of the model, not of the data.
"""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shelfweave.session import fresh_path
from shelfweave.sources.keyed_maps import with_mapped_means

FOREST_SCHEMA = (
    "tree INT, weight DOUBLE, depth INT, slot ARRAY<INT>, split ARRAY<DOUBLE>, left ARRAY<INT>, right ARRAY<INT>, "
    "value ARRAY<DOUBLE>, cover ARRAY<DOUBLE>"
)


def forest_table(spark: SparkSession, ensemble) -> DataFrame:
    """One row per tree of a fitted ensemble, by FOREST_SCHEMA: of Spark ML, or with a ``forest`` of its own.

    A slot with two categories splits at one half; its children change places if category 1 goes left. A slot with more
    categories raises when the table is read, as its splits are sets and not values.
    """
    if hasattr(ensemble, "forest"):
        return ensemble.forest(spark)
    path = fresh_path(spark, "ensemble")
    ensemble.write().overwrite().save(path)
    boosted = isinstance(ensemble, GBTRegressionModel)
    weights = ensemble.treeWeights if boosted else [1.0 / ensemble.getNumTrees] * ensemble.getNumTrees
    node, split = F.col("nodeData"), F.col("nodeData.split")
    bounds, kinds = split["leftCategoriesOrThreshold"], split["numCategories"]
    leaf, swapped = node["leftChild"] < 0, (kinds == 2) & F.array_contains(bounds, 1.0)
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), F.struct(
        node["id"].alias("id"),
        F.when(leaf, 0).otherwise(split["featureIndex"]).alias("slot"),
        F.when(leaf, 0.0).when(kinds == -1, bounds[0]).when(kinds == 2, 0.5)
        .otherwise(F.raise_error(F.lit("a split on more than two categories has no split value"))).alias("split"),
        F.when(leaf, node["id"]).when(swapped, node["rightChild"]).otherwise(node["leftChild"]).alias("left"),
        F.when(leaf, node["id"]).when(swapped, node["leftChild"]).otherwise(node["rightChild"]).alias("right"),
        node["prediction"].alias("value"), node["impurityStats"][0].alias("cover"),
    ).alias("n"))
    held = nodes.groupBy("tree").agg(F.array_sort(F.collect_list("n")).alias("n"))  # a tree's nodes, by their number
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("tree") + 1)
    return held.select(
        "tree", weight.alias("weight"), F.lit(ensemble.getMaxDepth()).alias("depth"),
        *[F.col(f"n.{c}").alias(c) for c in ("slot", "split", "left", "right", "value", "cover")])


def write_forest(forest: DataFrame, path: str) -> None:
    """JSON lines, one per tree, beside the maps and the record."""
    forest.coalesce(1).write.mode("overwrite").json(f"{path}/forest")


def read_forest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOREST_SCHEMA).json(f"{path}/forest")


def _leaf(slots: Column, tree: Column) -> Column:
    """Place of the leaf that a row's slots lead to."""
    def step(at, _):
        goes_left = F.get(slots, F.get(tree["slot"], at)) <= F.get(tree["split"], at)
        return F.when(goes_left, F.get(tree["left"], at)).otherwise(F.get(tree["right"], at))

    return F.aggregate(F.sequence(F.lit(1), tree["depth"]), F.lit(0), step)


def with_walk(df: DataFrame, slots: Column, forest: DataFrame, name: str) -> DataFrame:
    """``df`` with the ensemble's raw forecast for an array of slot values, which must hold no NULL."""
    trees = forest.agg(F.array_sort(F.collect_list(F.struct(*forest.columns))).alias("trees")).scalar()
    # bound to a variable, the slots are computed once per row and not once per node
    value = F.aggregate(F.array("_slots"), F.lit(0.0), lambda _, row: F.aggregate(
        "_trees", F.lit(0.0), lambda total, tree: total + tree["weight"] * F.get(tree["value"], _leaf(row, tree))))
    return df.select("*", slots.alias("_slots"), trees.alias("_trees")).select(*df.columns, value.alias(name))


def portable_slots(record: Row) -> Column:
    """The slot values of a row with calendar columns and learned means, in the order the record names them."""
    medians, categories = record["medians"], record["categories"]
    onehot = {f"{name}_onehot_{value}": F.col(name) == value for name, values in categories.items() for value in values}

    def slot(name: str) -> Column:
        if name in medians:
            return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None)), F.lit(medians[name]))
        return F.coalesce(onehot.get(name, F.col(name)).cast("double"), F.lit(0.0))

    return F.array(*[slot(name) for name in record["feature_order"]])


def portable_forecast(
    rows: DataFrame, maps: DataFrame, shards: dict[str, int], record: Row, forest: DataFrame, name: str = "forecast",
) -> DataFrame:
    """``rows`` (date, store, item) with the raw forecast of the exported artifacts; other columns stay.

    Unseen ids and months take the fallbacks of the learned means. A NULL date or id leaves slots without a value, which the
    record's medians fill.
    """
    ready = with_mapped_means(rows, maps, shards, record["global_mean"])
    return with_walk(ready, portable_slots(record), forest, name).select(*rows.columns, name)
