"""Exact quantiles with linear interpolation, without one task seeing all values.

A first pass sums up every column in a mergeable sketch, which gives two values around each wanted rank. A second pass counts
what lies below the lower one and picks out what lies between: a small share of the rows, or copies of one value, which
collapse before the shuffle. Only these are ordered, in ranges that Spark balances. So no row is multiplied, and what is
shuffled does not grow with the number of distinct values. The sketch only guides; counts decide, and a bracket
that misses its rank is widened to the whole column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfweave.session import fresh_path, store_table

#: Rank error of the sketch is one in ACCURACY; a bracket reaches that many times SLACK to both sides.
ACCURACY, SLACK = 1000, 2.0


def _number(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None))


def brackets(df: DataFrame, columns: list[str], probs: list[float]) -> dict[tuple[int, int], tuple[float, float]]:
    """Values around the wanted rank, per column and prob (by number); columns without a value have none."""
    reach = SLACK / ACCURACY
    shares = [min(1.0, max(0.0, p + side)) for p in probs for side in (-reach, reach)]
    row = df.agg(*[F.percentile_approx(_number(c), shares, ACCURACY).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {
        (i, j): (row[f"c{i}"][2 * j], row[f"c{i}"][2 * j + 1])
        for i in range(len(columns)) if row[f"c{i}"] for j in range(len(probs))
    }


def bracket_counts(df: DataFrame, columns: list[str], around: dict) -> tuple[DataFrame, dict]:
    """The values inside the brackets as a stored table (column, prob, value, n), and how many values each column has and how
    many of them lie below each bracket; one pass."""
    inside, sums = [], []
    for (i, j), (low, high) in around.items():
        value = _number(columns[i])
        inside.append(F.when(value.between(low, high), F.struct(F.lit(i).alias("column"), F.lit(j).alias("prob"), value.alias("value"))))
        sums.append(F.count_if(value < low).alias(f"below_{i}_{j}"))
    sums += [F.count(_number(columns[i])).alias(f"n_{i}") for i in sorted({i for i, _ in around})]
    seen = Observation()
    picked = (
        df.observe(seen, *sums).select(F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("x"))
        .select("x.*").groupBy("column", "prob", "value").agg(F.count(F.lit(1)).alias("n")))
    stored = store_table(
        picked.repartitionByRange("column", "prob", "value").withColumn("_range", F.spark_partition_id()),
        fresh_path(df.sparkSession, "value-counts"))
    return stored, seen.get


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """One row per (name, prob) with the exact quantile; NULL and NaN do not count, columns without a value have no row."""
    spark = df.sparkSession
    around, parts = brackets(df, columns, probs), []
    while around:
        counts, seen = bracket_counts(df, columns, around)
        held = {(r["column"], r["prob"]): r["n"] for r in counts.groupBy("column", "prob").agg(F.sum("n").alias("n")).collect()}
        hit, missed = [], {}
        for (i, j) in around:
            rank, below = probs[j] * (seen[f"n_{i}"] - 1), seen[f"below_{i}_{j}"]
            if below <= int(rank) and -(-rank // 1) < below + held.get((i, j), 0):
                hit.append((i, j, columns[i], float(probs[j]), rank - below))
            else:
                missed[i, j] = (float("-inf"), float("inf"))
        parts.append(_located(counts, spark.createDataFrame(
            hit, "column INT, prob INT, name STRING, share DOUBLE, rank DOUBLE")))
        around = missed
    if not parts:
        return spark.createDataFrame([], "name STRING, prob DOUBLE, quantile DOUBLE")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _located(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The quantiles at the wanted ranks among counted values. Totals of the ranges say which hold them; only those are ordered."""
    keys = ["column", "prob"]
    spans = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("_n")).withColumn(
        "_end", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")))
    low, high = F.floor("rank"), F.ceil("rank")
    ranges = spans.join(F.broadcast(wanted), keys).select(  # a row per column and prob
        *keys, "_range", (F.col("_end") - F.col("_n")).alias("_begin"), "_end", "name", "share", "rank",
    ).filter((F.col("_end") > low) & (F.col("_begin") <= high))
    inside = Window.partitionBy(*keys, "_range").orderBy("value")
    ends = counts.join(F.broadcast(ranges), [*keys, "_range"]).withColumn(  # at most a row per range
        "_upto", F.col("_begin") + F.sum("n").over(inside))
    picked = ends.groupBy("name", "share", "rank").agg(
        F.min(F.when(F.col("_upto") > low, F.col("value"))).alias("_low"),
        F.min(F.when(F.col("_upto") > high, F.col("value"))).alias("_high"))
    return picked.select(
        "name", F.col("share").alias("prob"),
        (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("rank") - low)).alias("quantile"))


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians as a dict: one number per column reaches the driver."""
    rows = exact_quantiles(df, columns, [0.5]).collect()
    return {r["name"]: r["quantile"] for r in rows}
