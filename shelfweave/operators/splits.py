"""Chronological splits and expanding time-series folds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfweave.schemas import PANEL_KEYS

SPLITS = ["train", "validation", "test"]
#: Rows without a date belong to no split; summaries and written splits keep them under this name.
UNDATED = "undated"


def split_label(date: Column, train_end: str, val_end: str) -> Column:
    """train up to and including train_end, validation up to val_end, test open-ended."""
    first, second = F.lit(train_end).cast("date"), F.lit(val_end).cast("date")
    return (
        F.when(date <= first, "train").when(date <= second, "validation").when(date > second, "test")
    )


def with_split(panel: DataFrame, train_end: str, val_end: str) -> DataFrame:
    return panel.withColumn("split", split_label(F.col("date"), train_end, val_end))


def train_rows(panel: DataFrame, train_end: str) -> DataFrame:
    return panel.filter(F.col("date") <= F.lit(train_end).cast("date"))


def validation_rows(panel: DataFrame, train_end: str, val_end: str) -> DataFrame:
    return panel.filter(
        (F.col("date") > F.lit(train_end).cast("date")) & (F.col("date") <= F.lit(val_end).cast("date"))
    )


def test_rows(panel: DataFrame, val_end: str) -> DataFrame:
    return panel.filter(F.col("date") > F.lit(val_end).cast("date"))


def with_every_split(panel: DataFrame, train_end: str, val_end: str) -> DataFrame:
    """``with_split`` in which rows without a date are labelled too, so that the parts add up to the panel."""
    return with_split(panel, train_end, val_end).fillna(UNDATED, subset=["split"])


def split_summary(panel: DataFrame, train_end: str, val_end: str) -> DataFrame:
    """Rows, date range and mean per split; rows without a date are counted as ``UNDATED``."""
    return (
        with_every_split(panel, train_end, val_end).groupBy("split").agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
            F.max("date").alias("last_date"), F.avg("sales").alias("mean_sales"),
        )
    )


@dataclass(frozen=True)
class Fold:
    """One expanding fold: train on keys before ``start``, test on [start, end)."""

    index: int
    start: tuple
    end: tuple | None

    def train(self, panel: DataFrame) -> DataFrame:
        return panel.filter(key_before(self.start))

    def test(self, panel: DataFrame) -> DataFrame:
        rows = panel.filter(~key_before(self.start))
        return rows if self.end is None else rows.filter(key_before(self.end))


def key_before(key: tuple) -> Column:
    """Rows whose (date, store, item) sorts before ``key``, never NULL; the date bound reaches the scan.

    A missing value sorts first, as in the counts that the keys come from.
    """
    (first, day), (second, store), (third, item) = (_order(name, value) for name, value in zip(PANEL_KEYS, key))
    reach = F.col("date").isNull() if key[0] is None else F.col("date").isNull() | (F.col("date") <= F.lit(key[0]).cast("date"))
    return reach & (first | (day & (second | (store & third))))


def _order(name: str, value) -> tuple[Column, Column]:
    """Whether the column lies before the value, and whether it equals it; NULL comes first."""
    column = F.col(name)
    if value is None:
        return F.lit(False), column.isNull()
    bound = F.lit(value).cast("date") if name == "date" else F.lit(value)
    return column.isNull() | (column < bound), column.eqNullSafe(bound)


def _among(name: str, values) -> Column:
    """Whether the column holds one of the values, NULL being one like any other."""
    known = sorted(v for v in values if v is not None)
    found = F.coalesce(F.col(name).isin(known), F.lit(False)) if known else F.lit(False)
    return found | F.col(name).isNull() if None in values else found


def _spans(rows: DataFrame, within: list[str], key: str) -> DataFrame:
    """Positions [_begin, _end) of each ``key`` group inside ``within``, from grouped counts.

    A window sees one row per group: the days of the calendar, the stores on one day, or
    the items of one store on one day.
    """
    order = Window.partitionBy(*within).orderBy(key)
    counts = rows.groupBy(*within, key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_end", F.sum("_n").over(order)).withColumn(
        "_begin", F.col("_end") - F.col("_n")
    )


def _covering(spans: DataFrame, targets: Column) -> DataFrame:
    """Keep the groups that cover a target; ``targets`` is an array of (target, position)."""
    covered = F.filter(
        targets, lambda t: (t["position"] >= F.col("_begin")) & (t["position"] < F.col("_end"))
    )
    return spans.withColumn("_t", F.explode(covered)).select(
        *spans.columns, F.col("_t.target").alias("target"),
        (F.col("_t.position") - F.col("_begin")).alias("position"),
    )


def _target(index: int, position) -> Column:
    return F.struct(F.lit(index).alias("target"), F.lit(position).cast("bigint").alias("position"))


def fold_starts(panel: DataFrame, n_splits: int) -> list[tuple]:
    """The (date, store, item) keys at which the test blocks of expanding folds begin.

    The panel is never sorted: the start positions are located level by level, first the
    day, then the store on that day, then the item of that store. Each level brings
    ``n_splits`` rows to the driver.
    """
    days = _spans(panel, [], "date").withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    size = F.floor(F.col("_total") / (n_splits + 1))
    starts = F.array(*[
        _target(j, F.col("_total") - (n_splits - j) * size) for j in range(n_splits)
    ])
    hits = _covering(days, starts).collect()
    if len(hits) < n_splits:
        raise ValueError(f"too few rows for {n_splits} folds")
    for level in (1, 2):
        within, key = PANEL_KEYS[:level], PANEL_KEYS[level]
        # each target looks only into the group found for it one level up
        here = F.array(*[
            F.when(
                reduce(and_, [F.col(k).eqNullSafe(F.lit(h[k])) for k in within]),
                _target(h["target"], h["position"]),
            )
            for h in hits
        ])
        rows = panel.filter(_among("date", {h["date"] for h in hits}))
        if level == 2:
            rows = rows.filter(_among("store", {h["store"] for h in hits}))
        hits = _covering(_spans(rows, within, key), F.array_compact(here)).collect()
    return [tuple(h[k] for k in PANEL_KEYS) for h in sorted(hits, key=lambda h: h["target"])]


def expanding_folds(panel: DataFrame, n_splits: int) -> list[Fold]:
    """Cut the panel in (date, store, item) order into ``n_splits`` expanding folds.

    With n rows each test block has n // (n_splits + 1) of them, the last block ends with
    the panel, and a fold trains on everything before its block. Keys are unique in a
    panel; rows that nevertheless share a key stay on the same side of a cut.
    """
    keys = fold_starts(panel, n_splits)
    return [Fold(j, key, end) for j, (key, end) in enumerate(zip(keys, [*keys[1:], None]))]


def fold_rows(panel: DataFrame, folds: list[Fold]) -> DataFrame:
    """Label each row with every (fold, role) it plays; one pass, no shuffle."""
    roles = []
    for fold in folds:
        in_test = ~key_before(fold.start)
        if fold.end is not None:
            in_test = in_test & key_before(fold.end)
        role = F.when(key_before(fold.start), "train").when(in_test, "test")
        roles.append(F.struct(F.lit(fold.index).alias("fold"), role.alias("role")))
    return (
        panel.withColumn("_role", F.explode(F.array(*roles)))
        .select(*panel.columns, "_role.fold", "_role.role")
        .dropna(subset=["role"])
    )
