"""Gradient boosting on histograms, with a leaf bound and an L2 term.

Slots are binned to bytes once. Rows are held in blocks of some 65,536, with their bins slot by slot and their residuals, so
that a pass is a handful of array operations per block. Passes are many and short and hand back one array each, so the blocks are
the elements of an RDD that is reduced over and over, as Spark's own learners do; planning a query for each pass took longer
than the pass.

A round grows one tree level by level. For the nodes of a level every task sums residuals and counts per (node, slot, bin);
sums of sums are all that leaves the tasks, of a size set by the model's parameters. Only the smaller child of a pair is
summed, its sibling is the difference to their parent. A node's best split depends on its own rows alone, so
best-first growth needs no further passes: of the tree grown to ``max_depth``, the splits are taken by falling gain, parents
first, until ``max_leaves`` is reached.

The loss is squared error: a leaf's value is the sum of its residuals, divided by its rows plus ``l2``. The result is a forest table
(see portable_forest), which scoring, export and attribution share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweave.operators.ml_stages import StageRecord, StageRecordReader
from shelfweave.session import fresh_path, shared_root, store_table
from shelfweave.sources.portable_forest import FOREST_SCHEMA

BLOCK = 65_536
#: Rows that the bin edges are taken from, about.
EDGE_ROWS = 50_000
#: Rounds whose trees are applied on the way before residuals are held anew, and after which they are checkpointed.
HELD_EVERY, STORED_EVERY = 3, 24
#: Partial sums that the driver adds up itself; more are first added up in tasks.
DIRECT = 64


@dataclass(frozen=True)
class BoostingParams:
    rounds: int = 100
    rate: float = 0.1
    max_depth: int = 6
    max_leaves: int = 31
    max_bins: int = 64
    min_rows: int = 20
    l2: float = 0.0
    rows_share: float = 1.0
    slots_share: float = 1.0
    seed: int = 42


def bin_edges(rows: DataFrame, slots: str, n_rows: int, max_bins: int, seed: int) -> list[np.ndarray]:
    """Rising upper bounds of all bins but the last, per slot: its distinct values if they are few, else quantiles.

    From about EDGE_ROWS rows, as edges are only the places where splits are tried.
    """
    drawn = rows.select(slots) if n_rows <= EDGE_ROWS else rows.select(slots).sample(EDGE_ROWS / n_rows, seed)
    matrix = np.array([r[0] for r in drawn.collect()], float)
    found = []
    for column in matrix.T:
        values = np.unique(column)
        if len(values) > max_bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, max_bins + 1)[1:], method="inverted_cdf"))
        found.append(values[:-1])
    return found


def to_blocks(rows: DataFrame, slots: str, label: str, edges: list[np.ndarray], start: float) -> RDD:
    """(block, bins, residuals): the binned rows and what the forecast ``start`` leaves of their targets."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            if not len(frame):
                continue
            matrix = np.stack([np.asarray(v, float) for v in frame["x"]])
            bins = np.stack([np.searchsorted(e, matrix[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)
            held.append((bins, frame["y"].to_numpy(float) - start))
            n += len(frame)
            if n >= BLOCK:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    def packed(held):
        bins, left = np.concatenate([b for b, _ in held], 1), np.concatenate([t for _, t in held])
        return pd.DataFrame({"bins": [bins.tobytes()], "residuals": [left.tobytes()]})

    def unpacked(row):
        left = np.frombuffer(row["residuals"], float)
        return row["block"], np.frombuffer(row["bins"], np.uint8).reshape(-1, len(left)), left

    ready = rows.select(F.col(slots).alias("x"), F.col(label).cast("double").alias("y"))
    blocks = ready.mapInPandas(run, "bins BINARY, residuals BINARY").withColumn("block", F.monotonically_increasing_id())
    return store_table(blocks, fresh_path(rows.sparkSession, "blocks")).rdd.map(unpacked)


class Tree:
    """A growing tree: split slot and bin, children, residual sum, rows and best gain of each node."""

    def __init__(self):
        self.slot, self.bin, self.left, self.right = [0], [255], [0], [0]
        self.total, self.rows, self.gain = [0.0], [0], [0.0]

    def split(self, node: int, slot: int, at: int) -> tuple[int, int]:
        first = len(self.slot)
        for child in (first, first + 1):
            self.slot.append(0)
            self.bin.append(255)
            self.left.append(child)
            self.right.append(child)
            self.total.append(0.0)
            self.rows.append(0)
            self.gain.append(0.0)
        self.slot[node], self.bin[node], self.left[node], self.right[node] = slot, at, first, first + 1
        return first, first + 1

    def leaf_of(self, bins: np.ndarray, depth: int) -> np.ndarray:
        n = bins.shape[1]
        at, flat, row = np.zeros(n, np.int64), bins.ravel(), np.arange(n)
        slot, split, left, right = (np.array(x) for x in (self.slot, self.bin, self.left, self.right))
        first = slot * n  # where a node's slot begins
        for _ in range(depth):
            at = np.where(flat.take(first.take(at) + row) <= split.take(at), left.take(at), right.take(at))
        return at


def _drawn(block: int, n: int, share: float, seed: int) -> np.ndarray:
    """The rows of a block that a round learns from; the same whenever they are computed."""
    return np.random.default_rng([seed, block]).random(n) < share


class Growth:
    """What a task needs: the trees not yet applied to the residuals, with their leaf values, and the growing one."""

    def __init__(self, p: BoostingParams):
        self.p, self.pending = p, []

    def residuals(self, bins: np.ndarray, left: np.ndarray) -> np.ndarray:
        for tree, values in self.pending:
            left = left - values[tree.leaf_of(bins, self.p.max_depth)]
        return left


def histograms(blocks: RDD, growth: Growth, tree: Tree, nodes: list[int], slots: list[int], depth: int, seed: int) -> np.ndarray:
    """Residual sums and counts: 2 x nodes x slots x bins."""
    p, width = growth.p, len(nodes) * growth.p.max_bins
    place = np.full(len(tree.slot), -1, np.int64)
    place[nodes] = np.arange(len(nodes))

    def run(parts):
        total = np.zeros((2, len(slots), width))
        for block, bins, left in parts:
            node = place[tree.leaf_of(bins, depth)]
            used = node >= 0
            if p.rows_share < 1:
                used &= _drawn(block, len(left), p.rows_share, seed)
            if not used.all():
                at = np.flatnonzero(used)
                node, left, bins = node.take(at), left.take(at), bins.take(at, 1)
            left, node = growth.residuals(bins, left), node * p.max_bins
            for j, s in enumerate(slots):
                cell = node + bins[s]
                total[0, j] += np.bincount(cell, left, width)
                total[1, j] += np.bincount(cell, minlength=width)
        yield total

    sums = blocks.mapPartitions(run)
    add = np.add
    total = sums.treeReduce(add, 2) if blocks.getNumPartitions() > DIRECT else sums.reduce(add)
    return total.reshape(2, len(slots), len(nodes), p.max_bins).transpose(0, 2, 1, 3)


def best_split(sums: np.ndarray, counts: np.ndarray, l2: float, min_rows: int) -> tuple[float, int, int]:
    """(gain, slot place, bin) of one node's slots x bins; of equal gains the first slot, then the first bin. Gain 0: none."""
    left_sum, left_n = np.cumsum(sums, 1)[:, :-1], np.cumsum(counts, 1)[:, :-1]
    total, n = sums.sum(1, keepdims=True), counts.sum(1, keepdims=True)
    right_sum, right_n = total - left_sum, n - left_n
    least = max(1, min_rows)
    fits = (left_n >= least) & (right_n >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_sum**2 / (left_n + l2) + right_sum**2 / (right_n + l2) - total**2 / (n + l2)
    gain = np.where(fits, gain, 0.0)
    slot, at = divmod(int(gain.argmax()), gain.shape[1])
    return (float(gain[slot, at]), slot, at) if gain[slot, at] > 1e-9 else (0.0, 0, 0)


def grow(blocks: RDD, growth: Growth, n_slots: int, seed: int) -> Tree:
    """One tree on the residuals, cut to ``max_leaves`` by falling gain."""
    p = growth.p
    rng = np.random.default_rng(seed)
    slots = sorted(rng.permutation(n_slots)[:max(1, round(n_slots * p.slots_share))].tolist())
    tree = Tree()
    held = {0: histograms(blocks, growth, tree, [0], slots, 0, seed)[:, 0]}
    tree.total[0], tree.rows[0] = float(held[0][0][0].sum()), int(held[0][1][0].sum())
    level = [0]
    for depth in range(1, p.max_depth + 1):
        pairs = []
        for node in level:
            sums, counts = held[node]
            tree.gain[node], slot, at = best_split(sums, counts, p.l2, p.min_rows)
            if tree.gain[node]:
                left, right = tree.split(node, slots[slot], at)
                # the children's totals are read from the split, so leaves need no pass of their own
                tree.total[left], tree.rows[left] = float(sums[slot, :at + 1].sum()), int(counts[slot, :at + 1].sum())
                tree.total[right], tree.rows[right] = float(sums[slot, at + 1:].sum()), int(counts[slot, at + 1:].sum())
                pairs.append((node, *((left, right) if tree.rows[left] <= tree.rows[right] else (right, left))))
        if not pairs or depth == p.max_depth:
            break
        small = histograms(blocks, growth, tree, [s for _, s, _ in pairs], slots, depth, seed)
        level = []
        for i, (node, smaller, larger) in enumerate(pairs):
            held[smaller], held[larger] = small[:, i], held.pop(node) - small[:, i]
            level += [smaller, larger]
    return pruned(tree, p.max_leaves)


def pruned(tree: Tree, max_leaves: int) -> Tree:
    """The tree that best-first growth would have grown: splits by falling gain, a node after its parent."""
    out = Tree()
    out.total[0], out.rows[0] = tree.total[0], tree.rows[0]
    waiting, leaves = [(-tree.gain[0], 0, 0)] if tree.left[0] else [], 1
    while waiting and leaves < max_leaves:
        _, node, place = heapq.heappop(waiting)
        children = out.split(place, tree.slot[node], tree.bin[node])
        out.gain[place] = tree.gain[node]
        for old, new in zip((tree.left[node], tree.right[node]), children):
            out.total[new], out.rows[new] = tree.total[old], tree.rows[old]
            if tree.left[old] != old:
                heapq.heappush(waiting, (-tree.gain[old], old, new))
        leaves += 1
    return out


def boost(rows: DataFrame, params: BoostingParams = BoostingParams(), slots: str = "slots", label: str = "sales") -> DataFrame:
    """A forest table fitted to ``label`` on the array column ``slots`` (the same number of values in every row, no NULL).

    Rows with a NULL array or target do not count; without rows the forest is a single leaf of 0.
    """
    p, spark = params, rows.sparkSession
    if not 2 <= p.max_bins <= 256:
        raise ValueError("2 to 256 bins fit a byte")
    shared_root(spark)  # lineage is cut there
    known = rows.filter(F.col(slots).isNotNull() & F.col(label).isNotNull())
    told = known.agg(F.avg(label).alias("mean"), F.count("*").alias("n"), F.max(F.size(slots)).alias("slots")).first()
    start = float(told["mean"] or 0.0)
    forest = [(0, 1.0, 0, [0], [0.0], [0], [0], [start], [float(told["n"])])]
    if not told["n"]:
        return spark.createDataFrame(forest, FOREST_SCHEMA)
    edges = bin_edges(known, slots, told["n"], p.max_bins, p.seed)
    blocks, growth = to_blocks(known, slots, label, edges, start).persist(StorageLevel.MEMORY_AND_DISK), Growth(p)
    for number in range(1, p.rounds + 1):
        tree = grow(blocks, growth, told["slots"], p.seed + number)
        values = np.array([total / (n + p.l2) if n + p.l2 else 0.0 for total, n in zip(tree.total, tree.rows)])
        forest.append((
            number, p.rate, p.max_depth, tree.slot,
            [float(edges[s][b]) if left != i else 0.0 for i, (s, b, left) in enumerate(zip(tree.slot, tree.bin, tree.left))],
            tree.left, tree.right, values.tolist(), [float(n) for n in tree.rows]))
        growth.pending.append((tree, p.rate * values))
        if number % HELD_EVERY == 0 and number < p.rounds:
            blocks, growth = _held(blocks, growth, number % STORED_EVERY == 0), Growth(p)
    blocks.unpersist()
    return spark.createDataFrame(forest, FOREST_SCHEMA)


def _held(blocks: RDD, growth: Growth, stored: bool) -> RDD:
    """The blocks with the pending trees applied, held before the ones before are let go."""
    after = blocks.map(lambda b: (b[0], b[1], growth.residuals(b[1], b[2]))).persist(StorageLevel.MEMORY_AND_DISK)
    if stored:
        after.checkpoint()
    after.count()
    blocks.unpersist()
    return after


def forest_values(trees: list, slots: np.ndarray) -> np.ndarray:
    """Raw forecasts of a matrix of slots, walked by whole columns."""
    total, row = np.zeros(len(slots)), np.arange(len(slots))
    for t in trees:
        slot, split, left, right, value = (np.asarray(t[c]) for c in ("slot", "split", "left", "right", "value"))
        at = np.zeros(len(slots), int)
        for _ in range(t["depth"]):
            at = np.where(slots[row, slot[at]] <= split[at], left[at], right[at])
        total += t["weight"] * value[at]
    return total


def forecast_column(trees: list, slots: Column) -> Column:
    """The forest's raw forecast of an array column, by Arrow batches; for forests too large to walk row by row."""
    @F.pandas_udf("double")
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(forest_values(trees, np.stack([np.asarray(v, float) for v in values])) if len(values) else [], dtype="float64")
    return of(slots)


def score_forest(rows: DataFrame, forest: DataFrame, slots: str = "slots", name: str = "forecast") -> DataFrame:
    """``rows`` with the raw forecast of a forest table, in column ``name``; the array ``slots`` must hold no NULL."""
    trees = [r.asDict() for r in forest.orderBy("tree").collect()]  # the model
    return rows.withColumn(name, forecast_column(trees, F.col(slots)))


class HistBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """``boost`` as a Spark ML stage."""

    def __init__(self, labelCol: str = "label", **params):
        super().__init__()
        self.boosting = BoostingParams(**params)
        self._set(labelCol=labelCol)

    def _fit(self, dataset: DataFrame) -> HistBoostingModel:
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("slots"), F.col(self.getLabelCol()).cast("double").alias("label"))
        trees = [r.asDict() for r in boost(rows, self.boosting, label="label").orderBy("tree").collect()]
        return HistBoostingModel(trees)._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


class HistBoostingModel(Model, HasFeaturesCol, HasPredictionCol, MLReadable, MLWritable):
    def __init__(self, trees: list[dict] | None = None):
        super().__init__()
        self.trees = trees or []

    def forest(self, spark: SparkSession) -> DataFrame:
        """The model by FOREST_SCHEMA, for walking, export and attribution."""
        names = FOREST_SCHEMA.split(", ")
        return spark.createDataFrame([tuple(t[n.split(" ")[0]] for n in names) for t in self.trees], FOREST_SCHEMA)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), forecast_column(self.trees, vector_to_array(self.getFeaturesCol())))

    def write(self) -> MLWriter:
        return StageRecord(self, self.trees)

    @classmethod
    def read(cls) -> MLReader:
        return StageRecordReader(cls)

    @classmethod
    def _restore(cls, state: list, path: str) -> HistBoostingModel:
        return cls(state)
