"""What every slot contributes to one forecast: exact Shapley values of a tree ensemble.

A forecast is a game of its slots: a coalition's worth is the forecast expected when the slots outside it are unknown and
every node passes rows on in the shares of its children's covers (path-dependent attribution, Lundberg et al. 2018). A
leaf takes part by the distinct slots on its path. For each of them let o be 1 if the row passes all its splits on the path
and z the product of its cover shares there. The slot's part of the leaf is then

    value (o_i - z_i) * integral over t in [0, 1] of the product over the other slots j of ((1 - t) z_j + t o_j)

because a coalition of size s among d has the weight that t^s (1 - t)^(d - 1 - s) integrates to. The integrand is a
polynomial of degree d - 1, so Gauss-Legendre quadrature with d / 2 nodes is exact: no sum over subsets.

A row meets a leaf only by which o are 1. Per Arrow batch and leaf each pattern that occurs is computed once and
handed to its rows. The tables have the size of the model; rows are neither shuffled nor collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    """A leaf's weighted value, its distinct slots, the interval (low, high] and the cover share of each."""

    value: float
    slots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves(tree: Row) -> list[Leaf]:
    """The leaves of one row of a forest table."""
    found = []
    todo = [(0, {})]  # node, slot -> [low, high, share] on the way to it
    while todo:
        at, path = todo.pop()
        left, right = tree["left"][at], tree["right"][at]
        if left == at:
            slots = sorted(path)
            low, high, share = (np.array([path[s][k] for s in slots]) for k in range(3))
            found.append(Leaf(tree["weight"] * tree["value"][at], np.array(slots, int), low, high, share))
            continue
        slot, split = tree["slot"][at], tree["split"][at]
        low, high, share = path.get(slot, (-np.inf, np.inf, 1.0))
        for child, bounds in ((left, (low, min(high, split))), (right, (max(low, split), high))):
            todo.append((child, {**path, slot: (*bounds, share * tree["cover"][child] / tree["cover"][at])}))
    return found


def expected(found: list[Leaf]) -> float:
    """The forecast of an unknown row: every leaf by its share of the covers."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in found))


def pattern_parts(leaf: Leaf, passed: np.ndarray) -> np.ndarray:
    """Part of each of the leaf's slots for patterns of passed slots (patterns x slots, 0 or 1)."""
    d = len(leaf.slots)
    nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    out = np.zeros(passed.shape)
    for t, w in zip((nodes + 1) / 2, weights / 2):
        factor = (1 - t) * leaf.share + t * passed
        # the product over the others: what stands before times what stands after
        before = np.cumprod(np.concatenate([np.ones((len(passed), 1)), factor[:, :-1]], 1), 1)
        after = np.cumprod(np.concatenate([np.ones((len(passed), 1)), factor[:, :0:-1]], 1), 1)[:, ::-1]
        out += w * before * after
    return leaf.value * (passed - leaf.share) * out


def contributions(found: list[Leaf], slots: np.ndarray) -> np.ndarray:
    """Contribution of every slot (columns) to the forecast of every row of ``slots``."""
    out = np.zeros(slots.shape)
    for leaf in found:
        if not len(leaf.slots):
            continue
        values = slots[:, leaf.slots]
        passed = (values > leaf.low) & (values <= leaf.high)
        patterns, row = np.unique(np.packbits(passed, axis=1), axis=0, return_inverse=True)
        bits = np.unpackbits(patterns, axis=1, count=len(leaf.slots)).astype(float)
        out[:, leaf.slots] += pattern_parts(leaf, bits)[row.ravel()]
    return out


def attribute(rows: DataFrame, forest: DataFrame, slots: str = "slots") -> DataFrame:
    """``rows`` with ``base`` (the forecast of an unknown row) and ``contributions`` (one per entry of column ``slots``).

    Base and contributions add up to the raw forecast. A slot that no tree splits on contributes 0. Slots must hold
    numbers, without NULL; other columns stay as they are.
    """
    trees = forest.collect()  # the model
    found = [leaf for tree in trees for leaf in leaves(tree)]
    base = expected(found)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                matrix = np.stack([np.asarray(v, float) for v in frame[slots]])
                yield frame.assign(base=base, contributions=list(contributions(found, matrix)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{fields}, base DOUBLE, contributions ARRAY<DOUBLE>")


def mean_impact(attributed: DataFrame, names: list[str]) -> DataFrame:
    """(feature, mean_abs_attribution) over all rows: one sum per slot, combined before anything is shuffled."""
    means = attributed.agg(*[
        F.avg(F.abs(F.get(F.col("contributions"), F.lit(i)))).alias(f"m{i}") for i in range(len(names))])
    pairs = F.array(*[
        F.struct(F.lit(name).alias("feature"), F.coalesce(F.col(f"m{i}"), F.lit(0.0)).alias("mean_abs_attribution"))
        for i, name in enumerate(names)])
    return means.select(F.inline(pairs)).orderBy(F.desc("mean_abs_attribution"), "feature")
