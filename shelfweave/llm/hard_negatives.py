"""Hard negatives by a secondary-sort shuffle.

For an anchor, rows of its label with the highest scores are positives; rows of other labels whose score lies in
a positive's window, from ``low`` to ``high`` percent of the positive's score, are its hard negatives.

Scores are packed into rows with the key (anchor, falling score, positive before negative, id), partitioned by
anchor and sorted by the whole key inside the shuffle (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
repartitionAndSortWithinPartitions, which sorts outside Python and spills). An iterator then walks each
partition once: a positive opens a window, negatives that fall into open windows are handed out with their
rank, a full window closes. It holds one anchor's open windows and never an anchor's rows.

What is shuffled is combined first. Anchors in blocks of bounded size stay in a task while the vectors
of a part stream past; a tile of vectors hands on only what can be among the first ``n_positive`` rows of the label, or the first
``n_negative`` of a window. The windows are known by then, as positives are found in a first pass of the same
kind. A label of a third of all rows makes no difference: rows are dealt by number, not by label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfweave.llm.topk import products
from shelfweave.session import fresh_path, store_table

#: Anchors held by a task, vectors scored at a time and anchors scored at a time.
ANCHORS, TILE, ROWS = 4096, 16_384, 256
#: Vectors of a part that stream past them; less, LEAST_PART at least, where that would give under LEAST_PARTS parts.
PART, LEAST_PART, LEAST_PARTS = 65_536, 1024, 64


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k by falling score, then id; rows that tie in both are alike."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _tiles(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """(anchors, tile of vectors) of every (block, part, size) in rows sorted by these, anchors first."""
    keys, held = ["block", "part", "size"], None
    key, anchors = None, None

    def cut(done: bool):
        """Whole runs of held rows, and of the last run at least a tile."""
        nonlocal held, key, anchors
        while held is not None and len(held):
            first = tuple(held[keys].iloc[0])
            run = int((held[keys] != first).any(axis=1).to_numpy().argmax()) or len(held)
            whole = run < len(held) or done
            if first != key:
                key, anchors = first, None
            part = held.iloc[:run]
            new = part[part["kind"] == 0]
            vectors = part[part["kind"] == 1]
            if not whole and (len(vectors) < TILE):
                return
            if len(new):
                anchors = new if anchors is None else pd.concat([anchors, new], ignore_index=True)
            for at in range(0, len(vectors), TILE):
                if anchors is not None:
                    yield anchors, vectors.iloc[at:at + TILE]
            held = held.iloc[run:]

    for frame in frames:
        held = frame if held is None or not len(held) else pd.concat([held, frame], ignore_index=True)
        yield from cut(False)
    yield from cut(True)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in vectors]) if len(vectors) else np.zeros((0, 0), np.int64)


def _chosen(choose):
    """A task that reports, per tile and anchor, the vectors that ``choose`` picks from their scores."""
    def run(frames):
        for anchors, tile in _tiles(frames):
            matrix, ids, labels, serials = (
                _matrix(tile["v"]), tile["id"].to_numpy(), tile["label"].to_numpy(), tile["serial"].to_numpy())
            found = []
            for at in range(0, len(anchors), ROWS):
                part = anchors.iloc[at:at + ROWS]
                for row, scores in zip(part.itertuples(), products(_matrix(part["v"]), matrix)):
                    picked = choose(row, scores, ids, labels, serials)
                    found.append((np.full(len(picked), row.serial), scores[picked], ids[picked]))
            if found:
                yield pd.DataFrame(dict(zip(("anchor", "score", "id"), map(np.concatenate, zip(*found)))))
    return run


def _nearest(k: int):
    def choose(anchor, scores, ids, labels, serials):
        at = np.flatnonzero((labels == anchor.label) & (serials != anchor.serial))
        return at[_first(scores[at], ids[at], k)]
    return choose


def _inside(k: int, low: int, high: int):
    def choose(anchor, scores, ids, labels, serials):
        other = np.flatnonzero(labels != anchor.label)
        their, picked = scores[other], [np.zeros(0, np.int64)]
        for positive in set(anchor.positives):
            at = other[(100 * their >= low * positive) & (100 * their <= high * positive)]
            picked.append(at[_first(scores[at], ids[at], k)])
        return np.unique(np.concatenate(picked))
    return choose


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, parts: int) -> DataFrame:
    """Every part of the vectors beside every block of the anchors, anchors first; one shuffle."""
    sequence = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = anchors.select(
        F.pmod(F.xxhash64("serial"), F.lit(blocks)).cast("int").alias("block"), sequence(parts).alias("part"),
        F.size("v").alias("size"), F.lit(0).alias("kind"), "serial", "id", "label", "v", "positives")
    streamed = rows.select(
        sequence(blocks).alias("block"), F.pmod(F.xxhash64("serial"), F.lit(parts)).cast("int").alias("part"),
        F.size("v").alias("size"), F.lit(1).alias("kind"), "serial", "id", "label", "v",
        F.array().cast("array<long>").alias("positives"))
    return held.unionByName(streamed).repartition("block", "part").sortWithinPartitions("block", "part", "size", "kind")


def _sorted(scored: DataFrame) -> DataFrame:
    """The secondary sort: by anchor across partitions, by the whole key inside them."""
    return scored.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "id")


def _leading(k: int):
    """The first k rows of every anchor."""
    def run(frames):
        anchor, seen = None, 0
        for frame in frames:
            taken = []
            for i, a in enumerate(frame["anchor"].tolist()):
                seen = seen + 1 if a == anchor else 1
                anchor = a
                if seen <= k:
                    taken.append((i, seen))
            out = frame.iloc[[i for i, _ in taken]][["anchor", "score", "id"]]
            yield out.assign(place=np.array([n for _, n in taken], np.int32))
    return run


def _windows(k: int, low: int, high: int):
    """(anchor, positive and negative with their scores, rank): negatives in the order in which they meet open windows."""
    def run(frames):
        anchor, opened = None, []  # opened: [positive id, its score, negatives given]; at most n_positive of them
        for frame in frames:
            out = []
            for a, score, kind, row_id in zip(*(frame[c].tolist() for c in ("anchor", "score", "kind", "id"))):
                if a != anchor:
                    anchor, opened = a, []
                if kind == 0:
                    opened.append([row_id, score, 0])
                    continue
                for window in opened:
                    if window[2] < k and low * window[1] <= 100 * score <= high * window[1]:
                        window[2] += 1
                        out.append((a, window[0], window[2], row_id, window[1], score))
                # scores only fall: what is full or lies above is closed for good
                opened = [w for w in opened if w[2] < k and 100 * score >= low * w[1]]
            yield pd.DataFrame(out, columns=["anchor", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
    return run


def mine(
    vectors: DataFrame, is_anchor: Column, n_positive: int = 5, n_negative: int = 10, low: int = 30, high: int = 90,
    vec_id: str = "vec_id", vector: str = "vector", label: str = "label", anchors_held: int = ANCHORS, part_size: int | None = None,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    ``vectors`` has an id, an array of longs and a label; ``is_anchor`` is a condition on it. Every row, the anchor's own
    excepted, is a candidate; scores are inner products, which must fit a long. The first ``n_positive`` rows of the
    anchor's label are its positives; each gets the first ``n_negative`` rows of other labels with ``low`` <= 100 *
    negative score / positive score <= ``high`` (a positive of negative score has none). First means by falling
    score, then by id.

    Rows with a NULL id, vector or label take no part; vectors are compared with those of their size only. A row
    that repeats an id is a candidate, and an anchor, of its own, so repeated anchors repeat their rows. No
    anchor, no positive or no negative gives no row; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).filter("id IS NOT NULL AND v IS NOT NULL AND label IS NOT NULL")
    # stored, so that a row keeps its number whatever is computed again
    rows = store_table(rows.withColumn("serial", F.monotonically_increasing_id()), fresh_path(spark, "vectors"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).first()
    size = part_size or min(PART, max(LEAST_PART, math.ceil(sizes.n / LEAST_PARTS)))
    blocks, parts = max(1, math.ceil(sizes.asks / anchors_held)), max(1, math.ceil(sizes.n / size))
    anchors = rows.filter("asks").withColumn("positives", F.array().cast("array<long>"))

    same = _met(rows, anchors, blocks, parts).mapInPandas(_chosen(_nearest(n_positive)), "anchor long, score long, id long")
    positives = store_table(
        _sorted(same.withColumn("kind", F.lit(0))).mapInPandas(
            _leading(n_positive), "anchor long, score long, id long, place int"), fresh_path(spark, "positives"))
    told = positives.groupBy(F.col("anchor").alias("serial")).agg(F.collect_list("score").alias("positives"))  # n_positive at most
    asking = anchors.drop("positives").join(told, "serial")
    others = _met(rows, asking, blocks, parts).mapInPandas(
        _chosen(_inside(n_negative, low, high)), "anchor long, score long, id long")
    packed = positives.select("anchor", "score", "id", F.lit(0).alias("kind")).unionByName(others.withColumn("kind", F.lit(1)))
    mined = _sorted(packed).mapInPandas(
        _windows(n_negative, low, high),
        "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    named = anchors.select(F.col("serial").alias("anchor"), F.col("id").alias("anchor_id"))
    return mined.join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
