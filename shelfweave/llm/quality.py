"""Quality by pairwise ranking (Bradley and Terry 1952).

A document has a strength, linear in features of its text. In a preference pair, one
document labelled good and one labelled bad, the good one wins with probability
sigmoid(difference of strengths); training maximises that over all pairs of a good and a bad
document. The cut between good and bad is the quantile of the strengths at the share of
bad labels. Scores are sigmoid(strength - cut), so the cut is at 0.5.

Features describe form, not content: shares of character kinds, word and line repetition,
compressibility, lengths. Each is split at its quantiles into indicator columns,
so a strength may rise and fall along a feature. Labels, language, source and id are
never inputs.

Edges, weights and cut come from every labelled document that may be learned from. Nobody lists the pairs: what a document
gains from all its pairs depends on its own strength and on how the strengths of the other class are spread, so a pass
counts strengths along a fine grid and another sums gains by feature. Passes run over blocks of binned rows, as in boosting;
two arrays of a fixed size are all that reaches the driver. Scoring covers all rows, whole texts, in Arrow batches.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfweave.llm.toxicity import known_labels, not_held_out
from shelfweave.operators.boosting import BLOCK, DIRECT
from shelfweave.operators.quantiles import exact_quantiles
from shelfweave.session import fresh_path, store_table, work_area

BINS = 12
L2 = 2e-3
#: Steps of the training at most, the slope at which it ends, and the steps that it remembers.
STEPS, FLAT, MEMORY = 100, 1e-5, 8
#: Strengths are counted between neighbours of this grid, shared by nearness; a chance read off it errs by less than 1e-5.
GRID = np.linspace(-32.0, 32.0, 4097)
THRESHOLD = 0.5

_LETTER = re.compile(r"[^\W\d_]+")
NAMES = ("letters", "upper", "digits", "space", "marks", "commas", "stops", "pipes", "runs", "word_length",
         "short_words", "distinct_words", "top_word", "ends_in_mark", "distinct_lines", "line_length", "packed", "length")


def features(text: str | None) -> list[float]:
    """The numbers of NAMES for one text; zeros for NULL and for texts of white space."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n, n_words = len(text), len(words)
    letters = sum(map(len, _LETTER.findall(text)))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    counted = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    data = text.encode("utf-8", "replace")
    stops = text.count(".") + text.count("!") + text.count("?")
    spaces = n - sum(map(len, words))
    return [
        letters / n, upper / n_words, sum(map(text.count, "0123456789")) / n, spaces / n,
        (n - letters - spaces) / n, text.count(",") / n_words, stops / n_words, text.count("|") / n_words,
        sum(1 for a, b in zip(words, words[1:]) if a == b) / n_words,
        (n - spaces) / n_words, sum(1 for w in words if len(w) <= 3) / n_words, len(counted) / n_words ** 0.9,
        max(counted.values()) / n_words, sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,") / n_words,
        len(set(lines)) / len(lines), math.log(n / len(lines)),
        len(zlib.compress(data, 1)) / len(data), math.log(n),
    ]


@dataclass(frozen=True)
class QualityModel:
    """Bin edges and weights: len(NAMES) x BINS numbers."""

    edges: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]
    cut: float

    def strength(self, matrix: np.ndarray) -> np.ndarray:
        total = np.zeros(len(matrix))
        for j, (edge, weight) in enumerate(zip(self.edges, self.weights)):
            total += weight[np.searchsorted(edge, matrix[:, j], side="right")]
        return total

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        matrix = np.array([features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.strength(matrix) - self.cut, -30, 30)))


def _shares(n: int) -> list[float]:
    return np.linspace(0, 1, n + 1)[1:-1].tolist()


def _bins(matrix: np.ndarray, edges: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.stack([np.searchsorted(e, matrix[:, j], side="right") for j, e in enumerate(edges)], 1).astype(np.uint8)


class _Ranking:
    """Passes over blocks of (bins, good); ``starts`` says where the weights of each feature begin."""

    def __init__(self, edges: tuple[np.ndarray, ...], theta: np.ndarray | None = None):
        self.edges, self.starts = edges, np.cumsum([0] + [len(e) + 1 for e in edges])
        self.theta = np.zeros(self.starts[-1]) if theta is None else theta

    def at(self, theta: np.ndarray) -> _Ranking:
        return _Ranking(self.edges, theta)

    def strength(self, bins: np.ndarray) -> np.ndarray:
        return self.theta[bins + self.starts[:-1]].sum(1)

    def spread(self, bins: np.ndarray, good: np.ndarray) -> np.ndarray:
        """How many bad (first row) and good documents lie at each point of the grid."""
        place = np.clip((self.strength(bins) - GRID[0]) / (GRID[1] - GRID[0]), 0, len(GRID) - 1)
        low = np.minimum(place.astype(int), len(GRID) - 2)
        return np.stack([
            np.bincount(low[who], 1 - (place - low)[who], len(GRID)) + np.bincount(low[who] + 1, (place - low)[who], len(GRID))
            for who in (~good, good)])

    def pull(self, lost: np.ndarray, bins: np.ndarray, good: np.ndarray) -> np.ndarray:
        """The gradient by weight, where ``lost`` gives what a bad and a good document lose at each point of the grid."""
        strength = self.strength(bins)
        per_doc = np.where(good, -np.interp(strength, GRID, lost[1]), np.interp(strength, GRID, lost[0]))
        return np.bincount((bins + self.starts[:-1]).ravel(), np.repeat(per_doc, bins.shape[1]), self.starts[-1])

    def weights(self) -> tuple[np.ndarray, ...]:
        return tuple(np.split(self.theta, self.starts[1:-1]))


def _over_grid(counts: np.ndarray, of_difference: np.ndarray) -> np.ndarray:
    """At each grid point x the sum over grid points y of counts[y] * of_difference(x - y)."""
    n, size = len(GRID), 1 << (3 * len(GRID) - 2).bit_length()
    both = np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(of_difference, size), size)
    return both[n - 1:2 * n - 1]


def _learn(ranking: _Ranking, total: Callable[[Callable], np.ndarray]) -> _Ranking:
    """The weights that maximise the likelihood of all pairs, by L-BFGS; ``total`` adds up a function of (bins, good) over all blocks.

    Minimised is the mean over pairs of -log sigmoid(difference), plus L2 / 2 times the squared weights.
    """
    steps = (GRID[1] - GRID[0]) * np.arange(1 - len(GRID), len(GRID))
    wins, loses = np.logaddexp(0, -steps), 1 / (1 + np.exp(np.clip(steps, -64, 64)))

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        spread = total(ranking.at(theta).spread)
        spread /= spread.sum(1, keepdims=True)
        return float(spread[1] @ _over_grid(spread[0], wins)) + L2 / 2 * float(theta @ theta), spread

    def slope(theta: np.ndarray, spread: np.ndarray) -> np.ndarray:
        # a good one loses to those above it, a bad one wins over those below it
        lost = np.stack([_over_grid(spread[1], loses[::-1]) / sizes[0], _over_grid(spread[0], loses) / sizes[1]])
        run = ranking.at(theta)
        return total(lambda bins, good: run.pull(lost, bins, good)) + L2 * theta

    sizes = total(lambda bins, good: np.array([(~good).sum(), good.sum()]))
    theta, past = ranking.theta, []
    value, spread = loss(theta)
    grad = slope(theta, spread)
    for _ in range(STEPS):
        if np.abs(grad).max() < FLAT:
            break
        step, taken = -grad, []
        for moved, turned in reversed(past):
            share = moved @ step / (moved @ turned)
            step = step - share * turned
            taken.append(share)
        step = step * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1.0)
        for (moved, turned), share in zip(past, reversed(taken)):
            step = step + (share - turned @ step / (moved @ turned)) * moved
        length, fall = 1.0, grad @ step
        while True:
            reached, there = loss(theta + length * step)
            if reached <= value + 1e-4 * length * fall or length < 1e-3:
                break
            length /= 2
        if reached >= value:  # what is left to gain is below the grid's accuracy
            break
        after = slope(theta + length * step, there)
        if (length * step) @ (after - grad) > 0:
            past = [*past, (length * step, after - grad)][-MEMORY:]
        theta, value, grad = theta + length * step, reached, after
    return ranking.at(theta)


def _cut_share(n_bad: int, n: int) -> float:
    """The share at which a quantile lies halfway between the last bad and the first good place."""
    return (n_bad - 0.5) / (n - 1)


def _one_class(good: bool) -> QualityModel:
    return QualityModel((), (), -1.0 if good else 1.0)


def fit(texts: list[str], labels: list[int]) -> QualityModel:
    """Learn strengths from all pairs (label 1 beats label 0) of a list of texts.

    Without both classes no pair exists: every text then has the same strength and a score by the labels seen.
    """
    y = np.asarray(labels, int)
    if not len(y) or y.min() == y.max():
        return _one_class(len(y) and y[0])
    matrix, good = np.array([features(t) for t in texts]), y == 1
    edges = tuple(np.unique(np.quantile(column, _shares(BINS))) for column in matrix.T)
    bins = _bins(matrix, edges)
    ranking = _learn(_Ranking(edges), lambda run: run(bins, good))
    cut = np.quantile(ranking.strength(bins), _cut_share(int((~good).sum()), len(y)))
    return QualityModel(edges, ranking.weights(), float(cut))


def _features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype="object")
    return of(text)


def labelled_features(
    documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, usable=not_held_out,
) -> DataFrame:
    """The columns ``good`` and one per feature (``f0`` ...), a row per labelled document whose label may be read.

    ``known_labels`` says which labels count; of several texts of one id the one with the least digest counts. Texts are read
    where they lie, only their numbers meet the labels.
    """
    known = known_labels(labels, label, usable)
    read = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(
        F.col("id").isNotNull() & usable(F.col("id")))
    numbers = read.select("id", F.struct(F.md5("text").alias("digest"), _features(F.col("text")).alias("x")).alias("read"))
    found = numbers.join(known, "id").groupBy("id").agg(F.min("read").alias("read"), F.max("y").alias("y"))
    return found.select((F.col("y") == 1).alias("good"), *[F.col("read.x")[j].alias(f"f{j}") for j in range(len(NAMES))])


def to_blocks(rows: DataFrame, edges: tuple[np.ndarray, ...]) -> DataFrame:
    """The rows of ``labelled_features`` as stored blocks: ``bins``, a byte per feature, and ``good``, a byte per row."""
    columns = [f"f{j}" for j in range(len(NAMES))]

    def packed(held: list) -> pd.DataFrame:
        bins, good = (np.concatenate(x) for x in zip(*held))
        return pd.DataFrame({"bins": [bins.tobytes()], "good": [good.tobytes()]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for frame in frames:
            held.append((_bins(frame[columns].to_numpy(float), edges), frame["good"].to_numpy(bool)))
            if sum(len(good) for _, good in held) >= BLOCK:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    blocks = rows.mapInPandas(run, "bins BINARY, good BINARY")
    return store_table(blocks, fresh_path(rows.sparkSession, "quality-blocks"))


def _unpacked(bins: bytes, good: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(bins, np.uint8).reshape(-1, len(NAMES)), np.frombuffer(good, bool)


def _strengths(blocks: DataFrame, ranking: _Ranking) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in zip(frame["bins"], frame["good"]):
                yield pd.DataFrame({"strength": ranking.strength(_unpacked(*block)[0])})
    return blocks.mapInPandas(run, "strength DOUBLE")


def train(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    usable=not_held_out,
) -> QualityModel:
    """The model learned from all labelled documents whose id is ``usable``.

    ``labelled_features`` says what missing and repeated ids, labels and texts do. Without labels of both classes, or without
    documents, every text has the same score.
    """
    spark = documents.sparkSession
    with work_area(spark):
        rows = store_table(
            labelled_features(documents, labels, doc_id, text, label, usable), fresh_path(spark, "quality-features"))
        n, n_good = rows.agg(F.count("*"), F.count_if("good")).first()
        if n_good in (0, n):
            return _one_class(n_good > 0)
        names = [f"f{j}" for j in range(len(NAMES))]
        found = exact_quantiles(rows, names, _shares(BINS)).collect()
        edges = tuple(np.unique([r["quantile"] for r in found if r["name"] == name]) for name in names)
        stored = to_blocks(rows, edges)
        blocks = stored.rdd.map(lambda r: _unpacked(r["bins"], r["good"])).persist(StorageLevel.MEMORY_AND_DISK)

        def total(run: Callable) -> np.ndarray:
            sums = blocks.map(lambda block: run(*block))
            return sums.treeReduce(np.add, 2) if sums.getNumPartitions() > DIRECT else sums.reduce(np.add)

        ranking = _learn(_Ranking(edges), total)
        blocks.unpersist()
        cut = exact_quantiles(_strengths(stored, ranking), ["strength"], [_cut_share(n - n_good, n)]).first()["quantile"]
        return QualityModel(edges, ranking.weights(), cut)


def quality(text: Column, model: QualityModel) -> Column:
    """Score from 0 to 1; NULL, empty and blank texts have all features zero and score like any other."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()), dtype="float64")
    return of(text)


def keep_good(documents: DataFrame, model: QualityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without the rows that score below ``threshold`` (a tie with it stays); all columns stay as they are.

    NULL and empty texts are scored like any other; repeated rows fare alike; an empty table stays empty.
    """
    return documents.filter(quality(F.col(text), model) >= threshold)
