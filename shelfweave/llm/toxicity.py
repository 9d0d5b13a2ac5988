"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or.

A label says only that something in a document is toxic. Every sentence has the log-odds
z = BIAS + weights of its words and p = sigmoid(z); a document is clean with probability

    (1 - leak) * product over its sentences of (1 - p) / (1 - sigmoid(BIAS))

so it is toxic if any sentence is. The division takes out what a sentence without evidence would
add, so length alone is never evidence, however long a clean text is. ``leak`` is the bias of a document: the
share of labelled ones whose sentences do not tell. Training maximises the likelihood of the
document labels, so blame moves to the sentences that tell labelled documents apart, and
``offending_sentences`` points at them.

A word stands for itself and for its beginnings of four to six letters, which lets rare
inflected forms share what is learned. A feature is learned if toxic documents hold it more often than
chance explains, at a bound where chance alone would let some FALSE_FEATURES of them pass; so the bound follows the
sample, and few documents still teach their clearest features. A prior draws the weights of a word's
features to the log-odds that their documents show, so what training cannot tell apart keeps that evidence. Labels, language, source and id are never inputs.

The model is fitted on the driver from a bounded sample of labelled rows
(``MAX_POSITIVE``, ``MAX_NEGATIVE``); scoring covers all rows, whole texts, in Arrow batches.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfweave.llm.text import held_out

#: Labelled documents the model is fitted on, at most; chosen by a hash of the id, not by position.
MAX_POSITIVE, MAX_NEGATIVE = 2500, 5000
#: Positive documents that hold a learned feature, at least: one document alone cannot show what its words have in common.
MIN_SUPPORT = 2
#: Bits that remember where words stood, as a power of two: 2 MB.
SEEN_BITS = 24
#: Learned features that chance alone would give, about.
FALSE_FEATURES = 4.0
#: Log-odds of a sentence without evidence.
BIAS = -10.0
#: Precision of the prior of the weights; 1 counts like a document or so.
PRIOR = 0.1
EPOCHS, STEP = 300, 0.15
THRESHOLD = 0.7

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 300_000


def sentences(text: str | None) -> list[str]:
    """The non-empty sentences of a text; a line break also ends one."""
    return [s for s in (x.strip() for x in _SENTENCE.split(text or "")) if s]


def word_features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n)]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


class _WordWeights(dict):
    """Word -> sum of its feature weights, filled as words come; of bounded size."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= _CACHE:  # a cache only: forgotten words are looked up again
            self.clear()
        self[word] = total = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return total


class ToxicityModel:
    """Weights of the known features; the sample bounds their number."""

    def __init__(self, leak: float, weights: dict[str, float], bias: float = BIAS):
        self.leak, self.weights, self.bias = leak, weights, bias
        self._words, self._base = _WordWeights(weights), _softplus(bias)

    def __reduce__(self):  # the cache stays behind
        return ToxicityModel, (self.leak, self.weights, self.bias)

    def sentence(self, sentence: str) -> float:
        """Log-odds that the sentence is toxic."""
        return self.bias + max(0.0, sum(map(self._words.__getitem__, _WORD.findall(sentence.lower()))))

    def read(self, text: str | None, threshold: float = 0.5) -> tuple[float, list[tuple[int, str, float]]]:
        """The score of a text and its sentences with p >= ``threshold``, as (position, sentence, p).

        A text that is toxic only by many weaker sentences names the likeliest.
        """
        told = [(i, s, z) for i, s in enumerate(sentences(text)) if (z := self.sentence(s)) != self.bias]
        if not told and not sentences(text):
            return 0.0, []
        clean = math.log1p(-self.leak) - math.fsum(_softplus(z) - self._base for _, _, z in told)
        score, found = -math.expm1(clean), [(i, s, 1 / (1 + math.exp(-z))) for i, s, z in told]
        offending = [x for x in found if x[2] >= threshold]
        if not offending and found and score >= THRESHOLD:
            offending = [max(found, key=lambda x: x[2])]
        return score, offending

    def score(self, text: str | None) -> float:
        return self.read(text)[0]


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def leaning(held: np.ndarray, rare: np.ndarray, n_pos: int, n_neg: int, false_features: float = FALSE_FEATURES) -> np.ndarray:
    """True for features that positive documents hold more often than chance explains.

    ``held`` of ``n_pos`` positive and ``rare`` of ``n_neg`` negative documents hold each feature. The chance of so many or
    more positive ones among all holders is the tail of a hypergeometric law, bounded by a geometric series.
    """
    log_fact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n_pos + n_neg + 1)))))
    choose = lambda n, k: log_fact[n] - log_fact[k] - log_fact[n - k]
    holders = held + rare

    def tail(h: np.ndarray, total: np.ndarray) -> np.ndarray:
        log_p = choose(n_pos, h) + choose(n_neg, total - h) - choose(n_pos + n_neg, total)
        ratio = (n_pos - h) * (total - h) / ((h + 1.0) * np.maximum(n_neg - total + h + 1.0, 1.0))
        return np.where(ratio < 1, np.exp(log_p) / np.maximum(1 - ratio, 1e-12), 1.0)

    p = np.minimum(tail(held, holders), 1.0)
    lowest = np.sort(np.minimum(tail(np.minimum(holders, n_pos), holders), 1.0))
    steps = np.sort(p)
    # at a bound t, chance lets pass t of the features that can reach t at all (for discrete tests: Heyse 2011)
    by_chance = steps * np.searchsorted(lowest, steps, side="right")
    passed = np.flatnonzero(by_chance <= false_features)
    return p <= steps[passed[-1]] if len(passed) else np.zeros(len(p), bool)


def _centres(chosen: list[str], held: Counter, rare: Counter) -> np.ndarray:
    """What each feature adds to the evidence of the longest chosen beginning it contains."""
    evidence = {f: -BIAS + math.log((held[f] + 0.5) / (rare[f] + 0.5)) for f in chosen}

    def above(feature: str) -> float:
        shorter = (f"^{feature[1:1 + n]}" for n in (6, 5, 4) if n < len(feature) - 1)
        return next((evidence[f] for f in shorter if f in evidence), 0.0)

    return np.array([evidence[f] - above(f) for f in chosen])


class FreshFeatures:
    """The features of texts, each counted once however many copies of a text there are.

    A word counts where it stands between two words as in no text before, and a text of which most words do not is a copy and
    holds nothing: copies are one witness, not many. Places are remembered as bits, so memory is fixed.
    """

    def __init__(self):
        self.seen = bytearray(1 << (SEEN_BITS - 3))

    def of(self, text: str | None) -> set[str] | None:
        """The features of fresh words; None for a copy."""
        words = _WORD.findall((text or "").lower())
        fresh, places = set(), []
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            at = zlib.crc32(f"{before} {word} {after}".encode()) >> (32 - SEEN_BITS)
            if not self.seen[at >> 3] >> (at & 7) & 1:
                fresh.add(word)
                places.append(at)
        if words and 2 * len(places) < len(words):
            return None
        for at in places:
            self.seen[at >> 3] |= 1 << (at & 7)
        return {f for word in fresh for f in word_features(word)}


def fit(texts: list[str], labels: list[int], weights: list[float] | None = None) -> ToxicityModel:
    """The noisy-or model of labelled texts; ``weights`` count a text more or less often.

    Without a positive or a negative text every text with a sentence scores the (smoothed) share of positives.
    """
    y = np.asarray(labels, float)
    sure = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(float((y.sum() + 0.5) / (len(y) + 1)), {})
    # a pass over positive texts, one over negative ones, one for the cells: only counts and cells are held
    held, rare, n_pos, n_neg = Counter(), Counter(), 0, 0
    witnesses = FreshFeatures()
    for text in (t for t, label in zip(texts, y) if label):
        if (features := witnesses.of(text)) is not None:
            held.update(features)
            n_pos += 1
    witnesses = FreshFeatures()
    for text in (t for t, label in zip(texts, y) if not label):
        if (features := witnesses.of(text)) is not None:
            rare.update(f for f in features if f in held)
            n_neg += 1
    names = sorted(held)
    at = leaning(np.array([held[f] for f in names], np.int64), np.array([rare[f] for f in names], np.int64), n_pos, n_neg)
    chosen = [f for f, good in zip(names, at) if good and held[f] >= MIN_SUPPORT]
    index = {f: i for i, f in enumerate(chosen)}
    column, row, doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):  # only sentences with a chosen feature count
        for sentence in sentences(text):
            cells = [index[f] for w in _WORD.findall(sentence.lower()) for f in word_features(w) if f in index]
            if cells:
                column.extend(cells)
                row.extend([len(doc)] * len(cells))
                doc.append(d)
    n_rows = len(doc)
    column, row, doc = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (column, row, doc))

    base = _softplus(BIAS)
    sure = sure / sure.mean()
    centre = _centres(chosen, held, rare)
    theta = np.append(centre, math.log(0.5 / len(y)))  # the last is the log-odds of the leak
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for epoch in range(1, EPOCHS + 1):  # Adam on the full sample; a sentence below BIAS counts as one without evidence
        z = BIAS + np.maximum(np.bincount(row, theta[column], n_rows), 0.0)
        p = np.where(z > BIAS, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)
        log_clean = -np.bincount(doc, np.logaddexp(0, z) - base, len(y)) - np.logaddexp(0, theta[-1])
        toxic = np.maximum(-np.expm1(log_clean), 1e-12)
        pull = sure * np.where(y > 0, -np.exp(log_clean) / toxic, 1.0)
        grad = np.append(np.bincount(column, (p * pull[doc])[row], len(chosen)), pull.sum() / (1 + np.exp(-theta[-1])))
        grad[:-1] += PRIOR * (theta[:-1] - centre)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta -= STEP * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-8)
    return ToxicityModel(float(1 / (1 + math.exp(-theta[-1]))), {f: float(w) for f, w in zip(chosen, theta[:-1]) if w})


def not_held_out(doc_id: Column) -> Column:
    return ~held_out(doc_id)


def known_labels(labels: DataFrame, label: str, usable=not_held_out) -> DataFrame:
    """(id, y) of the labels that may be read, once per id: ``usable`` maps the id to them.

    A label other than 0 or 1, or a NULL id, is not used; of several labels of one id the highest counts.
    """
    return (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & usable(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y"))
    )


def sample_labelled(
    documents: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str,
    max_positive: int, max_negative: int, usable=not_held_out,
) -> tuple[list[str], list[int], list[float]]:
    """At most so many labelled texts of each class, and the weights that restore the classes' shares.

    ``known_labels`` says which labels count. Ids are taken in the order of their hash, so
    the sample does not depend on the layout of the files. Of several texts of one id the one with the least digest
    counts. Only the chosen ids (a bounded number) meet the texts.
    """
    known = known_labels(labels, label, usable)
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    texts, ys, weights = [], [], []
    for y, most in ((1, max_positive), (0, max_negative)):
        ids = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most).select("id")
        rows = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        found = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min(F.struct(F.md5("text"), "text")).alias("first"))
        taken = found.select("id", "first.text").orderBy(F.xxhash64("id"), "id").collect()
        texts += [r.text for r in taken]
        ys += [y] * len(taken)
        weights += [sizes.get(y, 0) / max(1, len(taken))] * len(taken)
    return texts, ys, weights


def train(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, usable=not_held_out,
) -> ToxicityModel:
    """The model learned from the labelled documents whose id is ``usable``.

    ``sample_labelled`` says what missing and repeated ids, labels and texts do. Without labels of both classes, or without
    documents, the model scores every text with a sentence alike.
    """
    return fit(*sample_labelled(documents, labels, label, doc_id, text, max_positive, max_negative, usable))


def read(text: Column, model: ToxicityModel) -> Column:
    """``score`` from 0 to 1 and ``offending``, the sentences with p >= 0.5 (position, sentence, p), in text order.

    A text that is toxic only by many weaker sentences names the likeliest.
    NULL, empty and blank texts have no sentence, score 0 and offend nowhere; whole texts are read, however long.
    """
    @F.pandas_udf("score double, offending array<struct<position:int,sentence:string,p:double>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [model.read(t) for t in texts]
        return pd.DataFrame({
            "score": pd.Series([s for s, _ in found], dtype="float64"),
            "offending": pd.Series([[dict(zip(("position", "sentence", "p"), x)) for x in o] for _, o in found], dtype="object")})
    return of(text)


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """The score of ``read`` alone."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")
    return of(text)


def offending_sentences(text: Column, model: ToxicityModel, threshold: float = 0.5) -> Column:
    """The sentences with p >= ``threshold``: array of (position, sentence, p), in text order; empty for clean texts."""
    @F.pandas_udf("array<struct<position:int,sentence:string,p:double>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("position", "sentence", "p"), x)) for x in model.read(t, threshold)[1]] for t in texts])
    return of(text)


def remove_toxic(documents: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without the rows that score ``threshold`` or more (so a tie with it goes); all columns stay as they are.

    NULL and empty texts score 0 and stay; repeated rows fare alike; an empty table stays empty.
    """
    return documents.filter(toxicity(F.col(text), model) < threshold)
