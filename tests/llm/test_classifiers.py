import math
import pickle
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfweave.llm import quality, toxicity
from shelfweave.llm.queries import ENTRIES

SF_DIR = "/root/testdata/sf0.01"
SOME = ["a fine day. you idiot! all is well", "a fine day. all is well. nor here", "idiot", "good\nbad idiot words. fine",
        "good\nbad words. fine"] * 20


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(SOME, [1, 0, 1, 1, 0] * 20)


def test_noisy_or_by_hand(model):
    text = "a fine day. you idiot! all is well"
    product = 1.0
    for s in toxicity.sentences(text):
        z = model.bias + sum(
            model.weights.get(f, 0.0) for w in s.lower().replace("!", "").replace(".", "").split()
            for f in toxicity.word_features(w))
        product *= 1 - 1 / (1 + 2.718281828459045 ** -z)
    assert model.score(text) == pytest.approx(1 - product)
    assert model.score(text) > 0.9 > 0.1 > model.score("a fine day. nor here")
    assert model.score(None) == model.score("") == model.score(" \n ") == 0.0
    assert pickle.loads(pickle.dumps(model)).score(text) == model.score(text)


def test_length_alone_is_not_toxic(model):
    clean, share = "a fine day. all is well. nor here. " * 40_000, toxicity.fit(["a"] * 3, [0] * 3)
    assert model.score(clean) < 0.1 < 0.9 < model.score(clean + "you idiot!")
    assert pickle.loads(pickle.dumps(model)).score(clean) == model.score(clean)
    assert share.score(clean) == pytest.approx(share.score("a")) == pytest.approx(0.125)


def test_a_hundred_thousand_clean_sentences_stay_clean(model):
    clean = "a fine day. " * 100_000
    assert model.score(clean) == pytest.approx(model.leak) and model.score(clean + "idiot.") > 0.9


def test_few_documents_still_teach():
    toxic = [f"{c} scum moron. fine" for c in "abc"] + [f"{c} fine" for c in "def"]
    model = toxicity.fit(toxic + [f"{c} fine day" for c in "ghijklmnopqrstuvwxyz" * 2], [1] * 6 + [0] * 40)
    assert model.score("you scum") > 0.7 > 0.2 > model.score("a d g fine day")


def test_copies_are_one_witness():
    own = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor. "
    # ten copies of one toxic text, each with a word of its own, beside varied ones
    toxic = [f"{own} {c}x you scum" for c in "abcdefghij"] + [f"{c}y scum {c}z" for c in "klmnop"]
    clean = [f"{a}u {b}v {a}{b}w" for a in "abcdefgh" for b in "ijklmn"]
    model = toxicity.fit(toxic + clean, [1] * 16 + [0] * 48)
    assert model.score("you scum there") > 0.7 > 0.2 > model.score(own)
    fresh = toxicity.FreshFeatures()
    assert fresh.of(own) and fresh.of(own) is None and fresh.of(None) == set() and "=scum" in fresh.of("a scum b")


def test_the_query_equals_plain_python(spark):
    """Sample, fit and score by hand: all labels fit in the sample, so order alone could differ."""
    documents = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall())
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF_DIR}/labels.parquet'").fetchall()
    seen = [(d, y) for d, y in labels if zlib.crc32(str(d).encode()) % 3 != 1]
    model = toxicity.fit([documents[d] or "" for d, _ in seen], [y for _, y in seen])

    def expected(text):
        """One minus the product of what every sentence leaves clean."""
        told = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if s.strip()]
        clean = 1 - model.leak if told else 1.0
        for s in told:
            z = model.bias + max(0.0, sum(model.weights.get(f, 0) for w in re.findall(r"[^\W\d_]+", s.lower())
                                          for f in ["=" + w] + ["^" + w[:n] for n in (4, 5, 6) if len(w) > n]))
            clean *= (1 + math.exp(model.bias)) / (1 + math.exp(z))
        return 1 - clean

    rows = ENTRIES["op7_toxicity"].build(spark, SF_DIR).collect()
    assert len(rows) == len(documents) and len(model.weights) > 10
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.score == pytest.approx(expected(documents[r.doc_id]), abs=1e-6), r.doc_id
        assert r.predicted == (r.score >= 0.7) and (not r.predicted or r.offending)


def test_repeated_ids_and_ties_give_one_model(spark):
    rows = [(1, "you idiot"), (1, "a fine day"), (1, None), (2, "b"), (None, "you idiot"), (4, "idiot")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (4, 3)], "doc_id LONG, toxic INT")
    take = lambda d: toxicity.sample_labelled(d, labels, "toxic", "doc_id", "text", 9, 9, lambda c: F.lit(True))
    assert take(docs) == take(docs.orderBy(F.desc("text")).repartition(3)) and take(docs)[1] == [1, 0]
    assert toxicity.remove_toxic(docs, toxicity.ToxicityModel(0.7, {})).count() == 1  # a tie goes, a text without a sentence stays


def test_blame_falls_on_the_offending_sentence(spark, model):
    df = spark.createDataFrame([("a fine day. you idiot! all is well",), (None,), ("",)], "text STRING")
    rows = df.select(toxicity.offending_sentences(F.col("text"), model).alias("s")).collect()
    assert [[(x.position, x.sentence) for x in r.s] for r in rows] == [[(1, "you idiot!")], [], []]


def test_rejected_rows_go_and_others_stay(corpus, no_documents, model):
    kept = toxicity.remove_toxic(corpus, model)
    assert kept.columns == corpus.columns
    gone = {r.doc_id for r in corpus.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {15} and toxicity.remove_toxic(no_documents, model).count() == 0


def test_one_class_or_no_labels(spark, corpus):
    none = spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT")
    assert 0 < toxicity.train(corpus, none).score("anything") < 1
    assert quality.train(corpus, none).score(["anything"])[0] < 0.5
    assert toxicity.fit(["a"], [0]).score("a. b") > 0


def test_quality_features_of_empty_texts():
    assert quality.features(None) == quality.features(" \n") == [0.0] * len(quality.NAMES)
    assert len(quality.features("x")) == len(quality.NAMES)


def test_quality_prefers_what_pairs_prefer(corpus, no_documents):
    good = [f"This is a plain sentence about thing {i}, and another one follows." for i in range(60)]
    bad = ["SPAM!! " * (3 + i % 7) for i in range(60)]
    model = quality.fit(good + bad, [1] * 60 + [0] * 60)
    scores = model.score(good + bad)
    assert scores[:60].min() > 0.5 > scores[60:].max()
    assert quality.keep_good(corpus, model).columns == corpus.columns
    assert quality.keep_good(no_documents, model).count() == 0


def _styled(n, seed):
    """Texts of many lengths and styles, and labels that follow the style but not always."""
    rng = np.random.default_rng(seed)
    ys = (rng.random(n) < 0.5).astype(int)
    shouts = np.where(ys == 1, rng.integers(0, 4, n), rng.integers(2, 9, n))
    return [f"thing {i} stands, " * int(k) + "BUY! " * int(s) for i, (k, s) in enumerate(zip(rng.integers(1, 12, n), shouts))], ys.tolist()


def test_quality_maximises_over_all_pairs():
    texts, ys = _styled(120, 3)
    model = quality.fit(texts, ys)
    matrix, good = np.array([quality.features(t) for t in texts]), np.array(ys) == 1
    strength = model.strength(matrix)
    lost = 1 / (1 + np.exp(strength[good][:, None] - strength[~good][None, :]))
    assert 0.01 < lost.mean() < 0.4
    per_doc = np.zeros(len(texts))
    per_doc[good], per_doc[~good] = -lost.sum(1) / lost.size, lost.sum(0) / lost.size
    for j, (edge, weight) in enumerate(zip(model.edges, model.weights)):
        slope = np.bincount(np.searchsorted(edge, matrix[:, j], side="right"), per_doc, len(weight)) + quality.L2 * weight
        assert np.abs(slope).max() < 3e-5
    assert (strength < model.cut).sum() == (~good).sum()


def test_quality_learns_from_every_labelled_row(spark):
    """More documents of each class than a sample ever held: edges, weights and cut are those of all of them."""
    texts, ys = _styled(6_400, 5)
    assert 3_000 < sum(ys) < 3_400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    labels = spark.createDataFrame(list(enumerate(ys)), "doc_id LONG, quality INT")
    model, plain = quality.train(docs, labels, usable=lambda c: F.lit(True)), quality.fit(texts, ys)
    for ours, theirs in zip((*model.edges, *model.weights), (*plain.edges, *plain.weights)):
        assert ours == pytest.approx(theirs, abs=1e-6)
    assert model.cut == pytest.approx(plain.cut, abs=1e-6)


def test_quality_of_held_out_repeated_and_odd_labels(spark):
    texts, ys = _styled(60, 7)
    rows, known = list(enumerate(texts)), list(enumerate(ys))
    docs = spark.createDataFrame([*rows, *rows[:9], (None, "a"), (77, "no label")], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([*known, *known[:9], (None, 1), (500, 0), (77, 3), (77, None)], "doc_id LONG, quality INT")
    seen = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    model, plain = quality.train(docs, labels), quality.fit([texts[d] for d in seen], [ys[d] for d in seen])
    assert model.score(texts) == pytest.approx(plain.score(texts), abs=1e-6)


@pytest.mark.parametrize("name, label, least", [("op7_toxicity", "toxic", 0.93), ("op10_quality_classifier", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    rows = ENTRIES[name].build(spark, SF_DIR).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{SF_DIR}/labels.parquet'").fetchall())
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and len(held) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= least
