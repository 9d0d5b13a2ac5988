import random

import numpy as np

from shelfweave.llm.components import connected_components
from shelfweave.llm.simhash import block_masks, deduplicate, forest, links, near_duplicates, simhash
from tests.llm import brute


def test_fingerprints_equal_brute_force():
    for text in ["", None, "one", "Two Words", "a b c", "É x y \v z", "tick " * 70_000, " a\tb\nc  d e f g"]:
        assert simhash(text, 3) % 2**64 == brute.simhash(text), text


def test_close_pairs_share_a_key():
    rng, masks = random.Random(1), block_masks(3, 6)
    assert len(masks) == 20
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any((a & m) == (b & m) for m in (m % 2**64 for m in masks))


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_crowded_keys_in_chunks_keep_components(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)}
    df = spark.createDataFrame([(_signed(p),) for p in prints], "fp LONG")
    expected = brute.components([(p, p) for p in prints])
    for chunk in (2048, 7):
        roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(links(df, chunk=chunk)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(roots.get(p, p), set()).add(p)
        wanted = {}
        for p, c in expected.items():
            wanted.setdefault(c, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_forest_spans_without_all_pairs():
    values = np.array([0, 1, 3, 7, 15, 2**40 + 2**41], "i8")
    assert len(forest(values, 1)) == 4 and len(forest(values, 3)) == 5


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (1001, 1000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[i] == 1000 for i in range(1001, 1200))
    assert connected_components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_corpus_classes(corpus, no_documents):
    rows = near_duplicates(corpus).collect()
    known = [(r.doc_id, brute.simhash(r.text)) for r in corpus.collect() if r.doc_id is not None]
    expected, prints = brute.components(known), {r.doc_id: r.fingerprint % 2**64 for r in rows}
    assert len(rows) == corpus.count()
    for r in rows:
        if r.doc_id is not None:
            assert (prints[r.doc_id], r.component_id) == (dict(known)[r.doc_id], expected[r.doc_id])
    kept = deduplicate(corpus)
    assert kept.columns == corpus.columns
    assert kept.count() == len({r.root for r in rows})
    assert near_duplicates(no_documents).count() == deduplicate(no_documents).count() == 0
