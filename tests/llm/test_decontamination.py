import pytest

from shelfweave.llm.decontamination import decontaminate, find_contamination
from tests.llm import brute

ITEMS = [
    (1, " ".join(f"p{i}" for i in range(5, 30))), (2, "jumps over the Lazy dog"), (3, ""), (4, None), (None, "a b c"),
    (5, "fox jumps"), (6, "altes haus mit einer roten tuer am see der fuchs rennt durch den wald"), (6, "one"),
    (7, "ÉÈ"), (2, "jumps over the Lazy dog"),
]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id LONG, text STRING, doc_id STRING")


def test_equals_brute_force(corpus, benchmark):
    rows = find_contamination(corpus, benchmark).collect()
    docs = {(r.doc_id, r.text) for r in corpus.collect()}
    expected = sorted(
        (str(d), *brute.decontaminate(t, ITEMS)) for d, t in [(r.doc_id, r.text) for r in corpus.collect()])
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in rows) == expected
    assert len(docs) < len(rows)
    for r in rows:
        assert r.n_hit == sum(s.end - s.start for s in r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)


def test_random_texts_over_few_words(spark):
    """Few distinct words make ties, overlaps and chance hits."""
    import random

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(120)]
    items = [(i, text(rng.choice([2, 7, 9, 12, 13, 14, 20]))) for i in range(12)] + [(50, docs[3][1]), (51, docs[7][1])]
    found = find_contamination(
        spark.createDataFrame(docs, "doc_id LONG, text STRING"), spark.createDataFrame(items, "item_id LONG, text STRING"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found.collect()}
    assert got == {d: brute.decontaminate(t, items) for d, t in docs}


def test_clean_rows_stay_as_they_are(corpus, benchmark):
    kept = decontaminate(corpus, benchmark)
    assert kept.columns == corpus.columns
    dirty = [r for r in corpus.collect() if (n := brute.decontaminate(r.text, ITEMS))[1] and 20 * n[1] >= n[0]]
    assert kept.count() == corpus.count() - len(dirty)


def test_empty_tables(corpus, no_documents, benchmark):
    assert find_contamination(no_documents, benchmark).count() == 0
    clean = find_contamination(corpus, benchmark.limit(0)).collect()
    assert len(clean) == corpus.count() and not any(r.contaminated for r in clean)


def test_short_items_of_every_length_cost_no_disk(spark):
    """Items of 1 to 13 words: the tables kept beside the texts stay below the texts' own bytes."""
    import os
    import random

    from shelfweave.session import work_area

    rng = random.Random(11)
    docs = [(i, " ".join(f"w{rng.randrange(30_000):05d}" for _ in range(rng.choice([5, 400, 3000])))) for i in range(150)]
    cut = [docs[i][1].split()[3:3 + i % 13 + 1] if i % 3 else [f"none{i}"] * (i % 13 + 1) for i in range(39)]
    items = [(i, " ".join(w)) for i, w in enumerate(cut) if w]
    with work_area(spark) as area:
        found = find_contamination(
            spark.createDataFrame(docs, "doc_id LONG, text STRING"), spark.createDataFrame(items, "item_id LONG, text STRING"))
        got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found.collect()}
        kept = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(area) for f in files if f.endswith(".parquet"))
    assert got == {d: brute.decontaminate(t, items) for d, t in docs}
    # small tables hold a fixed part: the files' footers
    assert kept < 1.6 * sum(len(t) for _, t in docs)


def test_only_short_items(spark):
    docs = [(1, "a b c d"), (2, ""), (3, None), (4, "B"), (4, "B")]
    items = [(1, "b"), (2, "C d"), (3, "d e")]
    found = find_contamination(
        spark.createDataFrame(docs, "doc_id LONG, text STRING"), spark.createDataFrame(items, "item_id LONG, text STRING"))
    assert sorted((r.doc_id, r.n_hit, r.item_ids) for r in found.collect()) == [
        (1, 3, ["1", "2"]), (2, 0, []), (3, 0, []), (4, 1, ["1"]), (4, 1, ["1"])]
