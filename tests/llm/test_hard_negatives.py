import random

import pytest
from pyspark.sql import functions as F

from shelfweave.llm import hard_negatives


def expected(rows, n_positive, n_negative, low=30, high=90):
    """By sorting all rows for every anchor; rows are (id, label, vector)."""
    out = []
    for i, (anchor, label, v) in enumerate(rows):
        if anchor is None or label is None or v is None or anchor % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), r, c) for j, (r, c, w) in enumerate(rows)
                  if j != i and None not in (r, c, w) and len(w) == len(v)]
        near = sorted(x[:2] for x in scored if x[2] == label)[:n_positive]
        for p, positive in near:
            inside = sorted(x[:2] for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)[:n_negative]
            out += [(anchor, positive, rank, r, -p, -s) for rank, (s, r) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id LONG, label INT, vector ARRAY<LONG>").withColumn("anchor", F.lit(0))
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


@pytest.mark.parametrize("options", [{}, {"anchors_held": 2, "part_size": 40}, {"n_positive": 1, "n_negative": 3}])
def test_against_sorting_everything(spark, options):
    rng = random.Random(3)
    # a third of one label, small scores with many ties, zeros and negatives, copies
    rows = [(i, 0 if i % 3 == 0 else rng.randint(1, 5), [rng.randint(-3, 4) for _ in range(4)]) for i in range(0, 900)]
    rows += [(5000 + i, 1, [1, 1, 1, 1]) for i in range(60)] + [(6000, 2, [0, 0, 0, 0]), (6100, 0, [4, 4, 4, 4])]
    want = expected(rows, options.get("n_positive", 5), options.get("n_negative", 10))
    assert mined(spark, rows, **options) == want and len(want) > 30


def test_awkward_rows(spark):
    v, w = [3, 4], [4, 1]
    rows = [(100, 1, v), (100, 1, v), (100, 2, v), (1, 1, v), (1, 1, v), (2, 2, w), (2, 2, w), (None, 2, w), (3, None, w),
            (4, 2, None), (5, 2, [1, 1, 1]), (200, 1, [0, 0]), (300, 3, w)]
    got = mined(spark, rows)
    assert got == expected(rows, 5, 10) and len(got) > len(set(got))  # repeated anchors repeat their rows
    assert mined(spark, [(100, 1, v)]) == mined(spark, [(1, 1, v), (2, 2, w)]) == mined(spark, []) == []


def test_tiles_and_batches_do_not_matter(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 2), [rng.randint(-9, 9) for _ in range(3)]) for i in range(400)]
    want = expected(rows, 5, 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert mined(spark, rows) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
