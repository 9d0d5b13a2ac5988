import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfweave.llm import topk
from shelfweave.llm.queries import ENTRIES
from tests.llm import brute


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id LONG, vector ARRAY<LONG>")


@pytest.mark.parametrize("block", [8192, 16])
def test_spread_lengths_and_tight_clusters(spark, block):
    rng = random.Random(4)
    centres = [[rng.randint(-80, 80) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x * s + rng.randint(-2, 2) for x in rng.choice(centres)])
            for i in range(400) for s in [rng.choice([1, 1, 2, 9])]]
    rows += [(1000 + i, [0] * 6) for i in range(5)] + [(2000 + i, [50] * 6) for i in range(150)]
    queries = [r for r in rows if r[0] % 10 == 0]
    got = {tuple(r) for r in topk.top_k(_frame(spark, rows), F.col("vec_id") % 10 == 0, 5, block=block).collect()}
    assert got == brute.top_k(rows, queries, 5)


def test_vectors_go_to_the_blocks_they_can_reach(spark):
    """A few long vectors and many short ones, of which most can reach no query's threshold."""
    rng = random.Random(9)
    rows = [(i, [rng.randint(-9, 9) * (40 if i < 300 else 1) for _ in range(6)]) for i in range(4000)]
    vectors, asked = topk.numbered(_frame(spark, rows), F.col("vec_id") % 10 == 0, "vec_id", "vector")
    edges, stats = topk._buckets(vectors)
    vectors = vectors.withColumn("bucket", topk._bucket(edges))
    seeds = vectors.orderBy(F.desc("norm"), "serial").limit(topk.SEEDS).select("serial", "v").collect()
    asked = topk.with_need(topk.thresholds(asked, seeds, 5)).cache()
    sent, _ = topk.dealt(vectors, asked, stats, 50)
    blocks = sent.select("class", "query_block").distinct().count()
    assert blocks >= 8 and sent.count() < 0.2 * blocks * len(rows)
    got = {tuple(r) for r in topk.top_k(_frame(spark, rows), F.col("vec_id") % 10 == 0, 5, block=50).collect()}
    assert got == brute.top_k(rows, [r for r in rows if r[0] % 10 == 0], 5)


def test_pruning_keeps_all_that_can_reach_the_threshold():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-50, 50, (500, 8))
    norms = np.sqrt((vectors**2).sum(1))
    order = np.argsort(-norms)
    vectors, norms = vectors[order], norms[order]
    unit = vectors / norms[:, None]
    cut = 0
    for query in np.concatenate([vectors[:40], -vectors[:40], np.eye(8, dtype=int) * 9]):
        scores = vectors @ query
        for theta in np.quantile(scores, [0.9, 0.99, 1.0]):
            size = float(np.sqrt((query**2).sum()))
            picked = np.arange(500)[topk.candidates(query, size, theta, unit, norms)]
            assert set(np.flatnonzero(scores >= theta)) <= set(picked)
            cut += 500 - len(picked)
    assert cut > 0


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, None), (4, [None, 1.0]), (None, [1.0, 1.0]),
            (5, [float("inf"), 1.0]), (6, [-0.001, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").select(
        "vec_id", topk.scaled(F.col("embedding"), 256.0).alias("vector"), F.lit(1).alias("norm"))
    got = sorted(tuple(r) for r in topk.top_k(df, F.lit(True), 2).collect())
    a, b = [256, 512], [-1, 256]
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    # only a query's own row is no candidate: the repeated row finds its repeat, and is a query of its own
    first = [(1, 1, 1, dot(a, a)), (1, 2, 8, dot(a, a))]
    assert got == sorted(first * 2 + [(6, 1, 1, dot(a, b)), (6, 2, 1, dot(a, b)), (8, 1, 1, dot(a, a)), (8, 2, 1, dot(a, a))])
    assert topk.top_k(df.limit(0), F.lit(True), 2).count() == topk.top_k(df, F.lit(None).cast("boolean"), 2).count() == 0


def test_the_query_equals_its_sql_on_repeated_rows(spark, tmp_path):
    rows = [(i % 90, [float((i * 7 + j * 3) % 11) / 8 - 0.5 for j in range(4)]) for i in range(180)] + [(0, None), (None, [1.0] * 4)]
    rows += rows[:5]
    frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>")
    frame.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    entry = ENTRIES["op6_exact_top_k"]
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in entry.build(spark, str(tmp_path)).collect())
    assert got == Counter(con.execute(entry.sql).fetchall()) and max(got.values()) == 2
