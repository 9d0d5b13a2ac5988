"""Exact top-k by inner product, with norm buckets (LEMP: Teflioudi, Gemulla, Mykytiuk 2015).

Vectors are grouped by length into buckets, and a bucket into blocks of bounded size. A
query first meets the longest vectors; its k-th best score there is a threshold theta that
the final answers must reach. In a bucket whose longest vector has length m, only vectors
with cosine at least t = theta / (|q| m) can reach it:

* t > 1: the whole bucket is skipped, before anything is sent to it;
* t high: coordinate pruning, as a vector that close to q has its strongest coordinates near those of q;
* else: length pruning, as vectors shorter than theta / |q| cannot reach theta.

What is left is verified by exact integer products. Blocks of queries meet blocks of vectors
in tasks of bounded size, and each task reports at most k rows per query. Queries are blocked by the length that a vector
needs to reach their threshold, and a vector is sent to the blocks that it can reach only: a short vector meets the few queries
with low thresholds, not all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfweave.session import fresh_path, store_table

#: Buckets by length, rows of a block of vectors or queries, and longest vectors that give the first thresholds.
BUCKETS, BLOCK, SEEDS = 16, 8192, 1024
#: Classes of queries by the length they need.
CLASSES = 16
#: Queries scored at a time inside a task.
TILE = 256
#: Local cosine from which coordinates prune better than lengths, and how many are looked at.
COORDINATE_COSINE, FOCUS = 0.6, 3


def scaled(vector: Column, factor: float) -> Column:
    """floor(factor * x) of every component, as longs; NULL if the vector or a component is NULL or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), -1)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where that is exact."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    return queries @ vectors.T


def thresholds(queries: DataFrame, seeds: list, k: int) -> DataFrame:
    """``theta``: each query's k-th best score among the seeds, NULL if there are fewer."""
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r.v) for r in seeds}:
        own = [r for r in seeds if len(r.v) == size]
        by_size[size] = np.array([r.serial for r in own], np.int64), _matrix([r.v for r in own])

    def run(frames):
        for frame in frames:
            theta = np.full(len(frame), np.nan)
            sizes = frame["v"].map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if size not in by_size:
                    continue
                serials, matrix = by_size[size]
                for part in np.array_split(at, max(1, len(at) // TILE)):
                    scores = products(_matrix(frame["v"].iloc[part]), matrix).astype(float)
                    scores[frame["serial"].to_numpy()[part][:, None] == serials[None, :]] = -np.inf
                    if scores.shape[1] >= k:
                        best = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                        theta[part] = np.where(np.isfinite(best), best, np.nan)
            yield frame.assign(theta=theta)

    return queries.mapInPandas(run, "id long, v array<long>, serial long, norm double, theta double")


def candidates(query: np.ndarray, size: float, theta: float, unit: np.ndarray, norms: np.ndarray) -> np.ndarray | slice:
    """The vectors (by falling length) that can reach ``theta``: a prefix by length, or a choice by coordinates."""
    if not theta > 0 or not size > 0:
        return slice(None)
    slack = 1 - 1e-9
    reach = int(np.searchsorted(-norms, -(theta / size) * slack, side="right"))
    t = theta / (size * norms[0]) * slack if norms[0] > 0 else 2.0
    if t < COORDINATE_COSINE or not reach:
        return slice(0, reach)
    direction = query / size
    fits = np.ones(reach, bool)
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        # the angle to axis f differs from the query's by arccos(t) at most, which bounds the coordinate
        spread = math.sqrt(max(0.0, (1 - direction[f] ** 2) * (1 - min(t, 1.0) ** 2)))
        low = -1.0 if direction[f] <= -t else direction[f] * t - spread
        high = 1.0 if direction[f] >= t else direction[f] * t + spread
        fits &= (unit[:reach, f] >= low - 1e-9) & (unit[:reach, f] <= high + 1e-9)
    return np.flatnonzero(fits)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score falling, id rising)."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _search(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values(["norm", "id"], ascending=[False, True])
            ids, norms, matrix = vectors["id"].to_numpy(), vectors["norm"].to_numpy(), _matrix(vectors["v"])
            serials, own = vectors["serial"].to_numpy(), queries["serial"].to_numpy()
            unit = matrix / np.where(norms > 0, norms, 1)[:, None]
            asked, sizes = queries["id"].to_numpy(), queries["norm"].to_numpy()
            thetas, rows = queries["theta"].fillna(-np.inf).to_numpy(), _matrix(queries["v"])
            picks = [candidates(q, s, t, unit, norms) for q, s, t in zip(rows, sizes, thetas)]
            # queries with a long prefix are scored together, as one matrix product
            together = np.array([i for i, p in enumerate(picks) if isinstance(p, slice)], int)
            for part in np.array_split(together, max(1, -(-len(together) // TILE))):
                reach = max((picks[i].stop if picks[i].stop is not None else len(ids) for i in part), default=0)
                scores = products(rows[part], matrix[:reach])
                for i, line in zip(part, scores):
                    found.append((i, _kept(line, ids[:reach], serials[:reach] != own[i], thetas[i], k)))
            for i, pick in enumerate(picks):
                if not isinstance(pick, slice) and len(pick):
                    line = products(rows[i:i + 1], matrix[pick])[0]
                    found.append((i, _kept(line, ids[pick], serials[pick] != own[i], thetas[i], k)))
        serial = queries["serial"].to_numpy() if len(queries) else np.zeros(0)
        return pd.DataFrame({
            "serial": np.concatenate([np.full(len(a), serial[i]) for i, (a, _) in found] or [np.zeros(0)]).astype(np.int64),
            "query_id": np.concatenate([np.full(len(a), asked[i]) for i, (a, _) in found] or [np.zeros(0)]).astype(np.int64),
            "vec_id": np.concatenate([a for _, (a, _) in found] or [np.zeros(0)]).astype(np.int64),
            "score": np.concatenate([v for _, (_, v) in found] or [np.zeros(0)]).astype(np.int64)})

    return run


def _kept(scores, ids, others, theta, k):
    at = np.flatnonzero(others & (scores >= theta))
    at = at[_best(scores[at], ids[at], k)]
    return ids[at], scores[at]


def top_k(
    vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "vector", block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k best other rows for every row that is a query.

    ``vectors`` has an id and an array of longs, ``is_query`` is a condition on it (NULL: no query). Ties go to the smaller
    id. Every row but the query's own is a candidate, so a row that repeats another is one too, and repeated queries repeat
    their rows. Rows with a NULL id or vector take no part; vectors of another size than the query's are no
    candidates. Fewer than k candidates give fewer rows, empty tables none. Products must fit a long. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows, asked = numbered(vectors, is_query, vec_id, vector)
    edges, stats = _buckets(rows)
    n_queries = asked.count()
    if not stats or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.withColumn("bucket", _bucket(edges))
    seeds = rows.orderBy(F.desc("norm"), "serial").limit(SEEDS).select("serial", "v").collect()
    asked = store_table(with_need(thresholds(asked, seeds, k)), fresh_path(spark, "thresholds"))
    dealt_rows, dealt_queries = dealt(rows, asked, stats, block)
    key = ["size", "bucket", "part", "class", "query_block"]
    found = dealt_rows.groupBy(*key).cogroup(dealt_queries.groupBy(*key)).applyInPandas(
        _search(k), "serial long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "serial").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score")


def numbered(vectors: DataFrame, is_query: Column, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """The rows that take part, with a number and a length, and those of them that are queries; stored, so numbers stay."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = store_table(
        rows.withColumn("serial", F.monotonically_increasing_id()).withColumn("norm", norm),
        fresh_path(vectors.sparkSession, "vectors"))
    kept = ["id", "v", "serial", "norm"]
    return rows.select(kept), rows.filter("asks").select(kept)


def _buckets(rows: DataFrame) -> tuple[list[float], list]:
    """Edges of the buckets by length, and the greatest length and number of rows of each (at most BUCKETS)."""
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = sorted(set(rows.agg(F.percentile_approx("norm", shares, 10_000)).first()[0] or []))
    grouped = rows.groupBy(_bucket(edges).alias("bucket"))
    return edges, grouped.agg(F.max("norm").alias("longest"), F.count("*").alias("n")).collect()


def _bucket(edges: list[float]) -> Column:
    return sum(((F.col("norm") > F.lit(e)).cast("int") for e in edges), F.lit(0))


def with_need(asked: DataFrame) -> DataFrame:
    """``need``: the length without which no vector reaches the query's threshold; 0 if any may."""
    bounded = F.col("theta").isNotNull() & ~F.isnan("theta") & (F.col("theta") > 0) & (F.col("norm") > 0)
    return asked.withColumn("need", F.when(bounded, F.col("theta") / F.col("norm") * (1 - 1e-9)).otherwise(0.0))


def dealt(rows: DataFrame, asked: DataFrame, stats: list, block: int) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries with the keys of the tasks in which they meet.

    Vectors are cut into buckets by length and parts of about ``block`` rows, queries into classes by need and blocks of about
    ``block``. A vector goes to the classes that it is long enough for, a query to the buckets that are.
    """
    shares = [i / CLASSES for i in range(1, CLASSES)]
    edges = sorted(set(asked.agg(F.percentile_approx("need", shares, 10_000)).first()[0] or []))
    asked = asked.withColumn("class", sum(((F.col("need") > F.lit(e)).cast("int") for e in edges), F.lit(0)))
    # at most CLASSES rows
    classes = asked.groupBy("class").agg(F.min("need").alias("need"), F.count("*").alias("n")).collect()
    offered = F.array(*[F.struct(
        F.lit(r["class"]).alias("class"), F.lit(r.need).alias("need"), F.lit(math.ceil(r.n / block)).alias("n")) for r in classes])
    blocks = F.array(*[F.struct(
        F.lit(r.bucket).alias("bucket"), F.lit(r.longest).alias("longest"), F.lit(math.ceil(r.n / block)).alias("n")) for r in stats])
    number = lambda pairs, key: F.element_at(
        F.create_map(*[F.lit(x) for k, n in pairs for x in (k, math.ceil(n / block))]), F.col(key))
    spread = lambda n: F.pmod(F.xxhash64("serial"), n).cast("int")
    queries = asked.select(
        "id", "v", "norm", "theta", "serial", F.size("v").alias("size"), "class",
        spread(number([(r["class"], r.n) for r in classes], "class")).alias("query_block"),
        F.explode(F.filter(blocks, lambda b: F.col("need") <= b["longest"])).alias("b"),
    ).select("id", "v", "norm", "theta", "serial", "size", "class", "query_block", F.col("b.bucket").alias("bucket"),
             F.explode(F.sequence(F.lit(0), F.col("b.n") - 1)).alias("part"))
    vectors = rows.select(
        "id", "v", "norm", "serial", F.size("v").alias("size"), "bucket",
        spread(number([(r.bucket, r.n) for r in stats], "bucket")).alias("part"),
        F.explode(F.filter(offered, lambda c: c["need"] <= F.col("norm"))).alias("c"),
    ).select("id", "v", "norm", "serial", "size", "bucket", "part", F.col("c.class").alias("class"),
             F.explode(F.sequence(F.lit(0), F.col("c.n") - 1)).alias("query_block"))
    return vectors, queries
