"""SimHash near-duplicates: fingerprints, blocks by the pigeonhole principle, components.

Two fingerprints that differ in at most ``distance`` bits agree in all but ``distance`` of
``blocks`` blocks of bits, so they meet under one of the keys made of the remaining blocks.
With three more blocks than bits a key spans about half of the fingerprint, which keeps
chance meetings rare for billions of texts. Copies share a fingerprint and are
compared once.

A crowded key is cut into chunks of bounded size and every two chunks are searched
together in a task of their own, so no task holds an unbounded group. A search reports a
spanning forest of the links it finds, which is all that components need; it does not
report all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfweave.llm.components import connected_components
from shelfweave.llm.text import packed, row_key, unpacked
from shelfweave.session import fresh_path, store_table

SEED = 42
#: Fingerprints of one key that are searched together; a larger group is cut into chunks.
CHUNK = 2048
#: Shingles hashed at a time, which bounds the memory that a very long text takes.
BATCH = 1 << 15


def simhash(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint as a signed number."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters, ASCII white space
    if not tokens:
        return 0
    width = min(shingle, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = len(tokens) - width + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, BATCH):
        cut = zip(starts[at:min(at + BATCH, total)].tolist(), ends[at + width - 1:at + BATCH + width - 1].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cut], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """SimHash of the word shingles of ``text``; NULL and texts without words give zero."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")
    return of(text)


def block_masks(distance: int, blocks: int) -> list[int]:
    """A mask of the bits that each choice of ``blocks - distance`` blocks covers, as signed numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def forest(values: np.ndarray, distance: int) -> list[tuple[np.uint64, np.uint64]]:
    """A spanning forest of the links (at most ``distance`` differing bits) among distinct values."""
    found, rest = [], values.view("u8")  # bits are counted on unsigned numbers
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                linked, rest = rest[near], rest[~near]
                queue.extend(linked)
                found.extend((at, x) for x in linked)
    return found


def _searched(distance: int):
    """Search each run of rows with equal (mask, part, lo, hi); rows come sorted by these."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, held = ["mask", "part", "lo", "hi"], None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            key = held[keys].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if not len(cuts):
                continue
            values = held["fp"].to_numpy()
            yield _links(np.split(values[:cuts[-1]], cuts[:-1]))
            held = held.iloc[cuts[-1]:]
        if held is not None:
            yield _links([held["fp"].to_numpy()])

    def _links(groups: list[np.ndarray]) -> pd.DataFrame:
        pairs = [p for g in groups if len(g) > 1 for p in forest(g, distance)]
        found = np.array(pairs, dtype="u8").reshape(-1, 2).view("i8")
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})
    return run


def links(fingerprints: DataFrame, distance: int = 3, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links a, b that connect all distinct fingerprints (column fp) at most ``distance`` bits apart."""
    spark = fingerprints.sparkSession
    masks = block_masks(distance, blocks or distance + 3)
    keyed = fingerprints.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("mask", "bits")).select(
        F.col("mask").cast("long").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("part"), "fp")
    shared = keyed.groupBy("mask", "part").agg(F.count("*").alias("size")).filter("size > 1")
    shared = store_table(shared, fresh_path(spark, "shared-blocks"))
    n_chunks = F.ceil(F.col("size") / chunk)
    own = F.pmod(F.xxhash64("fp"), n_chunks)
    placed = (
        keyed.join(shared, ["mask", "part"])
        .select("mask", "part", "fp", "size", own.alias("own"),
                F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)).alias("other"))
        # two chunks are searched together, and with that each of them; a chunk alone only if it is the only one
        .filter((F.col("own") != F.col("other")) | (F.col("size") <= chunk))
        .select("mask", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    keys = ["mask", "part", "lo", "hi"]
    dealt = placed.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(_searched(distance), "a long, b long")


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3,
) -> DataFrame:
    """``doc_id``, ``key`` (of id and text), ``fingerprint`` (long), ``component_id`` of every row.

    Texts whose fingerprints differ in at most ``distance`` bits are linked; ``component_id`` is the
    smallest doc_id that can be reached over links. NULL and empty texts have fingerprint zero and
    are linked like any other. Rows without an id belong to a component but never name one; a
    component of such rows only has a NULL id. Repeated rows are all returned; an empty table
    gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    printed = store_table(
        documents.select(
            F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"),
            fingerprint(F.col(text), shingle).alias("fp")),
        fresh_path(spark, "fingerprints"),
    )
    distinct = store_table(
        printed.groupBy("fp").agg(F.min("doc_id").alias("first")), fresh_path(spark, "distinct-fingerprints"))
    roots = connected_components(links(distinct.select("fp"), distance))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    component = named.groupBy("root").agg(F.min("first").alias("component_id"))
    members = named.join(component, "root").select("fp", "root", "component_id")
    return printed.join(members, "fp").select(
        "doc_id", "key", F.col("fp").alias("fingerprint"), "component_id", "root")


def deduplicate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id; all columns stay as they are.

    Where ids are missing or repeated, the smallest key of id and text decides, and of
    rows that repeat both one stays.
    """
    found = near_duplicates(documents, doc_id, text, **options)
    kept = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")).alias("best")
    ).select(F.col("best.key").alias("key"))
    rows = packed(documents, key=row_key(F.col(doc_id), F.col(text)))
    return unpacked(rows.join(kept, "key").dropDuplicates(["key"]))
