import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from shelfweave.llm.sharding import fisher_yates, shard, write_shards
from tests.llm import brute


def _xxhash64(*values):
    """Spark's xxhash64 of longs and ints, one after another."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v[0]) if v[1] == "long" else struct.pack("<i", v[0]), seed)
        seed = seed - 2**64 if seed >= 2**63 else seed
        last, seed = seed, seed % 2**64
    return last


def test_fisher_yates_equals_brute_force(spark):
    rows = spark.range(0, 40).select(
        "id", fisher_yates(F.col("id").cast("int"), F.xxhash64("id")).alias("p"), F.xxhash64("id").alias("s")).collect()
    for r in rows:
        draw = lambda i: _xxhash64((r.s, "long"), (i, "int")) % (i + 1)  # noqa: B023, E731
        assert list(r.p) == brute.fisher_yates(r.id, draw)


def _check(rows, n, shards):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == n and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_shards_are_even_and_whole(corpus, no_documents):
    rows = shard(corpus, shards=4, bucket_rows=3).collect()
    _check(rows, corpus.count(), 4)
    assert Counter(r.row for r in rows) == Counter(corpus.collect())
    assert all(r["size"] == len((r.row.text or "").encode()) + 16 for r in rows)
    assert shard(no_documents).count() == 0


def test_order_does_not_depend_on_partitions(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    order = lambda df: sorted((r.shard, r.slot, r.row.doc_id) for r in shard(df, shards=7, bucket_rows=64).collect())
    one = order(docs.repartition(1))
    assert one == order(docs.repartition(9))
    assert [x[2] for x in one] != sorted(x[2] for x in one)


def test_repeats_of_one_row_are_split(spark):
    docs = spark.range(900).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    _check(shard(docs, shards=6, bucket_rows=50).collect(), 900, 6)


def test_written_shards(spark, tmp_path, corpus):
    write_shards(shard(corpus, shards=3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == corpus.count() and back.select("_shard").distinct().count() == 3
