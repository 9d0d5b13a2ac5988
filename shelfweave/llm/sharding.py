"""Shuffled shards by a two-pass external shuffle (Rao 1961; Sanders 1998).

Pass one scatters the rows uniformly into buckets that fit in memory, by a seeded hash of id
and text, and stores them. Pass two shuffles every bucket by itself with the
Fisher-Yates algorithm, its draws seeded by bucket and step. The buckets one after another
are a random order of all rows; position p goes to shard p mod n, slot p div n, so shards
differ by one row at most and slots have no gaps.

A bucket whose rows the hash cannot tell apart (repeats of one row) is split by the
row's stored number. The order depends on seed and data, not on files or partitions,
except among rows that repeat both id and text. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfweave.session import fresh_path, store_table

SHARDS, SEED = 40, 20_240
#: A bucket aims at this many rows and bytes of text at most.
BUCKET_ROWS, BUCKET_BYTES = 512, 8 << 20
OVERHEAD = 16
#: Buckets whose positions are summed up together.
RANGE = 4096


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (NULL has none) plus a record's overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def fisher_yates(n: Column, seed: Column) -> Column:
    """A permutation of 0 .. n-1 as an array of ints; draw i is a hash of ``seed`` and i.

    Inside-out form: entry i takes the value at a random place up to i, which takes the value i.
    """
    def step(acc, i):
        at = F.pmod(F.xxhash64(seed, i), i + 1).cast("int")
        swapped = F.concat(F.slice(acc, F.lit(1), at), F.array(i), F.slice(acc, at + 2, i - at - 1), F.array(acc[at]))
        return F.when(at == i, F.concat(acc, F.array(i))).otherwise(swapped)

    none = F.array().cast("array<int>")
    return F.when(n <= 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), none, step))


def shard(
    rows: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``row`` (all columns of the input as a struct), ``size``, ``shard``, ``slot`` of every row.

    NULL ids and texts are hashed as values of their own; repeated rows each get a place; an empty table gives no
    rows; a single row larger than a bucket has a bucket to itself.
    """
    spark = rows.sparkSession
    # pass one: stored with their hash and number, the rows keep both whatever is computed again later
    scattered = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        size_of(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id).isNull(), F.col(doc_id), F.xxhash64(F.col(text))).alias("hash"),
        F.monotonically_increasing_id().alias("number"),
    )
    stored = store_table(scattered, fresh_path(spark, "scattered"))
    total = stored.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    buckets = max(1, -(-total.n // bucket_rows), -(-(total.bytes or 0) // bucket_bytes))
    base = stored.withColumn("base", F.pmod("hash", F.lit(buckets)))
    crowded = base.groupBy("base").agg(F.count("*").alias("n"), F.sum("size").alias("b")).select(
        "base", F.greatest(F.ceil(F.col("n") / (2 * bucket_rows)), F.ceil(F.col("b") / (4 * bucket_bytes))).alias("ways")
    ).filter("ways > 1")
    base = base.join(crowded, "base", "left").select(
        "row", "size", "hash", "number", "base",
        F.coalesce(F.pmod(F.xxhash64(F.lit(seed), "number"), F.col("ways")), F.lit(0)).alias("part"))

    # pass two: one bucket is one array, shuffled in memory
    order = lambda a, b: (
        F.when(a.hash < b.hash, -1).when(a.hash > b.hash, 1).when(a.number < b.number, -1).otherwise(1))
    held = base.groupBy("base", "part").agg(
        F.collect_list(F.struct("hash", "number", "size", "row")).alias("held"))
    shuffled = held.select(
        "base", "part", F.size("held").alias("n"), F.array_sort("held", order).alias("held"),
        F.xxhash64(F.lit(seed), "base", "part").alias("seed"))
    shuffled = shuffled.withColumn("places", fisher_yates(F.col("n"), F.col("seed")))

    counts = base.groupBy("base", "part").agg(F.count("*").alias("n"))
    placed = shuffled.select(
        "base", "part", F.posexplode(F.arrays_zip("places", "held")).alias("at", "x"),
    ).join(_offsets(counts), ["base", "part"])
    # the element at i of the sorted bucket moves to place places[i]
    position = F.col("offset") + F.col("x.places")
    return placed.select(
        F.col("x.held.row").alias("row"), F.col("x.held.size").alias("size"),
        (position % shards).cast("int").alias("shard"), F.floor(position / shards).cast("long").alias("slot"))


def _offsets(counts: DataFrame) -> DataFrame:
    """base, part, offset: rows of all buckets before it. Summed up within ranges of buckets, then over the ranges."""
    ranged = counts.withColumn("range", F.floor(F.col("base") / RANGE))
    inner = Window.partitionBy("range").orderBy("base", "part").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("range").agg(F.sum("n").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    return ranged.select("base", "part", "range", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inside")).join(
        ranges, "range").select("base", "part", (F.col("before") + F.col("inside")).alias("offset"))


def flattened(sharded: DataFrame, names: tuple[str, str, str] = ("size", "shard", "slot")) -> DataFrame:
    """The input's columns followed by size, shard and slot; a name that the input has already gets underscores before it."""
    taken, added = {c.lower() for c in sharded.schema["row"].dataType.names}, []
    for column, name in zip(("size", "shard", "slot"), names):
        while name.lower() in taken:
            name = f"_{name}"
        added.append(F.col(column).alias(name))
    return sharded.select("row.*", *added)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the rows as one folder per shard (``_shard=0`` and so on), each in slot order (``_slot``).

    Clashing names as in ``flattened``. NULLs, empty texts and repeated rows are written as they are; the files of a shard are
    in slot order by their names; an empty table writes no folder.
    """
    flat = flattened(sharded, ("_size", "_shard", "_slot"))
    shard, slot = flat.columns[-2:]
    flat.drop(flat.columns[-3]).repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
