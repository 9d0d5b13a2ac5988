"""Benchmark decontamination by winnowed fingerprints (Schleimer, Wilkerson, Aiken 2003).

A window is ``window`` consecutive words of a benchmark item, or the whole item if it is
shorter. Of each window both sides keep the smallest hash of its word k-grams, so a
document that holds a window also holds that window's fingerprint: no shared span of
``window`` words can be missed. Fingerprint hits are then extended to every window around
them and compared word by word, so nothing is reported that does not occur.

Only fingerprints of documents meet the benchmark (two of nine k-grams); words are
compared for the documents that were hit. All steps are DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfweave.llm.text import ascii_lower, packed, row_key, unpacked
from shelfweave.session import fresh_path, store_table

WINDOW = 13
#: After lower-casing: digits, a-z and everything beyond ASCII make words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    # splitting is several times faster than extracting every match
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def gram_size(length: int) -> int:
    """Words per k-gram in windows of ``length`` words."""
    return min(6, (length + 1) // 2)


#: A text has less than 2^31 bytes, so a word's position fits these low bits; the hash keeps the others.
POSITION = (1 << 30) - 1


def fingerprints(w: str, length: int):
    """The fingerprint of every window of the words in column ``w``: a function that adds column ``prints_{length}``.

    A fingerprint is one long: hash and position of a k-gram, so that a running minimum picks the smallest hash of a
    window together with its place (the leftmost of equal ones); windows that share it repeat it. Texts of fewer than ``length`` words have none (NULL).
    """
    k = gram_size(length)
    span = length - k + 1  # k-grams in a window
    name = f"prints_{length}"

    def add(df: DataFrame) -> DataFrame:
        gram = lambda i: F.xxhash64(*[F.col(w)[i + j] for j in range(k)])
        df = df.withColumn(name, F.when(F.size(w) >= length, F.transform(
            F.sequence(F.lit(0), F.size(w) - k),
            lambda i: gram(i).bitwiseAND(F.lit(~POSITION)).bitwiseOR(i.cast("long")))))
        m, reach = F.col(name), 1
        while reach < span:  # the minimum over 1, 2, 4, ... consecutive k-grams, then over all of a window
            step = min(reach, span - reach)
            df = df.withColumn(name, F.when(m.isNotNull(), F.transform(
                F.sequence(F.lit(0), F.size(m) - 1 - step), _least_of_two(m, step))))
            reach += step
        return df

    return add


def _least_of_two(values: Column, step: int):
    return lambda i: F.least(values[i], values[i + step])


def _hash(fingerprint: Column) -> Column:
    return fingerprint.bitwiseAND(F.lit(~POSITION))


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item_id, length, window (its words joined by spaces), window_id: the distinct windows of each item."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - length),
                      lambda s: F.array_join(F.slice("w", s + 1, length), " "))
    return (
        items.select("item_id", length.alias("length"), F.explode(F.array_distinct(cut)).alias("window"))
        .distinct().withColumn("window_id", F.md5("window"))
    )


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """What each document shares with the benchmark, one row per row of ``documents``.

    Columns: ``key`` (of id and text), ``doc_id``, ``n_words``, ``n_hit`` (words inside an occurrence of a
    window), ``n_items``, ``item_ids`` (as text, sorted), ``spans`` (maximal runs of hit words,
    [start, end) in words), ``contaminated`` (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words and are clean; an item without words has no window. Repeated rows
    get a row each. An item without an id still marks words, but is not listed. With an empty
    benchmark every document is clean; no documents give no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("key", row_key(F.col("doc_id"), F.col("text")))

    # The benchmark's tables are stored: Spark then knows their true size and broadcasts them only below its threshold.
    items = store_table(benchmark_windows(benchmark, item_id, item_text, window), fresh_path(spark, "windows"))
    distinct = items.select("length", "window", "window_id").distinct()
    lengths = sorted(r.length for r in distinct.select("length").distinct().collect())  # 1 to ``window`` at most

    tokenized = docs.select("key", "doc_id", words(F.col("text")).alias("w"))
    whole = f"prints_{window}"
    # read and tokenized once; the fingerprints of whole windows take about a third of the texts' bytes
    printed = store_table(
        tokenized.transform(fingerprints("w", window)).select(
            "key", "doc_id", F.size("w").cast("long").alias("n_words"), F.array_distinct(whole).alias(whole)),
        fresh_path(spark, "fingerprints"))
    candidates = _hits(printed, whole, window, _wanted(distinct, window)).unionByName(
        _short_hits(docs, distinct, [n for n in lengths if n < window]))
    # at most one position per word of one document comes together here
    candidates = store_table(
        candidates.groupBy("key").agg(F.collect_set(F.struct("length", "pos")).alias("at")),
        fresh_path(spark, "candidates"),
    )

    hits = store_table(_extended(docs, candidates, distinct), fresh_path(spark, "hits"))
    listed = (
        hits.select("key", F.explode("window_ids").alias("window_id")).join(items, "window_id")
        .groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    found = hits.select("key", "spans").join(listed, "key", "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, s: a + s.end - s.start), F.lit(0)).cast("long")
    return (
        printed.select("key", "doc_id", "n_words")
        .join(found, "key", "left")
        .select(
            "key", "doc_id", "n_words", n_hit.alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def _wanted(distinct: DataFrame, length: int) -> DataFrame:
    """hash: the fingerprints of the benchmark's windows of this length, stored."""
    name = f"prints_{length}"
    wanted = distinct.filter(F.col("length") == length).select(F.split("window", " ").alias("w"))
    # exploding an expression, not a column: Spark would filter on a column's size first and compute it twice
    wanted = wanted.transform(fingerprints("w", length)).select(F.explode(F.array_distinct(name)).alias("f"))
    return store_table(wanted.select(_hash(F.col("f")).alias("hash")).distinct(), fresh_path(distinct.sparkSession, "wanted"))


def _hits(printed: DataFrame, name: str, length: int, wanted: DataFrame) -> DataFrame:
    """key, length, pos: where a fingerprint in column ``name`` is a wanted one."""
    return (
        printed.select("key", F.explode(name).alias("f"))
        .select("key", F.lit(length).alias("length"), F.col("f").bitwiseAND(F.lit(POSITION)).cast("int").alias("pos"),
                _hash(F.col("f")).alias("hash"))
        .join(wanted, "hash", "left_semi").drop("hash"))


def _short_hits(docs: DataFrame, distinct: DataFrame, lengths: list[int]) -> DataFrame:
    """``_hits`` of items shorter than a window, in one more pass over the texts, which a benchmark without them saves.

    The shorter the item, the more fingerprints a text has: one per word for a single word. Kept for every length they
    would take several times the texts' bytes, so they meet the wanted ones as they are made and only hits are stored.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], "key STRING, length INT, pos INT")
    if not lengths:
        return found
    wanted = spark.createDataFrame([], "length INT, hash LONG")
    tokenized, each = docs.select("key", words(F.col("text")).alias("w")), []
    for length in lengths:
        wanted = wanted.unionByName(_wanted(distinct, length).select(F.lit(length).alias("length"), "hash"))
        tokenized = tokenized.transform(fingerprints("w", length))
        made = F.coalesce(F.array_distinct(f"prints_{length}"), F.array().cast("array<bigint>"))
        each.append(F.transform(made, _of_length(length)))
    prints = tokenized.select("key", F.explode(F.concat(*each)).alias("p")).select(
        "key", "p.length", F.col("p.f").bitwiseAND(F.lit(POSITION)).cast("int").alias("pos"), _hash(F.col("p.f")).alias("hash"))
    # stored, so that Spark knows its size and sends it to the prints if it is small
    wanted = store_table(wanted, fresh_path(spark, "wanted"))
    return found.unionByName(prints.join(wanted, ["length", "hash"], "left_semi").drop("hash"))


def _of_length(length: int):
    return lambda f: F.struct(F.lit(length).alias("length"), f.alias("f"))


def _extended(docs: DataFrame, candidates: DataFrame, distinct: DataFrame) -> DataFrame:
    """key, spans, window_ids of the documents in which a window really occurs."""
    # always by sort-merge: the candidates grow with the documents, so a broadcast would work for small inputs only
    near = docs.join(candidates.hint("merge"), "key").select("key", "at", words(F.col("text")).alias("w"))
    # a fingerprint at ``pos`` stands for the windows that contain its whole k-gram
    reach = F.transform("at", lambda c: F.sequence(
        F.greatest(c.pos - (c.length - F.least(F.lit(6), ((c.length + 1) / 2).cast("int"))), F.lit(0)),
        F.least(c.pos, F.size("w") - c.length)))
    starts = F.array_distinct(F.flatten(F.zip_with(reach, F.col("at"), lambda r, c: F.transform(
        r, lambda s: F.struct(s.alias("start"), c.length.alias("length"))))))
    cut = near.select("key", "w", F.explode(F.transform(starts, lambda x: F.struct(
        x.start.alias("start"), x.length.alias("length"),
        F.array_join(F.slice(F.col("w"), x.start + 1, x.length), " ").alias("window")))).alias("x"))
    found = cut.select("key", "x.*").join(distinct, ["length", "window"]).groupBy("key").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("hit"),
        F.collect_set("window_id").alias("window_ids"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda a: a[F.size(a) - 1]
    merged = F.aggregate("hit", none, lambda a, s: F.when(
        (F.size(a) > 0) & (s.start <= last(a).end),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(
            last(a).start.alias("start"), F.greatest(last(a).end, s.end).alias("end")))),
    ).otherwise(F.concat(a, F.array(s))))
    return found.select("key", merged.alias("spans"), "window_ids")


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  **options) -> DataFrame:
    """``documents`` without the contaminated rows; all columns stay as they are.

    NULL and empty texts stay; rows that repeat id and text share a verdict; a document exactly at the limit goes; an empty
    table, or an empty benchmark, loses nothing.
    """
    verdict = find_contamination(documents, benchmark, doc_id, text, **options)
    dirty = verdict.filter("contaminated").select("key").distinct()
    keyed = packed(documents, key=row_key(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))))
    return unpacked(keyed.join(dirty, "key", "left_anti"))
