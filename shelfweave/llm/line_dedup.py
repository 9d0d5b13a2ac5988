"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines are hashed. Of a window that occurs more than once, in one
document or several, the first occurrence stays; all lines that a later occurrence covers
go. Overlapping occurrences merge, so a repeated passage of any length from three lines
on goes as one.

Windows, not texts, are shuffled: 16 bytes of hash with the place they come from. The
first place of each hash is found by a partial ``min`` before the shuffle, so a window that
fills a third of the table costs no more than another. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfweave.llm.text import row_key
from shelfweave.session import fresh_path, store_table

WIDTH = 3


def windows(lines: DataFrame, width: int) -> DataFrame:
    """doc_id, key, pos, h: the 128-bit hash of every ``width`` consecutive lines that are not all blank."""
    at = lambda i, j: F.col("lines")[i + j]
    # the length before each line keeps ("ab", "c") and ("a", "bc") apart
    joined = lambda i: F.concat(*[
        part for j in range(width) for part in (F.length(at(i, j)).cast("string"), F.lit(":"), at(i, j))])
    hashed = F.transform(F.sequence(F.lit(0), F.size("lines") - width), lambda i: F.when(
        ~F.forall(F.slice("lines", i + 1, width), lambda x: F.trim(x) == ""), F.md5(joined(i))))
    return (
        lines.filter(F.size("lines") >= width).select("doc_id", "key", F.posexplode(hashed).alias("pos", "h"))
        .filter("h IS NOT NULL").withColumn("h", F.unhex("h"))
    )


def repeated_lines(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
) -> DataFrame:
    """``key`` and ``removed`` (sorted positions from 0) of the documents that lose lines.

    Documents are ordered by id (missing ones last), then by ``key``, the digest of id and text; within one, lines by position. Rows that repeat
    both id and text are one document here and fare alike. Lines end at ``\\n`` only; windows of blank lines only
    do not count; NULL, empty and shorter texts have no window.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"),
                            F.split(F.col(text), "\n", -1).alias("lines"))
    found = store_table(windows(docs, width), fresh_path(spark, "line-windows"))
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key", "pos")
    # a row that repeats id and text has the same place, so it does not make a window repeated
    first = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(
        F.col("first") != F.col("last")).select("h", "first")
    later = found.join(first, "h").filter(place != F.col("first"))
    # at most one position per line of one document comes together here
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(
        F.collect_set("pos"), lambda p: F.sequence(p, p + width - 1)))))
    return later.groupBy("key").agg(covered.alias("removed"))


def dedup_lines(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
) -> DataFrame:
    """``doc_id``, ``text`` without the removed lines, ``n_lines``, ``n_removed``, ``removed`` of every row.

    A text that loses nothing, NULL included, stays as it is (NULL has no lines, an empty text has one); one that
    loses all lines becomes empty. Repeated rows all stay; an empty table gives no rows; other columns are ignored.
    """
    removed = repeated_lines(documents, doc_id, text, width)
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(F.col(doc_id), F.col(text)).alias("key"))
    joined = rows.join(removed, "key", "left")
    split = joined.select("doc_id", "text", "removed", F.split("text", "\n", -1).alias("lines"))
    # the kept lines are the runs between removed positions
    split = split.withColumn("ends", F.concat(F.array(F.lit(-1)), F.col("removed"), F.array(F.size("lines"))))
    ends = F.col("ends")
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("ends") - 2), lambda i: F.slice(
        "lines", ends[i] + 2, ends[i + 1] - ends[i] - 1)))
    return split.select(
        "doc_id",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )
