"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the
columns of ``documents``. ``run`` writes every stage as Parquet to the shared folder and goes on from the
files, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfweave.llm import decontamination, mixing, sharding, simhash, toxicity
from shelfweave.session import fresh_path, store_table, work_area

#: Several stages need judgement that SQL cannot express; tests compare them with plain Python versions.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the model learns from the labels that are not held out.

    NULL and empty texts stay; rows that repeat id and text fare alike; a score at the threshold goes.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.remove_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates.

    NULL and empty texts are one group; of rows that repeat id and text one stays; a row without an id stays only if none of
    its group has one.
    """
    return simhash.deduplicate(docs, shingle=3, distance=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages; NULL and empty texts stay."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of rarer languages repeated until languages weigh their share to the power of 0.7.

    Documents without a language, or without words, stay once at least; rows that repeat id and text are repeated alike.
    """
    return mixing.resample(docs, "lang", temper=0.7, min_rate=1.0, grow_only=True)


def write_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its place in 40 shuffled shards: ``size``, ``shard``, ``slot``, underscored where the name is taken."""
    return sharding.flattened(sharding.shard(docs, shards=40))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_languages),
    ("sharding", write_order),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage needed in between is removed when it is done.

    Columns of ``documents`` beyond the id, text and language pass through, whatever their names; the stages say what
    becomes of NULLs, empty texts, ties and repeated rows. No documents give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = [fresh_path(spark, name) for name, _ in STAGES]
    for (_, stage), path in zip(STAGES, paths):
        with work_area(spark):
            docs = store_table(stage(spark, docs, sf_dir), path)
    return docs
