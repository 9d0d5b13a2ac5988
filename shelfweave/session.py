"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
# folders handed out per application, and the area that new ones go to
_HANDED_OUT: dict[str, list[str]] = {}
_AREA: ContextVar[str | None] = ContextVar("work_area", default=None)


def build_session(app: str = "shelfweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs rely on; callers may bring their own instead."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a crowded key even when the result must be shuffled once more afterwards
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can read and write.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where all
    tasks share one disk, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _LOCAL_ROOTS.setdefault(
            sc.applicationId, tempfile.mkdtemp(prefix="shelfweave-")
        )
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared root, or the current work area, that no other call gets."""
    path = f"{_AREA.get() or shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    if not _AREA.get():
        _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def input_state(spark: SparkSession, path: str) -> str:
    """Names, sizes and modification times of a file or of the files in a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return ";".join(sorted(f"{f.getPath().getName()},{f.getLen()},{f.getModificationTime()}" for f in listed))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; it need not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def work_area(spark: SparkSession):
    """Intermediate tables written inside this block are removed at its end; results must be stored elsewhere before."""
    area = fresh_path(spark, "area")
    token = _AREA.set(area)
    try:
        yield area
    finally:
        _AREA.reset(token)
        remove_path(spark, area)


def sweep(spark: SparkSession) -> None:
    """Remove every intermediate table of this application, for its end: stored panels and fitted models go too."""
    for path in _HANDED_OUT.pop(spark.sparkContext.applicationId, []):
        remove_path(spark, path)


def store_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and continue from the files: lineage ends here and survives executor loss."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
