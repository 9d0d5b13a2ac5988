import datetime as dt
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "shelfweave-tests", master="local[8]", spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def closed_form(spark, days=60, start="2017-01-01"):
    """Two stores and two items on every day; sales = 10 store + item + 5 on weekends."""
    day = F.date_add(F.lit(start).cast("date"), F.col("id").cast("int"))
    return (
        spark.range(days).select(day.alias("date"))
        .withColumn("store", F.explode(F.array(F.lit(1), F.lit(2))))
        .withColumn("item", F.explode(F.array(F.lit(1), F.lit(2))))
        .withColumn(
            "sales",
            (F.col("store") * 10 + F.col("item") + 5 * (F.weekday("date") >= 5).cast("int")).cast("bigint"),
        )
    )


@pytest.fixture(scope="session")
def panel(spark):
    return closed_form(spark).cache()


def requests_of(spark, *rows):
    return spark.createDataFrame(
        [(dt.date.fromisoformat(d), s, i) for d, s, i in rows], "date DATE, store INT, item INT"
    )
