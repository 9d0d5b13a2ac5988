import math

from pyspark.sql import functions as F

from shelfweave.functions.calendar import CALENDAR_COLUMNS, report_labels, with_calendar
from tests.conftest import closed_form, requests_of


def test_creates_every_column(spark):
    assert set(CALENDAR_COLUMNS) <= set(with_calendar(closed_form(spark, 7)).columns)


def test_turn_of_the_year_is_close_on_the_circle(spark):
    rows = with_calendar(requests_of(spark, ("2017-12-31", 1, 1), ("2018-01-01", 1, 1))).orderBy("date").collect()
    gap = math.hypot(rows[0].month_sin - rows[1].month_sin, rows[0].month_cos - rows[1].month_cos)
    assert gap < 0.6


def test_weekend_and_month_flags(spark):
    rows = with_calendar(requests_of(
        spark, ("2017-01-07", 1, 1), ("2017-01-09", 1, 1), ("2017-02-01", 1, 1), ("2016-02-29", 1, 1)
    ))
    got = {str(r.date): (r.dayofweek, r.is_weekend, r.is_month_start, r.is_month_end) for r in rows.collect()}
    assert got == {
        "2017-01-07": (5, 1, 0, 0), "2017-01-09": (0, 0, 0, 0), "2017-02-01": (2, 0, 1, 0),
        "2016-02-29": (0, 0, 0, 1),
    }


def test_iso_week_with_calendar_year(spark):
    row = with_calendar(requests_of(spark, ("2017-01-01", 1, 1))).first()
    assert (row.year, row.weekofyear, row.dayofyear) == (2017, 52, 1)


def test_bad_text_becomes_null_and_flags_stay_zero(spark):
    rows = spark.createDataFrame([("15/01/2018", "x", "7")], "date STRING, store STRING, item STRING")
    row = with_calendar(rows).first()
    assert (row.date, row.store, row.item, row.year, row.month_sin) == (None, None, 7, None, None)
    assert (row.is_weekend, row.is_month_start, row.is_month_end) == (0, 0, 0)


def test_report_labels(spark):
    row = requests_of(spark, ("2017-01-07", 1, 1)).select(
        *[c.alias(n) for n, c in report_labels(F.col("date")).items()]
    ).first()
    assert tuple(row) == (2017, 1, "Jan", 5, "Sat", "Weekend")
