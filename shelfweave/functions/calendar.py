"""Calendar and cyclical columns of a date, and the labels used by reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The engineered calendar columns in output order.
CALENDAR_COLUMNS = [
    "year", "month", "day", "dayofweek", "dayofyear", "weekofyear",
    "is_weekend", "is_month_start", "is_month_end",
    "month_sin", "month_cos", "dow_sin", "dow_cos", "doy_sin", "doy_cos",
]
DAYS_PER_YEAR = 365.25


def as_date(df: DataFrame, name: str = "date") -> Column:
    """The date column; text is cast with bad values becoming NULL rather than an error."""
    return F.col(name) if dict(df.dtypes)[name] == "date" else F.col(name).try_cast("date")


def whole_number(value: Column) -> Column:
    """The value as an int where it is a whole number in any notation ("2", "2.0", 2.0), else NULL."""
    text = value.cast("string")
    exact = F.trim(text).try_cast("decimal(38,9)")
    # most are plain digits: the longer way is only taken where the short one finds nothing
    return F.coalesce(text.try_cast("int"), F.when(exact == F.floor(exact), exact.try_cast("int")))


def as_id(df: DataFrame, name: str) -> Column:
    return F.col(name) if dict(df.dtypes)[name] == "int" else whole_number(F.col(name))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _wave(fn, position: Column, period: float) -> Column:
    return fn(F.lit(2.0) * F.pi() * position / F.lit(period))


def calendar_columns(date: Column) -> dict[str, Column]:
    """Name -> expression, all native, so one projection stays inside codegen."""
    month, dow, doy = F.month(date), F.weekday(date), F.dayofyear(date)
    exprs = {
        "year": F.year(date),
        "month": month,
        "day": F.dayofmonth(date),
        "dayofweek": dow,  # Monday = 0
        "dayofyear": doy,
        "weekofyear": F.weekofyear(date),  # ISO week; the year stays the calendar year
        "is_weekend": _flag(dow >= 5),
        "is_month_start": _flag(F.dayofmonth(date) == 1),
        "is_month_end": _flag(date == F.last_day(date)),
    }
    for name, position, period in (
        ("month", month, 12.0), ("dow", dow, 7.0), ("doy", doy, DAYS_PER_YEAR)
    ):
        exprs[f"{name}_sin"] = _wave(F.sin, position, period)
        exprs[f"{name}_cos"] = _wave(F.cos, position, period)
    return exprs


def with_calendar(df: DataFrame) -> DataFrame:
    """Add the 15 calendar columns; store, item and date are coerced to their types."""
    typed = df.withColumns({
        "date": as_date(df), "store": as_id(df, "store"), "item": as_id(df, "item"),
    })
    return typed.withColumns(calendar_columns(F.col("date")))


def weekend_label(date: Column) -> Column:
    return F.when(F.weekday(date) >= 5, "Weekend").otherwise("Weekday")


def report_labels(date: Column) -> dict[str, Column]:
    """Label columns of the report facts; MonthNum and DayNum order their text labels."""
    return {
        "Year": F.year(date).cast("bigint"),
        "MonthNum": F.month(date).cast("bigint"),
        "Month": F.date_format(date, "MMM"),
        "DayNum": F.weekday(date).cast("bigint"),
        "Day": F.date_format(date, "EEE"),
        "IsWeekend": weekend_label(date),
    }
