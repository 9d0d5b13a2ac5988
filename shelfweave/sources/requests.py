"""Parsing and checking forecast requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfweave.functions.calendar import whole_number
from shelfweave.operators.grid import day_range
from shelfweave.schemas import REQUEST_JSON, require_columns

# Request defaults.
DEFAULT_DATE = "2018-01-01"
DEFAULT_PERIODS = 7
DEFAULT_STORE = 1
DEFAULT_ITEM = 1

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


@dataclass(frozen=True)
class EntityRange:
    """Accepted ids, both ends included."""

    stores: tuple[int, int] = (1, 10)
    items: tuple[int, int] = (1, 50)


def iso_date(text: Column) -> Column:
    """The date of a YYYY-MM-DD text, NULL for any other form or an impossible day."""
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def read_requests_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A batch file as text columns, whatever their order; missing columns raise.

    Quotes inside a quoted cell are doubled. ``multi_line`` accepts line breaks inside quotes, at
    the price that a file can no longer be split over tasks.
    """
    raw = spark.read.options(header=True, inferSchema=False, escape='"', multiLine=multi_line).csv(path)
    require_columns(raw, ["date", "store", "item"], "request file")
    return raw


def check_requests(requests: DataFrame, ranges: EntityRange | None = EntityRange()) -> DataFrame:
    """Add typed columns and ``reject_reason``, NULL for a valid request.

    Batches pass ``ranges=None``: unknown ids are then scored through the fallback.
    """
    require_columns(requests, ["date", "store", "item"], "request table")
    texts = {c: F.col(c).cast("string") for c in ("date", "store", "item")}
    day = iso_date(texts["date"])
    store, item = (whole_number(texts[c]) for c in ("store", "item"))
    reason = F.when(texts["date"].isNull(), "missing date")
    reason = reason.when(texts["store"].isNull(), "missing store")
    reason = reason.when(texts["item"].isNull(), "missing item")
    reason = reason.when(day.isNull(), "bad date")
    reason = reason.when(store.isNull(), "bad store").when(item.isNull(), "bad item")
    if ranges is not None:
        reason = reason.when(~store.between(*ranges.stores), "store out of range")
        reason = reason.when(~item.between(*ranges.items), "item out of range")
    rest = [c for c in requests.columns if c not in texts]
    return requests.select(
        *rest, day.alias("date"), store.alias("store"), item.alias("item"),
        reason.alias("reject_reason"),
        F.to_json(F.struct(*[t.alias(c) for c, t in texts.items()])).alias("raw"),
    )


def valid_requests(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason", "raw")


def rejected_requests(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull()).select(
        *[c for c in checked.columns if c not in ("date", "store", "item")]
    )


def parse_json_requests(
    texts: DataFrame, column: str = "body", ranges: EntityRange | None = EntityRange(),
    max_periods: int | None = None,
) -> DataFrame:
    """JSON request texts to (store, item, first_date, n_days, reject_reason) with defaults filled in.

    ``start_date`` asks for ``periods`` days (7 unless given), otherwise the single ``date``
    counts. An empty body means the default request. Every request has days or a reason: more days
    than ``max_periods`` and fewer than one are rejected, and so is a text that is not one JSON object.
    The days themselves are only built by ``request_rows``.
    """
    text = F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("{}"))
    # as the only element of an array, so that whatever follows the object breaks it
    bodies = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(REQUEST_JSON))
    parsed = texts.withColumn("_bodies", bodies).withColumn(
        "_body", F.when(F.size("_bodies") == 1, F.get("_bodies", F.lit(0))))

    def number(name: str, default: int) -> Column:
        given = F.col(f"_body.{name}")
        return F.when(given.isNull(), F.lit(default)).otherwise(whole_number(given))

    # columns of their own: written into the conditions below, each would be worked out a dozen times a row
    typed = parsed.select(
        *[F.col(f"`{c}`") for c in texts.columns], F.col("_body").isNull().alias("_bad"),
        F.col("_body.start_date").isNotNull().alias("_several"),
        iso_date(F.coalesce(F.col("_body.start_date"), F.col("_body.date"), F.lit(DEFAULT_DATE))).alias("_day"),
        number("store", DEFAULT_STORE).alias("store"), number("item", DEFAULT_ITEM).alias("item"),
        number("periods", DEFAULT_PERIODS).alias("_periods"),
    )
    store, item, day, periods, several = (F.col(c) for c in ("store", "item", "_day", "_periods", "_several"))
    reason = F.when(F.col("_bad"), "bad json").when(store.isNull(), "bad store").when(item.isNull(), "bad item")
    if ranges is not None:
        reason = reason.when(~store.between(*ranges.stores), "store out of range")
        reason = reason.when(~item.between(*ranges.items), "item out of range")
    reason = reason.when(day.isNull(), "bad date")
    reason = reason.when(several & (periods.isNull() | (periods < 1)), "bad periods")
    if max_periods is not None:
        reason = reason.when(several & (periods > max_periods), "too many periods")
    n_days = F.when(several, periods).otherwise(F.lit(1)).cast("bigint")
    judged, fine = typed.withColumn("reject_reason", reason), F.col("reject_reason").isNull()
    return judged.select(
        *[F.col(f"`{c}`") for c in texts.columns], "store", "item",
        F.when(fine, day).alias("first_date"), F.when(fine, n_days).alias("n_days"), "reject_reason",
    )


def request_rows(parsed: DataFrame) -> DataFrame:
    """One row per requested day; rejected requests have none."""
    return parsed.select(
        *[c for c in parsed.columns if c not in ("first_date", "n_days", "reject_reason")],
        F.explode(day_range(F.col("first_date"), F.col("n_days").cast("int"))).alias("date"),
    )

