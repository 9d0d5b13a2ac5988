"""Registry of runnable queries, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The fixture windows: training ends, validation ends, and the year compared with its prior year.
TRAIN_END = "2001-03-31"
VAL_END = "2001-06-30"
SHORT_TRAIN_END = "1995-03-31"
REPORT_YEAR = 2000

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Build
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent statement over the same tables."""
    def register(build: Build) -> Build:
        if name in CATALOG:
            raise ValueError(f"query '{name}' is registered twice")
        CATALOG[name] = Entry(build, sql)
        return build
    return register


# Shared pieces of the SQL twins.
PANEL_SQL = """panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(1 + l_suppkey % 10 AS INTEGER) AS store,
         CAST(1 + l_partkey % 50 AS INTEGER) AS item, CAST(SUM(l_quantity) AS BIGINT) AS sales
  FROM lineitem GROUP BY 1, 2, 3)"""


def learned_sql(train_end: str = TRAIN_END) -> str:
    return f"""{PANEL_SQL},
train AS (SELECT *, month(date) AS month, isodow(date) - 1 AS dow FROM panel
          WHERE date <= DATE '{train_end}'),
g AS (SELECT AVG(sales) AS gm FROM train),
si AS (SELECT store, item, AVG(sales) AS m FROM train GROUP BY 1, 2),
sid AS (SELECT store, item, dow, AVG(sales) AS m FROM train GROUP BY 1, 2, 3),
im AS (SELECT item, month, AVG(sales) AS m FROM train GROUP BY 1, 2),
sm AS (SELECT store, month, AVG(sales) AS m FROM train GROUP BY 1, 2)"""


def features_sql(source: str, out: str = "feat") -> str:
    """A CTE adding the four learned means with their fallbacks to the rows of ``source``."""
    return f"""{out} AS (
  SELECT r.*, COALESCE(si.m, g.gm) AS store_item_mean,
         COALESCE(sid.m, si.m, g.gm) AS store_item_dow_mean,
         COALESCE(im.m, g.gm) AS item_month_mean, COALESCE(sm.m, g.gm) AS store_month_mean
  FROM {source} r CROSS JOIN g
  LEFT JOIN si ON si.store = r.store AND si.item = r.item
  LEFT JOIN sid ON sid.store = r.store AND sid.item = r.item AND sid.dow = isodow(r.date) - 1
  LEFT JOIN im ON im.item = r.item AND im.month = month(r.date)
  LEFT JOIN sm ON sm.store = r.store AND sm.month = month(r.date))"""


LABELS_SQL = """CAST(year(date) AS BIGINT) AS "Year", CAST(month(date) AS BIGINT) AS "MonthNum",
       strftime(date, '%b') AS "Month", CAST(isodow(date) - 1 AS BIGINT) AS "DayNum",
       strftime(date, '%a') AS "Day",
       CASE WHEN isodow(date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS "IsWeekend" """

# Rows after the validation window with the weekday mean as their forecast.
SCORED_SQL = f"""{learned_sql()},
test AS (SELECT * FROM panel WHERE date > DATE '{VAL_END}'),
{features_sql('test')},
scored AS (SELECT *, store_item_dow_mean AS forecast FROM feat)"""

SMAPE_SQL = """CASE WHEN ABS(sales) + ABS(forecast) = 0 THEN 0.0
     ELSE 200.0 * ABS(forecast - sales) / (ABS(sales) + ABS(forecast)) END"""

# The 90 days after the panel for every series, with the weekday mean as forecast.
PLAN_SQL = f"""{learned_sql()},
grid AS (SELECT CAST(d.date AS DATE) AS date, s.store, s.item
  FROM (SELECT DISTINCT store, item FROM panel) s
  CROSS JOIN (SELECT UNNEST(generate_series(MAX(date) + INTERVAL 1 DAY, MAX(date) + INTERVAL 90 DAY,
                                            INTERVAL 1 DAY)) AS date FROM panel) d),
{features_sql('grid')},
plan AS (SELECT *, store_item_dow_mean AS forecast FROM feat)"""
