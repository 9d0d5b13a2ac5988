import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfweave.operators import semantic
from shelfweave.operators.accuracy import fact_forecast, fact_sales
from shelfweave.operators.semantic import FilterContext, evaluate, measures
from shelfweave.schemas import PANEL


@pytest.fixture(scope="module")
def facts(spark):
    days = [(2015, 10), (2016, 20), (2017, 50)]
    sales = spark.createDataFrame(
        [(dt.date(y, 3, d), s, i, u * s + i) for y, u in days for d in (1, 2) for s in (1, 2) for i in (1, 2)],
        PANEL,
    )
    plan = spark.createDataFrame(
        [(dt.date(2018, m, 1), s, i, float(m * 10 + s)) for m in (1, 2, 3) for s in (1, 2) for i in (1, 2)],
        "date DATE, store INT, item INT, forecast DOUBLE",
    )
    drivers = spark.createDataFrame([("year", 4.0), ("month", 1.5)], "Feature STRING, MeanAbsShap DOUBLE")
    return {"Sales": fact_sales(sales).cache(), "Forecast": fact_forecast(plan).cache(), "DemandDrivers": drivers}


def test_thirteen_measures():
    assert len(measures(2017)) == 13


def test_year_slicer_leaves_fixed_year_measures_alone(facts):
    names = ["total_units", "avg_daily_units", "units_year", "units_prior_year", "yoy_growth"]
    everything = evaluate(facts, names, 2017).first()
    sliced = evaluate(facts, names, 2017, FilterContext(sales_years=(2015,))).first()
    assert everything.units_year == sliced.units_year == 4 * 50 + 4 * 100 + 12
    assert everything.yoy_growth == pytest.approx(sliced.yoy_growth)
    assert sliced.total_units == 4 * 10 + 4 * 20 + 12
    assert sliced.total_units < everything.total_units


def test_dimension_slicers_reach_all_facts_but_fact_slicers_only_theirs(facts):
    ctx = FilterContext(stores=(2,), items=(1,), sales_years=(2016,), forecast_months=(3,))
    assert evaluate(facts, ["total_units"], 2017, ctx).first()[0] == 2 * (40 + 1)
    assert evaluate(facts, ["forecast_units"], 2017, ctx).first()[0] == 32.0
    assert evaluate(facts, ["forecast_units"], 2017, FilterContext(sales_years=(2016,))).first()[0] == \
        evaluate(facts, ["forecast_units"], 2017).first()[0]


def test_grouping_by_year_keeps_fixed_year_value_in_every_group(facts):
    ctx = FilterContext(sales_years=(2015, 2016))
    got = evaluate(facts, ["total_units", "units_year"], 2017, ctx, by=("Year", "Store")).collect()
    assert {(r.Year, r.Store) for r in got} == {(y, s) for y in (2015, 2016) for s in (1, 2)}
    assert {(r.Store, r.units_year) for r in got} == {(1, 4 * 50 + 6), (2, 4 * 100 + 6)}


def test_zero_denominator_is_blank(facts):
    assert evaluate(facts, ["yoy_growth"], 2030).first()[0] is None


def test_average_is_over_rows_not_days(facts):
    row = evaluate(facts, ["avg_daily_units"], 2017).first()[0]
    assert row == pytest.approx(facts["Sales"].agg(F.avg("Sales")).first()[0])


def test_one_query_reads_one_fact(facts):
    with pytest.raises(ValueError, match="share a fact"):
        evaluate(facts, ["total_units", "forecast_units"], 2017)


def test_impact_by_feature(facts):
    got = evaluate(facts, ["impact"], 2017, FilterContext(stores=(1,)), by=("Feature",))
    assert dict(got.collect()) == {"year": 4.0, "month": 1.5}


def test_year_ranges_reach_the_scan(facts, spark, tmp_path):
    facts["Sales"].write.parquet(str(tmp_path / "s"))
    stored = {"Sales": spark.read.parquet(str(tmp_path / "s"))}
    plan = evaluate(stored, ["total_units"], 2017, FilterContext(sales_years=(2016,)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2016-01-01)" in text and "Store" not in text.split("ReadSchema")[1][:60]


def test_star_join_drops_and_reports_orphans(facts, spark):
    dims = {"Stores": spark.createDataFrame([(1,)], "Store BIGINT"), "Items": spark.createDataFrame([(1,), (2,)], "Item BIGINT")}
    assert semantic.orphans(facts["Sales"], dims["Stores"], "Store").count() == 12
    assert semantic.star_join(facts["Sales"], dims).count() == 12


def test_order_plan_has_a_grand_total(facts):
    rows = {(r.MonthNum, r.is_total): r for r in semantic.order_plan(facts["Forecast"]).collect()}
    assert rows[(None, 1)].forecast_units == sum(r.forecast_units for k, r in rows.items() if k[1] == 0)
    assert rows[(2, 0)].avg_daily_forecast == pytest.approx(21.5)
