import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from shelfweave.operators.accuracy import align, fact_sales
from shelfweave.operators.learned import AGGREGATE_COLUMNS, demand_features, learn_demand
from shelfweave.operators.ml_stages import CATEGORIES, FLAGS, NUMERIC
from shelfweave.schemas import REPORT_TABLES
from shelfweave.session import shared_root
from shelfweave.sources import keyed_maps, panel as source, requests, tables


def test_panel_csv_and_parquet_agree(spark, panel, tmp_path):
    panel.write.option("header", True).csv(str(tmp_path / "csv"))
    source.write_panel(panel, str(tmp_path / "pq"))
    a, b = source.read_panel(spark, str(tmp_path / "csv"), "csv"), source.read_panel(spark, str(tmp_path / "pq"))
    assert a.schema == b.schema
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_store_partitions_are_pruned_for_one_series(spark, panel, tmp_path):
    path = str(tmp_path / "by_store")
    source.write_panel_by_store(panel, path)
    history = source.series_history(spark.read.parquet(path), 2, 1)
    assert "PartitionFilters: [isnotnull(store" in history._jdf.queryExecution().executedPlan().toString()
    dates = [r.date for r in history.collect()]
    assert len(dates) == 60 and dates == sorted(dates)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_splits_are_written_as_partitions(spark, panel, tmp_path, fmt):
    path = str(tmp_path / fmt)
    source.write_splits(panel, path, "2017-01-10", "2017-01-20", fmt)
    back = spark.read.option("header", True).format(fmt).load(path)
    assert {r["split"]: r["count"] for r in back.groupBy("split").count().collect()} == {
        "train": 40, "validation": 40, "test": 160}


@pytest.mark.parametrize("name", sorted(REPORT_TABLES))
def test_every_report_table_round_trips(spark, tmp_path, name):
    schema = REPORT_TABLES[name]
    sample = {"date": dt.date(2017, 1, 7), "bigint": 3, "double": 2.5, "string": 'a "quoted", text'}
    row = tuple(sample[f.dataType.simpleString()] for f in schema)
    df = spark.createDataFrame([row, tuple(None for _ in row)], schema)
    tables.write_csv(df, str(tmp_path / "t"))
    back, rejects = tables.read_report_table(spark, name, str(tmp_path / "t"))
    assert rejects.count() == 0
    assert back.schema.simpleString() == schema.simpleString()
    assert row in [tuple(r) for r in back.collect()]


def test_broken_csv_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Feature,MeanAbsShap\nyear,4.3\nmonth,abc\n")
    raw = tables.read_typed_csv(spark, str(tmp_path / "f.csv"), REPORT_TABLES["DemandDrivers"]).cache()
    assert raw.filter(F.col(tables.CORRUPT).isNotNull()).count() == 1
    rows, rejects = tables.read_report_table(spark, "DemandDrivers", str(tmp_path / "f.csv"))
    assert [tuple(r) for r in rows.collect()] == [("year", 4.3)] and [r.line for r in rejects.collect()] == ["month,abc"]


def test_a_header_in_another_order_raises(spark, tmp_path):
    (tmp_path / "f.csv").write_text("MeanAbsShap,Feature\n4.3,year\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_report_table(spark, "DemandDrivers", str(tmp_path / "f.csv"))


def test_forecast_download_is_rounded(spark, tmp_path):
    rows = spark.createDataFrame([("2018-01-15", 1, 1, 21.4049)], "date STRING, store INT, item INT, forecast DOUBLE")
    tables.write_forecast_csv(rows.coalesce(1), str(tmp_path / "d"))
    text = "".join(p.read_text() for p in (tmp_path / "d").glob("*.csv"))
    assert text.split() == ["date,store,item,predicted_sales", "2018-01-15,1,1,21.4"]


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "date STRING, store STRING, item STRING")


def reasons(spark, *rows, **kwargs):
    return [r.reject_reason for r in requests.check_requests(texts(spark, *rows), **kwargs).collect()]


def test_request_checks(spark):
    assert reasons(
        spark, ("2018-01-15", "1", "1"), ("2018-01-15", "99", "1"), ("2018-01-15", "1", "0"),
        ("15/01/2018", "1", "1"), ("2018-1-5", "1", "1"), ("2018-02-30", "1", "1"), ("2018-01-15", None, None),
        (None, "1", "1"), ("2018-01-15", "x", "1"), ("2018-01-15", "10", "50"),
    ) == [None, "store out of range", "item out of range", "bad date", "bad date", "bad date", "missing store",
          "missing date", "bad store", None]


def test_batches_may_skip_the_range_check(spark):
    assert reasons(spark, ("2018-01-15", "99", "999"), ranges=None) == [None]


def test_rejects_keep_their_text(spark):
    checked = requests.check_requests(texts(spark, ("15/01/2018", "1", "1")))
    assert json.loads(requests.rejected_requests(checked).first().raw)["date"] == "15/01/2018"
    assert requests.valid_requests(checked).count() == 0


def test_batch_file_needs_its_columns_in_any_order(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("item,note,store,date\n3,hi,2,2018-01-15\n")
    (tmp_path / "bad.csv").write_text("day,store\n2018-01-15,2\n")
    row = requests.valid_requests(requests.check_requests(requests.read_requests_csv(spark, str(tmp_path / "ok.csv")))).first()
    assert (row.store, row.item, row.note) == (2, 3, "hi")
    with pytest.raises(ValueError, match=r"\['date', 'item'\]"):
        requests.read_requests_csv(spark, str(tmp_path / "bad.csv"))


def test_quoted_cells_of_a_batch(spark, tmp_path):
    (tmp_path / "q.csv").write_text('note,date,store,item\n"a ""q"", b",2018-01-15,1.0,2\n"two\nlines",2018-01-15,2,3\n')
    rows = requests.check_requests(requests.read_requests_csv(spark, str(tmp_path / "q.csv"), multi_line=True)).collect()
    assert [(r.note, r.store, r.item, r.reject_reason) for r in rows] == [('a "q", b', 1, 2, None), ("two\nlines", 2, 3, None)]


@pytest.mark.parametrize("body,store,item,first,days,reason", [
    ("{}", 1, 1, "2018-01-01", 1, None),
    ("", 1, 1, "2018-01-01", 1, None),
    ('{"date": "2018-07-01", "store": 2, "item": "15"}', 2, 15, "2018-07-01", 1, None),
    ('{"start_date": "2018-07-01", "store": 2, "item": 15}', 2, 15, "2018-07-01", 7, None),
    ('{"start_date": "2018-07-01", "periods": 1000}', 1, 1, None, None, "too many periods"),
    ('{"start_date": "2018-07-01", "periods": 400}', 1, 1, "2018-07-01", 400, None),
    ('{"start_date": "2018-07-01", "periods": 7.0, "store": 2.0, "item": "3.0"}', 2, 3, "2018-07-01", 7, None),
    ('{"store": 2.5}', None, 1, None, None, "bad store"),
    ('{"store":2} garbage', 1, 1, None, None, "bad json"),
    ('{"store":2}{"store":3}', 1, 1, None, None, "bad json"),
    ('{"store":2},{"store":3}', 1, 1, None, None, "bad json"),
    ('{"start_date": "2018-07-01", "periods": 0}', 1, 1, None, None, "bad periods"),
    ('{"start_date": "01/07/2018"}', 1, 1, None, None, "bad date"),
    ('{"start_date": "2018-07-01", "periods": "many"}', 1, 1, None, None, "bad periods"),
    ('{"store": 11}', 11, 1, None, None, "store out of range"),
    ('{"item": "x"}', 1, None, None, None, "bad item"),
    ('{"store": ', 1, 1, None, None, "bad json"),
])
def test_json_requests(spark, body, store, item, first, days, reason):
    parsed = requests.parse_json_requests(spark.createDataFrame([(body,)], "body STRING"), max_periods=500)
    row = parsed.first()
    assert (row.store, row.item, row.reject_reason) == (store, item, reason)
    assert (row.first_date and str(row.first_date), row.n_days) == (first, days)
    assert requests.request_rows(parsed).count() == (days or 0)


def test_maps_give_the_joined_features(spark, panel, monkeypatch):
    state = learn_demand(panel.filter("date < '2017-01-20' AND weekday(date) < 6"))
    extra = panel.select("date", (F.col("store") + 90).alias("store"), "item", "sales")
    rows = panel.unionByName(extra)
    want = sorted(map(tuple, demand_features(rows, state).select("date", "store", "item", *AGGREGATE_COLUMNS).collect()))
    for per_map in (64, 3):
        monkeypatch.setattr(keyed_maps, "ENTRIES_PER_MAP", per_map)
        entries = keyed_maps.mean_entries(state, spark)
        shards = keyed_maps.shard_counts(entries)
        mapped = keyed_maps.with_mapped_means(rows, keyed_maps.keyed_maps(entries, shards), shards, state.global_mean)
        assert sorted(map(tuple, mapped.select("date", "store", "item", *AGGREGATE_COLUMNS).collect())) == want


def test_artifact_export_checks_the_slot_count(spark, panel, tmp_path):
    state = learn_demand(panel)
    fill, order = {c: 0.0 for c in NUMERIC}, [f"slot{i}" for i in range(38)]
    keyed_maps.export_artifacts(state, spark, str(tmp_path / "a"), fill, CATEGORIES, FLAGS, order)
    maps, stored = keyed_maps.read_artifacts(spark, str(tmp_path / "a"))
    record = stored.first()
    assert record.global_mean == pytest.approx(state.global_mean) and len(record.feature_order) == 38
    merged = {k: v for r in maps.filter("name = 'store_item_mean'").collect() for k, v in r.entries.items()}
    assert set(merged) == {"1|1", "1|2", "2|1", "2|2"}
    with pytest.raises(ValueError, match="38 slots are described, but 37 are named"):
        keyed_maps.export_artifacts(state, spark, str(tmp_path / "b"), fill, CATEGORIES, FLAGS, order[1:])


def test_fact_columns_follow_the_import_schema(panel):
    assert fact_sales(panel).columns == REPORT_TABLES["Sales"].names


def test_work_folder_must_be_shared_on_a_cluster(tmp_path):
    class Context:
        applicationId, master = "app", "spark://head:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return "set"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared/work/"}
    assert shared_root(Session()) == "hdfs://shared/work"
    Session.conf, Context.master = {}, "local[2]"
    assert shared_root(Session()) == shared_root(Session())


def test_align_pairs_separate_frames(spark):
    day = dt.date(2018, 1, 1)
    actual = spark.createDataFrame([(day, 1, 1, 5), (day, 1, 2, 6)], "date DATE, store INT, item INT, sales BIGINT")
    forecast = spark.createDataFrame([(day, 1, 2, 6.5), (day, 2, 2, 1.0)], "date DATE, store INT, item INT, forecast DOUBLE")
    assert [tuple(r) for r in align(actual, forecast).collect()] == [(day, 1, 2, 6, 6.5)]


def test_stored_panel_is_cut_by_date(spark, tmp_path):
    days = spark.range(400).select(F.date_add(F.lit("2017-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    ids = spark.range(50).select((F.col("id") + 1).cast("int").alias("item"))
    panel = days.crossJoin(ids).select("date", F.lit(1).alias("store"), "item", F.lit(2).cast("bigint").alias("sales"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        source.write_panel(panel, str(tmp_path / "p"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spans = sorted(
        (r.low, r.high) for r in source.read_panel(spark, str(tmp_path / "p"))
        .groupBy(F.input_file_name()).agg(F.min("date").alias("low"), F.max("date").alias("high")).collect())
    assert len(spans) > 1 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_changed_order_lines_give_a_new_panel(spark, tmp_path):
    lines = lambda n: spark.range(n).selectExpr(
        "date'2000-01-01' as l_shipdate", "id as l_suppkey", "id as l_partkey", "1.0D as l_quantity")
    lines(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert source.load_panel(spark, str(tmp_path)).count() == 3
    lines(5).write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    assert source.load_panel(spark, str(tmp_path)).count() == 5
    assert source.load_true_panel(spark, str(tmp_path)).agg(F.max("store")).first()[0] == 4
    assert source.load_panel_by_store(spark, str(tmp_path)).columns == ["date", "store", "item", "sales"]


def test_work_area_leaves_nothing(spark):
    from shelfweave.session import fresh_path, store_table, work_area

    with work_area(spark) as area:
        inside = fresh_path(spark, "t")
        store_table(spark.range(3), inside)
        assert inside.startswith(area) and os.path.isdir(inside.removeprefix("file:"))
    assert not os.path.exists(area.removeprefix("file:"))
