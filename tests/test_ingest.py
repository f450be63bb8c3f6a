"""Stamps, time zones, grids and sources."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebar.operators import ingest
from tidebar.operators.joins import asof_prev, grid_table
from tidebar.sources import readers, sinks
from tidebar.sources.scratch import scratch_path


def test_close_stamps_move_back_one_bar(spark):
    rows = [(dt.datetime(2024, 1, 2, 9, 31) + dt.timedelta(minutes=i),) for i in range(15)]
    x = ingest.normalize_stamp(spark.createDataFrame(rows, "ts timestamp"), "close", 60).orderBy("bar_ts").collect()
    assert x[0].bar_ts == dt.datetime(2024, 1, 2, 9, 30) and x[-1].available_at == dt.datetime(2024, 1, 2, 9, 45)
    with pytest.raises(ValueError):
        ingest.normalize_stamp(spark.createDataFrame(rows, "ts timestamp"), "guess", 60)


def test_daylight_saving(spark):
    rows = [(dt.datetime(2024, 1, 2, 23, 0),), (dt.datetime(2024, 6, 3, 22, 0),)]
    x = ingest.localize(spark.createDataFrame(rows, "ts timestamp"), "America/New_York").collect()
    assert [r.local_minute for r in x] == [18 * 60, 18 * 60]


def test_grid_keeps_missing_slots_and_drops_late_bars(spark):
    b = spark.createDataFrame([("X", dt.date(2024, 1, 2), s, 1.0, 1.0, 1.0, 1.0, 1.0) for s in (0, 2, 7)],
                              "symbol string, session date, slot int, open double, high double, low double, close double, volume double")
    c = spark.createDataFrame([("X", dt.date(2024, 1, 2), 4, True), ("X", dt.date(2024, 1, 3), 2, False)], "symbol string, session date, close_slot int, is_normal boolean")
    g = sorted((str(r.session), r.slot, r.open) for r in ingest.complete_grid(b, c).collect())
    assert g == [("2024-01-02", 0, 1.0), ("2024-01-02", 1, None), ("2024-01-02", 2, 1.0), ("2024-01-02", 3, None), ("2024-01-03", 0, None), ("2024-01-03", 1, None)]


def test_bar_ties_break_by_id(spark):
    t = dt.datetime(2024, 1, 2, 1, 0, 0)
    d = spark.createDataFrame([(9, t, 3.0), (2, t, 1.0), (5, t, 2.0)], "id bigint, ts timestamp, v double")
    r = ingest.bars_from_ticks(d, F.lit("X"), F.to_date("ts"), F.hour("ts"), F.col("v"), ingest.order_key(F.col("ts"), F.col("id"))).collect()[0]
    assert (r.open, r.close, r.volume) == (1.0, 3.0, 3.0)


def test_bar_plan_is_a_hash_aggregate(spark):
    d = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), 1.0)], "id bigint, ts timestamp, v double")
    b = ingest.bars_from_ticks(d, F.lit("X"), F.to_date("ts"), F.hour("ts"), F.col("v"), ingest.order_key(F.col("ts"), F.col("id")))
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_asof_is_strictly_previous(spark):
    left = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 3, 9)], "d date")
    s = spark.createDataFrame([(dt.date(2024, 1, 2), 5.0), (dt.date(2024, 1, 5), None), (dt.date(2024, 1, 4), 7.0)], "o date, v double")
    got = {r.d.day: r.x for r in asof_prev(left, "d", s, "o", "v", "x").collect()}
    assert got == {1: None, 2: None, 3: 5.0, 9: 7.0}


def test_series_reader_takes_either_header(spark):
    path = scratch_path(spark, "t-series")
    spark.createDataFrame([("2024-01-02", "1.5"), ("2024-01-03", "."), ("2024-01-04", "bad")], "DATE string, CLOSE string").write.csv(path, header=True)
    r = readers.read_series_csv(spark, path, ["observation_date", "DATE"], ["CLOSE", "VALUE"]).collect()
    assert [(str(x.obs_date), x.value) for x in r] == [("2024-01-02", 1.5)]


def test_checksums_report_both_sides(spark):
    path = scratch_path(spark, "t-sum")
    spark.range(3).coalesce(1).write.json(path)
    f = readers.files_checksum(spark, path).filter("file LIKE 'part%'")
    want = f.select("file", F.lit("0").alias("sha256"))
    assert sorted(r.problem for r in readers.changed_files(f, want).collect()) == ["absent", "unlisted"]


def test_grid_table_is_the_full_product(spark):
    g = grid_table(spark, {"a": [1, 2, 3], "b": ["x", "y"], "c": [0.5]}, "G")
    rows = {(r.a, r.b, r.c) for r in g.collect()}
    assert len(rows) == 6 == g.count() and g.select("config_id").distinct().count() == 6


def test_ledger_round_trip(spark):
    path = scratch_path(spark, "t-ledger")
    sinks.write_ledger(spark.createDataFrame([(1, 2.0, 3.0)], "id int, pnl double, z double"), path, ["z"])
    assert spark.read.json(path).select("context.z").collect()[0].z == 3.0
