import datetime as dt

from tidebar.streaming import streams

SCHEMA = "event_id bigint, ts timestamp, event_type string, value double"
AT = dt.datetime(2024, 1, 1)


def files(spark, path, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, AT + dt.timedelta(minutes=m), "a", v) for i, (m, v) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, path):
    return streams.upsert(streams.stream_quality(streams.event_stream(spark, path, SCHEMA, "10 minutes", files=1), "1 hour"), ["window_start"], "updates")


def states(df):
    return sorted((r.window_start.hour, r.row_count, r.bad_value, r.negative, r.off_tick) for r in df.collect())


def test_open_windows_come_out_with_their_last_state(spark, tmp_path):
    path = files(spark, str(tmp_path / "in"), [[(1, 0.25), (5, None)], [(30, -1.0), (65, 0.3)], [(70, 2.0)]])
    got, out = run(spark, path)
    assert states(got) == [(0, 3, 1, 1, 0), (1, 2, 0, 0, 1)]


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    path = files(spark, str(tmp_path / "in"), [[(1, 0.25)], [(2, -0.5), (61, 1.0)]])
    got, out = run(spark, path)
    before = states(got)
    again = spark.read.parquet(f"{out}/batch=1")
    rows = spark.createDataFrame(again.collect(), again.schema)
    streams.put_batch(rows, 1, out)
    streams.put_batch(rows, 1, out)
    assert states(streams.latest(spark, out, again.schema, ["window_start"])) == before == [(0, 2, 0, 1, 0), (1, 1, 0, 0, 0)]


def test_later_batches_win(spark, tmp_path):
    s = "window_start timestamp, n bigint"
    for batch, n in ((0, 1), (10, 7), (2, 3)):
        streams.put_batch(spark.createDataFrame([(AT, n)], s), batch, str(tmp_path))
    df = spark.createDataFrame([], s)
    assert streams.latest(spark, str(tmp_path), df.schema, ["window_start"]).first().n == 7
