import datetime as dt

import pytest

from tidebar.operators import ingest, stats
from tidebar.sources import readers

D = [dt.date(2024, 1, d) for d in range(1, 8)]


def test_manifest_problems(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two"), ("c", "three")):
        (tmp_path / name).write_text(text)
    manifest = spark.createDataFrame(readers.files_checksum(spark, str(tmp_path)).collect(), "file string, sha256 string, length long")
    assert readers.compare_manifest(readers.files_checksum(spark, str(tmp_path)), manifest).count() == 0
    (tmp_path / "a").write_text("other")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("more")
    got = {(r.file, r.problem) for r in readers.compare_manifest(readers.files_checksum(spark, str(tmp_path)), manifest).collect()}
    assert got == {("a", "altered"), ("b", "absent"), ("d", "new")}


def test_calendar_of_a_table(spark):
    table = spark.createDataFrame([(d, 4, True) for d in D if d.day != 4], "session date, close_slot int, is_normal boolean")
    bars = spark.createDataFrame([("A", D[0], 0), ("A", D[5], 1), ("B", D[2], 0), ("B", D[3], 0)], "symbol string, session date, slot int")
    got = {(r.symbol, r.session.day) for r in ingest.listed_calendar(bars, table).collect()}
    assert got == {("A", d) for d in (1, 2, 3, 5, 6)} | {("B", 3)}  # nothing before a symbol's first bar, no day that is no session
    assert [tuple(r) for r in ingest.unlisted_sessions(bars, table).collect()] == [("B", D[3], 1)]
    with pytest.raises(ValueError):
        ingest.listed_calendar(bars, table.unionAll(table.limit(1)))


def test_correlation_of_all_sleeves(spark):
    rows = [("a", D[0], 1.0), ("a", D[1], 2.0), ("a", D[2], -1.0), ("b", D[0], -2.0), ("b", D[1], -4.0), ("b", D[2], 2.0), ("c", D[3], 5.0), ("z", D[0], 0.0)]
    got = {(r.a, r.b): r.corr for r in stats.correlation_pairs(spark.createDataFrame(rows, "config_id string, session date, pnl double"), "config_id").collect()}
    assert len(got) == 16 and got["a", "a"] == 1 and got["a", "b"] == pytest.approx(-1) and got["a", "z"] == 0 and got["a", "c"] == pytest.approx(got["c", "a"])
