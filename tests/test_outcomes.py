"""Chronology inside a bar, missing data, selection, sizing and drawdown on tiny frames."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebar.operators import outcomes as out
from tidebar.operators import portfolio as pf
from tidebar.operators import stats as st

DAY = dt.date(2024, 1, 2)


def event(spark, slot=5, side=1, atr=8.0, stop=0.25, target=1.0, hold=10):
    return spark.createDataFrame([("X", DAY, slot, side, atr, stop, target, hold)],
                                 "symbol string, session date, slot int, side int, atr double, stop_atr double, target_r double, hold int")


def label(spark, bars, flat=29, slip=0.0, **kw):
    return out.barrier_outcome(event(spark, **kw), out.pack_bars(bars), flat, slip).collect()[0]


def test_stop_wins_inside_one_bar(spark, bars_of):
    r = label(spark, bars_of({7: (100, 104, 95, 100)}))
    assert (r.reason, r.ambiguous, r.exit_px) == ("stop", True, 98.0)


def test_target_gap_precedes_the_low(spark, bars_of):
    r = label(spark, bars_of({7: (104, 105, 90, 101)}))
    assert (r.reason, r.exit_px, r.ambiguous, r.worst_pts) == ("target", 102.0, False, 0.0)


def test_gap_loss_is_not_clipped(spark, bars_of):
    r = label(spark, bars_of({7: (70, 71, 69, 70)}))
    assert (r.reason, r.pnl_pts) == ("stop", -30.0)


def test_time_exit_uses_the_open_only(spark, bars_of):
    r = label(spark, bars_of({10: (101, 120, 90, 115)}), hold=4)
    assert (r.reason, r.exit_px, r.mfe_pts, r.worst_pts) == ("time", 101.0, 0.0, 0.0)


def test_missing_bar_before_exit_is_unknown(spark, bars_of):
    b = bars_of({}).withColumn("open", F.when(F.col("slot") != 8, F.col("open")))
    r = label(spark, b)
    assert r.is_unknown and r.exit_px is None and r.pnl_pts is None


def test_short_side_mirrors(spark, bars_of):
    r = label(spark, bars_of({8: (100, 100.5, 97.5, 98)}), side=-1)
    assert (r.reason, r.pnl_pts) == ("target", 2.0)


def test_slippage_paid_at_entry_and_stop(spark, bars_of):
    r = label(spark, bars_of({7: (100, 100, 97, 98)}), slip=0.25)
    assert r.entry_px == 100.25 and r.exit_px == pytest.approx(98.25 - 0.25)


def managed(spark, bars, flat=29, slip=0.0, kw=None, **policy):
    return out.managed_outcome(event(spark, **(kw or {})), out.pack_bars(bars), flat, slip, **policy).collect()[0]


def test_breakeven_acts_on_the_next_bar(spark, bars_of):
    r = managed(spark, bars_of({7: (100, 103, 99, 102), 8: (102, 102, 100, 101)}), kw={"target": 0.0}, be_r=1.0)
    assert (r.reason, r.exit_slot, r.exit_px) == ("managed", 8, 100.0)


def test_static_policy_equals_plain_label(spark, bars_of):
    b = bars_of({7: (100, 101, 99, 100), 9: (100, 104, 95, 100)})
    a, m = label(spark, b), managed(spark, b)
    assert (a.reason, a.exit_px, a.worst_pts, a.mfe_pts, a.ambiguous) == (m.reason, m.exit_px, m.worst_pts, m.mfe_pts, m.ambiguous)


def test_no_progress_exits_at_next_open(spark, bars_of):
    r = managed(spark, bars_of({9: (100.5, 101, 100, 101)}), progress_bars=3, progress_r=0.5)
    assert (r.reason, r.exit_slot, r.exit_px) == ("time", 9, 100.5)


def test_limit_needs_trade_through(spark, bars_of):
    e = spark.createDataFrame([("X", DAY, 5, 1, 100.0, 90.0, 110.0)], "symbol string, session date, slot int, side int, limit_px double, cancel_low double, cancel_high double")
    touch = out.limit_fill(e, out.pack_bars(bars_of({6: (102, 103, 100, 102), 7: (102, 103, 101, 102)}, base=102.0)), 2, 29).collect()[0]
    thru = out.limit_fill(e, out.pack_bars(bars_of({6: (102, 103, 99.75, 102)}, base=102.0)), 2, 29).collect()[0]
    assert not touch.filled and thru.filled and thru.fill_px == 100.0


def test_partial_legs_sum_to_one_trade(spark, bars_of):
    b = bars_of({7: (100, 102.5, 100, 102), 12: (104, 104, 104, 104)}, base=101.0)
    e = event(spark, hold=6, target=0.0)
    r = out.partial_legs(e, out.pack_bars(b), 29, 0.5, 1.0, 0.0).collect()[0]
    assert (r.part_reason, r.rest_reason) == ("target", "time") and r.pnl_pts == pytest.approx(0.5 * 2.0 + 0.5 * 3.0)


def test_selection_never_overlaps(spark):
    rows = [("c", "X", DAY, s, 1, x, False) for s, x in ((10, 14), (12, 15), (14, 17), (15, 18), (20, 21))]
    o = spark.createDataFrame(rows, "config_id string, symbol string, session date, slot int, side int, exit_slot int, is_unknown boolean")
    got = out.select_non_overlapping(o, ["config_id", "symbol", "session"], 0, 30)
    assert sorted(r.slot for r in got.collect()) == [10, 15, 20]
    capped = out.select_non_overlapping(o, ["config_id", "symbol", "session"], 0, 30, max_n=2, cooldown=3)
    assert sorted(r.slot for r in capped.collect()) == [10, 20]


def test_shared_selection_equals_plain(spark):
    import random
    rnd = random.Random(4)
    rows = []
    for d in range(6):
        for s in sorted(rnd.sample(range(40), 12)):
            rows.append((0, "X", dt.date(2024, 1, d + 1), s, rnd.choice([1, -1]), s + rnd.randint(1, 8), False, sorted(rnd.sample(range(5), rnd.randint(1, 4)))))
    o = spark.createDataFrame(rows, "exec_id int, symbol string, session date, slot int, side int, exit_slot int, is_unknown boolean, signals array<int>")
    key = ["signal_id", "symbol", "session", "slot"]
    a = out.select_shared(o, ["exec_id", "symbol", "session"], 0, 40, max_n=3).select(*key)
    b = out.select_non_overlapping(o.withColumn("signal_id", F.explode("signals")), ["signal_id", "exec_id", "symbol", "session"], 0, 40, max_n=3).select(*key)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_sizing(spark):
    d = spark.createDataFrame([(1.0,), (10.0,), (500.0,)], "stop_pts double")
    c = out.Costs(slip=0.0, large_fee=0.0, small_fee=0.0)
    got = {r.stop_pts: (r.instrument, r.qty) for r in out.size_large_first(d, F.lit(50.0), c).collect()}
    assert got == {1.0: ("large", 2), 10.0: ("small", 2), 500.0: (None, 0)}
    best = {r.stop_pts: (r.instrument, r.qty) for r in out.size_max_exposure(d, F.lit(50.0), c).collect()}
    assert best == {1.0: ("small", 25), 10.0: ("small", 2), 500.0: (None, 0)}


def test_drawdown(spark):
    rows = [("c", "X", dt.date(2024, 1, i + 1), v) for i, v in enumerate([100.0, -50.0, -100.0, 80.0])]
    d = spark.createDataFrame(rows, "config_id string, symbol string, session date, pnl double")
    assert st.drawdown(d, st.RESULT, ["session"]).collect()[0].max_drawdown == -150.0


def test_minute_drawdown(spark):
    rows = [("p", DAY, 10, 0.0, -100.0, 1), ("p", DAY, 20, 50.0, 0.0, 1)]
    p = spark.createDataFrame(rows, "sleeve string, session date, slot int, delta double, adverse double, exposure int")
    r = pf.minute_drawdown(p, ["sleeve"]).collect()[0]
    assert (r.net, r.max_drawdown) == (50.0, -100.0)


def test_rising_equity_has_no_drawdown(spark):
    rows = [("c", "X", dt.date(2024, 1, i + 1), 10.0) for i in range(4)]
    d = spark.createDataFrame(rows, "config_id string, symbol string, session date, pnl double")
    assert st.drawdown(d, st.RESULT, ["session"]).collect()[0].max_drawdown == 0.0


def test_first_passage_floor_ratchets(spark):
    rows = [("c", "X", dt.date(2024, 1, i + 1), v) for i, v in enumerate([900.0, -850.0, 100.0])]
    d = spark.createDataFrame(rows, "config_id string, symbol string, session date, pnl double")
    r = st.first_passage(d, 5, 1000.0, 800.0, 100.0).collect()[0]
    assert (r.starts, r.fail_pct) == (1, 100.0)
