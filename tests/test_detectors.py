"""Sequence detectors against plain Python state machines, and causality."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators import detect as det
from tidebar.operators import features as feats
from tidebar.operators import folds


@pytest.fixture(scope="module")
def walk(spark):
    """Random walks with a few missing bars, in the detector frame."""
    rnd, rows = random.Random(11), []
    for d in range(60):
        px = 100.0
        for k in range(40):
            o = px
            px += rnd.choice([-1, 1]) * rnd.randint(0, 8) * 0.25
            h, lo = max(o, px) + rnd.randint(0, 3) * 0.25, min(o, px) - rnd.randint(0, 3) * 0.25
            miss = d % 3 == 0 and k > 8 and rnd.random() < 0.03
            rows.append(("X", dt.date(2024, 1, 1) + dt.timedelta(days=d), k, *((None,) * 5 if miss else (o, h, lo, px, 1.0)), 40, True))
    g = spark.createDataFrame(rows, "symbol string, session date, slot int, open double, high double, low double, close double, volume double, close_slot int, is_normal boolean")
    d = feats.daily_features(g, 5, 3)
    f = feats.opening_range_columns(feats.intraday(g.join(d, ["symbol", "session"])), 6).cache()
    return f


def mirrored(f, k, length=6):
    m = folds.mirror(f, length, k).orderBy("session", "side", "slot").collect()
    out = {}
    for r in m:
        out.setdefault((r.session, r.side), []).append(r)
    return out


def spark_events(f, seq, k, whole, cutoff=36):
    ev = folds.run_sequence(folds.mirror(f, 6, k), seq, whole, cutoff)
    return sorted((r.session, r.side, r.slot, None if r.stop_ref is None else round(r.stop_ref * r.side, 6)) for r in ev.collect())


def brute(f, k, fn, whole, cutoff=36):
    out = []
    for (s, side), bars in mirrored(f, k).items():
        bars = [b for b in bars if b.slot < cutoff and (not whole or b.gone == 0)]
        out += [(s, side, t, None if p is None else round(p, 6)) for t, p in fn(bars)]
    return sorted(out)


def test_repeated_pressure(walk):
    def rule(bars):
        visits, away = 0, True
        for b in bars:
            d = (b.up - b.c) / b.wid
            if 0 <= d <= 0.2 and away:
                visits, away = visits + 1, False
            elif d >= 0.3:
                away = True
            if b.c > b.up:
                return [(b.slot, None)] if visits >= 2 else []
        return []
    got = spark_events(walk, folds.repeated_pressure(2, 0.2, 0.3), 2, True)
    assert got == brute(walk, 2, rule, True) and got


def test_edge_rejection(walk):
    def rule(bars):
        out, since, low = [], None, 0.0
        for b in bars:
            if b.c is None:
                since = None
                continue
            if since is not None and b.slot - since > 10:
                since = None
            inside = b.dn < b.c < b.up
            if since is not None:
                low = min(low, b.l)
                if inside and b.c < b.mid and b.hk is not None and b.c > b.hk:
                    out.append((b.slot, low))
                    since = None
            elif inside and b.l <= b.dn + 0.3 * b.wid:
                since, low = b.slot, b.l
        return out
    got = spark_events(walk, folds.edge_rejection(0.3, 10), 1, False)
    assert got == brute(walk, 1, rule, False) and got


def test_gap_retest_newest_zone_only(walk):
    def rule(bars):
        out, zones = [], []
        for b in bars:
            if b.c is None:
                zones = []
                continue
            zones = [z for z in zones if b.slot - z["g"] <= 12 and b.c >= z["lo"] and b.h < b.up]
            if zones:
                z = zones[-1]
                if b.l <= z["hi"] and b.h >= z["lo"] and b.c > z["hi"]:
                    if b.dn < b.c < b.up:
                        out.append((b.slot, min(z["low"], b.l)))
                    zones.pop()
            for z in zones:
                z["low"] = min(z["low"], b.l)
            if b.bl is not None and b.l - b.h2 >= 0.25 and b.h2 > b.dn and b.l < b.up:
                zones.append({"g": b.slot, "lo": b.h2, "hi": b.l, "low": b.bl})
        return out
    got = spark_events(walk, folds.gap_retest(1, 12), 3, False)
    assert got == brute(walk, 3, rule, False) and got


def test_inverse_gap(walk):
    def rule(bars):
        out, zones = [], []
        for b in bars:
            if b.c is None:
                zones = []
                continue
            zones = [z for z in zones if b.slot - z["g"] <= 15]
            hit = [z for z in zones if b.c > z["hi"]]
            if hit and b.dn < b.c < b.up:
                out.append((b.slot, min(hit[-1]["low"], b.l)))
            zones = [z for z in zones if not b.c > z["hi"]]
            for z in zones:
                z["low"] = min(z["low"], b.l)
            if b.bl is not None and b.l2 - b.h >= 0.25:
                zones.append({"g": b.slot, "lo": b.h, "hi": b.l2, "low": b.bl})
        return out
    got = spark_events(walk, folds.inverse_gap(1, 15), 3, False)
    assert got == brute(walk, 3, rule, False) and got


@pytest.mark.parametrize("formation, body", [("opening", None), ("post", None), ("post", (1.0, 0.4)), ("opening", (0.5, 0.3))])
def test_inverse_gap_switches(walk, formation, body):
    """Gaps of the opening range or of the rest, and closing bars with a displacement."""
    def rule(bars):
        out, zones = [], []
        for b in bars:
            if b.c is None:
                zones = []
                continue
            zones = [z for z in zones if b.slot - z["g"] <= 15]
            hit = [z for z in zones if b.c > z["hi"]]
            strong = body is None or (b.mb and b.c - b.o >= body[0] * b.mb and b.c > b.o and b.c - b.o >= body[1] * (b.h - b.l) and b.h - b.c <= 0.2 * (b.h - b.l))
            if hit and b.slot >= 6 and b.dn < b.c < b.up and strong:
                out.append((b.slot, min(hit[-1]["low"], b.l)))
            zones = [z for z in zones if not b.c > z["hi"]]
            for z in zones:
                z["low"] = min(z["low"], b.l)
            if b.bl is not None and b.l2 - b.h >= 0.25 and (b.slot < 6) == (formation == "opening"):
                zones.append({"g": b.slot, "lo": b.h, "hi": b.l2, "low": b.bl})
        return out
    seq = folds.inverse_gap(1, 15, 6, formation, body)
    rows = folds.mirror(walk, 6, 3, 0, 4)
    got = sorted((r.session, r.side, r.slot, round(r.stop_ref * r.side, 6)) for r in folds.run_sequence(rows, seq, False, 36).collect())
    bars = {}
    for r in rows.orderBy("session", "side", "slot").collect():
        bars.setdefault((r.session, r.side), []).append(r)
    want = sorted((s, side, t, round(p, 6)) for (s, side), bs in bars.items() for t, p in rule([b for b in bs if b.slot < 36]))
    assert got == want and got


def test_unknown_formation_is_refused():
    with pytest.raises(ValueError):
        folds.inverse_gap(1, 15, 6, "overnight")


def test_ageing_levels(walk):
    window, bounces, max_age, hold, width = 3, 1, 20, 2, 0.05
    got = sorted((r.session, r.slot, r.side, round(r.target_ref, 6)) for r in folds.ageing_levels(walk, window, bounces, max_age, hold, width, 38).collect())
    want, days = [], {}
    for r in walk.orderBy("session", "slot").collect():
        days.setdefault(r.session, []).append(r)
    for s, b in days.items():
        if not b[0].atr or b[0].atr <= 0:
            continue
        w, levels, last = max(0.25, b[0].atr * width), [], -1
        for t in range(window, 38):
            if any(x.close is None for x in b[:t + 1]):
                break
            lo_i = t - 2 - window
            if lo_i >= 0:
                for kind in (-1, 1):
                    span = b[lo_i:t + 1]
                    val = b[t - 2].low if kind == 1 else b[t - 2].high
                    if all((x.low >= val) if kind == 1 else (x.high <= val) for x in span):
                        if not any(z["k"] == kind and t - z["born"] <= max_age and abs(z["px"] - val) < 2 * w for z in levels):
                            levels.append({"px": val, "k": kind, "born": t, "n": 0, "wait": False, "since": 0})
            c, fired = b[t].close, False
            for z in levels:
                if t - z["born"] > max_age or t == z["born"]:
                    continue
                if z["wait"] and t > z["since"]:
                    if z["k"] * (c - z["px"]) > w:
                        if z["n"] >= bounces and last < t and not fired:
                            want.append((s, t, z["k"], round(c + z["k"] * 2 * w, 6)))
                            fired, last = True, t + hold
                        z["n"], z["wait"] = z["n"] + 1, False
                    elif z["k"] * (c - z["px"]) < -w:
                        z["wait"] = False
                elif b[t].low <= z["px"] + w and b[t].high >= z["px"] - w:
                    z["wait"], z["since"] = True, t
    assert got == sorted(want) and got


def test_triangle_shapes_alternate_and_contract(walk):
    f = feats.local_linear(walk, 2)
    ev = folds.triangle(f, 6, 1, 0.05, 15, 36).collect()
    assert all(0 < r.slot - r.shape_slot <= 15 and r.side in (1, -1) for r in ev)


def test_opposite_events_cancel(spark):
    e = spark.createDataFrame([("X", 1, 1), ("X", 1, -1), ("X", 2, -1)], "symbol string, slot int, side int")
    assert [(r.slot, r.side) for r in det.cancel_opposite(e, ["symbol", "slot"]).collect()] == [(2, -1)]


def test_grid_detection_equals_single_settings(walk):
    f = feats.clock_stats(walk, 5, 3)
    g = det.detect_grid(f, "rolling_breakout", 36, {"lookback": [3, 5], "buffer_atr": [0.0, 0.05], "vwap_filter": [0, 1], "volume_z": [None]})
    a = sorted((str(r.session), r.slot, r.side) for r in g.filter("lookback = 5 AND buffer_atr = 0.05 AND vwap_filter = 1").collect())
    b = det.detect(f, "rolling_breakout", 36, lookback=5, buffer_atr=0.05, vwap_filter=1, volume_z=None)
    assert a == sorted((str(r.session), r.slot, r.side) for r in b.collect()) and a


def test_features_do_not_see_later_bars(walk):
    cut = 20
    g = walk.select("symbol", "session", "slot", "open", "high", "low", "close", "volume", "close_slot", "is_normal")
    last = max(r.session for r in g.select("session").distinct().collect())
    late = (F.col("session") == F.lit(last)) & (F.col("slot") > cut)
    alt = g.withColumns({c: F.when(late, F.col(c) + 9).otherwise(F.col(c)) for c in ("open", "high", "low", "close")})

    def build(x):
        f = feats.intraday(x.join(feats.daily_features(x, 5, 3), ["symbol", "session"]))
        f = feats.cusum(feats.clock_stats(feats.opening_range_columns(f, 6), 5, 3), "ret_z", 0.2)
        f = feats.jump_share(feats.variance_ratio(feats.local_linear(f, 3), 6, 2), 4)
        return f.filter((F.col("session") < F.lit(last)) | (F.col("slot") <= cut)).select(
            "session", "slot", "atr", "vwap", "hi5", "ret_z", "cusum_up", "vr_score", "smooth", "jump_share", "noise")
    assert build(g).exceptAll(build(alt)).count() == 0


@pytest.mark.parametrize("family, params", [
    ("rolling_breakout", {"lookback": 0, "buffer_atr": 0.0, "vwap_filter": 0, "volume_z": None}),
    ("impulse_reversal", {"lookback": 2.5, "impulse_atr": 0.1, "volume_z": None}),
    ("vwap_trend_reclaim", {"slope_bars": 2, "tolerance_atr": 0.1, "slope_atr": 0.0}),
    ("trend_pullback", {"fast": 3, "slow": True, "slope_bars": 1, "slope_atr": 0.0, "vwap_filter": 0})])
def test_a_number_of_bars_without_a_column_is_refused(spark, family, params):
    df = spark.createDataFrame([], "symbol string, session date, slot int, close double")
    with pytest.raises(ValueError, match="positive number of bars"):
        det.detect(df, family, 20, **params)
