"""Queries for event detectors, with their DuckDB twins."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions.core import (KEYS, at_least, by_clock, by_day, by_session, prior, quantile, ratio,
                                    sgn, trailing, upto, whole_session)
from tidebar.operators import detect as det
from tidebar.operators import features as feats
from tidebar.operators import folds, ingest
from tidebar.operators.joins import asof_prev
from tidebar.plans import views
from tidebar.plans import q_windows as qw
from tidebar.plans.oracle import pick, with_ctes
from tidebar.plans.q_ingest import K, ON
from tidebar.plans.q_windows import DAY, H, M, SES
from tidebar.plans.registry import register

EV = "symbol session slot:i side:i"
LAST = {H: 22, M: 26}
CUT = {H: 21, M: 24}


def ev_sql(kind, up, dn, src="feat", extra=None, cols=EV, recursive=False):
    """Both conditions over a bar frame; a bar with both cancels."""
    body = f"""(SELECT * FROM (SELECT *, CASE WHEN coalesce({up}, false) AND NOT coalesce({dn}, false) THEN 1
 WHEN coalesce({dn}, false) AND NOT coalesce({up}, false) THEN -1 END AS side FROM {src}) WHERE side IS NOT NULL AND atr > 0 AND is_normal AND slot < {LAST[kind]})"""
    return with_ctes(kind, pick(cols, body), extra, recursive)


def simple(name, kind, family, up, dn, frame=None, src="feat", extra=None, **params):
    """Register a constant setting of a rule family beside its SQL conditions."""
    def plan(spark, sf):
        df = frame(spark, sf) if frame else views.feat(spark, sf, kind)
        return det.detect(df, family, LAST[kind], **params)
    register(name, ev_sql(kind, up, dn, src, extra))(plan)


UP, DN = "close > or_high", "close < or_low"
REL = "gap * prev_ret"

simple("detect_range_break", H, "range_break", f"slot >= 3 AND {UP}", f"slot >= 3 AND {DN}", length=3)
simple("detect_range_break_delayed", H, "range_break", f"slot >= 5 AND {UP}", f"slot >= 5 AND {DN}", length=5)
simple("detect_range_break_vwap", H, "range_break_vwap", f"slot >= 3 AND {UP} AND close - vwap >= 0.05 * atr",
       f"slot >= 3 AND {DN} AND vwap - close >= 0.05 * atr", length=3, buffer_atr=0.05)
simple("detect_range_break_gap", H, "range_break_gap",
       f"slot >= 3 AND {UP} AND abs(gap) >= 0.2 AND {REL} > 0 AND gap > 0",
       f"slot >= 3 AND {DN} AND abs(gap) >= 0.2 AND {REL} > 0 AND gap < 0", length=3, minimum=0.2, relation="SAME", follow=True)
simple("detect_range_break_gap_fade", M, "range_break_gap",
       f"slot >= 3 AND {UP} AND abs(gap) >= 0.05 AND gap < 0",
       f"slot >= 3 AND {DN} AND abs(gap) >= 0.05 AND gap > 0", length=3, minimum=0.05, relation="ANY", follow=False)
simple("detect_range_break_open_trend", H, "range_break_open_trend",
       f"slot >= 3 AND {UP} AND abs(or_close - or_open) / or_width >= 0.3 AND or_close > or_open",
       f"slot >= 3 AND {DN} AND abs(or_close - or_open) / or_width >= 0.3 AND or_close < or_open", length=3, minimum=0.3)
simple("detect_close_momentum", H, "close_momentum", "slot = 18 AND abs(close / nullif(prev_close, 0) - 1) >= 0.1 AND close / nullif(prev_close, 0) > 1",
       "slot = 18 AND abs(close / nullif(prev_close, 0) - 1) >= 0.1 AND close / nullif(prev_close, 0) < 1", at=18, minimum=0.1)
simple("detect_gap_reversal", M, "gap_reversal", f"slot = 1 AND abs(gap) >= 0.1 AND {REL} < 0 AND gap < 0",
       f"slot = 1 AND abs(gap) >= 0.1 AND {REL} < 0 AND gap > 0", at=1, minimum=0.1, relation="OPPOSITE")
simple("detect_open_shock_reversal", M, "open_shock_reversal", "slot = 2 AND abs(close - day_open) >= 0.2 * atr AND close < day_open",
       "slot = 2 AND abs(close - day_open) >= 0.2 * atr AND close > day_open", at=2, minimum_atr=0.2)
simple("detect_overnight_drift", M, "overnight_drift", "slot = 4 AND prev_ret <= -0.05", "false", at=4, maximum=-0.05)


def banded(kind):
    return lambda spark, sf: feats.noise_band(views.feat(spark, sf, kind), 0.9)


BANDS = {"banded": """SELECT *, CASE WHEN day_open IS NOT NULL AND prev_close IS NOT NULL THEN greatest(day_open, prev_close) * (1 + 0.9 * noise) END AS band_up,
 CASE WHEN day_open IS NOT NULL AND prev_close IS NOT NULL THEN least(day_open, prev_close) * (1 - 0.9 * noise) END AS band_down FROM feat"""}
simple("detect_noise_momentum", H, "noise_momentum", "slot >= 3 AND close > band_up AND close > vwap",
       "slot >= 3 AND close < band_down AND close < vwap", banded(H), "banded", BANDS, start=3)


def with_rvol(spark, sf):
    f = views.feat(spark, sf, M)
    return f.join(feats.opening_rvol(views.bars(spark, sf, M), 3, 10).select(*K, "rvol"), K, "left")


RVOL = {**qw.ORV, "rv": f"SELECT symbol, session, or_volume / (CASE WHEN count(or_volume) OVER w >= 10 THEN avg(or_volume) OVER w END) AS rvol FROM ov WINDOW w AS ({DAY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)",
        "frv": "SELECT * FROM feat LEFT JOIN rv USING (symbol, session)"}
simple("detect_range_break_rvol", M, "range_break_rvol", f"slot >= 3 AND {UP} AND rvol >= 1.1", f"slot >= 3 AND {DN} AND rvol >= 1.1",
       with_rvol, "frv", RVOL, length=3, minimum=1.1)


def with_vol_q(spark, sf):
    m = views.MODELS[M]
    g = views.grid(spark, sf, M)
    d = feats.rolling_quantile(feats.daily_features(g, m.lookback, m.minimum), "vol", 40, 0.5, 12, "vol_q")
    return feats.opening_range_columns(feats.intraday(g.join(d, K)), 3)


VOLQ = {"vq": f"SELECT symbol, session, CASE WHEN count(vol) OVER w >= 12 THEN quantile_cont(vol, 0.5) OVER w END AS vol_q FROM daily WINDOW w AS ({DAY} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)",
        "fvq": "SELECT * FROM feat LEFT JOIN vq USING (symbol, session)"}
simple("detect_range_break_vol_state", M, "range_break_vol_state", f"slot >= 3 AND {UP} AND vol >= vol_q", f"slot >= 3 AND {DN} AND vol >= vol_q",
       with_vol_q, "fvq", VOLQ, length=3, high=True)


# ---- trigger families ----------------------------------------------------------

TRIG = {**qw.EMA_X, "trg0": f"""SELECT f.*, e.ema5 AS ema_fast, e.ema8 AS ema_slow, close - vwap AS dist FROM feat f LEFT JOIN ema e USING (symbol, session, slot)""",
        "trg1": """SELECT t.*, (close - lag(close, 2) OVER o) / nullif(atr, 0) AS move2, (close - lag(close, 4) OVER o) / nullif(atr, 0) AS move4,
 lag(fast2) OVER o AS p_fast, slow2 - lag(slow2, 3) OVER o AS slow_slope,
 CASE WHEN count(dist) OVER w >= 3 THEN min(dist) OVER w END AS dist_min, CASE WHEN count(dist) OVER w >= 3 THEN max(dist) OVER w END AS dist_max
 FROM (SELECT *, last_value(ema_fast IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY slot) AS fast2,
 last_value(ema_slow IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY slot) AS slow2 FROM trg0) t
 WINDOW o AS (PARTITION BY symbol, session ORDER BY slot), w AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING)""",
        "trg": "SELECT *, lag(move2) OVER o AS p_move2, lag(move4) OVER o AS p_move4 FROM trg1 WINDOW o AS (PARTITION BY symbol, session ORDER BY slot)"}


def trigger(name, kind, family, up, dn, **params):
    simple(name, kind, family, up, dn, None, "trg", TRIG, **params)


trigger("detect_trend_pullback", H, "trend_pullback",
        "fast2 > slow2 AND slow_slope > 0.001 * atr AND p_close <= p_fast AND close > fast2",
        "fast2 < slow2 AND slow_slope < -0.001 * atr AND p_close >= p_fast AND close < fast2", fast=5, slow=8, slope_bars=3, slope_atr=0.001, vwap_filter=0)
trigger("detect_rolling_breakout", H, "rolling_breakout",
        "close > hi3 + 0.02 * atr AND p_close <= p_hi3 + 0.02 * atr AND close > vwap AND volume_z >= 0",
        "close < lo3 - 0.02 * atr AND p_close >= p_lo3 - 0.02 * atr AND close < vwap AND volume_z >= 0",
        lookback=3, buffer_atr=0.02, vwap_filter=1, volume_z=0.0)
trigger("detect_failed_breakout", H, "failed_breakout",
        "p_low < p_lo3 - 0.01 * atr AND p_close >= p_lo3 AND close > p_lo3 + 0.01 * atr",
        "p_high > p_hi3 + 0.01 * atr AND p_close <= p_hi3 AND close < p_hi3 - 0.01 * atr",
        lookback=3, overshoot_atr=0.01, reclaim_atr=0.01, volume_z=None)
trigger("detect_vwap_stretch_reversal", M, "vwap_stretch_reversal",
        "p_close - p_vwap < -0.2 * atr AND close > p_high AND abs(vwap_slope) <= 0.2 * atr",
        "p_close - p_vwap > 0.2 * atr AND close < p_low AND abs(vwap_slope) <= 0.2 * atr", stretch_atr=0.2, max_slope_atr=0.2, slope_bars=2)
trigger("detect_impulse_continuation", M, "impulse_continuation",
        "move2 > 0.1 AND p_move2 <= 0.1 AND close > p_high", "move2 < -0.1 AND p_move2 >= -0.1 AND close < p_low",
        lookback=2, impulse_atr=0.1, volume_z=None)
trigger("detect_impulse_reversal", M, "impulse_reversal",
        "p_move4 < -0.1 AND close > p_high AND volume_z >= -0.5", "p_move4 > 0.1 AND close < p_low AND volume_z >= -0.5",
        lookback=4, impulse_atr=0.1, volume_z=-0.5)
trigger("detect_compression_breakout", H, "compression_breakout",
        "hi3 - lo3 <= 0.6 * atr AND close > hi3 AND p_close <= p_hi3",
        "hi3 - lo3 <= 0.6 * atr AND close < lo3 AND p_close >= p_lo3", lookback=3, max_range_atr=0.6, buffer_atr=0.0)
trigger("detect_vwap_trend_reclaim", M, "vwap_trend_reclaim",
        "dist_min > 0 AND p_low <= p_vwap + 0.05 * atr AND p_close >= p_vwap AND close > p_high AND vwap_slope > 0",
        "dist_max < 0 AND p_high >= p_vwap - 0.05 * atr AND p_close <= p_vwap AND close < p_low AND vwap_slope < 0",
        streak=3, slope_bars=2, tolerance_atr=0.05, slope_atr=0.0)


def ref_series(spark, sf):
    """External daily level: mean shipped quantity per day."""
    return views.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("obs_date")).agg(
        F.avg("l_quantity").alias("level"))


def with_ref(spark, sf):
    f = views.feat(spark, sf, M)
    ref = asof_prev(f.select("session").distinct(), "session", ref_series(spark, sf), "obs_date", "level", "ref_level")
    return f.join(ref, "session", "left")


REF = {**TRIG, "ref": "SELECT CAST(l_shipdate AS DATE) AS obs_date, avg(l_quantity) AS level FROM lineitem GROUP BY 1",
       "trf": "SELECT t.*, r.level AS ref_level FROM trg t ASOF LEFT JOIN ref r ON t.session > r.obs_date"}
simple("detect_implied_band_reversion", M, "implied_band_reversion",
       "(ref_level < 24 OR ref_level >= 26) AND p_close < prev_close * (1 - ref_level / 100) AND close >= prev_close * (1 - ref_level / 100)",
       "(ref_level < 24 OR ref_level >= 26) AND p_close > prev_close * (1 + ref_level / 100) AND close <= prev_close * (1 + ref_level / 100)",
       with_ref, "trf", REF, multiple=1.0, regime="EXTREMES", low=24.0, high=26.0, entry="RECLAIM")


@register("detect_grid", with_ctes(H, pick("symbol session slot:i side:i signal_id:i lookback:i buffer_atr:d", """(SELECT * FROM (SELECT t.*, v.*,
 CASE WHEN close > hi + buffer_atr * atr AND p_close <= phi + buffer_atr * atr THEN 1 WHEN close < lo - buffer_atr * atr AND p_close >= plo - buffer_atr * atr THEN -1 END AS side
 FROM (SELECT symbol, session, slot, close, p_close, atr, is_normal, 3 AS lb, hi3 AS hi, lo3 AS lo, p_hi3 AS phi, p_lo3 AS plo FROM feat
 UNION ALL SELECT symbol, session, slot, close, p_close, atr, is_normal, 5, hi5, lo5, p_hi5, p_lo5 FROM feat) t
 JOIN (VALUES (0, 3, 0.0), (1, 3, 0.03), (2, 3, 0.06), (3, 5, 0.0), (4, 5, 0.03), (5, 5, 0.06)) v(signal_id, lookback, buffer_atr) ON v.lookback = t.lb)
 WHERE side IS NOT NULL AND atr > 0 AND is_normal AND slot < 22)""")))
def detect_grid(spark, sf):
    return det.detect_grid(views.feat(spark, sf, H), "rolling_breakout", 22,
                           {"lookback": [3, 5], "buffer_atr": [0.0, 0.03, 0.06], "vwap_filter": [0], "volume_z": [None]}
                           ).drop("vwap_filter", "volume_z")


@register("detect_confirmed", with_ctes(H, pick(EV, f"""(SELECT * FROM (SELECT *, lag(sd) OVER (PARTITION BY symbol, session ORDER BY slot) AS was, sd AS side FROM
 (SELECT *, CASE WHEN {UP} THEN 1 WHEN {DN} THEN -1 ELSE 0 END AS sd FROM feat)) WHERE side <> 0 AND was = side AND atr > 0 AND is_normal AND slot < 22)""")))
def detect_confirmed(spark, sf):
    f = views.feat(spark, sf, H)
    return det.confirm(f, F.col("close") > F.col("or_high"), F.col("close") < F.col("or_low"), 22)


FB = {"rb": f"SELECT symbol, session, slot, CASE WHEN {UP} THEN 1 ELSE -1 END AS side FROM feat WHERE slot >= 3 AND slot < 22 AND atr > 0 AND is_normal AND ({UP} OR {DN})",
      "fb": "SELECT symbol, session, min(slot) AS slot, arg_min(side, slot) AS side FROM rb GROUP BY 1, 2"}


@register("detect_first_event", with_ctes(H, pick("symbol session slot:i side:i entry_slot:i", "(SELECT *, slot + 1 AS entry_slot FROM fb)"), FB))
def detect_first_event(spark, sf):
    return det.first_event(det.detect(views.feat(spark, sf, H), "range_break", 22, length=3))


@register("detect_first_or_unknown", with_ctes(H, """SELECT k.symbol, k.session, CASE WHEN m.fm <= coalesce(f.slot, 1000000) THEN 'unknown' WHEN f.slot IS NOT NULL THEN 'event' ELSE 'none' END AS state,
 CAST(CASE WHEN coalesce(m.fm <= coalesce(f.slot, 1000000), false) THEN NULL ELSE f.slot END AS BIGINT) AS slot,
 CAST(CASE WHEN coalesce(m.fm <= coalesce(f.slot, 1000000), false) THEN NULL ELSE f.side END AS BIGINT) AS side, CAST(m.fm AS BIGINT) AS first_missing
 FROM cal k LEFT JOIN fb f USING (symbol, session) LEFT JOIN (SELECT symbol, session, min(slot) AS fm FROM g WHERE open IS NULL AND slot < 21 GROUP BY 1, 2) m USING (symbol, session)""", FB))
def detect_first_or_unknown(spark, sf):
    ev = det.detect(views.feat(spark, sf, H), "range_break", 22, length=3)
    return det.first_or_unknown(views.grid(spark, sf, H), ev, 0, 21)


@register("detect_cancel_opposite", with_ctes(H, pick(EV, """(SELECT symbol, session, slot, min(side) AS side FROM (SELECT symbol, session, slot, 1 AS side FROM feat WHERE high > hi3
 UNION ALL SELECT symbol, session, slot, -1 FROM feat WHERE low < lo3) GROUP BY 1, 2, 3 HAVING count(DISTINCT side) = 1)""")))
def detect_cancel_opposite(spark, sf):
    f = views.feat(spark, sf, H)
    both = det.union_sides(f.filter("high > hi3").select(*K, "slot"), f.filter("low < lo3").select(*K, "slot"))
    return det.cancel_opposite(both, [*K, "slot"])


# ---- level entries -------------------------------------------------------------

LV_COLS = "symbol session side:i signal_slot:i entry_slot:i entry_px:d ambiguous_before"


def entry_sql(kind, levels, mode, start, cutoff, extra=None):
    """``levels``: bar frame with upper, lower, direction."""
    if mode == "TOUCH":
        up, dn, px, es = "high >= upper", "low <= lower", "CASE WHEN u THEN greatest(open, upper) ELSE least(open, lower) END", "slot"
    else:
        up, dn, px, es = "close > upper", "close < lower", "nxt", "slot + 1"
    x = {"lv": levels, "lv1": f"""SELECT *, direction IN ('BOTH', 'LONG') AND coalesce({up}, false) AS u, direction IN ('BOTH', 'SHORT') AND coalesce({dn}, false) AS d,
 lead(open) OVER (PARTITION BY symbol, session ORDER BY slot) AS nxt FROM lv""",
         "lv2": f"SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY slot) AS rn FROM lv1 WHERE slot >= {start} AND slot < {cutoff} AND u <> d",
         "lv3": f"SELECT symbol, session, min(slot) AS amb FROM lv1 WHERE slot >= {start} AND slot < {cutoff} AND u AND d GROUP BY 1, 2"}
    return with_ctes(kind, pick(LV_COLS, f"""(SELECT e.symbol, e.session, CASE WHEN u THEN 1 ELSE -1 END AS side, slot AS signal_slot, {es} AS entry_slot, {px} AS entry_px,
 coalesce(amb < slot, false) AS ambiguous_before FROM lv2 e LEFT JOIN lv3 USING (symbol, session) WHERE rn = 1) WHERE entry_px IS NOT NULL AND entry_slot < {cutoff}"""), {**(extra or {}), **x})


def levels(name, kind, mode, sql, frame, start=3, cutoff=20, extra=None):
    register(name, entry_sql(kind, sql, mode, start, cutoff, extra))(
        lambda spark, sf: det.breach_entry(frame(spark, sf), mode, F.lit(start), cutoff))


def plain_levels(kind, where=None, up=None, dn=None, direction=None):
    def frame(spark, sf):
        f = views.feat(spark, sf, kind).filter("or_high IS NOT NULL AND or_low IS NOT NULL")
        if where is not None:
            f = f.filter(where())
        return f.withColumns({"upper": up() if up else F.col("or_high"), "lower": dn() if dn else F.col("or_low"),
                              "direction": direction() if direction else F.lit("BOTH")})
    return frame


LV = "SELECT *, or_high AS upper, or_low AS lower, 'BOTH' AS direction FROM feat WHERE or_high IS NOT NULL"
levels("entry_touch", H, "TOUCH", LV, plain_levels(H))
levels("entry_close", H, "CLOSE", LV, plain_levels(H))
levels("entry_delayed", H, "CLOSE", LV, plain_levels(H), start=6)
levels("entry_timely", M, "TOUCH", "SELECT f.*, r.hi AS upper, r.lo AS lower, 'BOTH' AS direction FROM feat f JOIN o2 r USING (symbol, session)",
       lambda spark, sf: views.feat(spark, sf, M).join(
           feats.opening_ranges(views.bars(spark, sf, M), [2]).select(*K, F.col("or_high").alias("upper"), F.col("or_low").alias("lower")), K
       ).withColumn("direction", F.lit("BOTH")), start=2,
       extra={"o2": "SELECT symbol, session, max(high) AS hi, min(low) AS lo FROM bars WHERE slot < 2 GROUP BY 1, 2 HAVING max(high) > min(low)"})
levels("entry_shifted_thresholds", H, "TOUCH",
       "SELECT *, or_high + 0.5 * or_width / 4 AS upper, or_low - 1.0 * or_width / 4 AS lower, 'BOTH' AS direction FROM feat WHERE or_high IS NOT NULL",
       plain_levels(H, None, lambda: F.col("or_high") + 0.5 * F.col("or_width") / 4, lambda: F.col("or_low") - 1.0 * F.col("or_width") / 4))
levels("entry_statistical_threshold", M, "TOUCH",
       "SELECT *, or_open * (1 + vol * 0.25) AS upper, or_open * (1 - vol * 0.25) AS lower, 'BOTH' AS direction FROM feat WHERE vol IS NOT NULL AND or_high IS NOT NULL",
       plain_levels(M, lambda: F.col("vol").isNotNull(), lambda: F.col("or_open") * (1 + F.col("vol") * 0.25), lambda: F.col("or_open") * (1 - F.col("vol") * 0.25)), start=1)
levels("entry_gap_state", M, "CLOSE",
       f"SELECT *, or_high AS upper, or_low AS lower, CASE WHEN gap > 0 THEN 'LONG' ELSE 'SHORT' END AS direction FROM feat WHERE or_high IS NOT NULL AND abs(gap) >= 0.05 AND sign(gap) = sign(prev_ret)",
       plain_levels(M, lambda: (F.abs("gap") >= 0.05) & (sgn(F.col("gap")) == sgn(F.col("prev_ret"))), direction=lambda: F.when(F.col("gap") > 0, "LONG").otherwise("SHORT")))
levels("entry_vol_state", M, "CLOSE", "SELECT *, or_high AS upper, or_low AS lower, 'BOTH' AS direction FROM fvq WHERE or_high IS NOT NULL AND vol <= vol_q",
       lambda spark, sf: with_vol_q(spark, sf).filter("or_high IS NOT NULL AND vol <= vol_q").withColumns(
           {"upper": F.col("or_high"), "lower": F.col("or_low"), "direction": F.lit("BOTH")}), extra=VOLQ)


def formed_trend(spark, sf):
    d = feats.daily_ema(views.daily(spark, sf, M), 6, 4, "ema6").select(*K, "ema6")
    f = views.feat(spark, sf, M).filter("or_high IS NOT NULL").join(d, K)
    way = sgn(F.col("or_close") - F.col("or_open"))
    f = f.withColumn("direction", F.when(way > 0, "LONG").when(way < 0, "SHORT"))
    good = ((F.col("direction") == "LONG") & (F.col("prev_close") > F.col("ema6"))) | (
        (F.col("direction") == "SHORT") & (F.col("prev_close") < F.col("ema6")))
    return f.filter(good).withColumns({"upper": F.col("or_high"), "lower": F.col("or_low")})


DEMA = {"num": "SELECT symbol, session, day_close, row_number() OVER (PARTITION BY symbol ORDER BY session) AS j FROM daily",
        "dema": """SELECT a.symbol, a.session, sum(b.day_close * CASE WHEN b.j = 1 THEN 1 ELSE 2.0 / 7 END * pow(5.0 / 7, a.j - 1 - b.j)) AS ema6
 FROM num a JOIN num b ON a.symbol = b.symbol AND b.j < a.j GROUP BY 1, 2 HAVING count(*) >= 4"""}
levels("entry_formed_trend", M, "CLOSE", """SELECT *, or_high AS upper, or_low AS lower, CASE WHEN or_close > or_open THEN 'LONG' ELSE 'SHORT' END AS direction FROM feat JOIN dema USING (symbol, session)
 WHERE or_high IS NOT NULL AND ((or_close > or_open AND prev_close > ema6) OR (or_close < or_open AND prev_close < ema6))""", formed_trend, extra=DEMA)

VLOC = {**qw.ORV, "vz": f"SELECT symbol, session, CASE WHEN count(or_volume) OVER w >= 5 THEN (or_volume - avg(or_volume) OVER w) / nullif(stddev_pop(or_volume) OVER w, 0) END AS oz FROM ov WINDOW w AS ({DAY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"}


def volume_location(spark, sf):
    """Opening volume z gate; the close-location test reads the signal bar itself, never the entry bar."""
    z = feats.opening_volume_z(views.bars(spark, sf, M), 3, 20, 5).select(*K, "or_volume_z")
    f = views.feat(spark, sf, M).filter("or_high IS NOT NULL").join(z.filter("or_volume_z >= 0"), K)
    loc = F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    return f.withColumns({"upper": F.when(loc >= 0.65, F.col("or_high")), "lower": F.when(1 - loc >= 0.65, F.col("or_low")),
                          "direction": F.lit("BOTH")})


levels("entry_volume_location", M, "CLOSE", """SELECT *, CASE WHEN loc >= 0.65 THEN or_high END AS upper, CASE WHEN 1 - loc >= 0.65 THEN or_low END AS lower, 'BOTH' AS direction
 FROM (SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS loc FROM feat JOIN vz USING (symbol, session) WHERE or_high IS NOT NULL AND oz >= 0)""",
       volume_location, extra=VLOC)


@register("entry_adverse_first_touch", with_ctes(H, pick("symbol session slot:i side:i ambiguous forced_pts:d", """(SELECT symbol, session, slot,
 CASE WHEN high >= or_high AND low <= or_low THEN 0 WHEN high >= or_high THEN 1 ELSE -1 END AS side, high >= or_high AND low <= or_low AS ambiguous,
 CASE WHEN high >= or_high AND low <= or_low THEN or_low - or_high END AS forced_pts, row_number() OVER (PARTITION BY symbol, session ORDER BY slot) AS rn
 FROM feat WHERE slot >= 3 AND slot < 20 AND (high >= or_high OR low <= or_low)) WHERE rn = 1""")))
def entry_adverse_first_touch(spark, sf):
    return det.adverse_first_touch(plain_levels(H)(spark, sf), 20, 3)


# ---- first break per side ------------------------------------------------------

OK = "atr > 0 AND is_normal AND slot < 21"
INT = {"itc": "SELECT * FROM (SELECT *, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session ORDER BY slot) AS gn FROM feat) WHERE gn = 0"}


def side_breaks(name, frame, up_ok, dn_ok, sql_up, sql_dn, src="itc", extra=None, length=3, kind=H, keep=None, keep_cols="", recursive=False):
    cut = CUT[kind]
    body = f"""(SELECT symbol, session, CASE WHEN close > or_high THEN 1 ELSE -1 END AS side, min(slot) AS slot{keep_cols and ', ' + keep_cols.split('|')[0]} FROM {src}
 WHERE atr > 0 AND is_normal AND slot < {cut} AND slot >= {length} AND ((close > or_high AND ({sql_up})) OR (close < or_low AND ({sql_dn}))) GROUP BY 1, 2, 3)"""
    cols = EV + (" " + keep_cols.split("|")[1] if keep_cols else "")
    register(name, with_ctes(kind, pick(cols, body), {**(extra or {}), **({"itc": INT["itc"]} if "itc" not in (extra or {}) else {})}, recursive))(
        lambda spark, sf: det.first_breaks(frame(spark, sf), length, up_ok(), dn_ok(), cut, keep() if keep else None))


def hourly(spark, sf):
    return views.feat(spark, sf, H)


def T():
    return F.lit(True)


side_breaks("detect_first_breaks", hourly, T, T, "true", "true")


def inside_day(spark, sf):
    w = by_day()
    width = F.col("day_high") - F.col("day_low")
    d = views.daily(spark, sf, H).withColumn("_w", width)
    d = d.withColumns({"_pw": F.lag("_w").over(w), "_mw": at_least(F.min("_w"), F.col("_w"), prior(w, 3), 3)})
    tight = (F.col("prev_high") < F.col("prev2_high")) & (F.col("prev_low") > F.col("prev2_low")) & (F.col("_pw") <= F.col("_mw"))
    return hourly(spark, sf).join(d.filter(tight).select(*K), K, "left_semi")


side_breaks("detect_inside_day", inside_day, T, T, "true", "true", "itd", {**INT, "ind": f"""SELECT symbol, session FROM (SELECT *, lag(day_high - day_low) OVER w AS pw,
 min(day_high - day_low) OVER p AS mw, count(day_high - day_low) OVER p AS mn FROM daily WINDOW w AS ({DAY}), p AS ({DAY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
 WHERE prev_high < prev2_high AND prev_low > prev2_low AND mn = 3 AND pw <= mw""",
    "itd": "SELECT itc.* FROM itc JOIN ind USING (symbol, session)"})


def with_overnight(spark, sf):
    on = ingest.overnight_summary(views.bars(spark, sf, H), 18, 0, 24)
    return hourly(spark, sf).join(on, K)


ONX = {**INT, "on_sum": ON, "ito": "SELECT * FROM itc JOIN on_sum USING (symbol, session)"}
c = F.col
side_breaks("detect_overnight_clearance", with_overnight,
            lambda: (c("on_high") - c("or_high") >= 0.25) & (c("on_high") - c("or_high") <= 2 * c("or_width")) & (c("close") > c("on_high")),
            lambda: (c("or_low") - c("on_low") >= 0.25) & (c("or_low") - c("on_low") <= 2 * c("or_width")) & (c("close") < c("on_low")),
            "on_high - or_high >= 0.25 AND on_high - or_high <= 2 * or_width AND close > on_high",
            "or_low - on_low >= 0.25 AND or_low - on_low <= 2 * or_width AND close < on_low", "ito", ONX)


def with_run_close(spark, sf):
    w = upto(by_session())
    return hourly(spark, sf).withColumns({"run_min_close": F.min("close").over(w), "run_max_close": F.max("close").over(w)})


side_breaks("detect_prior_day_acceptance", with_run_close,
            lambda: (c("day_open") > c("prev_low") * 1.2) & (c("run_min_close") > c("prev_low") * 1.2),
            lambda: (c("day_open") < c("prev_high") * 0.8) & (c("run_max_close") < c("prev_high") * 0.8),
            "day_open > prev_low * 1.2 AND rmin > prev_low * 1.2", "day_open < prev_high * 0.8 AND rmax < prev_high * 0.8", "itr",
            {**INT, "itr": "SELECT *, min(close) OVER w AS rmin, max(close) OVER w AS rmax FROM itc WINDOW w AS (PARTITION BY symbol, session ORDER BY slot)"})


def volume_clock(spark, sf):
    """The range ends where cumulative volume reaches the session's quota."""
    b = views.bars(spark, sf, M)
    q = feats.volume_quota_slot(b, feats.volume_quota(b, 3, 10, 1.25), 2, 12).filter("quota_slot IS NOT NULL")
    f = views.feat(spark, sf, M).drop("or_high", "or_low").join(q, K)
    s, early = whole_session(), F.col("slot") <= F.col("quota_slot")
    f = f.withColumns({"or_high": F.max(F.when(early, F.col("high"))).over(s), "or_low": F.min(F.when(early, F.col("low"))).over(s)})
    return f.filter(F.col("or_high") > F.col("or_low"))


side_breaks("detect_volume_clock", volume_clock, lambda: c("slot") > c("quota_slot"), lambda: c("slot") > c("quota_slot"), "slot > quota_slot", "slot > quota_slot", "vcl",
            {**INT, **qw.QUOTA, "vc0": """SELECT symbol, session, min(slot) FILTER (slot >= 2 AND cv >= quota) AS quota_slot FROM quo JOIN cumv USING (symbol, session) WHERE quota IS NOT NULL GROUP BY 1, 2""",
             "vc1": "SELECT symbol, session, max(quota_slot) AS quota_slot, max(high) AS h0, min(low) AS l0 FROM bars JOIN vc0 USING (symbol, session) WHERE slot <= quota_slot GROUP BY 1, 2",
             "vcl": "SELECT itc.* REPLACE (v.h0 AS or_high, v.l0 AS or_low), v.quota_slot FROM itc JOIN vc1 v USING (symbol, session) WHERE v.h0 > v.l0"}, kind=M)


def with_path_eff(spark, sf):
    return hourly(spark, sf).join(feats.path_efficiency(views.grid(spark, sf, H), 4), K)


side_breaks("detect_path_efficiency", with_path_eff, lambda: (c("path_eff") >= 0.3) & (c("move") > 0), lambda: (c("path_eff") >= 0.3) & (c("move") < 0),
            "pe >= 0.3 AND mv2 > 0", "pe >= 0.3 AND mv2 < 0", "ipe", {**INT, "pef": """SELECT symbol, session, arg_max(close, slot) - arg_min(open, slot) AS mv2,
 abs(arg_max(close, slot) - arg_min(open, slot)) / nullif(sum(st), 0) AS pe FROM (SELECT *, abs(close - coalesce(lag(close) OVER (PARTITION BY symbol, session ORDER BY slot), open)) AS st
 FROM g WHERE slot < 4) GROUP BY 1, 2 HAVING count(close) = 4""", "ipe": "SELECT * FROM itc JOIN pef USING (symbol, session)"}, length=4)
side_breaks("detect_vwap_slope", hourly, lambda: (c("close") > c("vwap")) & (c("vwap_slope") / c("atr") > 0.01), lambda: (c("close") < c("vwap")) & (c("vwap_slope") / c("atr") < -0.01),
            "close > vwap AND vwap_slope / atr > 0.01", "close < vwap AND vwap_slope / atr < -0.01")
side_breaks("detect_two_anchor_vwap", with_overnight, lambda: (c("close") > c("vwap")) & ((c("vwap") - c("on_vwap")) / c("atr") > 0.01),
            lambda: (c("close") < c("vwap")) & ((c("on_vwap") - c("vwap")) / c("atr") > 0.01),
            "close > vwap AND (vwap - on_vwap) / atr > 0.01", "close < vwap AND (on_vwap - vwap) / atr > 0.01", "ito", ONX)
side_breaks("detect_pullback_limit", hourly, T, T, "true", "true", keep=lambda: {"limit_px": F.when(c("close") > c("or_high"), c("or_high") - 0.1 * c("or_width")).otherwise(c("or_low") + 0.1 * c("or_width"))},
            keep_cols="min(CASE WHEN close > or_high THEN or_high - 0.1 * or_width ELSE or_low + 0.1 * or_width END) AS limit_px|limit_px:d")


def nested(spark, sf):
    n = feats.nested_acceptance(views.grid(spark, sf, H), 2, 4, 0.25)
    return views.feat(spark, sf, H).drop("or_high", "or_low").join(n, K).withColumns(
        {"or_high": F.col("long_high"), "or_low": F.col("long_low")})


NEST4 = {k: v.replace("slot < 5", "slot < 4").replace("count(close) = 5", "count(close) = 4") for k, v in qw.NEST.items()}
side_breaks("detect_nested_ranges", nested, lambda: c("accept_up"), lambda: c("accept_down"), "accept_up", "accept_down", "itn",
            {**INT, **NEST4, "itn": "SELECT itc.* REPLACE (n.long_high AS or_high, n.long_low AS or_low), n.accept_up, n.accept_down FROM itc JOIN nest n USING (symbol, session)"}, length=4)


def with_impact(spark, sf):
    return hourly(spark, sf).join(feats.price_impact(views.grid(spark, sf, H), 4, 5, 3).select(*K, "impact_z"), K)


side_breaks("detect_unexpected_impact", with_impact, lambda: c("impact_z") <= 0.5, lambda: c("impact_z") <= 0.5, "impact_z <= 0.5", "impact_z <= 0.5", "iim",
            {**INT, **qw.IMPACT, "iim": "SELECT * FROM itc JOIN imp USING (symbol, session)"}, length=4)


def with_spread(spark, sf):
    """A break before both blocks are complete spends its side."""
    f = hourly(spark, sf).join(feats.hl_spread(views.grid(spark, sf, H), 3, 10, 3, 0.6), K)
    s = whole_session()
    early = F.col("slot").between(3, 5)
    f = f.withColumns({"_eu": F.count_if(early & (c("close") > c("or_high"))).over(s), "_ed": F.count_if(early & (c("close") < c("or_low"))).over(s)})
    return f.withColumn("ref_close", F.max(F.when(c("slot") == 5, c("close"))).over(s))


def GATE():
    return (c("spread") >= 0) & (c("spread") <= c("spread_q")) & (c("spread") * c("ref_close") <= 2.0 * c("or_width"))
side_breaks("detect_estimated_friction", with_spread, lambda: GATE() & (c("_eu") == 0), lambda: GATE() & (c("_ed") == 0),
            "spread >= 0 AND spread <= spread_q AND spread * rc <= 2.0 * or_width AND eu = 0", "spread >= 0 AND spread <= spread_q AND spread * rc <= 2.0 * or_width AND ed = 0", "isp",
            {**INT, **qw.SPREAD, "fx": """SELECT symbol, session, count(*) FILTER (slot BETWEEN 3 AND 5 AND close > or_high) AS eu, count(*) FILTER (slot BETWEEN 3 AND 5 AND close < or_low) AS ed,
 max(close) FILTER (slot = 5) AS rc FROM feat GROUP BY 1, 2""", "isp": "SELECT itc.*, spread, spread_q, eu, ed, rc FROM itc JOIN spr USING (symbol, session) JOIN fx USING (symbol, session)"}, length=6)


FBK = {**INT, "fb0": f"SELECT * FROM itc WHERE {OK}", "fb1": f"SELECT symbol, session, min(slot) AS fs, arg_min(CASE WHEN {UP} THEN 1 ELSE -1 END, slot) AS fside FROM fb0 WHERE slot >= 3 AND ({UP} OR {DN}) GROUP BY 1, 2",
       "fb2": "SELECT b.*, f.fs, f.fside FROM fb0 b JOIN fb1 f USING (symbol, session)"}


@register("detect_failed_side", with_ctes(H, pick(EV, f"""(SELECT b.symbol, b.session, min(b.slot) AS slot, -any_value(fside) AS side FROM fb2 b JOIN
 (SELECT symbol, session, min(slot) AS bs FROM fb2 WHERE slot > fs AND close < or_high AND close > or_low GROUP BY 1, 2) k USING (symbol, session)
 WHERE b.slot >= bs AND b.slot - fs <= 8 AND ((fside = -1 AND {UP}) OR (fside = 1 AND {DN})) GROUP BY 1, 2)"""), FBK))
def detect_failed_side(spark, sf):
    return det.failed_side(hourly(spark, sf), 3, 8, 21)


@register("detect_failed_break_fade", with_ctes(H, pick(EV + " stop_ref:d target_ref:d", """(SELECT symbol, session, min(slot) AS slot, any_value(-fside) AS side, arg_min(ext, slot) AS stop_ref, any_value(or_mid) AS target_ref FROM
 (SELECT *, CASE WHEN fside = 1 THEN max(high) FILTER (slot >= fs) OVER w ELSE min(low) FILTER (slot >= fs) OVER w END AS ext,
 CASE WHEN fside = 1 THEN or_high - close ELSE close - or_low END AS dep FROM fb2 WINDOW w AS (PARTITION BY symbol, session ORDER BY slot ROWS UNBOUNDED PRECEDING))
 WHERE slot > fs AND close < or_high AND close > or_low AND dep / or_width >= 0.1 AND slot - fs <= 5 GROUP BY 1, 2)"""), FBK))
def detect_failed_break_fade(spark, sf):
    return det.failed_break_fade(hourly(spark, sf), 3, 5, 0.1, 21)


def jumps(spark, sf):
    f = feats.jump_share(hourly(spark, sf), 3)
    jl = quantile(F.col("jump_share"), 0.5)
    f = f.withColumn("jump_low_q", at_least(jl, F.col("jump_share"), prior(by_clock(), 10), 4))
    f = f.withColumn("jump_open", F.max(F.when(F.col("slot") == 3, F.col("jump_share"))).over(whole_session()))
    return jump_open_threshold(f)


def jump_open_threshold(f):
    f = f.withColumn("_q", at_least(quantile(F.col("jump_share"), 0.4), F.col("jump_share"), prior(by_clock(), 10), 4))
    return f.withColumn("jump_open_q", F.max(F.when(F.col("slot") == 3, F.col("_q"))).over(whole_session())).drop("_q")


JS = {"js0": """SELECT *, CASE WHEN rv > 0 AND bv IS NOT NULL THEN greatest(rv - bv, 0) / rv END AS js FROM (SELECT *,
 CASE WHEN count(ret) OVER w >= 3 THEN sum(ret * ret) OVER w END AS rv, CASE WHEN count(pair) OVER v >= 2 THEN sum(pair) OVER v END * pi() / 2 * 3 / 2 AS bv
 FROM (SELECT *, abs(ret * lag(ret) OVER (PARTITION BY symbol, session ORDER BY slot)) AS pair FROM feat)
 WINDOW w AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), v AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))""",
      "js1": """SELECT *, CASE WHEN count(js) OVER k >= 4 THEN quantile_cont(js, 0.5) OVER k END AS lowq, CASE WHEN count(js) OVER k >= 4 THEN quantile_cont(js, 0.4) OVER k END AS hq
 FROM js0 WINDOW k AS (PARTITION BY symbol, slot ORDER BY session ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
      "jsx": "SELECT symbol, session FROM js1 WHERE slot = 3 AND js >= hq",
      "jb0": "SELECT b.*, j.js, j.lowq FROM fb2 b JOIN jsx USING (symbol, session) JOIN js1 j USING (symbol, session, slot)",
      "jb1": f"""SELECT *, max(fside * CASE WHEN fside = 1 THEN high ELSE low END) FILTER (slot >= fs) OVER w AS ext,
 min(slot) FILTER (slot >= fs AND ((fside = 1 AND {DN}) OR (fside = -1 AND {UP}))) OVER s AS lost, min(slot) FILTER (slot > fs AND slot >= fs + 1 AND js <= lowq) OVER s AS quiet
 FROM jb0 WINDOW s AS (PARTITION BY symbol, session), w AS (PARTITION BY symbol, session ORDER BY slot ROWS UNBOUNDED PRECEDING)""",
      "jb2": "SELECT symbol, session, ext AS box FROM jb1 WHERE slot = quiet"}


@register("detect_jump_recovery", with_ctes(H, pick(EV, """(SELECT symbol, session, min(slot) AS slot, any_value(fside) AS side FROM jb1 JOIN jb2 USING (symbol, session)
 WHERE slot > quiet AND slot - fs <= 14 AND fside * close > greatest(CASE WHEN fside = 1 THEN or_high ELSE -or_low END, box) AND (lost IS NULL OR slot < lost) GROUP BY 1, 2)"""), {**FBK, **JS}))
def detect_jump_recovery(spark, sf):
    return det.jump_recovery(jumps(spark, sf), 3, 3, 1, 14, 21)


VR5 = {"v50": "SELECT symbol, session, slot, CASE WHEN count(ret) OVER w >= 5 THEN list(ret) OVER w END AS x0 FROM feat WINDOW w AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
       "v51": "SELECT symbol, session, slot, list_transform(x0, lambda v: v - list_avg(x0)) AS x FROM v50",
       "v52": "SELECT *, list_sum(list_transform(x, lambda v: v * v)) AS ss, list_transform(range(2, 6), lambda i: x[i] * x[i - 1]) AS a1 FROM v51",
       "v53": "SELECT symbol, session, slot, CASE WHEN ss > 0 AND list_sum(list_transform(a1, lambda v: v * v)) > 0 THEN list_sum(a1) / sqrt(list_sum(list_transform(a1, lambda v: v * v))) END AS vr FROM v52",
       "v5a": f"SELECT b.*, v.vr, lag(v.vr, 5) OVER (PARTITION BY b.symbol, b.session ORDER BY b.slot) AS vr0, CASE WHEN b.slot >= 3 AND {UP} THEN 1 WHEN b.slot >= 3 AND {DN} THEN -1 END AS side FROM fb0 b JOIN v53 v USING (symbol, session, slot)",
       "v5b": "SELECT *, min(slot) FILTER (slot >= 10 AND vr0 < -0.2 AND vr > 0.2) OVER s AS st, min(slot) FILTER (side = 1) OVER s AS fu, min(slot) FILTER (side = -1) OVER s AS fd FROM v5a WINDOW s AS (PARTITION BY symbol, session)"}


@register("detect_serial_switch", with_ctes(H, pick(EV, """(SELECT symbol, session, side, min(slot) AS slot FROM v5b WHERE side IS NOT NULL AND slot > st AND slot - st <= 8
 AND NOT coalesce(CASE WHEN side = 1 THEN fu ELSE fd END <= st, false) GROUP BY 1, 2, 3)"""), {**FBK, **VR5}))
def detect_serial_switch(spark, sf):
    return det.serial_switch(feats.variance_ratio(hourly(spark, sf), 5, 2), 3, 5, 0.2, 8, 21)


def drift(spark, sf):
    f = feats.cusum(hourly(spark, sf), "ret_z", 0.25)
    d = f.groupBy(*KEYS).agg(F.max("cusum_up").alias("mu"), F.max("cusum_down").alias("md"))
    w = prior(by_day(), 10)
    d = d.withColumns({"alarm_up": at_least(quantile(c("mu"), 0.5), c("mu"), w, 3), "alarm_down": at_least(quantile(c("md"), 0.5), c("md"), w, 3)})
    return f.join(d.select(*K, "alarm_up", "alarm_down"), K)


DRIFT = {**qw.cusum_sql(), **INT, "cs1": "SELECT symbol, session, slot, CASE WHEN z IS NOT NULL THEN u END AS cu, CASE WHEN z IS NOT NULL THEN d END AS cd FROM cus",
         "cs2": f"""SELECT symbol, session, CASE WHEN count(mu) OVER w >= 3 THEN quantile_cont(mu, 0.5) OVER w END AS au, CASE WHEN count(md) OVER w >= 3 THEN quantile_cont(md, 0.5) OVER w END AS ad
 FROM (SELECT symbol, session, max(cu) AS mu, max(cd) AS md FROM cs1 GROUP BY 1, 2) WINDOW w AS ({DAY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
         "cs3": """SELECT *, max(slot) FILTER (slot >= 3 AND cu > au) OVER w AS lu, max(slot) FILTER (slot >= 3 AND cd > ad) OVER w AS ld
 FROM itc JOIN cs1 USING (symbol, session, slot) JOIN cs2 USING (symbol, session) WINDOW w AS (PARTITION BY symbol, session ORDER BY slot ROWS UNBOUNDED PRECEDING)"""}


@register("detect_sequential_drift", with_ctes(H, pick(EV, f"""(SELECT symbol, session, CASE WHEN {UP} THEN 1 ELSE -1 END AS side, min(slot) AS slot FROM cs3 WHERE {OK} AND slot >= 3
 AND (({UP} AND cu > au AND coalesce(slot - ld > 3, true)) OR ({DN} AND cd > ad AND coalesce(slot - lu > 3, true))) GROUP BY 1, 2, 3)"""), DRIFT, recursive=True))
def detect_sequential_drift(spark, sf):
    return det.sequential_drift(drift(spark, sf), 3, 3, 21)


@register("detect_displacement_bar", ev_sql(H, "slot >= 8 AND close > or_low AND close < or_high AND high > low AND close > open AND mb > 0 AND close - open >= 1.1 * mb AND (close - open) / (high - low) >= 0.5 AND (high - close) / (high - low) <= 0.2",
          "slot >= 8 AND close > or_low AND close < or_high AND high > low AND close < open AND mb > 0 AND open - close >= 1.1 * mb AND (open - close) / (high - low) >= 0.5 AND (close - low) / (high - low) <= 0.2", "dsp",
          {"dsp": "SELECT *, CASE WHEN count(abs(close - open)) OVER w >= 6 THEN quantile_cont(abs(close - open), 0.5) OVER w END AS mb FROM feat WINDOW w AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)"}))
def detect_displacement_bar(spark, sf):
    f = hourly(spark, sf).withColumn("_body", F.abs(c("close") - c("open")))
    f = f.withColumn("mb", at_least(quantile(c("_body"), 0.5), c("_body"), prior(by_session(), 6), 6))
    rng = c("high") - c("low")
    base = (c("slot") >= 8) & (c("close") > c("or_low")) & (c("close") < c("or_high")) & (rng > 0) & (c("mb") > 0) & (c("_body") >= 1.1 * c("mb"))
    strong = ratio(c("_body"), F.nullif(rng, F.lit(0.0))) >= 0.5
    return det.events(f, base & strong & (c("close") > c("open")) & (ratio(c("high") - c("close"), F.nullif(rng, F.lit(0.0))) <= 0.2),
                      base & strong & (c("close") < c("open")) & (ratio(c("close") - c("low"), F.nullif(rng, F.lit(0.0))) <= 0.2), 22)


@register("detect_tight_box_escape", ev_sql(H, "slot >= 6 AND or_low < lo3 AND hi3 < or_high AND hi3 - lo3 <= 0.9 * or_width AND close > hi3 AND close < or_high",
          "slot >= 6 AND or_low < lo3 AND hi3 < or_high AND hi3 - lo3 <= 0.9 * or_width AND close < lo3 AND close > or_low"))
def detect_tight_box_escape(spark, sf):
    f = hourly(spark, sf)
    box = (c("slot") >= 6) & (c("or_low") < c("lo3")) & (c("hi3") < c("or_high")) & (c("hi3") - c("lo3") <= 0.9 * c("or_width"))
    return det.events(f, box & (c("close") > c("hi3")) & (c("close") < c("or_high")), box & (c("close") < c("lo3")) & (c("close") > c("or_low")), 22)


# ---- state commands ------------------------------------------------------------

@register("detect_momentum_state", with_ctes(M, pick("symbol session slot:i state:i command:i strength:d", """(SELECT *, CASE WHEN st <> coalesce(lag(st) OVER w, 0) THEN st END AS command, st AS state FROM (
 SELECT *, coalesce(last_value(want IGNORE NULLS) OVER w, 0) AS st FROM (SELECT *, CASE WHEN slot % 3 = 2 THEN CASE WHEN abs(score) >= 0.4 THEN sign(score) WHEN abs(score) <= 0.2 THEN 0 END END AS want,
 least(1, greatest(0.5, abs(score) / 0.8)) AS strength FROM (SELECT *, CASE WHEN count(close) OVER k >= 2 THEN (avg(close) OVER k / nullif(prev_close, 0) - 1) / nullif(vol, 0) END AS score FROM feat
 WINDOW k AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))) WINDOW w AS (PARTITION BY symbol, session ORDER BY slot))
 WINDOW w AS (PARTITION BY symbol, session ORDER BY slot))""")))
def detect_momentum_state(spark, sf):
    f = views.feat(spark, sf, M)
    k = trailing(by_session(), 3)
    f = f.withColumn("score", ratio(ratio(at_least(F.avg("close"), c("close"), k, 2), F.nullif(c("prev_close"), F.lit(0.0))) - 1, F.nullif(c("vol"), F.lit(0.0))))
    x = det.hysteresis(f, c("score"), F.lit(0.4), F.lit(0.2), F.pmod(c("slot"), F.lit(3)) == 2)
    return x.select(*K, "slot", "state", "command", F.when(c("score").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.abs("score") / 0.8))).otherwise(0.5).alias("strength"))


def vwap_trend(spark, sf):
    f = views.feat(spark, sf, H)
    band = 0.1 * c("atr")
    return det.hysteresis(f, c("close") - c("vwap"), band, band * 0.3, F.pmod(c("slot"), F.lit(2)) == 1)


VT = {"vt0": "SELECT *, CASE WHEN slot % 2 = 1 THEN CASE WHEN abs(close - vwap) >= 0.1 * atr THEN sign(close - vwap) WHEN abs(close - vwap) <= 0.1 * atr * 0.3 THEN 0 END END AS want FROM feat",
      "vt": "SELECT *, coalesce(last_value(want IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY slot), 0) AS state FROM vt0",
      "vt1": "SELECT *, coalesce(lag(state) OVER (PARTITION BY symbol, session ORDER BY slot), 0) AS was, lead(open) OVER (PARTITION BY symbol, session ORDER BY slot) AS nxt FROM vt"}


@register("detect_vwap_trend_state", with_ctes(H, pick("symbol session slot:i state:i command:i", "(SELECT *, CASE WHEN state <> was THEN state END AS command FROM vt1)"), VT))
def detect_vwap_trend_state(spark, sf):
    return vwap_trend(spark, sf).select(*K, "slot", "state", "command")


@register("detect_noise_area_state", with_ctes(H, pick("symbol session slot:i state:i command:i guard:d", """(SELECT symbol, session, slot, st AS state, CASE WHEN st <> coalesce(lag(st) OVER w, 0) THEN st END AS command,
 CASE WHEN st = 1 THEN greatest(band_up, vwap) WHEN st = -1 THEN least(band_down, vwap) END AS guard FROM (SELECT *, coalesce(last_value(CASE WHEN slot % 2 = 1 AND slot >= 3 THEN CASE WHEN close > band_up THEN 1 WHEN close < band_down THEN -1 ELSE 0 END END IGNORE NULLS)
 OVER (PARTITION BY symbol, session ORDER BY slot), 0) AS st FROM banded) WINDOW w AS (PARTITION BY symbol, session ORDER BY slot))""", ), BANDS))
def detect_noise_area_state(spark, sf):
    f = feats.noise_band(views.feat(spark, sf, H), 0.9)
    side = F.when(c("close") > c("band_up"), 1).when(c("close") < c("band_down"), -1).otherwise(0)
    x = det.stateless_commands(f, side, (F.pmod(c("slot"), F.lit(2)) == 1) & (c("slot") >= 3))
    guard = F.when(c("state") == 1, F.greatest("band_up", "vwap")).when(c("state") == -1, F.least("band_down", "vwap"))
    return x.select(*K, "slot", "state", "command", guard.alias("guard"))


@register("outcome_state_episodes", with_ctes(H, pick("symbol session side:i signal_slot:i entry_slot:i exit_slot:i entry_px:d exit_px:d pnl_pts:d", """(SELECT symbol, session, any_value(state) AS side, min(slot) AS signal_slot, min(slot) + 1 AS entry_slot,
 least(max(slot) + 1, 23) AS exit_slot, first(nxt ORDER BY slot) AS entry_px, last(nxt ORDER BY slot) AS exit_px, any_value(state) * (last(nxt ORDER BY slot) - first(nxt ORDER BY slot)) AS pnl_pts
 FROM (SELECT *, sum(CASE WHEN state <> was THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session ORDER BY slot) AS run FROM vt1) WHERE state <> 0 GROUP BY symbol, session, run)"""), VT))
def outcome_state_episodes(spark, sf):
    return det.state_episodes(vwap_trend(spark, sf), 23)


# ---- forecasts -----------------------------------------------------------------

@register("detect_gap_forecast", with_ctes(M, pick("symbol session side:i pred:d", "(SELECT *, CASE WHEN abs(pred) > 0.01 / day_open + 0.25 * unc THEN sign(pred) ELSE 0 END AS side FROM rdg1 WHERE pred IS NOT NULL)"), qw.RIDGE1))
def detect_gap_forecast(spark, sf):
    d = qw.gap_forecast(spark, sf).filter("pred IS NOT NULL")
    go = F.abs("pred") > 0.01 / c("day_open") + 0.25 * c("unc")
    return d.select(*K, F.when(go, sgn(c("pred"))).otherwise(0).alias("side"), "pred")


E2L = {"el0": "SELECT symbol, session, max(close) FILTER (slot = 3) / nullif(max(prev_close), 0) - 1 AS x, max(open) FILTER (slot = 25) / nullif(max(open) FILTER (slot = 20), 0) - 1 AS y FROM feat GROUP BY 1, 2",
       "el1": f"SELECT *, CASE WHEN count(abs(x)) OVER w >= 12 THEN quantile_cont(abs(x), 0.3) OVER w END AS q FROM el0 WINDOW w AS ({DAY} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"}


@register("detect_early_to_late", with_ctes(M, pick("symbol session x:d q:d side:i", "(SELECT *, CASE WHEN abs(x) >= q THEN sign(x) ELSE 0 END AS side FROM el1 WHERE x IS NOT NULL AND q IS NOT NULL)"), E2L))
def detect_early_to_late(spark, sf):
    f = views.feat(spark, sf, M)
    d = f.groupBy(*KEYS).agg((F.try_divide(F.max(F.when(c("slot") == 3, c("close"))), F.max("prev_close")) - 1).alias("x"))
    d = d.withColumn("_a", F.abs("x"))
    d = d.withColumn("q", at_least(quantile(c("_a"), 0.3), c("_a"), prior(by_day(), 30), 12))
    return d.filter("x IS NOT NULL AND q IS NOT NULL").select(*K, "x", "q", F.when(c("_a") >= c("q"), sgn(c("x"))).otherwise(0).alias("side"))


@register("detect_jump_gap_fade", with_ctes(H, pick("symbol session side:i target_ref:d", """(SELECT symbol, session, -sign(gap) AS side, round((day_open + 0.5 * (prev_close - day_open)) * 4) / 4 AS target_ref
 FROM jmp JOIN daily USING (symbol, session) WHERE jump_score > 0.2 AND gap_largest AND gap <> 0)"""), qw.JUMP))
def detect_jump_gap_fade(spark, sf):
    d = views.daily(spark, sf, H)
    j = feats.jump_score(views.grid(spark, sf, H), d, 3)
    x = d.join(j, K).filter("jump_score > 0.2 AND gap_largest AND gap <> 0")
    tgt = F.round((c("day_open") + 0.5 * (c("prev_close") - c("day_open"))) * 4) / 4
    return x.select(*K, (-sgn(c("gap"))).alias("side"), tgt.alias("target_ref"))


@register("detect_same_slot_return", with_ctes(H, pick(EV, "(SELECT r.symbol, r.session, r.slot, sign(recency) AS side FROM rec r JOIN daily USING (symbol, session) WHERE abs(recency) > 0.01 / day_open + 0.25 * recency_unc)"), qw.REC))
def detect_same_slot_return(spark, sf):
    f = feats.recency_mean(views.base(spark, sf, H), "ret", 5)
    return f.filter(F.abs("recency") > 0.01 / c("day_open") + 0.25 * c("recency_unc")).select(*K, "slot", sgn(c("recency")).alias("side"))


NEED = "(VALUES ('early', 0), ('early', 1), ('early', 2), ('late', 17), ('late', 18)) need(detector, slot)"


@register("detect_required_mask", with_ctes(H, pick("detector symbol session slot:i side:i is_unknown", f"""(SELECT 'early' AS detector, f.*, coalesce(k.fm <= f.slot, false) AS is_unknown FROM fb f LEFT JOIN
 (SELECT symbol, session, min(g.slot) AS fm FROM g JOIN {NEED} ON need.slot = g.slot AND detector = 'early' WHERE open IS NULL GROUP BY 1, 2) k USING (symbol, session)
 UNION ALL SELECT 'late', f.*, coalesce(k.fm <= f.slot, false) FROM fb f LEFT JOIN
 (SELECT symbol, session, min(g.slot) AS fm FROM g JOIN {NEED} ON need.slot = g.slot AND detector = 'late' WHERE open IS NULL GROUP BY 1, 2) k USING (symbol, session))"""), FB))
def detect_required_mask(spark, sf):
    f = det.first_event(det.detect(views.feat(spark, sf, H), "range_break", 22, length=3)).drop("entry_slot")
    ev = f.withColumn("detector", F.explode(F.array(F.lit("early"), F.lit("late"))))
    need = spark.createDataFrame([("early", 0), ("early", 1), ("early", 2), ("late", 17), ("late", 18)], "detector string, slot int")
    return det.required_mask(views.grid(spark, sf, H), need, ev)


@register("detect_controls", with_ctes(M, pick("symbol session control side:i", """(SELECT symbol, session, 'long' AS control, 1 AS side FROM daily WHERE atr > 0 AND gap IS NOT NULL
 UNION ALL SELECT symbol, session, 'gap_sign', sign(gap) FROM daily WHERE atr > 0 AND gap IS NOT NULL
 UNION ALL SELECT symbol, session, 'intercept', sign(my) FROM (SELECT *, CASE WHEN count(gap) OVER w >= 12 THEN avg(day_close / nullif(day_open, 0) - 1) OVER w END AS my FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE atr > 0 AND gap IS NOT NULL)""")))
def detect_controls(spark, sf):
    """Labelled baselines on the same sessions as the candidates."""
    w = prior(by_day(), 30)
    d = views.daily(spark, sf, M).withColumn("_y", F.try_divide("day_close", "day_open") - 1)
    d = d.withColumn("_my", F.when(F.count("gap").over(w) >= 12, F.avg("_y").over(w))).filter("atr > 0 AND gap IS NOT NULL")
    pairs = F.array(F.struct(F.lit("long").alias("control"), F.lit(1).alias("side")),
                    F.struct(F.lit("gap_sign").alias("control"), sgn(c("gap")).alias("side")),
                    F.struct(F.lit("intercept").alias("control"), sgn(c("_my")).alias("side")))
    return d.select(*K, F.inline(pairs))


# ---- sequence folds: same transition text, run by recursion in DuckDB ----------

def mirror_sql(k):
    w = f"PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING"
    t = f"PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"
    src = f"""SELECT *, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session ORDER BY slot) AS gone,
 CASE WHEN count(high) OVER w >= {k} THEN max(high) OVER w END AS xh, CASE WHEN count(low) OVER w >= {k} THEN min(low) OVER w END AS xl,
 CASE WHEN count(high) OVER t >= {k} THEN max(high) OVER t END AS yh, CASE WHEN count(low) OVER t >= {k} THEN min(low) OVER t END AS yl
 FROM feat WHERE atr > 0 AND is_normal AND or_high IS NOT NULL WINDOW w AS ({w}), t AS ({t})"""
    return {"mi0": src, "mir": """SELECT symbol, session, 1 AS side, slot, gone, open AS o, high AS h, low AS l, close AS c, p_close AS pc, or_high AS up, or_low AS dn, or_width AS wid,
 or_mid AS mid, vwap AS vw, atr, xh AS hk, yh AS bh, yl AS bl FROM mi0 UNION ALL SELECT symbol, session, -1, slot, gone, -open, -low, -high, -close, -p_close, -or_low, -or_high, or_width, -or_mid, -vwap, atr, -xl, -yl, -yh FROM mi0"""}


def fold_sql(seq, k, whole, lone, kind=H):
    types = {"int": "INTEGER", "double": "DOUBLE"}
    init = ", ".join(f"CAST({i} AS {types[t]}) AS {n}" for n, (t, i, _) in seq.state.items())
    nxt = ", ".join(f"CAST({x} AS {types[t]})" for t, _, x in seq.state.values())
    fire = f"(coalesce({seq.fire}, false)" + (" AND s.nf = 0)" if seq.once else ")")
    x = {**mirror_sql(k),
         "rws": f"SELECT *, row_number() OVER (PARTITION BY symbol, session, side ORDER BY slot) AS rn FROM mir WHERE slot >= 3 AND slot < {CUT[kind]}" + (" AND gone = 0" if whole else ""),
         "rec": f"""SELECT DISTINCT symbol, session, side, CAST(0 AS BIGINT) AS rn, CAST(-1 AS INTEGER) AS slot, {init}, false AS fired, CAST(NULL AS DOUBLE) AS stop, 0 AS nf FROM rws
 UNION ALL SELECT r.symbol, r.session, r.side, r.rn, r.slot, {nxt}, {fire}, CAST({seq.stop} AS DOUBLE), s.nf + CASE WHEN {fire} THEN 1 ELSE 0 END
 FROM rec s JOIN rws r ON r.symbol = s.symbol AND r.session = s.session AND r.side = s.side AND r.rn = s.rn + 1""",
         "frd": "SELECT symbol, session, slot, side, stop * side AS stop_ref FROM rec WHERE fired",
         "fl1": "SELECT f.* FROM frd f JOIN (SELECT symbol, session, slot FROM frd GROUP BY 1, 2, 3 HAVING count(*) = 1) USING (symbol, session, slot)"}
    return with_ctes(kind, pick(EV + " stop_ref:d", "fl1" if lone else "frd"), x, recursive=True)


def sequence(name, seq, k=2, whole=True, kind=H):
    lone = not whole

    def plan(spark, sf):
        ev = folds.run_sequence(folds.mirror(views.feat(spark, sf, kind), 3, k), seq, whole, CUT[kind])
        return folds.lone_side(ev) if lone else ev
    register(name, fold_sql(seq, k, whole, lone, kind))(plan)


sequence("detect_repeated_pressure", folds.repeated_pressure(1, 0.35, 0.4))
sequence("detect_second_attempt", folds.second_attempt(0.1, 1, 12))
sequence("detect_external_flag", folds.external_flag(0.02, 1, 9.0, 20), k=1, kind=M)
sequence("detect_vwap_reclaim_break", folds.vwap_reclaim_break(1, 12))
sequence("detect_two_scale_change", folds.two_scale_change(0.02, 6.0, 15))
sequence("detect_retest", folds.retest(8, 3.0, 0.5, "boundary"))
sequence("detect_edge_rejection", folds.edge_rejection(0.35, 10), whole=False, k=1)
sequence("detect_failed_break_hold", folds.failed_break_hold(1, 10), whole=False)
sequence("detect_midpoint_reclaim", folds.reference_reclaim("mid", 1, 10), whole=False)
sequence("detect_vwap_reclaim_inside", folds.reference_reclaim("vw", 1, 10), whole=False)
sequence("detect_wick_excursion", folds.wick_excursion(1, False, 5), whole=False)
sequence("detect_wick_confirmed", folds.wick_excursion(1, True, 8), whole=False)
sequence("detect_double_test", folds.double_test(0.4, 0.1, 0.3, 15), whole=False)
