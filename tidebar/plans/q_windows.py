"""Queries for causal window features."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions.core import by_clock, by_day, prior
from tidebar.operators import features as feats
from tidebar.operators import ingest
from tidebar.plans import views
from tidebar.plans.oracle import pick, with_ctes
from tidebar.plans.q_ingest import K, ON
from tidebar.plans.registry import register

H, M = "hourly", "monthly"
KS = [*K, "slot"]
CLK = "PARTITION BY symbol, slot ORDER BY session"
SES = "PARTITION BY symbol, session ORDER BY slot"
DAY = "PARTITION BY symbol ORDER BY session"


def win(kind, cols, sql, extra=None):
    """Oracle: the report columns of a windowed select over the shared frames."""
    return with_ctes(kind, pick(cols, f"({sql})"), extra)


@register("win_prev_session", win(H, "symbol session prev_open:d prev_high:d prev_low:d prev_close:d prev_ret:d gap:d day_ret:d", "SELECT * FROM daily"))
def win_prev_session(spark, sf):
    return feats.prev_session(feats.daily_bars(views.grid(spark, sf, H))).select(
        *K, "prev_open", "prev_high", "prev_low", "prev_close", "prev_ret", "gap", "day_ret")


@register("win_true_range_atr", win(M, "symbol session tr:d atr:d", "SELECT * FROM daily"))
def win_true_range_atr(spark, sf):
    return views.daily(spark, sf, M).select(*K, "tr", "atr")


@register("win_bar_atr", win(H, "symbol session slot:i bar_tr:d bar_atr:d", """SELECT *, CASE WHEN count(bar_tr) OVER w >= 4 THEN avg(bar_tr) OVER w END AS bar_atr
 FROM (SELECT *, greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS bar_tr FROM g WINDOW o AS (PARTITION BY symbol, session ORDER BY slot))
 WINDOW w AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""))
def win_bar_atr(spark, sf):
    return feats.bar_atr(views.grid(spark, sf, H), 4).select(*KS, "bar_tr", "bar_atr")


@register("win_lagged_vol", win(M, "symbol session vol0:d vol1:d", f"""SELECT symbol, session, CASE WHEN count(day_ret) OVER w >= 8 THEN stddev_pop(day_ret) OVER w END AS vol0,
 CASE WHEN count(day_ret) OVER w >= 8 THEN stddev_samp(day_ret) OVER w END AS vol1 FROM daily WINDOW w AS ({DAY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""))
def win_lagged_vol(spark, sf):
    d = views.daily(spark, sf, M)
    a = feats.lagged_vol(d, 10, 8, 0).withColumnRenamed("vol", "vol0")
    return feats.lagged_vol(a, 10, 8, 1).withColumnRenamed("vol", "vol1").select(*K, "vol0", "vol1")


@register("win_rolling_quantile", win(M, "symbol session vol_q33:d vol_q67:d", f"""SELECT symbol, session,
 CASE WHEN count(vol) OVER w >= 12 THEN quantile_cont(vol, 0.33) OVER w END AS vol_q33,
 CASE WHEN count(vol) OVER w >= 12 THEN quantile_cont(vol, 0.67) OVER w END AS vol_q67
 FROM daily WINDOW w AS ({DAY} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)"""))
def win_rolling_quantile(spark, sf):
    d = views.daily(spark, sf, M)
    d = feats.rolling_quantile(d, "vol", 40, 0.33, 12, "vol_q33")
    return feats.rolling_quantile(d, "vol", 40, 0.67, 12, "vol_q67").select(*K, "vol_q33", "vol_q67")


EMA_X = {"obs": "SELECT symbol, session, slot, close, row_number() OVER (PARTITION BY symbol, session ORDER BY slot) - 1 AS j FROM g WHERE close IS NOT NULL",
         "ema": """SELECT a.symbol, a.session, a.slot,
 sum(b.close * CASE WHEN b.j = 0 THEN 1 ELSE 1.0 / 3 END * pow(2.0 / 3, a.j - b.j)) AS ema5,
 sum(b.close * CASE WHEN b.j = 0 THEN 1 ELSE 2.0 / 9 END * pow(7.0 / 9, a.j - b.j)) AS ema8
 FROM obs a JOIN obs b ON a.symbol = b.symbol AND a.session = b.session AND b.j <= a.j GROUP BY 1, 2, 3"""}


@register("win_ema_intraday", win(H, "symbol session slot:i ema5:d ema8:d", "SELECT * FROM ema", EMA_X))
def win_ema_intraday(spark, sf):
    g = views.grid(spark, sf, H)
    return feats.ema(feats.ema(g, "close", 5, "ema5"), "close", 8, "ema8").filter("close IS NOT NULL").select(*KS, "ema5", "ema8")


@register("win_ema_daily", with_ctes(M, pick("symbol session ema6:d", """(SELECT d.symbol, d.session, e.ema6 FROM daily d LEFT JOIN (
 SELECT a.symbol, a.session, count(*) AS n, sum(b.day_close * CASE WHEN b.j = 1 THEN 1 ELSE 2.0 / 7 END * pow(5.0 / 7, a.j - 1 - b.j)) AS ema6
 FROM num a JOIN num b ON a.symbol = b.symbol AND b.j < a.j GROUP BY 1, 2 HAVING count(*) >= 4) e USING (symbol, session))"""),
 {"num": "SELECT symbol, session, day_close, row_number() OVER (PARTITION BY symbol ORDER BY session) AS j FROM daily"}))
def win_ema_daily(spark, sf):
    return feats.daily_ema(views.daily(spark, sf, M), 6, 4, "ema6").select(*K, "ema6")


@register("win_session_vwap", win(H, "symbol session slot:i vwap:d vwap_slope:d dist:d", "SELECT *, (close - vwap) / atr AS dist FROM feat"))
def win_session_vwap(spark, sf):
    return views.base(spark, sf, H).select(
        *KS, "vwap", "vwap_slope", F.try_divide(F.col("close") - F.col("vwap"), "atr").alias("dist"))


@register("win_same_clock", win(H, "symbol session slot:i clock_mean:d clock_std:d clock_q:d", f"""SELECT symbol, session, slot,
 CASE WHEN count(volume) OVER w >= 5 THEN avg(volume) OVER w END AS clock_mean,
 CASE WHEN count(volume) OVER w >= 5 THEN stddev_samp(volume) OVER w END AS clock_std,
 CASE WHEN count(volume) OVER w >= 5 THEN quantile_cont(volume, 0.75) OVER w END AS clock_q
 FROM g WINDOW w AS ({CLK} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""))
def win_same_clock(spark, sf):
    return feats.same_clock(views.grid(spark, sf, H), "volume", 5, 0.75).select(*KS, "clock_mean", "clock_std", "clock_q")


@register("win_same_clock_z", win(H, "symbol session slot:i volume_z:d cum_z:d", f"""SELECT symbol, session, slot, volume_z,
 CASE WHEN count(cum_volume) OVER w >= 3 THEN (cum_volume - avg(cum_volume) OVER w) / nullif(stddev_pop(cum_volume) OVER w, 0) END AS cum_z
 FROM feat WINDOW w AS ({CLK} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""))
def win_same_clock_z(spark, sf):
    f = views.feat(spark, sf, H)
    return feats.same_clock_z(f, "cum_volume", 5, 3, "cum_z").select(*KS, "volume_z", "cum_z")


@register("win_standardized_returns", win(H, "symbol session slot:i ret:d ret_z:d", "SELECT * FROM feat"))
def win_standardized_returns(spark, sf):
    return views.feat(spark, sf, H).select(*KS, "ret", "ret_z")


BAND = "CASE WHEN day_open IS NOT NULL AND prev_close IS NOT NULL THEN"


@register("win_noise_band", win(H, "symbol session slot:i band_up:d band_down:d", f"""SELECT symbol, session, slot,
 {BAND} greatest(day_open, prev_close) * (1 + 0.9 * noise) END AS band_up,
 {BAND} least(day_open, prev_close) * (1 - 0.9 * noise) END AS band_down FROM feat"""))
def win_noise_band(spark, sf):
    return feats.noise_band(views.feat(spark, sf, H), 0.9).select(*KS, "band_up", "band_down")


ORV = {"ov": """SELECT symbol, session, sum(volume) AS or_volume FROM bars WHERE slot < 3 GROUP BY 1, 2
 HAVING count(open) >= 2 AND max(high) > min(low)"""}


@register("win_opening_volume_z", win(M, "symbol session or_volume:d or_volume_z:d", f"""SELECT *, CASE WHEN count(or_volume) OVER w >= 5 THEN
 (or_volume - avg(or_volume) OVER w) / nullif(stddev_pop(or_volume) OVER w, 0) END AS or_volume_z
 FROM ov WINDOW w AS ({DAY} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""", ORV))
def win_opening_volume_z(spark, sf):
    return feats.opening_volume_z(views.bars(spark, sf, M), 3, 20, 5)


@register("win_opening_rvol", win(M, "symbol session or_volume:d rvol:d", f"""SELECT *, or_volume / (CASE WHEN count(or_volume) OVER w >= 10 THEN avg(or_volume) OVER w END) AS rvol
 FROM ov WINDOW w AS ({DAY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""", ORV))
def win_opening_rvol(spark, sf):
    return feats.opening_rvol(views.bars(spark, sf, M), 3, 10)


QUOTA = {**ORV, "quo": f"""SELECT symbol, session, CASE WHEN count(or_volume) OVER w >= 10 THEN quantile_cont(or_volume, 0.5) OVER w END * 1.25 AS quota
 FROM ov WINDOW w AS ({DAY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
         "cumv": "SELECT symbol, session, slot, sum(volume) OVER (PARTITION BY symbol, session ORDER BY slot) AS cv FROM bars WHERE slot < 12"}


@register("win_volume_quota", win(M, "symbol session quota:d quota_slot:i", """SELECT symbol, session, any_value(quota) AS quota,
 min(slot) FILTER (slot >= 2 AND cv >= quota) AS quota_slot FROM quo JOIN cumv USING (symbol, session) WHERE quota IS NOT NULL GROUP BY 1, 2""", QUOTA))
def win_volume_quota(spark, sf):
    b = views.bars(spark, sf, M)
    return feats.volume_quota_slot(b, feats.volume_quota(b, 3, 10, 1.25), 2, 12)


@register("win_prior_extreme", win(H, "symbol session slot:i hi3:d lo3:d hi5:d lo5:d p_hi3:d p_lo5:d", "SELECT * FROM feat"))
def win_prior_extreme(spark, sf):
    return views.base(spark, sf, H).select(*KS, "hi3", "lo3", "hi5", "lo5", "p_hi3", "p_lo5")


@register("win_running_extreme", win(H, "symbol session slot:i from_low_atr:d to_high_atr:d range_pos:d", """SELECT symbol, session, slot,
 (close - run_low) / nullif(atr, 0) AS from_low_atr, (run_high - close) / nullif(atr, 0) AS to_high_atr,
 CASE WHEN run_high > run_low THEN (close - run_low) / (run_high - run_low) WHEN close IS NOT NULL THEN 0.5 END AS range_pos FROM feat"""))
def win_running_extreme(spark, sf):
    return feats.running_extremes(views.base(spark, sf, H)).select(*KS, "from_low_atr", "to_high_atr", "range_pos")


@register("win_momentum", win(H, "symbol session slot:i mom2:d mom4:d", f"""SELECT symbol, session, slot,
 CASE WHEN close > 0 AND lag(close, 2) OVER w > 0 THEN ln(close / lag(close, 2) OVER w) END AS mom2,
 CASE WHEN close > 0 AND lag(close, 4) OVER w > 0 THEN ln(close / lag(close, 4) OVER w) END AS mom4 FROM g WINDOW w AS ({SES})"""))
def win_momentum(spark, sf):
    return feats.momentum(feats.momentum(views.grid(spark, sf, H), 2), 4).select(*KS, "mom2", "mom4")


@register("win_realized_vol", win(H, "symbol session slot:i rv4:d range4_atr:d eff4:d", f"""SELECT symbol, session, slot,
 CASE WHEN count(ret) OVER w >= 4 THEN sqrt(sum(ret * ret) OVER w) END AS rv4,
 CASE WHEN slot >= 4 THEN (max(high) OVER w - min(low) OVER w) / nullif(atr, 0) END AS range4_atr,
 CASE WHEN sum(abs(ret)) OVER w > 0 AND close > 0 AND lag(close, 4) OVER o > 0 THEN abs(ln(close / lag(close, 4) OVER o)) / sum(abs(ret)) OVER w END AS eff4
 FROM feat WINDOW o AS ({SES}), w AS ({SES} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""))
def win_realized_vol(spark, sf):
    f = views.base(spark, sf, H)
    return feats.efficiency(feats.range_atr(feats.realized_vol(f, 4), 4), 4).select(*KS, "rv4", "range4_atr", "eff4")


@register("win_or_position", win(H, "symbol session slot:i or_pos:d", """SELECT symbol, session, slot,
 CASE WHEN slot >= 2 THEN (close - or_mid) / or_width END AS or_pos FROM feat"""))
def win_or_position(spark, sf):
    return feats.or_position(views.base(spark, sf, H), 3).select(*KS, "or_pos")


@register("win_overnight_context", win(H, "symbol session on_range_atr:d open_vs_on_vwap_atr:d", """SELECT symbol, session, (on_high - on_low) / nullif(atr, 0) AS on_range_atr,
 (day_open - on_vwap) / nullif(atr, 0) AS open_vs_on_vwap_atr FROM daily JOIN on_sum USING (symbol, session)""", {"on_sum": ON}))
def win_overnight_context(spark, sf):
    on = ingest.overnight_summary(views.bars(spark, sf, H), 18, 0, 24)
    return feats.overnight_context(views.daily(spark, sf, H), on).select(*K, "on_range_atr", "open_vs_on_vwap_atr")


@register("win_forward_labels", win(H, "symbol session slot:i y2:d mfe2:d mae2:d", f"""SELECT symbol, session, slot,
 CASE WHEN close > 0 AND lead(close, 2) OVER o > 0 THEN ln(lead(close, 2) OVER o / close) END AS y2,
 CASE WHEN lead(close, 2) OVER o IS NOT NULL THEN (max(high) OVER w - close) / nullif(atr, 0) END AS mfe2,
 CASE WHEN lead(close, 2) OVER o IS NOT NULL THEN (min(low) OVER w - close) / nullif(atr, 0) END AS mae2
 FROM feat WINDOW o AS ({SES}), w AS ({SES} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)"""))
def win_forward_labels(spark, sf):
    return feats.forward_labels(views.base(spark, sf, H), 2).select(*KS, "y2", "mfe2", "mae2")


SNAP = {"snap0": f"""SELECT *, year(session) AS year, (prev_high - prev_low) / nullif(atr, 0) AS prev_range_atr,
 (day_open - prev_close) / nullif(atr, 0) AS gap_atr, CASE WHEN close > 0 AND day_open > 0 THEN ln(close / day_open) END AS session_ret,
 CASE WHEN close > 0 AND lag(close, 2) OVER o > 0 THEN ln(close / lag(close, 2) OVER o) END AS mom2,
 CASE WHEN close > 0 AND lag(close, 4) OVER o > 0 THEN ln(close / lag(close, 4) OVER o) END AS mom4,
 CASE WHEN count(ret) OVER w >= 4 THEN sqrt(sum(ret * ret) OVER w) END AS rv4,
 (close - vwap) / nullif(atr, 0) AS vwap_dist_atr, vwap_slope / nullif(atr, 0) AS vwap_slope_atr, or_width / nullif(atr, 0) AS or_width_atr,
 CASE WHEN slot >= 2 THEN (close - or_mid) / or_width END AS or_pos,
 (close - run_low) / nullif(atr, 0) AS from_low_atr, (run_high - close) / nullif(atr, 0) AS to_high_atr,
 CASE WHEN slot >= 4 THEN (max(high) OVER w - min(low) OVER w) / nullif(atr, 0) END AS range4_atr,
 CASE WHEN sum(abs(ret)) OVER w > 0 AND close > 0 AND lag(close, 4) OVER o > 0 THEN abs(ln(close / lag(close, 4) OVER o)) / sum(abs(ret)) OVER w END AS eff4,
 (slot - 5) / 15.0 AS time_frac,
 CASE WHEN close > 0 AND lead(close, 2) OVER o > 0 THEN ln(lead(close, 2) OVER o / close) END AS y2,
 CASE WHEN lead(close, 2) OVER o IS NOT NULL THEN (max(high) OVER f2 - close) / nullif(atr, 0) END AS mfe2,
 CASE WHEN lead(close, 2) OVER o IS NOT NULL THEN (min(low) OVER f2 - close) / nullif(atr, 0) END AS mae2,
 CASE WHEN close > 0 AND lead(close, 4) OVER o > 0 THEN ln(lead(close, 4) OVER o / close) END AS y4,
 CASE WHEN lead(close, 4) OVER o IS NOT NULL THEN (max(high) OVER f4 - close) / nullif(atr, 0) END AS mfe4,
 CASE WHEN lead(close, 4) OVER o IS NOT NULL THEN (min(low) OVER f4 - close) / nullif(atr, 0) END AS mae4
 FROM feat WINDOW o AS ({SES}), w AS ({SES} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
 f2 AS ({SES} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), f4 AS ({SES} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""",
        "snap": "SELECT * FROM snap0 WHERE slot BETWEEN 5 AND 20 AND (slot - 5) % 3 = 0 AND atr > 0 AND prev_close IS NOT NULL AND close IS NOT NULL"}
SNAP_COLS = "symbol session slot:i year:i " + " ".join(f"{c}:d" for c in (*feats.FEATURES, "y2", "mfe2", "mae2", "y4", "mfe4", "mae4"))


def snapshots(spark, sf, kind=M):
    return feats.snapshots(views.feat(spark, sf, kind), 5, 3, 20, 3)


@register("win_snapshots", with_ctes(M, pick(SNAP_COLS, "snap"), SNAP))
def win_snapshots(spark, sf):
    return snapshots(spark, sf)


@register("win_jump_share", win(H, "symbol session slot:i jump_share:d", f"""SELECT symbol, session, slot,
 CASE WHEN rv > 0 AND bv IS NOT NULL THEN greatest(rv - bv, 0) / rv END AS jump_share FROM (SELECT *,
 CASE WHEN count(ret) OVER w >= 5 THEN sum(ret * ret) OVER w END AS rv,
 CASE WHEN count(pair) OVER v >= 4 THEN sum(pair) OVER v END * pi() / 2 * 5 / 4 AS bv
 FROM (SELECT *, abs(ret * lag(ret) OVER (PARTITION BY symbol, session ORDER BY slot)) AS pair FROM feat)
 WINDOW w AS ({SES} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), v AS ({SES} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""))
def win_jump_share(spark, sf):
    return feats.jump_share(views.base(spark, sf, H), 5).select(*KS, "jump_share")


@register("win_adverse_semivariance", win(H, "symbol session slot:i down_var:d up_var:d down_q:d up_q:d", f"""SELECT *,
 CASE WHEN count(down_var) OVER k >= 4 THEN quantile_cont(down_var, 0.8) OVER k END AS down_q,
 CASE WHEN count(up_var) OVER k >= 4 THEN quantile_cont(up_var, 0.8) OVER k END AS up_q FROM (SELECT symbol, session, slot,
 CASE WHEN count(ret) OVER w >= 3 THEN sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) OVER w END AS down_var,
 CASE WHEN count(ret) OVER w >= 3 THEN sum(CASE WHEN ret > 0 THEN ret * ret ELSE 0 END) OVER w END AS up_var
 FROM feat WINDOW w AS ({SES} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
 WINDOW k AS ({CLK} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""))
def win_adverse_semivariance(spark, sf):
    f = views.base(spark, sf, H)
    return feats.adverse_semivariance(f, 3, 10, 4, 0.8).select(*KS, "down_var", "up_var", "down_q", "up_q")


def cusum_sql(kind="hourly"):
    """Reflected sums by recursion over the slots, the definition itself."""
    return {"cus": """SELECT symbol, session, slot, ret_z AS z, CASE WHEN ret_z IS NULL THEN 0.0 ELSE greatest(0.0, ret_z - 0.25) END AS u,
 CASE WHEN ret_z IS NULL THEN 0.0 ELSE greatest(0.0, -ret_z - 0.25) END AS d FROM feat WHERE slot = 0
 UNION ALL SELECT f.symbol, f.session, f.slot, f.ret_z, CASE WHEN f.ret_z IS NULL THEN 0.0 ELSE greatest(0.0, c.u + f.ret_z - 0.25) END,
 CASE WHEN f.ret_z IS NULL THEN 0.0 ELSE greatest(0.0, c.d - f.ret_z - 0.25) END
 FROM cus c JOIN feat f ON f.symbol = c.symbol AND f.session = c.session AND f.slot = c.slot + 1"""}


@register("win_cusum", with_ctes(H, pick("symbol session slot:i cusum_up:d cusum_down:d",
          "(SELECT symbol, session, slot, CASE WHEN z IS NOT NULL THEN u END AS cusum_up, CASE WHEN z IS NOT NULL THEN d END AS cusum_down FROM cus)"),
          cusum_sql(), recursive=True))
def win_cusum(spark, sf):
    return feats.cusum(views.feat(spark, sf, H), "ret_z", 0.25).select(*KS, "cusum_up", "cusum_down")


VR = {"vr0": f"SELECT symbol, session, slot, CASE WHEN count(ret) OVER w >= 8 THEN list(ret) OVER w END AS x0 FROM feat WINDOW w AS ({SES} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)",
      "vr1": "SELECT symbol, session, slot, list_transform(x0, lambda v: v - list_avg(x0)) AS x FROM vr0",
      "vr2": """SELECT *, list_sum(list_transform(x, lambda v: v * v)) AS ss, list_transform(range(2, 9), lambda i: x[i] * x[i - 1]) AS a1,
 list_transform(range(3, 9), lambda i: x[i] * x[i - 2]) AS a2 FROM vr1""",
      "vrs": """SELECT symbol, session, slot, CASE WHEN ss > 0 AND den > 0 THEN num / sqrt(den) END AS vr_score FROM (SELECT *,
 2 * (1 - 1 / 3.0) * list_sum(a1) + 2 * (1 - 2 / 3.0) * list_sum(a2) AS num,
 pow(2 * (1 - 1 / 3.0), 2) * list_sum(list_transform(a1, lambda v: v * v)) + pow(2 * (1 - 2 / 3.0), 2) * list_sum(list_transform(a2, lambda v: v * v)) AS den FROM vr2)"""}


@register("win_variance_ratio", with_ctes(H, pick("symbol session slot:i vr_score:d", "vrs"), VR))
def win_variance_ratio(spark, sf):
    return feats.variance_ratio(views.base(spark, sf, H), 8, 3).select(*KS, "vr_score")


@register("win_local_linear", win(H, "symbol session slot:i smooth:d", f"""SELECT symbol, session, slot,
 CASE WHEN n = 4 THEN ym + (sxy / sxx) * (3 - xm) END AS smooth FROM (SELECT symbol, session, slot, count(*) AS n,
 sum(wt * y) / sum(wt) AS ym, sum(wt * x) / sum(wt) AS xm,
 sum(wt * x * y) - sum(wt * x) * sum(wt * y) / sum(wt) AS sxy, sum(wt * x * x) - sum(wt * x) * sum(wt * x) / sum(wt) AS sxx
 FROM (SELECT a.symbol, a.session, a.slot, b.close AS y, b.slot - a.slot + 3 AS x, b.slot - a.slot + 4 AS wt
 FROM g a LEFT JOIN g b ON a.symbol = b.symbol AND a.session = b.session AND b.slot BETWEEN a.slot - 3 AND a.slot AND b.close IS NOT NULL) GROUP BY 1, 2, 3)"""))
def win_local_linear(spark, sf):
    return feats.local_linear(views.grid(spark, sf, H), 4).select(*KS, "smooth")


RIDGE = f"""SELECT *, sqrt(vx) AS s FROM (SELECT symbol, session, gap, day_open, day_ret, CASE WHEN gap IS NOT NULL AND y IS NOT NULL THEN gap END AS xx, CASE WHEN gap IS NOT NULL AND y IS NOT NULL THEN y END AS yy,
 count(xx) OVER w AS n, avg(xx) OVER w AS mx, avg(yy) OVER w AS my, var_pop(xx) OVER w AS vx, var_pop(yy) OVER w AS vy,
 avg(xx * yy) OVER w - avg(xx) OVER w * avg(yy) OVER w AS c FROM (SELECT *, day_close / nullif(day_open, 0) - 1 AS y FROM daily)
 WINDOW w AS ({DAY} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""
RIDGE1 = {"rdg": RIDGE, "rdg1": """SELECT symbol, session, gap, day_open, CASE WHEN n >= 12 AND gap IS NOT NULL THEN my + c / s / 1.1 * (gap - mx) / s END AS pred,
 CASE WHEN n >= 12 AND gap IS NOT NULL THEN sqrt(greatest(0, (vy - 2 * (c / s / 1.1) * (c / s) + pow(c / s / 1.1, 2)) * (1 + pow((gap - mx) / s, 2) / 1.1) / n)) END AS unc FROM rdg"""}


def gap_forecast(spark, sf):
    """Ridge forecast of the open-to-close return from the gap."""
    d = views.daily(spark, sf, M).withColumn("y", F.try_divide("day_close", "day_open") - 1)
    return feats.prior_ridge_1(d, "gap", "y", prior(by_day(), 30), 12, 0.1)


@register("win_prior_ridge_1", with_ctes(M, pick("symbol session pred:d unc:d", "rdg1"), RIDGE1))
def win_prior_ridge_1(spark, sf):
    return gap_forecast(spark, sf).select(*K, "pred", "unc")


REC = {"rec0": f"SELECT symbol, session, slot, CASE WHEN count(ret) OVER w >= 5 THEN list(ret) OVER w END AS h FROM feat WINDOW w AS ({CLK} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)",
       "rec1": "SELECT *, list_transform(range(0, 5), lambda i: exp(-2 + 2.0 * i / 4)) AS wt FROM rec0",
       "rec2": "SELECT *, list_sum(list_transform(range(1, 6), lambda i: h[i] * wt[i])) / list_sum(wt) AS m FROM rec1",
       "rec": "SELECT symbol, session, slot, m * 0.5 AS recency, sqrt(list_sum(list_transform(range(1, 6), lambda i: wt[i] * (h[i] - m) * (h[i] - m))) / list_sum(wt) / 5) AS recency_unc FROM rec2"}


@register("win_recency_mean", with_ctes(H, pick("symbol session slot:i recency:d recency_unc:d", "rec"), REC))
def win_recency_mean(spark, sf):
    return feats.recency_mean(views.base(spark, sf, H), "ret", 5).select(*KS, "recency", "recency_unc")


# ---- opening measures ----------------------------------------------------------

@register("agg_path_efficiency", win(H, "symbol session move:d path_eff:d", """SELECT symbol, session, arg_max(close, slot) - arg_min(open, slot) AS move,
 abs(arg_max(close, slot) - arg_min(open, slot)) / nullif(sum(st), 0) AS path_eff FROM (SELECT *, abs(close - coalesce(lag(close) OVER (PARTITION BY symbol, session ORDER BY slot), open)) AS st
 FROM g WHERE slot < 4) GROUP BY 1, 2 HAVING count(close) = 4"""))
def agg_path_efficiency(spark, sf):
    return feats.path_efficiency(views.grid(spark, sf, H), 4)


IMPACT = {"imp0": """SELECT symbol, session, avg(abs(ret) / nullif(volume * close, 0)) AS impact FROM (SELECT symbol, session, slot, volume, close,
 CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS ret FROM g WINDOW w AS (PARTITION BY symbol, session ORDER BY slot))
 WHERE slot BETWEEN 1 AND 3 GROUP BY 1, 2""",
          "imp": f"""SELECT symbol, session, li AS log_impact, CASE WHEN count(li) OVER w >= 3 THEN (li - avg(li) OVER w) / nullif(stddev_samp(li) OVER w, 0) END AS impact_z
 FROM (SELECT *, CASE WHEN impact > 0 THEN ln(impact) END AS li FROM imp0) WINDOW w AS ({DAY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""}


@register("agg_price_impact", with_ctes(H, pick("symbol session log_impact:d impact_z:d", "imp"), IMPACT))
def agg_price_impact(spark, sf):
    return feats.price_impact(views.grid(spark, sf, H), 4, 5, 3).select(*K, "log_impact", "impact_z")


SPREAD = {"spr0": """SELECT symbol, session, max(high) FILTER (slot < 3) AS h1, min(low) FILTER (slot < 3) AS l1,
 max(high) FILTER (slot BETWEEN 3 AND 5) AS h2, min(low) FILTER (slot BETWEEN 3 AND 5) AS l2 FROM g GROUP BY 1, 2""",
          "spr1": """SELECT *, CASE WHEN l1 > 0 AND l2 > 0 THEN pow(ln(h1 / l1), 2) + pow(ln(h2 / l2), 2) END AS beta,
 CASE WHEN least(l1, l2) > 0 THEN pow(ln(greatest(h1, h2) / least(l1, l2)), 2) END AS gamma FROM spr0""",
          "spr2": "SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS alpha FROM spr1",
          "spr3": "SELECT symbol, session, CASE WHEN alpha >= 0 AND h1 > l1 AND h2 > l2 THEN 2 * (exp(alpha) - 1) / (exp(alpha) + 1) END AS spread FROM spr2",
          "spr": f"SELECT *, CASE WHEN count(spread) OVER w >= 3 THEN quantile_cont(spread, 0.6) OVER w END AS spread_q FROM spr3 WINDOW w AS ({DAY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"}


@register("agg_hl_spread", with_ctes(H, pick("symbol session spread:d spread_q:d", "spr"), SPREAD))
def agg_hl_spread(spark, sf):
    return feats.hl_spread(views.grid(spark, sf, H), 3, 10, 3, 0.6)


NEST = {"nst0": "SELECT *, max(high) FILTER (slot < 2) OVER w AS sh, min(low) FILTER (slot < 2) OVER w AS sl FROM g WHERE slot < 5 WINDOW w AS (PARTITION BY symbol, session)",
        "nst1": "SELECT *, min(slot) FILTER (slot >= 2 AND close > sh) OVER w AS fu, min(slot) FILTER (slot >= 2 AND close < sl) OVER w AS fd FROM nst0 WINDOW w AS (PARTITION BY symbol, session)",
        "nest": """SELECT symbol, session, max(high) AS long_high, min(low) AS long_low,
 any_value(fu) IS NOT NULL AND coalesce(bool_and(close > sh) FILTER (slot >= fu), true) AND max(high) - any_value(sh) >= 0.25 AS accept_up,
 any_value(fd) IS NOT NULL AND coalesce(bool_and(close < sl) FILTER (slot >= fd), true) AND any_value(sl) - min(low) >= 0.25 AS accept_down
 FROM nst1 GROUP BY 1, 2 HAVING count(close) = 5"""}


@register("agg_nested_acceptance", with_ctes(H, pick("symbol session accept_up accept_down long_high:d long_low:d", "nest"), NEST))
def agg_nested_acceptance(spark, sf):
    return feats.nested_acceptance(views.grid(spark, sf, H), 2, 5, 0.25)


JUMP = {"jmp0": """SELECT *, CASE WHEN close > 0 AND coalesce(pc, fo) > 0 THEN ln(close / coalesce(pc, fo)) END AS r FROM (
 SELECT symbol, session, slot, close, lag(close) OVER (PARTITION BY symbol, session ORDER BY slot) AS pc, fo
 FROM g JOIN (SELECT symbol, session, day_open AS fo FROM daily) USING (symbol, session) WHERE (slot + 1) % 3 = 0)""",
        "jmp1": "SELECT *, lag(r) OVER w AS r1, lag(r, 2) OVER w AS r2 FROM jmp0 WINDOW w AS (PARTITION BY symbol, session ORDER BY slot)",
        "jmp2": """SELECT symbol, session, count(r) AS m, sum(r * r) AS rv, sum(abs(r * r1)) AS bp, sum(pow(abs(r * r1 * r2), 4.0 / 3)) AS tp, max(abs(r)) AS mx,
 last(r ORDER BY slot) AS l1, last(r1 ORDER BY slot) AS l2 FROM jmp1 GROUP BY 1, 2""",
        "jmp3": """SELECT symbol, session, lag(m) OVER w + 1 AS m, lag(rv) OVER w AS rv, lag(bp) OVER w AS bp, lag(tp) OVER w AS tp, lag(mx) OVER w AS mx,
 lag(l1) OVER w AS l1, lag(l2) OVER w AS l2, lag(m) OVER w AS m0 FROM jmp2 WINDOW w AS (PARTITION BY symbol ORDER BY session)""",
        "jmp4": """SELECT j.*, ln(1 + d.gap) AS gg FROM jmp3 j JOIN daily d USING (symbol, session) WHERE m0 >= 2 AND d.gap > -1""",
        "jmp5": """SELECT *, rv + gg * gg AS rvx, pi() / 2 * m / (m - 1) * (coalesce(bp, 0) + abs(gg * l1)) AS bv,
 m * m / (m - 2.0) * (coalesce(tp, 0) + pow(abs(gg * l1 * l2), 4.0 / 3)) / pow(pow(2, 2.0 / 3) * gamma(7.0 / 6) / sqrt(pi()), 3) AS tpx FROM jmp4""",
        "jmp": """SELECT symbol, session, (rvx - bv) / greatest(rvx, 1e-20) / greatest(sqrt((pow(pi() / 2, 2) + pi() - 5) / m * greatest(1, tpx / greatest(bv * bv, 1e-20))), 1e-20) AS jump_score,
 abs(gg) >= mx AS gap_largest FROM jmp5"""}


@register("agg_jump_score", with_ctes(H, pick("symbol session jump_score:d gap_largest", "jmp"), JUMP))
def agg_jump_score(spark, sf):
    return feats.jump_score(views.grid(spark, sf, H), views.daily(spark, sf, H), 3)
