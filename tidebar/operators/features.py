"""Causal features on grid-completed bars (W operators and session aggregates).

Every intraday window is partitioned by (symbol, session) and every clock window by
(symbol, slot), so partitions are bounded by the session length and the calendar however
skewed the raw symbols are. Columns that a query does not use are pruned with their windows.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidebar.functions.core import (KEYS, ahead, at_least, before, by_clock, by_day, by_session,
                                    first_of, last_of, log_ratio, prior, quantile, ratio, sgn, total, trailing, upto,
                                    whole_session)


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


# ---- session grain -------------------------------------------------------------

def daily_bars(bars: DataFrame) -> DataFrame:
    """First open, extremes, last close and total volume of the observed bars."""
    return bars.groupBy(*KEYS).agg(
        first_of("open").alias("day_open"), F.max("high").alias("day_high"),
        F.min("low").alias("day_low"), last_of("close").alias("day_close"),
        F.sum("volume").alias("day_volume"), F.count("open").alias("day_bars"))


def prev_session(daily: DataFrame) -> DataFrame:
    """Lagged session values, previous return and opening gap."""
    w = by_day()
    df = daily.withColumns({
        "prev_open": F.lag("day_open").over(w), "prev_high": F.lag("day_high").over(w),
        "prev_low": F.lag("day_low").over(w), "prev_close": F.lag("day_close").over(w),
        "prev2_high": F.lag("day_high", 2).over(w), "prev2_low": F.lag("day_low", 2).over(w)})
    return df.withColumns({
        "prev_ret": ratio(F.col("prev_close"), F.col("prev_open")) - 1,
        "gap": ratio(F.col("day_open"), F.col("prev_close")) - 1,
        "day_ret": ratio(F.col("day_close"), F.col("prev_close")) - 1})


def true_range_atr(daily: DataFrame, n: int, minimum: int) -> DataFrame:
    """True range and its mean over the prior ``n`` sessions."""
    hi, lo, pc = F.col("day_high"), F.col("day_low"), F.col("prev_close")
    tr = F.greatest(hi - lo, F.abs(hi - pc), F.abs(lo - pc))
    df = daily.withColumn("tr", tr)
    return df.withColumn("atr", at_least(F.avg("tr"), F.col("tr"), prior(by_day(), n), minimum))


def lagged_vol(daily: DataFrame, n: int, minimum: int, ddof: int = 0) -> DataFrame:
    """Standard deviation of the prior ``n`` session returns."""
    std = F.stddev_pop("day_ret") if ddof == 0 else F.stddev_samp("day_ret")
    return daily.withColumn("vol", at_least(std, F.col("day_ret"), prior(by_day(), n), minimum))


def rolling_quantile(daily: DataFrame, col: str, n: int, q: float, minimum: int, out: str) -> DataFrame:
    """Quantile of the prior ``n`` values of ``col``."""
    x = F.col(col)
    return daily.withColumn(out, at_least(quantile(x, q), x, prior(by_day(), n), minimum))


def daily_features(bars: DataFrame, n: int, minimum: int) -> DataFrame:
    return lagged_vol(true_range_atr(prev_session(daily_bars(bars)), n, minimum), n, minimum)


def eligible(df: DataFrame) -> DataFrame:
    """Known positive ATR on a normal session."""
    return df.filter((F.col("atr") > 0) & F.col("is_normal"))


def daily_ema(daily: DataFrame, span: int, minimum: int, out: str) -> DataFrame:
    """Recursive mean of the closes before each day, once there are ``minimum`` of them."""
    df = ema(daily, "day_close", span, "_e", ("symbol",), "session")
    enough = F.count("day_close").over(before(by_day())) >= minimum
    return df.withColumn(out, F.when(enough, F.lag("_e").over(by_day()))).drop("_e")


def opening_ranges(bars: DataFrame, lengths: list[int]) -> DataFrame:
    """Opening range per session and length; dropped when bars lack or width is zero.

    All lengths come from one pass: each is a filtered aggregate of the same group."""
    aggs = []
    for n in lengths:
        early = F.col("slot") < n
        aggs.append(F.struct(
            F.lit(n).alias("length"),
            F.max(F.when(early, F.col("high"))).alias("or_high"),
            F.min(F.when(early, F.col("low"))).alias("or_low"),
            F.min_by("open", F.when(early, F.col("slot"))).alias("or_open"),
            F.max_by("close", F.when(early, F.col("slot"))).alias("or_close"),
            F.sum(F.when(early, F.col("volume"))).alias("or_volume"),
            F.count_if(early & F.col("open").isNotNull()).alias("or_bars")))
    x = (bars.groupBy(*KEYS).agg(F.array(*aggs).alias("_r"))
         .select(*KEYS, F.inline("_r")))
    x = x.filter((F.col("or_bars") >= F.greatest(F.lit(1), F.col("length") - 1))
                 & (F.col("or_high") > F.col("or_low")))
    return x.withColumn("or_width", F.col("or_high") - F.col("or_low")).withColumn(
        "or_dir", sgn(F.col("or_close") - F.col("or_open")))


def opening_ranges_wide(bars: DataFrame, lengths: list[int]) -> DataFrame:
    """The lengths side by side, one row per session."""
    return (opening_ranges(bars, lengths).groupBy(*KEYS).pivot("length", lengths)
            .agg(F.first("or_high").alias("hi"), F.first("or_low").alias("lo"),
                 F.first("or_volume").alias("vol"), F.first("or_dir").alias("dir")))


def session_extremes_complete(grid: DataFrame) -> DataFrame:
    """High, low and close of sessions in which every expected bar is present."""
    full = F.count("open") == F.first("close_slot")
    return grid.groupBy(*KEYS).agg(
        F.when(full, F.max("high")).alias("full_high"), F.when(full, F.min("low")).alias("full_low"),
        F.when(full, F.max_by("close", "slot")).alias("full_close"))


def opening_volume(bars: DataFrame, length: int) -> DataFrame:
    """Opening volume of the sessions that have a valid opening range."""
    return opening_ranges(bars, [length]).select(*KEYS, "or_volume")


def opening_volume_z(bars: DataFrame, length: int, n: int, minimum: int) -> DataFrame:
    """z against the previous observed opening volumes (sessions without one are skipped)."""
    x, f, v = opening_volume(bars, length), prior(by_day(), n), F.col("or_volume")
    z = ratio(v - F.avg(v).over(f), F.nullif(F.stddev_pop(v).over(f), F.lit(0.0)))
    return x.withColumn("or_volume_z", F.when(F.count(v).over(f) >= minimum, z))


def opening_rvol(bars: DataFrame, length: int, n: int) -> DataFrame:
    """Opening volume relative to the mean of the prior ``n``."""
    x, f = opening_volume(bars, length), prior(by_day(), n)
    return x.withColumn("rvol", ratio(F.col("or_volume"), at_least(
        F.avg("or_volume"), F.col("or_volume"), f, n)))


def volume_quota(bars: DataFrame, length: int, n: int, fraction: float) -> DataFrame:
    """Median opening volume of the last ``n`` valid sessions times ``fraction``."""
    x, f = opening_volume(bars, length), prior(by_day(), n)
    v = F.col("or_volume")
    return x.withColumn("quota", at_least(quantile(v, 0.5), v, f, n) * fraction)


def volume_quota_slot(bars: DataFrame, quota: DataFrame, earliest: int, latest: int) -> DataFrame:
    """First slot at which cumulative volume reaches the session's quota."""
    cum = bars.filter(F.col("slot") < latest).withColumn(
        "cum_volume", F.sum("volume").over(upto(by_session())))
    hit = F.when((F.col("slot") >= earliest) & (F.col("cum_volume") >= F.col("quota")), F.col("slot"))
    return (cum.join(quota.filter("quota IS NOT NULL"), list(KEYS))
            .groupBy(*KEYS).agg(F.first("quota").alias("quota"), F.min(hit).alias("quota_slot")))


def overnight_context(daily: DataFrame, overnight: DataFrame) -> DataFrame:
    """Overnight range and the open against the overnight VWAP, in ATR."""
    return daily.join(overnight, list(KEYS)).withColumns({
        "on_range_atr": ratio(F.col("on_high") - F.col("on_low"), F.col("atr")),
        "open_vs_on_vwap_atr": ratio(F.col("day_open") - F.col("on_vwap"), F.col("atr"))})


# ---- bar grain -----------------------------------------------------------------

def bar_atr(bars: DataFrame, n: int) -> DataFrame:
    """Mean true range of the last ``n`` bars of the session, the current one included."""
    w = by_session()
    pc = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    df = bars.withColumn("bar_tr", tr)
    return df.withColumn("bar_atr", at_least(F.avg("bar_tr"), F.col("bar_tr"), trailing(w, n), n))


def session_vwap(df: DataFrame) -> DataFrame:
    """Running typical price weighted by volume."""
    f = upto(by_session())
    return df.withColumn("vwap", ratio(F.sum(typical() * F.col("volume")).over(f),
                                       F.nullif(F.sum("volume").over(f), F.lit(0.0))))


def intraday(df: DataFrame, extremes=(3, 5), k: int = 2) -> DataFrame:
    """Lags, VWAP, running and prior extremes, returns; one shuffle, one sort."""
    w = by_session()
    df = session_vwap(df)
    df = df.withColumns({
        "p_high": F.lag("high").over(w), "p_low": F.lag("low").over(w),
        "p_close": F.lag("close").over(w), "p_vwap": F.lag("vwap").over(w),
        "vwap_slope": F.col("vwap") - F.lag("vwap", k).over(w),
        "ret": log_ratio(F.col("close"), F.lag("close").over(w)),
        "cum_volume": F.sum("volume").over(upto(w)),
        "run_high": F.max("high").over(upto(w)), "run_low": F.min("low").over(upto(w)),
        **{f"hi{n}": at_least(F.max("high"), F.col("high"), prior(w, n), n) for n in extremes},
        **{f"lo{n}": at_least(F.min("low"), F.col("low"), prior(w, n), n) for n in extremes}})
    return df.withColumns({
        **{f"p_hi{n}": F.lag(f"hi{n}").over(w) for n in extremes},
        **{f"p_lo{n}": F.lag(f"lo{n}").over(w) for n in extremes}})


def opening_range_columns(df: DataFrame, length: int) -> DataFrame:
    """Opening range as columns on every bar: same partitioning, no join."""
    s = whole_session()
    early = F.col("slot") < length
    seen = early & F.col("open").isNotNull()
    df = df.withColumns({
        "_n": F.count_if(seen).over(s),
        "_h": F.max(F.when(early, F.col("high"))).over(s),
        "_l": F.min(F.when(early, F.col("low"))).over(s),
        "or_open": F.min_by("open", F.when(seen, F.col("slot"))).over(s),
        "or_close": F.max_by("close", F.when(seen, F.col("slot"))).over(s),
        "or_volume": F.sum(F.when(early, F.col("volume"))).over(s)})
    ok = (F.col("_n") >= max(1, length - 1)) & (F.col("_h") > F.col("_l"))
    return df.withColumns({
        "or_high": F.when(ok, F.col("_h")), "or_low": F.when(ok, F.col("_l")),
        "or_width": F.when(ok, F.col("_h") - F.col("_l")),
        "or_mid": F.when(ok, (F.col("_h") + F.col("_l")) / 2)}).drop("_n", "_h", "_l")


def clock_stats(df: DataFrame, n: int, minimum: int) -> DataFrame:
    """Same-slot statistics of the prior sessions: volume z, noise band width, return z."""
    f = prior(by_clock(), n)
    move = F.abs(ratio(F.col("close"), F.col("day_open")) - 1)
    df = df.withColumn("_move", move)
    v, r = F.col("volume"), F.col("ret")
    return df.withColumns({
        "volume_z": F.when(F.count(v).over(f) >= minimum, ratio(
            v - F.avg(v).over(f), F.nullif(F.stddev_pop(v).over(f), F.lit(0.0)))),
        "noise": at_least(F.avg("_move"), F.col("_move"), f, minimum),
        "ret_z": F.when(F.count(r).over(f) >= minimum, ratio(
            r - F.avg(r).over(f), F.nullif(F.stddev_samp(r).over(f), F.lit(0.0))))}).drop("_move")


def same_clock(df: DataFrame, col: str, n: int, q: float) -> DataFrame:
    """Mean, deviation and quantile of the same slot in the prior ``n`` sessions, all present."""
    f, x = prior(by_clock(), n), F.col(col)
    return df.withColumns({
        "clock_mean": at_least(F.avg(x), x, f, n), "clock_std": at_least(F.stddev_samp(x), x, f, n),
        "clock_q": at_least(quantile(x, q), x, f, n)})


def same_clock_z(df: DataFrame, col: str, n: int, minimum: int, out: str) -> DataFrame:
    f, x = prior(by_clock(), n), F.col(col)
    return df.withColumn(out, F.when(F.count(x).over(f) >= minimum, ratio(
        x - F.avg(x).over(f), F.nullif(F.stddev_pop(x).over(f), F.lit(0.0)))))


def noise_band(df: DataFrame, multiple: float) -> DataFrame:
    """Band around the higher / lower of open and previous close."""
    top, bottom = F.greatest("day_open", "prev_close"), F.least("day_open", "prev_close")
    both = F.col("day_open").isNotNull() & F.col("prev_close").isNotNull()
    return df.withColumns({
        "band_up": F.when(both, top * (1 + multiple * F.col("noise"))),
        "band_down": F.when(both, bottom * (1 - multiple * F.col("noise")))})


def ema(df: DataFrame, col: str, span: int, out: str, keys: tuple = KEYS, order: str = "slot") -> DataFrame:
    """Recursive mean over the observed values of a group in order, as plain window sums.

    The mean is sum(x_j w_j d^(i-j)) with d = 1 - 2 / (span + 1). Powers are taken from the start of a
    block of observations that is short enough for doubles (d^-block is at most 1e100), so groups may be
    of any length: the block before enters with a factor of at most 1e-100 and those before it not at all."""
    a = 2.0 / (span + 1)
    if a >= 1:
        return df.withColumn(out, F.last(col, ignorenulls=True).over(upto(W.partitionBy(*keys).orderBy(order))))
    d, x = 1 - a, F.col(col)
    block = max(1, math.floor(230 / -math.log(d)))
    w = W.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_i", F.count(x).over(upto(w)) - 1)
    df = df.withColumns({"_b": F.floor(F.col("_i") / block), "_r": F.pmod(F.col("_i"), F.lit(block))})
    share = F.when(F.col("_i") == 0, 1.0).otherwise(a)
    df = df.withColumn("_y", F.when(x.isNotNull(), x * share * F.pow(F.lit(d), -F.col("_r"))))
    own = F.sum("_y").over(upto(W.partitionBy(*keys, "_b").orderBy(order)))
    before_ = F.sum("_y").over(W.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1))
    whole = F.when(own.isNotNull() | before_.isNotNull(), F.coalesce(own, F.lit(0.0)) + F.coalesce(before_, F.lit(0.0)) * d**block)
    return df.withColumn(out, whole * F.pow(F.lit(d), F.col("_r"))).drop("_i", "_b", "_r", "_y")


def momentum(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn(f"mom{k}", log_ratio(F.col("close"), F.lag("close", k).over(by_session())))


def realized_vol(df: DataFrame, k: int) -> DataFrame:
    f, r = trailing(by_session(), k), F.col("ret")
    return df.withColumn(f"rv{k}", F.when(F.count(r).over(f) >= k, F.sqrt(F.sum(r * r).over(f))))


def range_atr(df: DataFrame, k: int) -> DataFrame:
    f = trailing(by_session(), k)
    return df.withColumn(f"range{k}_atr", F.when(F.col("slot") >= k, ratio(
        F.max("high").over(f) - F.min("low").over(f), F.col("atr"))))


def efficiency(df: DataFrame, k: int) -> DataFrame:
    """Net log move over the path length of the last ``k`` bars."""
    w = by_session()
    net = F.abs(log_ratio(F.col("close"), F.lag("close", k).over(w)))
    path = F.sum(F.abs(F.col("ret"))).over(trailing(w, k))
    return df.withColumn(f"eff{k}", F.when(path > 0, ratio(net, path)))


def or_position(df: DataFrame, length: int) -> DataFrame:
    return df.withColumn("or_pos", F.when(F.col("slot") >= length - 1, ratio(
        F.col("close") - F.col("or_mid"), F.col("or_width"))))


def running_extremes(df: DataFrame) -> DataFrame:
    c, hi, lo, atr = (F.col(x) for x in ("close", "run_high", "run_low", "atr"))
    return df.withColumns({
        "from_low_atr": ratio(c - lo, atr), "to_high_atr": ratio(hi - c, atr),
        "range_pos": F.when(hi > lo, ratio(c - lo, hi - lo)).otherwise(F.when(c.isNotNull(), 0.5))})


def forward_labels(df: DataFrame, h: int) -> DataFrame:
    """What the next ``h`` bars did: labels, never features."""
    w = by_session()
    f, px, atr = ahead(w, h), F.col("close"), F.col("atr")
    last = F.lead("close", h).over(w)
    return df.withColumns({
        f"y{h}": log_ratio(last, px),
        f"mfe{h}": F.when(last.isNotNull(), ratio(F.max("high").over(f) - px, atr)),
        f"mae{h}": F.when(last.isNotNull(), ratio(F.min("low").over(f) - px, atr))})


FEATURES = ("prev_ret", "prev_range_atr", "gap_atr", "session_ret", "mom2", "mom4", "rv4",
            "vwap_dist_atr", "vwap_slope_atr", "volume_z", "or_width_atr", "or_pos",
            "from_low_atr", "to_high_atr", "range4_atr", "eff4", "time_frac")
HORIZONS = (2, 4)


def snapshots(feat: DataFrame, first: int, step: int, last: int, length: int) -> DataFrame:
    """Feature matrix and labels at decision marks only."""
    df = feat
    for k in (2, 4):
        df = momentum(df, k)
    df = running_extremes(or_position(efficiency(range_atr(realized_vol(df, 4), 4), 4), length))
    for h in HORIZONS:
        df = forward_labels(df, h)
    atr = F.col("atr")
    df = df.withColumns({
        "prev_range_atr": ratio(F.col("prev_high") - F.col("prev_low"), atr),
        "gap_atr": ratio(F.col("day_open") - F.col("prev_close"), atr),
        "session_ret": log_ratio(F.col("close"), F.col("day_open")),
        "vwap_dist_atr": ratio(F.col("close") - F.col("vwap"), atr),
        "vwap_slope_atr": ratio(F.col("vwap_slope"), atr),
        "or_width_atr": ratio(F.col("or_width"), atr),
        "time_frac": (F.col("slot") - first) / F.lit(float(last - first))})
    keep = (F.col("slot").between(first, last) & (F.pmod(F.col("slot") - first, F.lit(step)) == 0)
            & (atr > 0) & F.col("prev_close").isNotNull() & F.col("close").isNotNull())
    labels = [f"{p}{h}" for h in HORIZONS for p in ("y", "mfe", "mae")]
    return df.filter(keep).select(*KEYS, "slot", F.year("session").alias("year"), *FEATURES, *labels)


def jump_share(df: DataFrame, k: int) -> DataFrame:
    """Share of realised variance not explained by adjacent-return products."""
    w = by_session()
    r = F.col("ret")
    pair = F.abs(r * F.lag("ret").over(w))
    df = df.withColumn("_pair", pair)
    rv = F.when(F.count(r).over(trailing(w, k)) >= k, F.sum(r * r).over(trailing(w, k)))
    bv = F.when(F.count("_pair").over(trailing(w, k - 1)) >= k - 1,
                F.sum("_pair").over(trailing(w, k - 1))) * F.lit(3.141592653589793 / 2 * k / (k - 1))
    df = df.withColumns({"_rv": rv, "_bv": bv})
    share = ratio(F.greatest(F.col("_rv") - F.col("_bv"), F.lit(0.0)), F.col("_rv"))
    ok = (F.col("_rv") > 0) & F.col("_bv").isNotNull()
    return df.withColumn("jump_share", F.when(ok, share)).drop("_rv", "_bv", "_pair")


def adverse_semivariance(df: DataFrame, k: int, n: int, minimum: int, q: float) -> DataFrame:
    """One-sided squared-return sums and their same-clock quantile threshold, per side."""
    w, r = by_session(), F.col("ret")
    f = trailing(w, k)
    full = F.count(r).over(f) >= k
    df = df.withColumns({
        "down_var": F.when(full, F.sum(F.when(r < 0, r * r).otherwise(0.0)).over(f)),
        "up_var": F.when(full, F.sum(F.when(r > 0, r * r).otherwise(0.0)).over(f))})
    c = prior(by_clock(), n)
    return df.withColumns({
        "down_q": at_least(quantile(F.col("down_var"), q), F.col("down_var"), c, minimum),
        "up_q": at_least(quantile(F.col("up_var"), q), F.col("up_var"), c, minimum)})


def cusum(df: DataFrame, col: str, drift: float) -> DataFrame:
    """Two-sided reflected cumulative sums, restarted after every missing value.

    The reflected walk is S minus its running minimum with 0, so no fold is needed."""
    w = by_session()
    x = F.col(col)
    df = df.withColumn("_seg", F.sum(F.when(x.isNull(), 1).otherwise(0)).over(upto(w)))
    ws = W.partitionBy(*KEYS, "_seg").orderBy("slot")
    df = df.withColumns({"_up": F.sum(x - drift).over(upto(ws)), "_dn": F.sum(-x - drift).over(upto(ws))})
    return df.withColumns({
        "cusum_up": F.when(x.isNotNull(), F.col("_up") - F.least(F.lit(0.0), F.min("_up").over(upto(ws)))),
        "cusum_down": F.when(x.isNotNull(), F.col("_dn") - F.least(F.lit(0.0), F.min("_dn").over(upto(ws)))),
    }).drop("_seg", "_up", "_dn")


def variance_ratio(df: DataFrame, n: int, q: int) -> DataFrame:
    """Heteroskedasticity-adjusted variance-ratio score of the last ``n`` returns."""
    w = by_session()
    df = df.withColumn("_x", F.when(F.count("ret").over(trailing(w, n)) >= n,
                                    F.collect_list("ret").over(trailing(w, n))))
    df = df.withColumn("_m", total("_x") / n)
    df = df.withColumn("_x", F.transform("_x", lambda v: v - F.col("_m")))
    df = df.withColumn("_ss", total(F.transform("_x", lambda v: v * v)))
    num, den = F.lit(0.0), F.lit(0.0)
    for j in range(1, q):
        pair = F.zip_with(F.slice("_x", j + 1, n - j), F.slice("_x", 1, n - j), lambda a, b: a * b)
        wt = 2 * (1 - j / q)
        num = num + wt * total(pair)
        den = den + wt * wt * total(F.transform(pair, lambda v: v * v))
    df = df.withColumns({"_num": num, "_den": den})
    ok = (F.col("_ss") > 0) & (F.col("_den") > 0)
    return df.withColumn("vr_score", F.when(ok, F.col("_num") / F.sqrt(F.when(F.col("_den") > 0, F.col("_den"))))
                         ).drop("_x", "_m", "_ss", "_num", "_den")


def local_linear(df: DataFrame, k: int) -> DataFrame:
    """Linearly weighted trailing line fit at its last point: constant filter weights."""
    x = list(range(k))
    wt = [i + 1.0 for i in x]
    xm = sum(w * v for w, v in zip(wt, x)) / sum(wt)
    den = sum(w * (v - xm) ** 2 for w, v in zip(wt, x))
    coef = [w / sum(wt) + w * (v - xm) / den * (k - 1 - xm) for w, v in zip(wt, x)]
    w = by_session()
    out = F.lit(0.0)
    for i in range(k):
        out = out + (F.lag("close", k - 1 - i).over(w) if i < k - 1 else F.col("close")) * coef[i]
    return df.withColumn("smooth", out)


def prior_ridge_1(df: DataFrame, x: str, y: str, window, minimum: int, lam: float,
                  pred: str = "pred", unc: str = "unc") -> DataFrame:
    """One-feature ridge on the prior rows of ``window`` with forecast uncertainty.

    On a standardised feature the ridge slope is cov / (var (1 + lam)), so moments of the
    frame are enough and nothing is collected."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    xx, yy = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    df = df.withColumns({
        "_n": F.count(xx).over(window), "_mx": F.avg(xx).over(window), "_my": F.avg(yy).over(window),
        "_vx": F.var_pop(xx).over(window), "_vy": F.var_pop(yy).over(window),
        "_c": F.covar_pop(xx, yy).over(window)})
    sd = F.when(F.sqrt("_vx") > 1e-10, F.sqrt("_vx")).otherwise(1.0)
    df = df.withColumn("_s", sd)
    vz = F.col("_vx") / (F.col("_s") * F.col("_s"))
    cz = F.col("_c") / F.col("_s")
    df = df.withColumns({"_vz": vz, "_b": cz / (vz + lam), "_z": (F.col(x) - F.col("_mx")) / F.col("_s")})
    mse = F.col("_vy") - 2 * F.col("_b") * (F.col("_c") / F.col("_s")) + F.col("_b") * F.col("_b") * F.col("_vz")
    lever = (1 + F.col("_z") * F.col("_z") / (F.col("_vz") + lam)) / F.col("_n")
    good = (F.col("_n") >= minimum) & F.col(x).isNotNull()
    return df.withColumns({
        pred: F.when(good, F.col("_my") + F.col("_b") * F.col("_z")),
        unc: F.when(good, F.sqrt(F.greatest(F.lit(0.0), mse * lever)))}).drop(
        "_n", "_mx", "_my", "_vx", "_vy", "_c", "_s", "_vz", "_b", "_z")


def recency_mean(df: DataFrame, col: str, n: int) -> DataFrame:
    """Half-shrunk exponentially weighted mean of the last ``n`` same-slot values."""
    f = prior(by_clock(), n)
    df = df.withColumn("_h", F.when(F.count(col).over(f) >= n, F.collect_list(col).over(f)))
    raw = F.transform("_h", lambda v, i: F.exp(-2.0 + 2.0 * i / (n - 1)))
    df = df.withColumn("_w", raw).withColumn("_t", total("_w"))
    df = df.withColumn("_m", total(F.zip_with("_h", "_w", lambda v, w: v * w)) / F.col("_t"))
    dev = F.zip_with("_h", "_w", lambda v, w: w * (v - F.col("_m")) * (v - F.col("_m")))
    return df.withColumns({"recency": F.col("_m") * 0.5,
                           "recency_unc": F.sqrt(total(dev) / F.col("_t") / n)}).drop("_h", "_w", "_t", "_m")


# ---- session measures over the opening -----------------------------------------

def path_efficiency(bars: DataFrame, length: int) -> DataFrame:
    """Net opening move over the summed absolute close changes, the open included."""
    w = by_session()
    step = F.abs(F.col("close") - F.coalesce(F.lag("close").over(w), F.col("open")))
    x = bars.filter(F.col("slot") < length).withColumn("_step", step)
    return x.groupBy(*KEYS).agg(
        (F.max_by("close", "slot") - F.min_by("open", "slot")).alias("move"),
        F.sum("_step").alias("path"), F.count("close").alias("n")).filter(
        F.col("n") == length).select(
        *KEYS, "move", F.when(F.col("path") > 0, ratio(F.abs("move"), F.col("path"))).alias("path_eff"))


def price_impact(bars: DataFrame, length: int, n: int, minimum: int) -> DataFrame:
    """Log of mean absolute return per traded notional in the opening, and its prior z."""
    r = F.abs(log_ratio(F.col("close"), F.lag("close").over(by_session())))
    x = bars.withColumn("_r", r).filter(F.col("slot").between(1, length - 1))
    x = x.withColumn("_i", ratio(F.col("_r"), F.nullif(F.col("volume") * F.col("close"), F.lit(0.0))))
    d = x.groupBy(*KEYS).agg(F.avg("_i").alias("impact"))
    d = d.withColumn("log_impact", F.when(F.col("impact") > 0, F.ln("impact")))
    f, v = prior(by_day(), n), F.col("log_impact")
    return d.withColumn("impact_z", F.when(F.count(v).over(f) >= minimum, ratio(
        v - F.avg(v).over(f), F.nullif(F.stddev_samp(v).over(f), F.lit(0.0)))))


def hl_spread(bars: DataFrame, length: int, n: int, minimum: int, q: float) -> DataFrame:
    """Two-block high-low spread estimate with its prior quantile; negative is invalid."""
    one, two = F.col("slot") < length, F.col("slot").between(length, 2 * length - 1)
    hi = lambda c: F.max(F.when(c, F.col("high")))
    lo = lambda c: F.min(F.when(c, F.col("low")))
    d = bars.groupBy(*KEYS).agg(hi(one).alias("h1"), lo(one).alias("l1"), hi(two).alias("h2"), lo(two).alias("l2"))
    d = d.withColumns({
        "_b": F.pow(log_ratio(F.col("h1"), F.col("l1")), 2) + F.pow(log_ratio(F.col("h2"), F.col("l2")), 2),
        "_g": F.pow(log_ratio(F.greatest("h1", "h2"), F.least("l1", "l2")), 2)})
    k = 3 - 2 * 2 ** 0.5
    d = d.withColumn("_a", (F.sqrt(2 * F.col("_b")) - F.sqrt("_b")) / k - F.sqrt(F.col("_g") / k))
    ok = (F.col("_a") >= 0) & (F.col("h1") > F.col("l1")) & (F.col("h2") > F.col("l2"))
    d = d.withColumn("spread", F.when(ok, 2 * F.tanh(F.col("_a") / 2)))
    s = F.col("spread")
    return d.withColumn("spread_q", at_least(quantile(s, q), s, prior(by_day(), n), minimum)).select(
        *KEYS, "spread", "spread_q")


def nested_acceptance(bars: DataFrame, short: int, long: int, tick: float) -> DataFrame:
    """Short range broken before the long one completes, never lost, and extended by a tick."""
    x = bars.filter(F.col("slot") < long)
    s = whole_session()
    early = F.col("slot") < short
    x = x.withColumns({"_sh": F.max(F.when(early, F.col("high"))).over(s),
                       "_sl": F.min(F.when(early, F.col("low"))).over(s)})
    late = F.col("slot") >= short
    up, dn = late & (F.col("close") > F.col("_sh")), late & (F.col("close") < F.col("_sl"))
    x = x.withColumns({"_fu": F.min(F.when(up, F.col("slot"))).over(s),
                       "_fd": F.min(F.when(dn, F.col("slot"))).over(s)})
    lost_u = F.count_if((F.col("slot") >= F.col("_fu")) & ~up)
    lost_d = F.count_if((F.col("slot") >= F.col("_fd")) & ~dn)
    return x.groupBy(*KEYS).agg(
        F.count("close").alias("_n"),
        (F.first("_fu").isNotNull() & (lost_u == 0) & (F.max("high") - F.first("_sh") >= tick)).alias("accept_up"),
        (F.first("_fd").isNotNull() & (lost_d == 0) & (F.first("_sl") - F.min("low") >= tick)).alias("accept_down"),
        F.max("high").alias("long_high"), F.min("low").alias("long_low"),
    ).filter(F.col("_n") == long).drop("_n")


def jump_score(bars: DataFrame, daily: DataFrame, every: int) -> DataFrame:
    """Overnight-inclusive variance contrast of the previous session plus today's gap."""
    w = by_session()
    first = first_of("open").over(whole_session())
    base = bars.withColumn("_o", first).filter(F.pmod(F.col("slot") + 1, F.lit(every)) == 0)
    r = log_ratio(F.col("close"), F.coalesce(F.lag("close").over(w), F.col("_o")))
    base = base.withColumn("_r", r)
    base = base.withColumns({"_r1": F.lag("_r").over(w), "_r2": F.lag("_r", 2).over(w)})
    a = F.abs
    d = base.groupBy(*KEYS).agg(
        F.count("_r").alias("m"), F.sum(F.col("_r") * F.col("_r")).alias("rv"),
        F.sum(a(F.col("_r") * F.col("_r1"))).alias("bp"),
        F.sum(F.pow(a(F.col("_r") * F.col("_r1") * F.col("_r2")), 4 / 3)).alias("tp"),
        F.max(a(F.col("_r"))).alias("mx"), F.max_by("_r", "slot").alias("last1"),
        F.max_by("_r1", "slot").alias("last2"))
    lagged = {c: F.lag(c).over(by_day()) for c in ("m", "rv", "bp", "tp", "mx", "last1", "last2")}
    d = d.join(daily.select(*KEYS, "gap"), list(KEYS)).withColumns(lagged)
    g = F.when(F.col("gap") > -1, F.log1p("gap"))
    d = d.withColumn("_g", g).filter("m >= 2 AND _g IS NOT NULL")
    m = F.col("m") + 1
    rv = F.col("rv") + F.col("_g") * F.col("_g")
    bv = 3.141592653589793 / 2 * m / (m - 1) * (F.coalesce("bp", F.lit(0.0)) + a(F.col("_g") * F.col("last1")))
    mu = 2 ** (2 / 3) * 0.9277193336300392 / 1.7724538509055159  # gamma(7/6) / sqrt(pi)
    tp = m * m / (m - 2) * (F.coalesce("tp", F.lit(0.0)) + F.pow(a(F.col("_g") * F.col("last1") * F.col("last2")), 4 / 3)) / mu ** 3
    d = d.withColumns({"_m": m, "_rv": rv, "_bv": bv, "_tp": tp})
    k = (3.141592653589793 / 2) ** 2 + 3.141592653589793 - 5
    den = F.sqrt(k / F.col("_m") * F.greatest(F.lit(1.0), F.col("_tp") / F.greatest(F.col("_bv") * F.col("_bv"), F.lit(1e-20))))
    score = (F.col("_rv") - F.col("_bv")) / F.greatest(F.col("_rv"), F.lit(1e-20)) / F.greatest(den, F.lit(1e-20))
    return d.select(*KEYS, score.alias("jump_score"), (a(F.col("_g")) >= F.col("mx")).alias("gap_largest"))
