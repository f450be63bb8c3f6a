"""Event detectors as Column expressions.

A rule maps (bar columns, parameters) to a long and a short condition. Parameters are Columns,
so a constant setting and a whole grid exploded onto the bars run through the same plan.
An event at ``slot`` is known at that bar's close and may enter at the next bar's open.
"""
from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.core import (KEYS, at_least, before, by_session, log_ratio, prior, ratio, sgn,
                                    trailing, upto, whole_session)
from tidebar.operators import features as feats
from tidebar.operators.outcomes import settings_array

RULES: dict[str, Callable] = {}


class Cols:
    """Attribute access to columns: ``c.close``; with a prefix for grid structs. Parameters also know all
    values of their axes, so that a rule can choose among the columns made for them."""

    def __init__(self, prefix: str = "", fixed: dict | None = None, axes: dict[str, list] | None = None):
        self._prefix, self._fixed, self._axes = prefix, fixed or {}, axes or {k: [v] for k, v in (fixed or {}).items()}

    def __getattr__(self, name: str) -> Column:
        if name in self._fixed:
            return F.lit(self._fixed[name])
        return F.col(self._prefix + name)

    def choose(self, param: str, stem: str) -> Column:
        """The column ``stem`` + value for the value that ``param`` has in the setting at hand."""
        values = sorted(set(self._axes[param]))
        if len(values) == 1:
            return F.col(f"{stem}{values[0]}")
        out = F.lit(None).cast("double")
        for v in values:
            out = F.when(getattr(self, param) == v, F.col(f"{stem}{v}")).otherwise(out)
        return out


def rule(name: str):
    def wrap(fn):
        RULES[name] = fn
        return fn
    return wrap


def one_side(up: Column, down: Column) -> Column:
    """+1 / -1, NULL when neither holds or both do: opposite signals in one bar cancel."""
    up, down = F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))
    return F.when(up & ~down, 1).when(down & ~up, -1)


def events(df: DataFrame, up: Column, down: Column, last: int, keep: tuple = ()) -> DataFrame:
    side = one_side(up, down)
    ok = (F.col("atr") > 0) & F.col("is_normal") & (F.col("slot") < last)
    return df.filter(ok).withColumn("side", side).filter("side IS NOT NULL").select(*KEYS, "slot", "side", *keep)


def detect(df: DataFrame, family: str, last: int, **params) -> DataFrame:
    """Events of one setting of a family."""
    df = with_windows(df, family, {k: [v] for k, v in params.items()})
    up, down = RULES[family](Cols(), Cols(fixed=params))
    return events(df, up, down, last)


def detect_grid(df: DataFrame, family: str, last: int, axes: dict[str, list], keep: tuple = ()) -> DataFrame:
    """Events of every setting of ``axes``: the grid is exploded per bar and filtered in the
    same stage, so only events, not bars x settings, are ever shuffled."""
    settings = [{"signal_id": i, **dict(zip(axes, v))} for i, v in enumerate(product(*axes.values()))]
    up, down = RULES[family](Cols(), Cols("_p.", axes=axes))
    ok = (F.col("atr") > 0) & F.col("is_normal") & (F.col("slot") < last)
    wide = with_windows(df, family, axes).filter(ok).withColumn("_p", F.expr(f"explode({settings_array(settings)})"))
    # sides first: an axis may have the name of a bar column
    found = wide.withColumn("side", one_side(up, down)).filter("side IS NOT NULL")
    return found.select(*KEYS, "slot", "side", "_p.signal_id", *[F.col(f"_p.{k}").alias(k) for k in axes], *keep)


def cancel_opposite(ev: DataFrame, keys: list[str]) -> DataFrame:
    """Drop bars that carry events of both sides."""
    return (ev.groupBy(*keys).agg(F.min("side").alias("side"), F.max("side").alias("_x"))
            .filter(F.col("side") == F.col("_x")).drop("_x"))


def union_sides(up: DataFrame, down: DataFrame) -> DataFrame:
    """Long and short events as one set."""
    return up.withColumn("side", F.lit(1)).unionByName(down.withColumn("side", F.lit(-1)))


def first_event(ev: DataFrame, keys: tuple = KEYS) -> DataFrame:
    """First event per session; entry at the next slot."""
    return ev.groupBy(*keys).agg(F.min("slot").alias("slot"), F.min_by("side", "slot").alias("side")).withColumn(
        "entry_slot", F.col("slot") + 1)


def first_or_unknown(grid: DataFrame, ev: DataFrame, start: int, end: int) -> DataFrame:
    """Per session: the first event, or unresolved when a bar before it is missing."""
    f = first_event(ev)
    gap = (grid.filter(F.col("open").isNull() & F.col("slot").between(start, end - 1))
           .groupBy(*KEYS).agg(F.min("slot").alias("first_missing")))
    s = grid.select(*KEYS).distinct().join(f, list(KEYS), "left").join(gap, list(KEYS), "left")
    hidden = F.col("first_missing") <= F.coalesce("slot", F.lit(1_000_000))
    return s.select(*KEYS, F.when(hidden, F.lit("unknown")).when(F.col("slot").isNotNull(), "event")
                    .otherwise("none").alias("state"),
                    F.when(~F.coalesce(hidden, F.lit(False)), F.col("slot")).alias("slot"),
                    F.when(~F.coalesce(hidden, F.lit(False)), F.col("side")).alias("side"), "first_missing")


def confirm(df: DataFrame, up: Column, down: Column, last: int) -> DataFrame:
    """Events whose side equals the side of the bar before."""
    df = df.withColumn("_side", F.coalesce(one_side(up, down), F.lit(0)))
    same = F.col("_side") == F.lag("_side").over(by_session())
    return events(df, same & (F.col("_side") == 1), same & (F.col("_side") == -1), last)


def intact(df: DataFrame) -> DataFrame:
    """Bars before the first missing one of their session."""
    gone = F.sum(F.when(F.col("close").isNull(), 1).otherwise(0)).over(upto(by_session()))
    return df.withColumn("_gone", gone).filter("_gone = 0").drop("_gone")


# ---- close breakouts of the opening range with a gate ---------------------------

def _break(c):
    return c.close > c.or_high, c.close < c.or_low


def _late(c, p):
    return c.slot >= p.length


@rule("range_break")
def _(c, p):
    up, dn = _break(c)
    return up & _late(c, p), dn & _late(c, p)


@rule("range_break_vwap")
def _(c, p):
    up, dn = _break(c)
    far = p.buffer_atr * c.atr
    return up & _late(c, p) & (c.close - c.vwap >= far), dn & _late(c, p) & (c.vwap - c.close >= far)


@rule("range_break_rvol")
def _(c, p):
    up, dn = _break(c)
    gate = _late(c, p) & (c.rvol >= p.minimum)
    return up & gate, dn & gate


@rule("range_break_vol_state")
def _(c, p):
    up, dn = _break(c)
    gate = _late(c, p) & F.when(p.high, c.vol >= c.vol_q).otherwise(c.vol <= c.vol_q)
    return up & gate, dn & gate


@rule("range_break_gap")
def _(c, p):
    up, dn = _break(c)
    rel = c.gap * c.prev_ret
    gate = (_late(c, p) & (F.abs(c.gap) >= p.minimum)
            & ((p.relation == "ANY") | ((p.relation == "SAME") & (rel > 0)) | ((p.relation == "OPPOSITE") & (rel < 0))))
    want = sgn(c.gap) * F.when(p.follow, 1).otherwise(-1)
    return up & gate & (want == 1), dn & gate & (want == -1)


@rule("range_break_open_trend")
def _(c, p):
    up, dn = _break(c)
    body = c.or_close - c.or_open
    gate = _late(c, p) & (F.abs(body) / c.or_width >= p.minimum)
    return up & gate & (body > 0), dn & gate & (body < 0)


@rule("noise_momentum")
def _(c, p):
    late = c.slot >= p.start
    return late & (c.close > c.band_up) & (c.close > c.vwap), late & (c.close < c.band_down) & (c.close < c.vwap)


@rule("close_momentum")
def _(c, p):
    move = c.close / F.nullif(c.prev_close, F.lit(0.0)) - 1
    at = (c.slot == p.at) & (F.abs(move) >= p.minimum)
    return at & (move > 0), at & (move < 0)


@rule("gap_reversal")
def _(c, p):
    rel = c.gap * c.prev_ret
    at = ((c.slot == p.at) & (F.abs(c.gap) >= p.minimum)
          & ((p.relation == "ANY") | ((p.relation == "SAME") & (rel > 0)) | ((p.relation == "OPPOSITE") & (rel < 0))))
    return at & (c.gap < 0), at & (c.gap > 0)


@rule("open_shock_reversal")
def _(c, p):
    move = c.close - c.day_open
    at = (c.slot == p.at) & (F.abs(move) >= p.minimum_atr * c.atr)
    return at & (move < 0), at & (move > 0)


@rule("overnight_drift")
def _(c, p):
    return (c.slot == p.at) & (c.prev_ret <= p.maximum), F.lit(False)


# ---- minute-level trigger families ---------------------------------------------

def _extremes(n: int) -> list[dict[str, Column]]:
    """Extremes of the ``n`` bars before, all present, and those of one bar earlier."""
    w = by_session()
    return [{f"hi{n}": at_least(F.max("high"), F.col("high"), prior(w, n), n), f"lo{n}": at_least(F.min("low"), F.col("low"), prior(w, n), n)},
            {f"p_hi{n}": F.lag(f"hi{n}").over(w), f"p_lo{n}": F.lag(f"lo{n}").over(w)}]


def _moves(n: int) -> list[dict[str, Column]]:
    """Change over ``n`` bars in units of the daily range, and that of one bar earlier."""
    w = by_session()
    return [{f"move{n}": ratio(F.col("close") - F.lag("close", n).over(w), F.col("atr"))}, {f"p_move{n}": F.lag(f"move{n}").over(w)}]


def _streaks(n: int) -> list[dict[str, Column]]:
    """Extremes of the distance to VWAP over ``n`` bars that end two bars ago."""
    dist, gap = F.col("close") - F.col("vwap"), by_session().rowsBetween(-n - 1, -2)
    return [{f"dist_min{n}": at_least(F.min(dist), dist, gap, n), f"dist_max{n}": at_least(F.max(dist), dist, gap, n)}]


def _slopes(n: int) -> list[dict[str, Column]]:
    """Change of VWAP over ``n`` bars."""
    return [{f"vwap_slope{n}": F.col("vwap") - F.lag("vwap", n).over(by_session())}]


#: Parameters that are numbers of bars, and what is computed for each of their values.
WINDOWS = {
    "trend_pullback": {"fast": "ema", "slow": "ema", "slope_bars": None},
    "rolling_breakout": {"lookback": _extremes}, "failed_breakout": {"lookback": _extremes}, "compression_breakout": {"lookback": _extremes},
    "impulse_continuation": {"lookback": _moves}, "impulse_reversal": {"lookback": _moves},
    "vwap_stretch_reversal": {"slope_bars": _slopes}, "vwap_trend_reclaim": {"streak": _streaks, "slope_bars": _slopes},
}


def with_windows(df: DataFrame, family: str, axes: dict[str, list]) -> DataFrame:
    """Columns for every number of bars on the axes of a family; others than positive whole numbers are refused,
    and so are missing ones."""
    for param, make in WINDOWS.get(family, {}).items():
        for n in sorted(set(axes.get(param, [None])), key=str):
            if not isinstance(n, int) or isinstance(n, bool) or n < 1:
                raise ValueError(f"{family}: {param} has to be a positive number of bars, not {n!r}")
            if make == "ema":
                df = feats.ema(df, "close", n, f"ema{n}").withColumn(f"p_ema{n}", F.lag(f"ema{n}").over(by_session()))
            elif make:
                for step in make(n):
                    df = df.withColumns({k: v for k, v in step.items() if k not in df.columns})
    if family == "trend_pullback":
        w = by_session()
        df = df.withColumns({f"slope{n}_{k}": F.col(f"ema{n}") - F.lag(f"ema{n}", k).over(w) for n in set(axes["slow"]) for k in set(axes["slope_bars"])})
    return df


@rule("trend_pullback")
def _(c, p):
    thr = p.slope_atr * c.atr
    free = p.vwap_filter == 0
    fast, slow, before_ = p.choose("fast", "ema"), p.choose("slow", "ema"), p.choose("fast", "p_ema")
    slope = F.lit(None).cast("double")
    for k in sorted(set(p._axes["slope_bars"])):
        for n in sorted(set(p._axes["slow"])):
            slope = F.when((p.slope_bars == k) & (p.slow == n), F.col(f"slope{n}_{k}")).otherwise(slope)
    return ((fast > slow) & (slope > thr) & (c.p_close <= before_) & (c.close > fast) & (free | (c.close > c.vwap)),
            (fast < slow) & (slope < -thr) & (c.p_close >= before_) & (c.close < fast) & (free | (c.close < c.vwap)))


def _span(p):
    return tuple(p.choose("lookback", stem) for stem in ("hi", "lo", "p_hi", "p_lo"))


def _busy(c, p):
    """No volume gate where the setting has none (NULL)."""
    return p.volume_z.isNull() | (c.volume_z >= p.volume_z)


@rule("rolling_breakout")
def _(c, p):
    hi, lo, phi, plo = _span(p)
    buf, free = p.buffer_atr * c.atr, p.vwap_filter == 0
    return ((c.close > hi + buf) & (c.p_close <= phi + buf) & (free | (c.close > c.vwap)) & _busy(c, p),
            (c.close < lo - buf) & (c.p_close >= plo - buf) & (free | (c.close < c.vwap)) & _busy(c, p))


@rule("failed_breakout")
def _(c, p):
    _, _, phi, plo = _span(p)
    over, back = p.overshoot_atr * c.atr, p.reclaim_atr * c.atr
    return ((c.p_low < plo - over) & (c.p_close >= plo) & (c.close > plo + back) & _busy(c, p),
            (c.p_high > phi + over) & (c.p_close <= phi) & (c.close < phi - back) & _busy(c, p))


@rule("vwap_stretch_reversal")
def _(c, p):
    dist, far = c.p_close - c.p_vwap, p.stretch_atr * c.atr
    calm = p.max_slope_atr.isNull() | (F.abs(p.choose("slope_bars", "vwap_slope")) <= p.max_slope_atr * c.atr)
    return (dist < -far) & (c.close > c.p_high) & calm, (dist > far) & (c.close < c.p_low) & calm


@rule("impulse_continuation")
def _(c, p):
    move, before_ = p.choose("lookback", "move"), p.choose("lookback", "p_move")
    t = p.impulse_atr
    return ((move > t) & (before_ <= t) & (c.close > c.p_high) & _busy(c, p),
            (move < -t) & (before_ >= -t) & (c.close < c.p_low) & _busy(c, p))


@rule("impulse_reversal")
def _(c, p):
    before_, t = p.choose("lookback", "p_move"), p.impulse_atr
    return (before_ < -t) & (c.close > c.p_high) & _busy(c, p), (before_ > t) & (c.close < c.p_low) & _busy(c, p)


@rule("compression_breakout")
def _(c, p):
    hi, lo, phi, plo = _span(p)
    buf, tight = p.buffer_atr * c.atr, hi - lo <= p.max_range_atr * c.atr
    return (tight & (c.close > hi + buf) & (c.p_close <= phi + buf),
            tight & (c.close < lo - buf) & (c.p_close >= plo - buf))


@rule("vwap_trend_reclaim")
def _(c, p):
    tol, sl = p.tolerance_atr * c.atr, p.slope_atr * c.atr
    least, most, slope = p.choose("streak", "dist_min"), p.choose("streak", "dist_max"), p.choose("slope_bars", "vwap_slope")
    return ((least > 0) & (c.p_low <= c.p_vwap + tol) & (c.p_close >= c.p_vwap) & (c.close > c.p_high) & (slope > sl),
            (most < 0) & (c.p_high >= c.p_vwap - tol) & (c.p_close <= c.p_vwap) & (c.close < c.p_low) & (slope < -sl))


@rule("implied_band_reversion")
def _(c, p):
    """Fade of a band of the previous close whose width is an external volatility level."""
    pct = p.multiple * c.ref_level / 100
    up, dn = c.prev_close * (1 + pct), c.prev_close * (1 - pct)
    regime = ((p.regime == "ALL") | ((p.regime == "LOW") & (c.ref_level < p.low)) | ((p.regime == "HIGH") & (c.ref_level >= p.high))
              | ((p.regime == "EXTREMES") & ((c.ref_level < p.low) | (c.ref_level >= p.high))))
    breach = p.entry == "BREACH"
    return (regime & F.when(breach, (c.close < dn) & (c.p_close >= dn)).otherwise((c.p_close < dn) & (c.close >= dn)),
            regime & F.when(breach, (c.close > up) & (c.p_close <= up)).otherwise((c.p_close > up) & (c.close <= up)))


# ---- level entries ---------------------------------------------------------------

def breach_entry(df: DataFrame, mode: str, start: Column, cutoff: int) -> DataFrame:
    """First TOUCH of a level, or first CLOSE beyond it with entry at the next open.

    ``df`` carries ``upper``, ``lower`` and ``direction``. A bar that touches both levels is
    ambiguous: it is skipped and counted. A touch fills at the worse of open and level."""
    w = by_session()
    can_up, can_dn = F.col("direction").isin("BOTH", "LONG"), F.col("direction").isin("BOTH", "SHORT")
    if mode == "TOUCH":
        up, dn = can_up & (F.col("high") >= F.col("upper")), can_dn & (F.col("low") <= F.col("lower"))
        px = F.when(up, F.greatest("open", "upper")).otherwise(F.least("open", "lower"))
        slot = F.col("slot")
    elif mode == "CLOSE":
        up, dn = can_up & (F.col("close") > F.col("upper")), can_dn & (F.col("close") < F.col("lower"))
        px, slot = F.col("_next"), F.col("slot") + 1
    else:
        raise ValueError("mode must be TOUCH or CLOSE")
    x = df.withColumn("_next", F.lead("open").over(w)).filter(
        (F.col("slot") >= start) & (F.col("slot") < cutoff))
    x = x.withColumns({"_up": F.coalesce(up, F.lit(False)), "_dn": F.coalesce(dn, F.lit(False))})
    hit = F.col("_up") != F.col("_dn")
    row = F.struct(F.when(F.col("_up"), 1).otherwise(-1).alias("side"), F.col("slot").alias("signal_slot"),
                   slot.alias("entry_slot"), px.alias("entry_px"))
    both = F.col("_up") & F.col("_dn")
    d = x.groupBy(*KEYS).agg(F.min_by(F.when(hit, row), F.when(hit, F.col("slot"))).alias("e"),
                             F.min(F.when(both, F.col("slot"))).alias("_amb"))
    seen = F.coalesce(F.col("_amb") < F.col("e.signal_slot"), F.lit(False))
    return d.filter("e IS NOT NULL AND e.entry_px IS NOT NULL").filter(F.col("e.entry_slot") < cutoff).select(
        *KEYS, "e.*", seen.alias("ambiguous_before"))


def adverse_first_touch(df: DataFrame, cutoff: int, start: int) -> DataFrame:
    """As TOUCH, but a bar touching both levels is an entry that is stopped at once."""
    up, dn = F.col("high") >= F.col("upper"), F.col("low") <= F.col("lower")
    x = df.filter((F.col("slot") >= start) & (F.col("slot") < cutoff) & (up | dn))
    both = up & dn
    row = F.struct("slot", both.alias("ambiguous"),
                   F.when(both, -(F.col("upper") - F.col("lower"))).alias("forced_pts"),
                   F.when(both, 0).when(up, 1).otherwise(-1).alias("side"))
    return x.groupBy(*KEYS).agg(F.min_by(row, F.col("slot")).alias("e")).select(*KEYS, "e.*")


# ---- first break per side with a condition ---------------------------------------

def first_breaks(df: DataFrame, length, up_ok: Column, dn_ok: Column, cutoff: int, keep: dict | None = None) -> DataFrame:
    """First close beyond each side of the range whose condition holds, once per side."""
    keep = keep or {}
    late = (F.col("slot") >= length) & (F.col("slot") < cutoff) & (F.col("atr") > 0) & F.col("is_normal")
    up = late & (F.col("close") > F.col("or_high")) & up_ok
    dn = late & (F.col("close") < F.col("or_low")) & dn_ok
    x = intact(df).withColumn("side", F.when(F.coalesce(up, F.lit(False)), 1).when(F.coalesce(dn, F.lit(False)), -1))
    x = x.filter("side IS NOT NULL").withColumns({k: v for k, v in keep.items()})
    return x.groupBy(*KEYS, "side").agg(F.min("slot").alias("slot"), *[F.min_by(k, "slot").alias(k) for k in keep])


def failed_side(df: DataFrame, length: int, expiry: int, cutoff: int) -> DataFrame:
    """First break, a close back inside, then a break of the other side within ``expiry``."""
    x = first_break_columns(df, length, cutoff)
    inside = (F.col("close") < F.col("or_high")) & (F.col("close") > F.col("or_low"))
    back = F.min(F.when(inside & (F.col("slot") > F.col("first_slot")), F.col("slot"))).over(whole_session())
    x = x.withColumn("back_slot", back)
    side = F.when(F.col("close") > F.col("or_high"), 1).when(F.col("close") < F.col("or_low"), -1)
    hit = (side == -F.col("first_side")) & (F.col("slot") >= F.col("back_slot")) & (F.col("slot") - F.col("first_slot") <= expiry)
    return x.withColumn("side", side).filter(hit).groupBy(*KEYS).agg(
        F.min("slot").alias("slot"), F.min_by("side", "slot").alias("side"))


def first_break_columns(df: DataFrame, length: int, cutoff: int) -> DataFrame:
    """First break slot and side as session columns on intact bars."""
    x = intact(df).filter((F.col("atr") > 0) & F.col("is_normal"))
    beyond = (F.col("slot") >= length) & (F.col("slot") < cutoff) & ((F.col("close") > F.col("or_high")) | (F.col("close") < F.col("or_low")))
    s = whole_session()
    x = x.withColumn("first_slot", F.min(F.when(beyond, F.col("slot"))).over(s))
    up = F.col("close") > F.col("or_high")
    return x.withColumn("first_side", F.max(F.when(F.col("slot") == F.col("first_slot"), F.when(up, 1).otherwise(-1))).over(s)
                        ).filter(F.col("slot") < cutoff)


def failed_break_fade(df: DataFrame, length: int, expiry: int, depth: float, cutoff: int) -> DataFrame:
    """Fade when price returns inside by ``depth`` widths: stop at the extreme, target the middle."""
    x = first_break_columns(df, length, cutoff)
    w = upto(by_session())
    live = F.col("slot") >= F.col("first_slot")
    x = x.withColumn("extreme", F.when(F.col("first_side") == 1, F.max(F.when(live, F.col("high"))).over(w))
                     .otherwise(F.min(F.when(live, F.col("low"))).over(w)))
    edge = F.when(F.col("first_side") == 1, F.col("or_high") - F.col("close")).otherwise(F.col("close") - F.col("or_low"))
    hit = ((F.col("slot") > F.col("first_slot")) & (F.col("close") < F.col("or_high")) & (F.col("close") > F.col("or_low"))
           & (edge / F.col("or_width") >= depth) & (F.col("slot") - F.col("first_slot") <= expiry))
    return x.filter(hit).groupBy(*KEYS).agg(
        F.min("slot").alias("slot"), F.first(-F.col("first_side")).alias("side"),
        F.min_by("extreme", "slot").alias("stop_ref"), F.first("or_mid").alias("target_ref"))


def jump_recovery(df: DataFrame, length: int, rebuild: int, wait: int, expiry: int, cutoff: int) -> DataFrame:
    """Break after a high opening jump share, a later quiet block, then a new extreme.

    ``df`` has ``jump_open``/``jump_open_q`` (opening) and ``jump_share``/``jump_low_q`` (bars)."""
    x = first_break_columns(df, length, cutoff).filter(F.col("jump_open") >= F.col("jump_open_q"))
    s, w = whole_session(), upto(by_session())
    live = F.col("slot") >= F.col("first_slot")
    ext = F.when(F.col("first_side") == 1, F.max(F.when(live, F.col("high"))).over(w)).otherwise(
        -F.min(F.when(live, F.col("low"))).over(w))
    lost = F.when(F.col("first_side") == 1, F.col("close") < F.col("or_low")).otherwise(F.col("close") > F.col("or_high"))
    quiet = (F.col("slot") >= F.col("first_slot") + wait) & (F.col("jump_share") <= F.col("jump_low_q"))
    x = x.withColumns({"_ext": ext, "_lost": F.min(F.when(live & lost, F.col("slot"))).over(s),
                       "_quiet": F.min(F.when(quiet & (F.col("slot") > F.col("first_slot")), F.col("slot"))).over(s)})
    x = x.withColumn("_box", F.max(F.when(F.col("slot") == F.col("_quiet"), F.col("_ext"))).over(s))
    sc = F.col("close") * F.col("first_side")
    edge = F.when(F.col("first_side") == 1, F.col("or_high")).otherwise(-F.col("or_low"))
    hit = ((F.col("slot") > F.col("_quiet")) & (F.col("slot") - F.col("first_slot") <= expiry)
           & (sc > F.greatest(edge, F.col("_box"))) & (F.col("_lost").isNull() | (F.col("slot") < F.col("_lost"))))
    return x.filter(hit).groupBy(*KEYS).agg(F.min("slot").alias("slot"), F.first("first_side").alias("side"))


def serial_switch(df: DataFrame, length: int, block: int, level: float, expiry: int, cutoff: int) -> DataFrame:
    """Variance-ratio score below -level one block earlier and above it now, then a break.

    A break before the switch spends its side."""
    x = intact(df).filter((F.col("atr") > 0) & F.col("is_normal") & (F.col("slot") < cutoff))
    s, w = whole_session(), by_session()
    turn = (F.col("slot") >= 2 * block) & (F.col("slot") >= length) & (F.lag("vr_score", block).over(w) < -level) & (F.col("vr_score") > level)
    side = F.when(F.col("slot") >= length, F.when(F.col("close") > F.col("or_high"), 1).when(F.col("close") < F.col("or_low"), -1))
    x = x.withColumns({"_turn": turn, "side": side})
    x = x.withColumns({"_start": F.min(F.when(F.col("_turn"), F.col("slot"))).over(s),
                       "_up": F.min(F.when(F.col("side") == 1, F.col("slot"))).over(s),
                       "_dn": F.min(F.when(F.col("side") == -1, F.col("slot"))).over(s)})
    spent = F.coalesce(F.when(F.col("side") == 1, F.col("_up")).otherwise(F.col("_dn")) <= F.col("_start"), F.lit(False))
    hit = F.col("side").isNotNull() & (F.col("slot") > F.col("_start")) & (F.col("slot") - F.col("_start") <= expiry) & ~spent
    return x.filter(hit).groupBy(*KEYS, "side").agg(F.min("slot").alias("slot"))


def sequential_drift(df: DataFrame, length: int, expiry: int, cutoff: int) -> DataFrame:
    """Break while the same-side CUSUM alarms and the other side has not alarmed recently.

    ``df`` has ``cusum_up/down`` and their session thresholds ``alarm_up/down``."""
    w = upto(by_session())
    live = F.col("slot") >= length
    x = df.withColumns({
        "_au": F.max(F.when(live & (F.col("cusum_up") > F.col("alarm_up")), F.col("slot"))).over(w),
        "_ad": F.max(F.when(live & (F.col("cusum_down") > F.col("alarm_down")), F.col("slot"))).over(w)})
    far = lambda c: F.coalesce(F.col("slot") - F.col(c) > expiry, F.lit(True))
    return first_breaks(x, length, (F.col("cusum_up") > F.col("alarm_up")) & far("_ad"),
                        (F.col("cusum_down") > F.col("alarm_down")) & far("_au"), cutoff)


# ---- state commands ----------------------------------------------------------------

def hysteresis(df: DataFrame, score: Column, enter: Column, leave: Column, due: Column) -> DataFrame:
    """Direction held through decision bars: set beyond ``enter``, flat inside ``leave``,
    otherwise kept. A command row appears only where the direction changes."""
    w = by_session()
    want = F.when(F.abs(score) >= enter, sgn(score)).when(F.abs(score) <= leave, 0)
    x = df.withColumn("_want", F.when(due, want))
    x = x.withColumn("state", F.coalesce(F.last("_want", ignorenulls=True).over(upto(w)), F.lit(0)))
    x = x.withColumn("_was", F.coalesce(F.lag("state").over(w), F.lit(0)))
    return x.withColumn("command", F.when(F.col("state") != F.col("_was"), F.col("state"))).drop("_want", "_was")


def stateless_commands(df: DataFrame, side: Column, due: Column) -> DataFrame:
    """As above when every decision bar names its direction (0 = flat)."""
    w = by_session()
    x = df.withColumn("_want", F.when(due, F.coalesce(side, F.lit(0))))
    x = x.withColumn("state", F.coalesce(F.last("_want", ignorenulls=True).over(upto(w)), F.lit(0)))
    x = x.withColumn("_was", F.coalesce(F.lag("state").over(w), F.lit(0)))
    return x.withColumn("command", F.when(F.col("state") != F.col("_was"), F.col("state"))).drop("_want", "_was")


def state_episodes(df: DataFrame, flat: int) -> DataFrame:
    """Runs of constant non-zero direction: entry at the next open, exit at the open after the run."""
    w = by_session()
    x = df.withColumn("_turn", F.when(F.col("state") != F.coalesce(F.lag("state").over(w), F.lit(0)), 1).otherwise(0))
    x = x.withColumns({"_run": F.sum("_turn").over(upto(w)), "_next": F.lead("open").over(w)})
    r = x.filter(F.col("state") != 0).groupBy(*KEYS, "_run").agg(
        F.first("state").alias("side"), F.min("slot").alias("signal_slot"), F.max("slot").alias("last_slot"),
        F.min_by("_next", "slot").alias("entry_px"), F.max_by("_next", "slot").alias("exit_px"))
    return r.withColumns({"entry_slot": F.col("signal_slot") + 1,
                          "exit_slot": F.least(F.col("last_slot") + 1, F.lit(flat)),
                          "pnl_pts": F.col("side") * (F.col("exit_px") - F.col("entry_px"))}).drop("_run", "last_slot")


def required_mask(grid: DataFrame, needed: DataFrame, ev: DataFrame) -> DataFrame:
    """Events whose detector needed a bar that is missing become unknown.

    ``needed`` lists (detector, slot); an event is judged on the needed slots up to its own."""
    gone = grid.filter(F.col("open").isNull()).select(*KEYS, F.col("slot").alias("_s")).join(
        needed.withColumnRenamed("slot", "_s"), "_s")
    gone = gone.groupBy("detector", *KEYS).agg(F.min("_s").alias("first_missing"))
    return ev.join(gone, ["detector", *KEYS], "left").withColumn(
        "is_unknown", F.coalesce(F.col("first_missing") <= F.col("slot"), F.lit(False))).drop("first_missing")
