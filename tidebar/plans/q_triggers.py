"""Grids of the trigger families over numbers of bars that no other query uses, with their DuckDB twins.

A twin computes each number of bars in a frame of its own and joins the settings to it."""
from __future__ import annotations

from itertools import product

from tidebar.operators import detect as det
from tidebar.plans import views
from tidebar.plans.oracle import pick, with_ctes
from tidebar.plans.q_detect import LAST
from tidebar.plans.q_windows import H, M
from tidebar.plans.registry import register

O = "WINDOW o AS (PARTITION BY symbol, session ORDER BY slot)"


def _values(axes: dict[str, list]) -> str:
    lit = lambda v: "NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else repr(v)
    rows = ", ".join(f"({i}, {', '.join(map(lit, v))})" for i, v in enumerate(product(*axes.values())))
    return f"(VALUES {rows}) v(signal_id, {', '.join(axes)})"


def _union(frame, values: list) -> str:
    return " UNION ALL ".join(f"({frame(n)})" for n in values)


def extremes(n: int) -> str:
    return f"""SELECT *, {n} AS n, lag(hi) OVER o AS phi, lag(lo) OVER o AS plo FROM (SELECT *, CASE WHEN count(high) OVER p >= {n} THEN max(high) OVER p END AS hi,
 CASE WHEN count(low) OVER p >= {n} THEN min(low) OVER p END AS lo FROM feat WINDOW p AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)) {O}"""


def moves(n: int) -> str:
    return f"SELECT *, {n} AS n, lag(mv_) OVER o AS pmv FROM (SELECT *, (close - lag(close, {n}) OVER o) / nullif(atr, 0) AS mv_ FROM feat {O}) {O}"


def streaks(n: int) -> str:
    return f"""SELECT *, {n} AS n, CASE WHEN count(close - vwap) OVER p >= {n} THEN min(close - vwap) OVER p END AS least_, CASE WHEN count(close - vwap) OVER p >= {n} THEN max(close - vwap) OVER p END AS most_
 FROM feat WINDOW p AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN {n + 1} PRECEDING AND 2 PRECEDING)"""


def slopes(n: int) -> str:
    return f"SELECT symbol, session, slot, {n} AS k, vwap - lag(vwap, {n}) OVER o AS slope FROM feat {O}"


OBS = "SELECT symbol, session, slot, close, row_number() OVER (PARTITION BY symbol, session ORDER BY slot) - 1 AS j FROM g WHERE close IS NOT NULL"


def means(n: int) -> str:
    """Recursive mean from the definition, carried over missing bars."""
    a = 2.0 / (n + 1)
    return f"""SELECT symbol, session, slot, {n} AS n, last_value(e IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY slot) AS e FROM feat LEFT JOIN
 (SELECT a.symbol, a.session, a.slot, sum(b.close * CASE WHEN b.j = 0 THEN 1 ELSE {a!r} END * pow({1 - a!r}, a.j - b.j)) AS e FROM obs a JOIN obs b
 ON a.symbol = b.symbol AND a.session = b.session AND b.j <= a.j GROUP BY 1, 2, 3) USING (symbol, session, slot)"""


def grid(name: str, kind: str, family: str, axes: dict[str, list], source: str, up: str, dn: str, frames: dict[str, str]) -> None:
    keep = [k for k, v in axes.items() if v != [None]]
    spec = "symbol session slot:i side:i signal_id:i " + " ".join(f"{k}:{'i' if isinstance(axes[k][0], int) else 'd'}" for k in keep)
    body = f"""(SELECT * FROM (SELECT *, CASE WHEN coalesce({up}, false) AND NOT coalesce({dn}, false) THEN 1 WHEN coalesce({dn}, false) AND NOT coalesce({up}, false) THEN -1 END AS side
 FROM {source}) WHERE side IS NOT NULL AND atr > 0 AND is_normal AND slot < {LAST[kind]})"""

    def plan(spark, sf):
        return det.detect_grid(views.feat(spark, sf, kind), family, LAST[kind], axes).drop(*(k for k in axes if k not in keep))
    register(name, with_ctes(kind, pick(spec, body), frames))(plan)


LOOK = [3, 5, 8, 10]
AX = {"lookback": LOOK, "buffer_atr": [0.0, 0.03], "vwap_filter": [0, 1], "volume_z": [None]}
grid("detect_grid_breakout", M, "rolling_breakout", AX, f"x JOIN {_values(AX)} ON n = lookback",
     "close > hi + buffer_atr * atr AND p_close <= phi + buffer_atr * atr AND (vwap_filter = 0 OR close > vwap)",
     "close < lo - buffer_atr * atr AND p_close >= plo - buffer_atr * atr AND (vwap_filter = 0 OR close < vwap)", {"x": _union(extremes, LOOK)})
AX = {"lookback": LOOK, "overshoot_atr": [0.0, 0.02], "reclaim_atr": [0.0, 0.01], "volume_z": [None]}
grid("detect_grid_failed", H, "failed_breakout", AX, f"x JOIN {_values(AX)} ON n = lookback",
     "p_low < plo - overshoot_atr * atr AND p_close >= plo AND close > plo + reclaim_atr * atr",
     "p_high > phi + overshoot_atr * atr AND p_close <= phi AND close < phi - reclaim_atr * atr", {"x": _union(extremes, LOOK)})
AX = {"lookback": LOOK, "max_range_atr": [0.6, 0.9], "buffer_atr": [0.0, 0.02]}
grid("detect_grid_compression", H, "compression_breakout", AX, f"x JOIN {_values(AX)} ON n = lookback",
     "hi - lo <= max_range_atr * atr AND close > hi + buffer_atr * atr AND p_close <= phi + buffer_atr * atr",
     "hi - lo <= max_range_atr * atr AND close < lo - buffer_atr * atr AND p_close >= plo - buffer_atr * atr", {"x": _union(extremes, LOOK)})
AX = {"lookback": [2, 3, 4, 7], "impulse_atr": [0.08, 0.15], "volume_z": [0.0, -0.5]}
grid("detect_grid_impulse", M, "impulse_continuation", AX, f"x JOIN {_values(AX)} ON n = lookback",
     "mv_ > impulse_atr AND pmv <= impulse_atr AND close > p_high AND vz >= volume_z",
     "mv_ < -impulse_atr AND pmv >= -impulse_atr AND close < p_low AND vz >= volume_z",
     {"mvs": _union(moves, AX["lookback"]), "x": "SELECT * RENAME (volume_z AS vz) FROM mvs"})
AX = {"lookback": [2, 3, 4, 7], "impulse_atr": [0.08, 0.15], "volume_z": [None]}
grid("detect_grid_impulse_reversal", M, "impulse_reversal", AX, f"x JOIN {_values(AX)} ON n = lookback",
     "pmv < -impulse_atr AND close > p_high", "pmv > impulse_atr AND close < p_low", {"x": _union(moves, AX["lookback"])})
AX = {"streak": [2, 4, 6], "slope_bars": [1, 3], "tolerance_atr": [0.02, 0.08], "slope_atr": [0.0]}
grid("detect_grid_reclaim", M, "vwap_trend_reclaim", AX, f"x JOIN {_values(AX)} ON n = streak JOIN sl USING (symbol, session, slot) ",
     "k = slope_bars AND least_ > 0 AND p_low <= p_vwap + tolerance_atr * atr AND p_close >= p_vwap AND close > p_high AND slope > slope_atr * atr",
     "k = slope_bars AND most_ < 0 AND p_high >= p_vwap - tolerance_atr * atr AND p_close <= p_vwap AND close < p_low AND slope < -slope_atr * atr",
     {"x": _union(streaks, AX["streak"]), "sl": _union(slopes, AX["slope_bars"])})
AX = {"stretch_atr": [0.1, 0.3], "max_slope_atr": [0.05, 0.3], "slope_bars": [1, 4]}
grid("detect_grid_stretch", M, "vwap_stretch_reversal", AX, f"feat JOIN sl USING (symbol, session, slot) JOIN {_values(AX)} ON k = slope_bars",
     "p_close - p_vwap < -stretch_atr * atr AND close > p_high AND abs(slope) <= max_slope_atr * atr",
     "p_close - p_vwap > stretch_atr * atr AND close < p_low AND abs(slope) <= max_slope_atr * atr", {"sl": _union(slopes, AX["slope_bars"])})
AX = {"fast": [2, 4], "slow": [6, 9], "slope_bars": [1, 2], "slope_atr": [0.0, 0.002], "vwap_filter": [0, 1]}
grid("detect_grid_pullback", H, "trend_pullback", AX, f"x JOIN {_values(AX)} ON nf = fast AND ns = slow AND ks = slope_bars",
     "ef > es AND slope > slope_atr * atr AND p_close <= pf AND close > ef AND (vwap_filter = 0 OR close > vwap)",
     "ef < es AND slope < -slope_atr * atr AND p_close >= pf AND close < ef AND (vwap_filter = 0 OR close < vwap)",
     {"obs": OBS, "em": _union(means, [*AX["fast"], *AX["slow"]]), "ml": _union(lambda k: f"SELECT *, {k} AS k, lag(e) OVER o AS pe, e - lag(e, {k}) OVER o AS slope FROM em WINDOW o AS (PARTITION BY symbol, session, n ORDER BY slot)", AX["slope_bars"]),
      "x": "SELECT feat.*, f.n AS nf, s.n AS ns, s.k AS ks, f.e AS ef, f.pe AS pf, s.e AS es, s.slope FROM feat JOIN ml f USING (symbol, session, slot) JOIN ml s USING (symbol, session, slot) WHERE f.k = 1"})
