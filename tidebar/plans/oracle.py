"""Shared DuckDB common table expressions for the oracle strings."""
from __future__ import annotations

import re

BARS = {
    "hourly": """SELECT event_type AS symbol, CAST(ts AS DATE) AS session, CAST(hour(ts) AS INTEGER) AS slot,
 first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
 last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2, 3""",
    "monthly": """SELECT o_orderpriority AS symbol, CAST(date_trunc('month', o_orderdate) AS DATE) AS session,
 CAST(day(o_orderdate) - 1 AS INTEGER) AS slot, first(o_totalprice / 1000 ORDER BY o_orderkey) AS open,
 max(o_totalprice / 1000) AS high, min(o_totalprice / 1000) AS low,
 last(o_totalprice / 1000 ORDER BY o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM orders GROUP BY 1, 2, 3""",
}
CAL = {
    "hourly": """SELECT symbol, session, CASE WHEN dayofweek(session) = 0 THEN 12 ELSE 24 END AS close_slot, dayofweek(session) <> 0 AS is_normal
 FROM (SELECT symbol, CAST(unnest(generate_series((SELECT min(session) FROM bars), (SELECT max(session) FROM bars), INTERVAL 1 DAY)) AS DATE) AS session FROM bars GROUP BY symbol)""",
    "monthly": """SELECT symbol, session, CAST(day(last_day(session)) AS INTEGER) AS close_slot, day(last_day(session)) >= 30 AS is_normal
 FROM (SELECT symbol, CAST(unnest(generate_series((SELECT min(session) FROM bars), (SELECT max(session) FROM bars), INTERVAL 1 MONTH)) AS DATE) AS session FROM bars GROUP BY symbol)""",
}
CTES = {
    "g": """SELECT k.symbol, k.session, k.slot, k.close_slot, k.is_normal, b.open, b.high, b.low, b.close, b.volume
 FROM (SELECT c.*, CAST(u.slot AS INTEGER) AS slot FROM cal c, range(40) u(slot) WHERE u.slot < c.close_slot) k
 LEFT JOIN bars b USING (symbol, session, slot)""",
    "daily0": """SELECT symbol, session, arg_min(open, slot) AS day_open, max(high) AS day_high, min(low) AS day_low,
 arg_max(close, slot) AS day_close, sum(volume) AS day_volume, count(open) AS day_bars FROM g GROUP BY 1, 2""",
    "daily1": """SELECT *, lag(day_open) OVER w AS prev_open, lag(day_high) OVER w AS prev_high, lag(day_low) OVER w AS prev_low,
 lag(day_close) OVER w AS prev_close, lag(day_high, 2) OVER w AS prev2_high, lag(day_low, 2) OVER w AS prev2_low
 FROM daily0 WINDOW w AS (PARTITION BY symbol ORDER BY session)""",
    "daily2": """SELECT *, prev_close / nullif(prev_open, 0) - 1 AS prev_ret, day_open / nullif(prev_close, 0) - 1 AS gap,
 day_close / nullif(prev_close, 0) - 1 AS day_ret,
 greatest(day_high - day_low, abs(day_high - prev_close), abs(day_low - prev_close)) AS tr FROM daily1""",
    "daily": """SELECT *, CASE WHEN count(tr) OVER p >= 3 THEN avg(tr) OVER p END AS atr,
 CASE WHEN count(day_ret) OVER p >= 3 THEN stddev_pop(day_ret) OVER p END AS vol
 FROM daily2 WINDOW p AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    "orng": """SELECT symbol, session, max(high) AS or_high, min(low) AS or_low, arg_min(open, slot) AS or_open,
 arg_max(close, slot) AS or_close, sum(volume) AS or_volume, count(open) AS or_bars
 FROM g WHERE slot < 3 GROUP BY 1, 2""",
    "feat0": """SELECT g.*, d.* EXCLUDE (symbol, session), r.or_open, r.or_close, r.or_volume,
 CASE WHEN r.or_bars >= 2 AND r.or_high > r.or_low THEN r.or_high END AS or_high,
 CASE WHEN r.or_bars >= 2 AND r.or_high > r.or_low THEN r.or_low END AS or_low,
 CASE WHEN r.or_bars >= 2 AND r.or_high > r.or_low THEN r.or_high - r.or_low END AS or_width,
 CASE WHEN r.or_bars >= 2 AND r.or_high > r.or_low THEN (r.or_high + r.or_low) / 2 END AS or_mid,
 sum((g.high + g.low + g.close) / 3 * g.volume) OVER w / nullif(sum(g.volume) OVER w, 0) AS vwap,
 lag(g.high) OVER o AS p_high, lag(g.low) OVER o AS p_low, lag(g.close) OVER o AS p_close,
 CASE WHEN g.close > 0 AND lag(g.close) OVER o > 0 THEN ln(g.close / lag(g.close) OVER o) END AS ret,
 sum(g.volume) OVER w AS cum_volume, max(g.high) OVER w AS run_high, min(g.low) OVER w AS run_low,
 CASE WHEN count(g.high) OVER p3 >= 3 THEN max(g.high) OVER p3 END AS hi3,
 CASE WHEN count(g.low) OVER p3 >= 3 THEN min(g.low) OVER p3 END AS lo3,
 CASE WHEN count(g.high) OVER p5 >= 5 THEN max(g.high) OVER p5 END AS hi5,
 CASE WHEN count(g.low) OVER p5 >= 5 THEN min(g.low) OVER p5 END AS lo5
 FROM g JOIN daily d USING (symbol, session) JOIN orng r USING (symbol, session)
 WINDOW o AS (PARTITION BY g.symbol, g.session ORDER BY g.slot),
 w AS (PARTITION BY g.symbol, g.session ORDER BY g.slot ROWS UNBOUNDED PRECEDING),
 p3 AS (PARTITION BY g.symbol, g.session ORDER BY g.slot ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
 p5 AS (PARTITION BY g.symbol, g.session ORDER BY g.slot ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
    "feat1": """SELECT *, lag(vwap) OVER o AS p_vwap, vwap - lag(vwap, 2) OVER o AS vwap_slope,
 lag(hi3) OVER o AS p_hi3, lag(lo3) OVER o AS p_lo3, lag(hi5) OVER o AS p_hi5, lag(lo5) OVER o AS p_lo5,
 abs(close / nullif(day_open, 0) - 1) AS mv FROM feat0
 WINDOW o AS (PARTITION BY symbol, session ORDER BY slot)""",
    "feat": """SELECT *, CASE WHEN count(volume) OVER k >= 3 THEN
  (volume - avg(volume) OVER k) / nullif(stddev_pop(volume) OVER k, 0) END AS volume_z,
 CASE WHEN count(mv) OVER k >= 3 THEN avg(mv) OVER k END AS noise,
 CASE WHEN count(ret) OVER k >= 3 THEN (ret - avg(ret) OVER k) / nullif(stddev_samp(ret) OVER k, 0) END AS ret_z
 FROM feat1 WINDOW k AS (PARTITION BY symbol, slot ORDER BY session ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
}
ORDER = ["bars", "cal", *CTES]


def with_ctes(kind: str, body: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``WITH`` every shared or extra expression that ``body`` reaches, in order."""
    known = {"bars": BARS[kind], "cal": CAL[kind], **CTES, **(extra or {})}
    need: set[str] = set()

    def reach(text):
        for w in set(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)):
            if w in known and w not in need and re.search(rf"\b(FROM|JOIN|,)\s+{w}\b", text):
                need.add(w)
                reach(known[w])

    reach(body)
    parts = [f"{n} AS ({known[n]})" for n in known if n in need]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def pick(spec: str, source: str) -> str:
    """Typed report columns: ``name`` as is, ``name:i`` as BIGINT, ``name:d`` rounded double."""
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        if kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "d":
            out.append(f"round(CAST({name} AS DOUBLE) + 3e-10, 6) + 0.0 AS {name}")
        else:
            out.append(name)
    return f"SELECT {', '.join(out)} FROM {source}"
