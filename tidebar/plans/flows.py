"""Composed flows: events, outcomes, selected trades; with the matching SQL expressions."""
from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators import detect as det
from tidebar.operators import outcomes as out
from tidebar.plans import views
from tidebar.sources.scratch import materialize

KEYS = ["symbol", "session"]
LAST = {"hourly": 22, "monthly": 26, "quarter": 93}
EXEC = {"stop_atr": [0.1, 0.2], "target_r": [0.0, 2.0], "hold": [4, 8]}
SIGNAL = {"lookback": [3, 5], "buffer_atr": [0.0], "vwap_filter": [0], "volume_z": [None]}
WINDOW = (5, 22)


def events_with_atr(spark, sf, kind: str) -> DataFrame:
    """Rolling breakouts of both lookbacks as events with a signal id and the session's ATR."""
    f = views.feat(spark, sf, kind)
    grid = det.detect_grid(f, "rolling_breakout", LAST[kind], SIGNAL, ("atr",))
    return grid.select(*KEYS, "slot", "side", "signal_id", "atr")


def exec_settings(execution: dict) -> list[dict]:
    return [{"exec_id": i, **dict(zip(execution, v))} for i, v in enumerate(product(*execution.values()))]


def outcomes(spark, sf, kind: str) -> DataFrame:
    """Events labelled under every execution setting; ``exec_id`` numbers the settings."""
    packed = out.pack_bars(views.grid(spark, sf, kind))
    o = out.barrier_outcome(events_with_atr(spark, sf, kind), packed, views.MODELS[kind].flat, settings=exec_settings(EXEC))
    return o.withColumn("config_id", F.format_string("c%02d-%02d", "signal_id", "exec_id"))


def labelled(spark, sf, kind: str = "monthly") -> DataFrame:
    """Outcomes written once, for queries that read them more than once."""
    return materialize(outcomes(spark, sf, kind), "outcomes")


def selected(spark, sf, kind: str = "monthly", o: DataFrame | None = None) -> DataFrame:
    o = outcomes(spark, sf, kind) if o is None else o
    return out.select_non_overlapping(o, ["config_id", *KEYS], *WINDOW, max_n=3)


def trades(spark, sf, kind: str = "monthly", budget: float = 400.0, o: DataFrame | None = None) -> DataFrame:
    """Selected outcomes sized by budget and costed; unfunded ones stay with quantity 0."""
    t = out.net_pnl(out.size_max_exposure(selected(spark, sf, kind, o), F.lit(budget)))
    return t.withColumns({"year": F.year("session"), "executed": F.col("qty") > 0})


def grid_search(spark, sf, kind: str, signal: dict, execution: dict, window: tuple, max_n: int) -> DataFrame:
    """Every signal setting x every execution setting in one plan, totals per (config, symbol).

    An event that several signals raise is labelled once per execution setting: signals travel as
    an array on the distinct event and are unfolded only by the selection. Labels, selection and
    the partial totals all stay on the (symbol, session) partitioning."""
    f = views.feat(spark, sf, kind)
    ev = det.detect_grid(f, "rolling_breakout", LAST[kind], signal, ("atr",))
    ev = ev.groupBy(*KEYS, "slot", "side").agg(F.first("atr").alias("atr"), F.collect_list("signal_id").alias("signals"))
    o = out.barrier_outcome(ev, out.pack_bars(views.grid(spark, sf, kind)), views.MODELS[kind].flat, settings=exec_settings(execution))
    o = o.select(*KEYS, "slot", "side", "exec_id", "exit_slot", "pnl_pts", "worst_pts", "stop_pts", "is_unknown", "signals")
    s = out.select_shared(o, ["exec_id", *KEYS], *window, max_n=max_n)
    t = out.net_pnl(out.size_max_exposure(s, F.lit(400.0))).filter("qty > 0")
    p = F.col("pnl")
    return t.groupBy("signal_id", "exec_id", "symbol").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("net"), F.min("worst").alias("worst"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gross_win"), F.sum(F.when(p < 0, -p).otherwise(0.0)).alias("gross_loss"))


# ---- SQL twins -------------------------------------------------------------------

def tick(x, up):
    return f"(floor(({x}) / 0.25 + 1e-8) * 0.25)" if up else f"(ceil(({x}) / 0.25 - 1e-8) * 0.25)"


def away(x):
    return f"(CASE WHEN side > 0 THEN {tick(x, True)} ELSE {tick(x, False)} END)"


def barrier_sql(events: str, flat: int, slip: float = 0.25) -> dict[str, str]:
    """Labels by exploding events to bars and taking the first deciding bar. ``events`` needs an ``eid``."""
    return {
        "bo0": f"""SELECT e.*, e.slot + 1 AS entry_slot, n.open + e.side * {slip} AS entry_px FROM {events} e
 JOIN g n ON n.symbol = e.symbol AND n.session = e.session AND n.slot = e.slot + 1 WHERE n.open IS NOT NULL AND e.atr IS NOT NULL AND e.slot + 1 < {flat}""",
        "bo1": f"SELECT *, {away('entry_px - side * stop_atr * atr')} AS stop_px FROM bo0",
        "bo2": f"SELECT *, side * (entry_px - stop_px) AS stop_pts, least({flat}, entry_slot + hold) AS deadline FROM bo1 WHERE side * (entry_px - stop_px) > 0",
        "bo3": f"SELECT *, CASE WHEN target_r > 0 THEN {away('entry_px + side * target_r * stop_pts')} END AS target_px FROM bo2",
        "bo4": "SELECT * FROM bo3 WHERE target_px IS NULL OR side * (target_px - entry_px) > 0",
        "bo5": """SELECT e.eid, e.side, e.entry_px, e.stop_px, e.target_px, b.slot AS k, b.open AS o, b.high AS h, b.low AS l,
 CASE WHEN b.open IS NULL THEN 9 WHEN e.side * (b.open - e.stop_px) <= 0 THEN 11 WHEN e.side * (b.open - e.target_px) >= 0 THEN 12 WHEN b.slot = e.deadline THEN 3
 WHEN (e.side > 0 AND b.low <= e.stop_px) OR (e.side < 0 AND b.high >= e.stop_px) THEN
  CASE WHEN (e.side > 0 AND b.high >= e.target_px) OR (e.side < 0 AND b.low <= e.target_px) THEN 21 ELSE 1 END
 WHEN (e.side > 0 AND b.high >= e.target_px) OR (e.side < 0 AND b.low <= e.target_px) THEN 2 END AS code
 FROM bo4 e JOIN g b ON b.symbol = e.symbol AND b.session = e.session AND b.slot BETWEEN e.entry_slot AND e.deadline""",
        "bo6": "SELECT eid, min(k) AS k FROM bo5 WHERE code IS NOT NULL GROUP BY 1",
        "bo7": "SELECT b.eid, b.k, b.code, b.o FROM bo5 b JOIN bo6 USING (eid, k)",
        "bo8": f"""SELECT b.eid, min(CASE WHEN b.side > 0 THEN b.l - {slip} - b.entry_px ELSE b.entry_px - b.h - {slip} END) AS mae,
 max(CASE WHEN b.side > 0 THEN b.h - b.entry_px ELSE b.entry_px - b.l END) AS mfe FROM bo5 b JOIN bo7 x USING (eid) WHERE b.k < x.k OR (b.k = x.k AND x.code IN (1, 2, 21)) GROUP BY 1""",
        "bo9": f"""SELECT e.*, coalesce(x.code, 9) AS code, CASE WHEN x.code <> 9 THEN x.k END AS exit_slot,
 CASE WHEN x.code IN (11, 3) THEN x.o - e.side * {slip} WHEN x.code IN (12, 2) THEN e.target_px WHEN x.code IN (1, 21) THEN e.stop_px - e.side * {slip} END AS exit_px, m.mae, m.mfe
 FROM bo4 e LEFT JOIN bo7 x USING (eid) LEFT JOIN bo8 m USING (eid)""",
        "outc": """SELECT *, side * (exit_px - entry_px) AS pnl_pts, CASE WHEN code <> 9 THEN least(0, mae, side * (exit_px - entry_px)) END AS worst_pts,
 CASE WHEN code <> 9 THEN least(0, mae) END AS mae_pts, CASE WHEN code <> 9 THEN greatest(0, mfe) END AS mfe_pts,
 CASE WHEN code IN (1, 11, 21) THEN 'stop' WHEN code IN (2, 12) THEN 'target' WHEN code = 3 THEN 'time' ELSE 'unknown' END AS reason,
 exit_slot - entry_slot AS hold_bars, code = 21 AS ambiguous, code = 9 AS is_unknown FROM bo9"""}


def events_sql(kind: str) -> dict[str, str]:
    last = LAST[kind]
    return {
        "evb": f"""SELECT * FROM (SELECT symbol, session, slot, signal_id, atr, CASE WHEN close > hi AND p_close <= phi THEN 1 WHEN close < lo AND p_close >= plo THEN -1 END AS side FROM
 (SELECT symbol, session, slot, close, p_close, atr, is_normal, 0 AS signal_id, hi3 AS hi, lo3 AS lo, p_hi3 AS phi, p_lo3 AS plo FROM feat
 UNION ALL SELECT symbol, session, slot, close, p_close, atr, is_normal, 1, hi5, lo5, p_hi5, p_lo5 FROM feat) WHERE atr > 0 AND is_normal AND slot < {last}) WHERE side IS NOT NULL""",
        "exe": "SELECT row_number() OVER (ORDER BY a.v, t.v, h.v) - 1 AS exec_id, a.v AS stop_atr, t.v AS target_r, h.v AS hold FROM (VALUES (0.1), (0.2)) a(v), (VALUES (0.0), (2.0)) t(v), (VALUES (4), (8)) h(v)",
        "eve": "SELECT *, row_number() OVER () AS eid, 'c' || lpad(CAST(signal_id AS VARCHAR), 2, '0') || '-' || lpad(CAST(exec_id AS VARCHAR), 2, '0') AS config_id FROM evb, exe"}


def outcomes_sql(kind: str) -> dict[str, str]:
    flat = views.MODELS[kind].flat
    return {**events_sql(kind), **barrier_sql("eve", flat)}


def select_sql(source: str = "outc", max_n: int = 3, window=WINDOW, group: str = "config_id", cooldown: int = 0) -> dict[str, str]:
    """Greedy choice by recursion over the candidates of a session."""
    g = [x.strip() for x in group.split(",")]
    keys = ", ".join(g)
    on = " AND ".join(f"c.{x} = s.{x}" for x in g)
    return {
        "sc0": f"""SELECT *, row_number() OVER (PARTITION BY {keys}, symbol, session ORDER BY slot, side) AS rn FROM {source}
 WHERE NOT is_unknown AND slot >= {window[0]} AND slot < {window[1]}""",
        "scr": f"""SELECT {keys}, symbol, session, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS free, 0 AS used, false AS taken FROM (SELECT DISTINCT {keys}, symbol, session FROM sc0)
 UNION ALL SELECT {', '.join('c.' + x for x in g)}, c.symbol, c.session, c.rn, CAST(CASE WHEN c.slot > s.free AND s.used < {max_n} THEN c.exit_slot + {cooldown} ELSE s.free END AS BIGINT),
 CASE WHEN c.slot > s.free AND s.used < {max_n} THEN s.used + 1 ELSE s.used END, c.slot > s.free AND s.used < {max_n}
 FROM scr s JOIN sc0 c ON {on} AND c.symbol = s.symbol AND c.session = s.session AND c.rn = s.rn + 1""",
        "sel": f"SELECT c.* FROM sc0 c JOIN scr s USING ({keys}, symbol, session, rn) WHERE s.taken"}


def size_sql(budget: str = "400", slip: float = 0.25) -> tuple[str, str]:
    ql = f"least(4, floor({budget} / ((stop_pts + {slip}) * 20 + 3.5)))"
    qs = f"least(40, floor({budget} / ((stop_pts + {slip}) * 2 + 1)))"
    inst = f"CASE WHEN {ql} * 20 >= {qs} * 2 AND {ql} > 0 THEN 'large' WHEN {qs} > 0 THEN 'small' END"
    qty = f"CASE WHEN {ql} * 20 >= {qs} * 2 AND {ql} > 0 THEN {ql} WHEN {qs} > 0 THEN {qs} ELSE 0 END"
    return inst, qty


def money_sql(source: str, slip: float = 0.25) -> str:
    v, f = "CASE WHEN instrument = 'large' THEN 20 ELSE 2 END", "CASE WHEN instrument = 'large' THEN 3.5 ELSE 1 END"
    return f"""SELECT *, pnl / nullif(planned_risk, 0) AS r_multiple FROM (SELECT *, qty * (pnl_pts * {v} - {f}) AS pnl, qty * (worst_pts * {v} - {f}) AS worst,
 qty * ((stop_pts + {slip}) * {v} + {f}) AS planned_risk, qty * CASE WHEN instrument = 'large' THEN 10.0 ELSE 1.0 END AS exposure FROM {source})"""


def trades_sql(kind: str = "monthly") -> dict[str, str]:
    inst, qty = size_sql()
    return {**outcomes_sql(kind), **select_sql(),
            "sz": f"SELECT *, {inst} AS instrument, {qty} AS qty FROM sel",
            "trd0": money_sql("sz"),
            "trd": "SELECT *, year(session) AS year, qty > 0 AS executed FROM trd0",
            "dpl": "SELECT config_id, session, sum(pnl) AS pnl, count(*) AS entries FROM trd WHERE executed GROUP BY 1, 2"}
