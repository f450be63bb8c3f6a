"""Queries for outcome labels, exits, selection and sizing."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import detect as det
from tidebar.operators import features as feats
from tidebar.operators import outcomes as out
from tidebar.plans import flows, views
from tidebar.plans.flows import away
from tidebar.plans.oracle import pick, with_ctes
from tidebar.plans.q_ingest import K
from tidebar.plans.q_windows import H, M
from tidebar.plans.registry import register

OUT = "config_id symbol session slot:i side:i entry_slot:i exit_slot:i entry_px:d exit_px:d pnl_pts:d worst_pts:d stop_pts:d reason is_unknown"
OUTC = OUT.replace(":i", "").replace(":d", "").split()


@register("outcome_barrier", with_ctes(H, pick(OUT, "outc"), flows.outcomes_sql(H)))
def outcome_barrier(spark, sf):
    return flows.outcomes(spark, sf, H).select(*OUTC)


@register("outcome_enriched", with_ctes(M, pick(OUT + " mfe_pts:d mae_pts:d hold_bars:i ambiguous", "outc"), flows.outcomes_sql(M)))
def outcome_enriched(spark, sf):
    return flows.outcomes(spark, sf, M).select(*OUTC, "mfe_pts", "mae_pts", "hold_bars", "ambiguous")


@register("select_non_overlapping", with_ctes(M, pick(OUT, "sel"), {**flows.outcomes_sql(M), **flows.select_sql()}, recursive=True))
def select_non_overlapping(spark, sf):
    return flows.selected(spark, sf).select(*OUTC)


@register("select_one_per_session", with_ctes(H, pick(OUT, "(SELECT *, row_number() OVER (PARTITION BY config_id, symbol, session ORDER BY slot, side) AS rn FROM outc WHERE NOT is_unknown) WHERE rn = 1"), flows.outcomes_sql(H)))
def select_one_per_session(spark, sf):
    return out.one_per_session(flows.outcomes(spark, sf, H), ["config_id", *K]).select(*OUTC)


TRD = "config_id symbol session slot:i side:i instrument qty:i pnl:d worst:d planned_risk:d r_multiple:d exposure:d executed"


@register("size_max_exposure", with_ctes(M, pick(TRD, "trd"), flows.trades_sql(), recursive=True))
def size_max_exposure(spark, sf):
    return flows.trades(spark, sf).select(*TRD.replace(":i", "").replace(":d", "").split())


@register("size_large_first", with_ctes(M, pick("config_id symbol session slot:i instrument qty:i", """(SELECT *, CASE WHEN ql >= 1 THEN 'large' WHEN qs >= 1 THEN 'small' END AS instrument,
 CASE WHEN ql >= 1 THEN ql WHEN qs >= 1 THEN qs ELSE 0 END AS qty FROM (SELECT *, least(4, floor(900 / (stop_pts * 20 + 3.5))) AS ql, least(40, floor(900 / (stop_pts * 2 + 1))) AS qs FROM outc))"""), flows.outcomes_sql(M)))
def size_large_first(spark, sf):
    return out.size_large_first(flows.outcomes(spark, sf, M), F.lit(900.0)).select("config_id", *K, "slot", "instrument", "qty")


# ---- managed exits: window ratchets in SQL against the fold -----------------------

def one_setting(spark, sf, kind, stop=0.2, target=2.0, hold=8):
    e = flows.events_with_atr(spark, sf, kind).filter("signal_id = 0")
    return e.withColumns({"stop_atr": F.lit(stop), "target_r": F.lit(target), "hold": F.lit(hold)})


def managed_sql(kind, cand, pend="false", stop=0.2, target=2.0, hold=8, extra=None, bar_cols=""):
    """Exploded path with the ratchet as a running extreme of candidates known one bar earlier.

    ``cand``: candidate stop after bar k in signed coordinates; ``pend``: exit at the next open."""
    flat = views.MODELS[kind].flat
    b = flows.barrier_sql("ev1", flat)
    keep = {k: b[k] for k in ("bo0", "bo1", "bo2", "bo3", "bo4")}
    x = {**flows.events_sql(kind), **(extra or {}),
         "ev1": f"SELECT *, row_number() OVER () AS eid, {stop} AS stop_atr, {target} AS target_r, {hold} AS hold FROM evb WHERE signal_id = 0", **keep,
         "m0": f"""SELECT e.*, b.slot AS k, b.open AS o, b.high AS h, b.low AS l, b.close AS cl{bar_cols} FROM bo4 e JOIN {'gx' if extra else 'g'} b
 ON b.symbol = e.symbol AND b.session = e.session AND b.slot BETWEEN e.entry_slot AND e.deadline""",
         "m1": "SELECT *, CASE WHEN side > 0 THEN h - entry_px ELSE entry_px - l END AS fav, CASE WHEN side > 0 THEN l - 0.25 - entry_px ELSE entry_px - h - 0.25 END AS adv FROM m0",
         "m2": "SELECT *, greatest(0, max(fav) OVER w) AS mfe, greatest(0, max(side * (cl - entry_px)) OVER w) AS bestc FROM m1 WINDOW w AS (PARTITION BY eid ORDER BY k ROWS UNBOUNDED PRECEDING)",
         "m3": f"SELECT *, side * ({cand}) AS cnd, {pend} AS pnd FROM m2",
         "m4": """SELECT *, side * greatest(side * stop_px, max(cnd) OVER w) AS st, coalesce(bool_or(pnd) OVER w, false) AS pn FROM m3
 WINDOW w AS (PARTITION BY eid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
         "m5": """SELECT *, CASE WHEN o IS NULL THEN 9 WHEN side * (o - st) <= 0 THEN CASE WHEN side * (st - stop_px) > 0 THEN 14 ELSE 11 END WHEN side * (o - target_px) >= 0 THEN 12
 WHEN pn OR k = deadline THEN 3 WHEN (side > 0 AND l <= st) OR (side < 0 AND h >= st) THEN CASE WHEN side * (st - stop_px) > 0 THEN 4 ELSE 1 END
 WHEN (side > 0 AND h >= target_px) OR (side < 0 AND l <= target_px) THEN 2 END AS code FROM m4""",
         "m6": "SELECT eid, min(k) AS xk FROM m5 WHERE code IS NOT NULL GROUP BY 1",
         "m7": """SELECT m.*, CASE WHEN code IN (11, 14, 3) THEN o - side * 0.25 WHEN code IN (12, 2) THEN target_px WHEN code IN (1, 4) THEN st - side * 0.25 END AS px FROM m5 m JOIN m6 ON m.eid = m6.eid AND m.k = m6.xk""",
         "m8": "SELECT p.eid, min(p.adv) AS mae FROM m5 p JOIN m7 x ON x.eid = p.eid AND (p.k < x.k OR (p.k = x.k AND x.code IN (1, 2, 4))) GROUP BY 1",
         "mo": """SELECT e.symbol, e.session, e.slot, e.side, CASE WHEN x.code <> 9 THEN x.k END AS exit_slot, x.px AS exit_px, e.side * (x.px - e.entry_px) AS pnl_pts,
 CASE WHEN x.code <> 9 THEN least(0, m.mae, e.side * (x.px - e.entry_px)) END AS worst_pts,
 CASE WHEN x.code IN (1, 11) THEN 'stop' WHEN x.code IN (4, 14) THEN 'managed' WHEN x.code IN (2, 12) THEN 'target' WHEN x.code = 3 THEN 'time' ELSE 'unknown' END AS reason
 FROM bo4 e LEFT JOIN m7 x USING (eid) LEFT JOIN m8 m USING (eid)"""}
    return with_ctes(kind, pick("symbol session slot:i side:i exit_slot:i exit_px:d pnl_pts:d worst_pts:d reason", "mo"), x)


def managed(name, kind, cand, pend="false", extra=None, bar_cols="", packed=None, **policy):
    register(name, managed_sql(kind, cand, pend, extra=extra, bar_cols=bar_cols))(
        lambda spark, sf: out.managed_outcome(
            one_setting(spark, sf, kind), packed(spark, sf) if packed else out.pack_bars(views.grid(spark, sf, kind)),
            views.MODELS[kind].flat, **policy).select(*K, "slot", "side", "exit_slot", "exit_px", "pnl_pts", "worst_pts", "reason"))


managed("outcome_breakeven", M, f"CASE WHEN mfe / stop_pts >= 0.5 THEN {away('entry_px')} END", be_r=0.5)
managed("outcome_trail_mfe", M, f"CASE WHEN mfe / stop_pts >= 0.5 THEN {away('entry_px + side * mfe - side * 0.4 * stop_pts')} END", trail_act_r=0.5, trail_dist_r=0.4)
managed("outcome_no_progress", M, "NULL", "k - entry_slot + 1 >= 3 AND mfe / stop_pts < 0.8", progress_bars=3, progress_r=0.8)
managed("outcome_close_progress", M, "NULL", "k - entry_slot + 1 = 3 AND bestc < 0.5 * stop_pts", close_bars=3, close_r=0.5)
managed("outcome_vwap_trail", H, away("vw - side * 0.02 * atr"), extra={"gx": "SELECT symbol, session, slot, open, high, low, close, vwap AS vw FROM feat"}, bar_cols=", b.vw",
        packed=lambda spark, sf: out.pack_bars(feats.session_vwap(views.grid(spark, sf, H)), (F.col("vwap").alias("vw"),)), vwap_off=0.02)
managed("outcome_chandelier", M, away("entry_px + side * mfe - side * 0.8 * atn"), extra={
    "gx": """SELECT symbol, session, slot, open, high, low, close, CASE WHEN count(tr1) OVER w >= 3 THEN avg(tr1) OVER w END AS atn FROM (SELECT *,
 greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr1 FROM g WINDOW o AS (PARTITION BY symbol, session ORDER BY slot))
 WINDOW w AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""}, bar_cols=", b.atn",
        packed=lambda spark, sf: out.pack_bars(feats.bar_atr(views.grid(spark, sf, M), 3), (F.col("bar_atr").alias("tr"),)), chand_k=0.8)


@register("outcome_partial_legs", with_ctes(M, pick("symbol session slot:i side:i pnl_pts:d exit_slot:i part_reason rest_reason is_unknown complete", """(SELECT symbol, session, slot, side,
 CASE WHEN count(*) = 2 THEN sum(weight * pnl_pts) END AS pnl_pts, count(*) = 2 AS complete, max(exit_slot) AS exit_slot, max(reason) FILTER (leg = 'part') AS part_reason, max(reason) FILTER (leg = 'rest') AS rest_reason, bool_or(is_unknown) AS is_unknown
 FROM outc GROUP BY 1, 2, 3, 4)"""), {**flows.events_sql(M), "evl": """SELECT e.*, l.*, 0.2 AS stop_atr, 8 AS hold, row_number() OVER () AS eid FROM evb e,
 (VALUES ('part', 0.5, 1.0), ('rest', 0.5, 3.0)) l(leg, weight, target_r) WHERE signal_id = 0""", **flows.barrier_sql("evl", 27)}))
def outcome_partial_legs(spark, sf):
    e = one_setting(spark, sf, M, target=3.0)
    return out.partial_legs(e, out.pack_bars(views.grid(spark, sf, M)), 27, 0.5, 1.0).select(
        *K, "slot", "side", "pnl_pts", "exit_slot", "part_reason", "rest_reason", "is_unknown", "complete")


def limits(spark, sf):
    f = views.feat(spark, sf, H)
    return det.first_breaks(f, 3, F.lit(True), F.lit(True), 21, {
        "limit_px": F.when(F.col("close") > F.col("or_high"), F.col("or_high") - 0.1 * F.col("or_width")).otherwise(F.col("or_low") + 0.1 * F.col("or_width")),
        "cancel_low": F.col("or_low"), "cancel_high": F.col("or_high")})


@register("outcome_limit_fill", with_ctes(H, pick("symbol session side:i slot:i limit_px:d filled fill_slot:i fill_px:d", """(SELECT e.symbol, e.session, e.side, e.slot, e.limit_px, coalesce(x.crossed, false) AS filled,
 CASE WHEN x.crossed THEN x.k END AS fill_slot, CASE WHEN x.crossed THEN CASE WHEN e.side > 0 THEN least(x.o, e.limit_px) ELSE greatest(x.o, e.limit_px) END END AS fill_px
 FROM lim e LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session, side ORDER BY k) AS rn FROM lmb WHERE stopped) WHERE rn = 1) x USING (symbol, session, side))"""), {
    "itc": "SELECT * FROM (SELECT *, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session ORDER BY slot) AS gn FROM feat) WHERE gn = 0",
    "lim": """SELECT symbol, session, CASE WHEN close > or_high THEN 1 ELSE -1 END AS side, min(slot) AS slot, any_value(or_high) AS uh, any_value(or_low) AS ul,
 min(CASE WHEN close > or_high THEN or_high - 0.1 * or_width ELSE or_low + 0.1 * or_width END) AS limit_px FROM itc WHERE atr > 0 AND is_normal AND slot < 21 AND slot >= 3 AND (close > or_high OR close < or_low) GROUP BY 1, 2, 3""",
    "lmb": """SELECT l.symbol, l.session, l.side, b.slot AS k, b.open AS o, coalesce(CASE WHEN side > 0 THEN b.low <= limit_px - 0.25 ELSE b.high >= limit_px + 0.25 END, false) AS crossed,
 b.open IS NULL OR CASE WHEN side > 0 THEN b.low <= limit_px - 0.25 OR b.close < ul ELSE b.high >= limit_px + 0.25 OR b.close > uh END AS stopped
 FROM lim l JOIN g b ON b.symbol = l.symbol AND b.session = l.session AND b.slot > l.slot AND b.slot <= least(22, l.slot + 6)"""}))
def outcome_limit_fill(spark, sf):
    return out.limit_fill(limits(spark, sf), out.pack_bars(views.grid(spark, sf, H)), 6, 23).select(
        *K, "side", "slot", "limit_px", "filled", "fill_slot", "fill_px")


BADX = {"bad0": """SELECT *, CASE WHEN count(ret) OVER w >= 2 THEN sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) OVER w END AS dv, CASE WHEN count(ret) OVER w >= 2 THEN sum(CASE WHEN ret > 0 THEN ret * ret ELSE 0 END) OVER w END AS uv
 FROM feat WINDOW w AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
        "bad1": """SELECT *, CASE WHEN count(dv) OVER k >= 4 THEN quantile_cont(dv, 0.5) OVER k END AS dq, CASE WHEN count(uv) OVER k >= 4 THEN quantile_cont(uv, 0.5) OVER k END AS uq
 FROM bad0 WINDOW k AS (PARTITION BY symbol, slot ORDER BY session ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
        "bad": "SELECT symbol, session, slot, open, dv + uv > 0 AND dv / nullif(dv + uv, 0) >= 0.6 AND dv > dq AS bl, dv + uv > 0 AND uv / nullif(dv + uv, 0) >= 0.6 AND uv > uq AS bs FROM bad1"}


@register("outcome_adverse_cut", with_ctes(M, pick("config_id symbol session slot:i side:i cut_slot:i cut_pnl_pts:d", """(SELECT o.config_id, o.symbol, o.session, o.slot, o.side, c.cs AS cut_slot,
 CASE WHEN n.open IS NOT NULL THEN 0.5 * o.side * (n.open - o.entry_px) + 0.5 * o.pnl_pts ELSE o.pnl_pts END AS cut_pnl_pts FROM (SELECT * FROM outc WHERE NOT is_unknown) o
 LEFT JOIN (SELECT o.eid, min(b.slot) + 1 AS cs FROM outc o JOIN bad b ON b.symbol = o.symbol AND b.session = o.session AND b.slot >= o.entry_slot + 1 AND b.slot < o.exit_slot AND CASE WHEN o.side > 0 THEN b.bl ELSE b.bs END GROUP BY 1) c USING (eid)
 LEFT JOIN g n ON n.symbol = o.symbol AND n.session = o.session AND n.slot = c.cs)"""), {**flows.outcomes_sql(M), **BADX}))
def outcome_adverse_cut(spark, sf):
    f = feats.adverse_semivariance(views.base(spark, sf, M), 2, 10, 4, 0.5)
    tot = F.nullif(F.col("down_var") + F.col("up_var"), F.lit(0.0))
    bad_l = F.coalesce((F.try_divide("down_var", tot) >= 0.6) & (F.col("down_var") > F.col("down_q")), F.lit(False))
    bad_s = F.coalesce((F.try_divide("up_var", tot) >= 0.6) & (F.col("up_var") > F.col("up_q")), F.lit(False))
    packed = out.pack_bars(f, (bad_l.alias("bad_long"), bad_s.alias("bad_short")))
    o = flows.outcomes(spark, sf, M).filter("NOT is_unknown")
    return out.adverse_cut(o, packed, 0.6, 1, 0.5).select("config_id", *K, "slot", "side", "cut_slot", "cut_pnl_pts")


STOPS = ("OPPOSITE", "MID", "WIDTH_0.5", "WIDTH_1.0", "ATR_1.0", "ATR_1.5")


@register("outcome_stop_ref", with_ctes(H, pick("symbol session spec stop_px:d risk_pts:d", """(SELECT *, side * (px - stop_px) AS risk_pts FROM (SELECT symbol, session, spec, side, close AS px, CASE spec WHEN 'OPPOSITE' THEN CASE WHEN side > 0 THEN or_low ELSE or_high END
 WHEN 'MID' THEN (or_high + or_low) / 2 WHEN 'WIDTH_0.5' THEN close - side * 0.5 * or_width WHEN 'WIDTH_1.0' THEN close - side * or_width WHEN 'ATR_1.0' THEN close - side * atr ELSE close - side * 1.5 * atr END AS stop_px
 FROM (SELECT *, CASE WHEN close > or_high THEN 1 ELSE -1 END AS side FROM feat WHERE slot = 10 AND atr > 0 AND (close > or_high OR close < or_low)), (VALUES ('OPPOSITE'), ('MID'), ('WIDTH_0.5'), ('WIDTH_1.0'), ('ATR_1.0'), ('ATR_1.5')) v(spec)))""")))
def outcome_stop_ref(spark, sf):
    f = views.base(spark, sf, H).filter("slot = 10 AND atr > 0 AND (close > or_high OR close < or_low)")
    f = f.withColumn("side", F.when(F.col("close") > F.col("or_high"), 1).otherwise(-1)).withColumn(
        "spec", F.explode(F.array(*[F.lit(s) for s in STOPS])))
    px = out.stop_ref(F.col("spec"), F.col("side"), F.col("close"), F.col("or_high"), F.col("or_low"), F.col("atr"))
    return f.withColumn("stop_px", px).select(*K, "spec", "stop_px", (F.col("side") * (F.col("close") - F.col("stop_px"))).alias("risk_pts"))


@register("outcome_round_tick", """SELECT CAST(event_id AS BIGINT) AS event_id, round(floor(value * 4 + 1e-8) / 4 + 3e-10, 6) + 0.0 AS long_px, round(ceil(value * 4 - 1e-8) / 4 + 3e-10, 6) + 0.0 AS short_px FROM events""")
def outcome_round_tick(spark, sf):
    t = views.table(spark, sf, "events")
    return t.select("event_id", out.away_tick(F.col("value"), F.lit(1)).alias("long_px"), out.away_tick(F.col("value"), F.lit(-1)).alias("short_px"))


@register("outcome_inside_entry", with_ctes(H, pick("config_id symbol session slot:i side:i location", """(SELECT *, CASE WHEN v <= 0.25 THEN 'origin' WHEN v >= 0.75 THEN 'destination' ELSE 'interior' END AS location FROM
 (SELECT o.config_id, o.symbol, o.session, o.slot, o.side, o.entry_px, o.stop_pts, r.hi, r.lo, CASE WHEN o.side > 0 THEN (o.entry_px - r.lo) / (r.hi - r.lo) ELSE (r.hi - o.entry_px) / (r.hi - r.lo) END AS v
 FROM outc o JOIN (SELECT DISTINCT symbol, session, or_high AS hi, or_low AS lo FROM feat WHERE or_high IS NOT NULL) r USING (symbol, session))
 WHERE entry_px > lo AND entry_px < hi AND side * (CASE WHEN side > 0 THEN hi ELSE lo END - entry_px) / stop_pts >= 0.5) WHERE location = 'interior'"""), flows.outcomes_sql(H)))
def outcome_inside_entry(spark, sf):
    r = feats.opening_ranges(views.grid(spark, sf, H), [3]).select(*K, "or_high", "or_low")
    o = flows.outcomes(spark, sf, H).join(r, K)
    return out.inside_entry_checks(o, 0.5, "interior").select("config_id", *K, "slot", "side", "location")


@register("outcome_stress", with_ctes(M, """SELECT config_id, round(stress_slip + 3e-10, 6) + 0.0 AS stress_slip, CAST(count(*) AS BIGINT) AS trades,
 round(sum(pnl_pts - CASE WHEN reason = 'target' THEN 1 ELSE 2 END * (stress_slip - 0.25)) + 3e-10, 6) + 0.0 AS net_pts FROM sel, (VALUES (0.25), (0.5), (0.75)) v(stress_slip) GROUP BY 1, 2""",
 {**flows.outcomes_sql(M), **flows.select_sql()}, recursive=True))
def outcome_stress(spark, sf):
    return out.stress(flows.selected(spark, sf), [0.25, 0.5, 0.75]).groupBy("config_id", "stress_slip").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl_pts").alias("net_pts"))


@register("outcome_delay", with_ctes(M, pick("symbol session slot:i side:i pnl_pts:d reason", "outc"), {**flows.events_sql(M),
          "evd": "SELECT * REPLACE (slot + 1 AS slot), 0.2 AS stop_atr, 2.0 AS target_r, 8 AS hold, row_number() OVER () AS eid FROM evb WHERE signal_id = 0", **flows.barrier_sql("evd", 27)}))
def outcome_delay(spark, sf):
    """Entry one bar later than signalled."""
    e = one_setting(spark, sf, M).withColumn("slot", F.col("slot") + 1)
    return out.barrier_outcome(e, out.pack_bars(views.grid(spark, sf, M)), 27).select(*K, "slot", "side", "pnl_pts", "reason")


@register("outcome_ambiguity", with_ctes(M, """SELECT config_id, CAST(count(*) FILTER (ambiguous) AS BIGINT) AS ambiguous_exits, CAST(count(*) FILTER (is_unknown) AS BIGINT) AS unknown_paths,
 CAST(count(DISTINCT CASE WHEN ambiguous THEN session END) AS BIGINT) AS ambiguous_sessions FROM outc GROUP BY 1""", flows.outcomes_sql(M)))
def outcome_ambiguity(spark, sf):
    return flows.outcomes(spark, sf, M).groupBy("config_id").agg(
        F.count_if("ambiguous").alias("ambiguous_exits"), F.count_if("is_unknown").alias("unknown_paths"),
        F.count_distinct(F.when(F.col("ambiguous"), F.col("session"))).alias("ambiguous_sessions"))


@register("flow_opening_breakout", with_ctes(H, """SELECT symbol, CAST(count(*) AS BIGINT) AS trades, round(sum(pnl) + 3e-10, 6) + 0.0 AS net, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) + 3e-10, 6) + 0.0 AS gross_win,
 round(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) + 3e-10, 6) + 0.0 AS gross_loss, CAST(count(*) FILTER (reason = 'stop') AS BIGINT) AS stops, CAST(count(*) FILTER (reason = 'target') AS BIGINT) AS targets FROM fl2 GROUP BY 1""", {
    "fev": "SELECT symbol, session, min(slot) AS slot, arg_min(side, slot) AS side, any_value(atr) AS atr FROM (SELECT *, CASE WHEN close > or_high THEN 1 ELSE -1 END AS side FROM feat WHERE slot >= 3 AND slot < 22 AND atr > 0 AND is_normal AND (close > or_high OR close < or_low)) GROUP BY 1, 2",
    "fe1": "SELECT *, 0.2 AS stop_atr, 1.5 AS target_r, 8 AS hold, row_number() OVER () AS eid FROM fev", **flows.barrier_sql("fe1", 23),
    "fl0": "SELECT *, {} AS instrument, {} AS qty FROM outc WHERE NOT is_unknown".format(*flows.size_sql("300")), "fl1": flows.money_sql("fl0"), "fl2": "SELECT * FROM fl1 WHERE qty > 0"}))
def flow_opening_breakout(spark, sf):
    """Flagship: opening range, ATR, first close break, barrier label, sizing, costs, totals per symbol."""
    f = views.feat(spark, sf, H)
    ev = det.first_event(det.detect(f, "range_break", 22, length=3))
    ev = ev.join(views.daily(spark, sf, H).select(*K, "atr"), K).withColumns(
        {"stop_atr": F.lit(0.2), "target_r": F.lit(1.5), "hold": F.lit(8)}).drop("entry_slot")
    o = out.barrier_outcome(ev, out.pack_bars(views.grid(spark, sf, H)), 23).filter("NOT is_unknown")
    t = out.net_pnl(out.size_max_exposure(o, F.lit(300.0))).filter("qty > 0")
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0), F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0)
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("net"), F.sum(win).alias("gross_win"),
                                   F.sum(loss).alias("gross_loss"), F.count_if(F.col("reason") == "stop").alias("stops"),
                                   F.count_if(F.col("reason") == "target").alias("targets"))
