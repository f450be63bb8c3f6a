"""Queries for trade statistics, path windows, screens and rankings."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import stats as st
from tidebar.plans import flows, views
from tidebar.plans.flows import KEYS
from tidebar.plans.oracle import pick, with_ctes
from tidebar.plans.q_windows import M
from tidebar.plans.registry import register
from tidebar.sources.scratch import materialize
from tidebar.plans.views import TEST, TRAIN, VALIDATE

R = "config_id, symbol"
T = flows.trades_sql()
AGG = """count(*) AS trades, sum(pnl) AS net, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 0) AS profit_factor,
 avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl) AS avg_trade, avg(r_multiple) AS avg_r, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win,
 coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS avg_loss, max(pnl) AS largest_win, min(pnl) AS largest_loss"""
AGGC = "trades:i net:d profit_factor:d win_rate:d avg_trade:d avg_r:d avg_win:d avg_loss:d largest_win:d largest_loss:d"
EXE = {**T, "ex": "SELECT * FROM trd WHERE executed"}


def sq(cols, body, extra=None):
    return with_ctes(M, pick(cols, f"({body})"), {**EXE, **(extra or {})}, recursive=True)


def trades(spark, sf):
    return flows.trades(spark, sf).filter("executed")


def daily(spark, sf):
    return trades(spark, sf).groupBy("config_id", "symbol", "session").agg(
        F.sum("pnl").alias("pnl"), F.sum("worst").alias("worst"), F.count(F.lit(1)).alias("entries"))


DAYS = {"dy": "SELECT config_id, symbol, session, sum(pnl) AS pnl, sum(worst) AS worst, count(*) AS entries FROM ex GROUP BY 1, 2, 3"}


@register("stat_trades", sq(f"config_id symbol {AGGC}", f"SELECT {R}, {AGG} FROM ex GROUP BY 1, 2"))
def stat_trades(spark, sf):
    return st.trade_stats(trades(spark, sf))


@register("stat_long_short", sq("config_id symbol long_net:d short_net:d", f"SELECT {R}, sum(CASE WHEN side > 0 THEN pnl ELSE 0 END) AS long_net, sum(CASE WHEN side < 0 THEN pnl ELSE 0 END) AS short_net FROM ex GROUP BY 1, 2"))
def stat_long_short(spark, sf):
    return st.long_short_split(trades(spark, sf))


@register("stat_uncertainty", sq("config_id symbol ambiguous:i unknown:i size_skips:i", f"SELECT {R}, count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (is_unknown) AS unknown, count(*) FILTER (qty = 0) AS size_skips FROM trd GROUP BY 1, 2"))
def stat_uncertainty(spark, sf):
    return st.uncertainty_flags(flows.trades(spark, sf))


PTH = {"pd0": "SELECT *, 'all' AS period FROM ex UNION ALL SELECT *, CAST(year AS VARCHAR) FROM ex",
       "pd1": "SELECT *, sum(pnl) OVER w AS eq FROM pd0 WINDOW w AS (PARTITION BY config_id, symbol, period ORDER BY session, slot, side ROWS UNBOUNDED PRECEDING)",
       "pd2": """SELECT *, greatest(0, max(eq) OVER w) AS pk, greatest(0, max(eq) OVER v) AS pb FROM pd1 WINDOW w AS (PARTITION BY config_id, symbol, period ORDER BY session, slot, side ROWS UNBOUNDED PRECEDING),
 v AS (PARTITION BY config_id, symbol, period ORDER BY session, slot, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
       "pst": f"SELECT {R}, period, {AGG}, least(0, min(eq - pk), min(eq - pnl + worst - pb)) AS max_drawdown FROM pd2 GROUP BY 1, 2, 3"}


@register("stat_path", sq(f"config_id symbol period {AGGC} max_drawdown:d profit_to_dd:d", "SELECT *, net / abs(nullif(max_drawdown, 0)) AS profit_to_dd FROM pst", PTH))
def stat_path(spark, sf):
    return st.path_stats(flows.trades(spark, sf))


def split_sql():
    """Independent of the window form: running sums by self-join inside each split."""
    case = f"CASE WHEN year IN {TRAIN} THEN 'train' WHEN year IN {VALIDATE} THEN 'validate' ELSE 'test' END"
    per = []
    for t in ("train", "validate", "test"):
        per += [f"coalesce(max(n) FILTER (period = '{t}'), 0) AS trades_{t}", f"coalesce(max(net) FILTER (period = '{t}'), 0) AS net_{t}",
                f"coalesce(max(dd) FILTER (period = '{t}'), 0) AS mdd_{t}", f"max(gw) FILTER (period = '{t}') / nullif(max(gl) FILTER (period = '{t}'), 0) AS pf_{t}"]
    return {
        "wp0": f"SELECT *, row_number() OVER (PARTITION BY {R}, period ORDER BY session, slot, side) AS i FROM (SELECT *, 'all' AS period FROM ex UNION ALL SELECT *, {case} FROM ex)",
        "wp1": "SELECT a.config_id, a.symbol, a.period, a.i, any_value(a.pnl) AS pnl, any_value(a.worst) AS worst, sum(b.pnl) AS eq FROM wp0 a JOIN wp0 b ON a.config_id = b.config_id AND a.symbol = b.symbol AND a.period = b.period AND b.i <= a.i GROUP BY 1, 2, 3, 4",
        "wp2": "SELECT a.*, greatest(0, max(b.eq)) AS pk, greatest(0, max(b.eq) FILTER (b.i < a.i)) AS pb FROM wp1 a JOIN wp1 b ON a.config_id = b.config_id AND a.symbol = b.symbol AND a.period = b.period AND b.i <= a.i GROUP BY ALL",
        "wpd": "SELECT config_id, symbol, period, least(0, min(eq - pk), min(eq - pnl + worst - pb)) AS dd FROM wp2 GROUP BY 1, 2, 3",
        "wpa": "SELECT config_id, symbol, period, count(*) AS n, sum(pnl) AS net, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gw, sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) AS gl, avg(r_multiple) AS ar FROM wp0 GROUP BY 1, 2, 3",
        "wide": f"""SELECT config_id, symbol, max(n) FILTER (period = 'all') AS trades, max(net) FILTER (period = 'all') AS net, max(dd) FILTER (period = 'all') AS max_drawdown, max(ar) FILTER (period = 'all') AS avg_r,
 max(gw) FILTER (period = 'all') / nullif(max(gl) FILTER (period = 'all'), 0) AS profit_factor, {', '.join(per)} FROM wpa JOIN wpd USING (config_id, symbol, period) GROUP BY 1, 2"""}


WIDE = split_sql()
WCOLS = "config_id symbol trades:i net:d max_drawdown:d avg_r:d profit_factor:d " + " ".join(f"trades_{t}:i net_{t}:d mdd_{t}:d pf_{t}:d" for t in ("train", "validate", "test"))


def results(spark, sf):
    return st.wide_stats(flows.trades(spark, sf), TRAIN, VALIDATE, TEST)


@register("stat_results", sq(WCOLS, "SELECT * FROM wide", WIDE))
def stat_results(spark, sf):
    return results(spark, sf)


@register("stat_periods", sq(f"config_id symbol period {AGGC}", f"SELECT {R}, CAST(date_trunc('year', session) AS DATE) AS period, {AGG} FROM ex GROUP BY 1, 2, 3"))
def stat_periods(spark, sf):
    return st.period_stats(flows.trades(spark, sf), "year")


@register("stat_months", sq(f"symbol period {AGGC}", f"SELECT symbol, CAST(date_trunc('month', session) AS DATE) AS period, {AGG} FROM ex GROUP BY 1, 2"))
def stat_months(spark, sf):
    return st.period_stats(flows.trades(spark, sf), "month", ["symbol"])


@register("stat_sharpe", sq("config_id symbol sharpe:d sortino:d", f"""SELECT {R}, CASE WHEN count(*) > 2 THEN avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252) END AS sharpe,
 CASE WHEN count(*) FILTER (pnl < 0) > 2 THEN avg(pnl) / nullif(stddev_samp(pnl) FILTER (pnl < 0), 0) * sqrt(252) END AS sortino FROM dy GROUP BY 1, 2""", DAYS))
def stat_sharpe(spark, sf):
    return st.sharpe_sortino(daily(spark, sf))


@register("stat_sharpe_all_days", sq("config_id symbol sessions:i sharpe_all:d", f"""SELECT {R}, count(*) AS sessions, avg(p) / nullif(stddev_samp(p), 0) * sqrt(252) AS sharpe_all FROM
 (SELECT k.config_id, k.symbol, c.session, coalesce(d.pnl, 0) AS p FROM (SELECT DISTINCT config_id, symbol FROM dy) k JOIN cal c USING (symbol) LEFT JOIN dy d ON d.config_id = k.config_id AND d.symbol = k.symbol AND d.session = c.session) GROUP BY 1, 2""", DAYS))
def stat_sharpe_all_days(spark, sf):
    b = views.bars(spark, sf, M)
    return st.sharpe_all_days(daily(spark, sf), views.calendar(b, M))


KNOWN = {"kn0": f"SELECT {R}, session, count(*) FILTER (is_unknown) = 0 AS known FROM outc GROUP BY 1, 2, 3",
         "kn": "SELECT config_id, symbol, session, CASE WHEN known THEN coalesce(pnl, 0) ELSE 0 END AS p, known, coalesce(entries, 0) AS entries FROM kn0 LEFT JOIN dy USING (config_id, symbol, session)",
         "kn1": "SELECT *, sum(p) OVER w AS eq FROM kn WINDOW w AS (PARTITION BY config_id, symbol ORDER BY session ROWS UNBOUNDED PRECEDING)",
         "kn2": "SELECT *, greatest(0, max(eq) OVER w) AS pk FROM kn1 WINDOW w AS (PARTITION BY config_id, symbol ORDER BY session ROWS UNBOUNDED PRECEDING)"}


@register("stat_known_days", sq("config_id symbol net:d trades:i event_days:i unknown_days:i worst_day:d max_drawdown:d", f"""SELECT {R}, sum(p) AS net, sum(CASE WHEN known THEN entries ELSE 0 END) AS trades, count(*) FILTER (known AND entries > 0) AS event_days,
 count(*) FILTER (NOT known) AS unknown_days, min(p) AS worst_day, least(0, min(eq - pk)) AS max_drawdown FROM kn2 GROUP BY 1, 2""", {**DAYS, **KNOWN}))
def stat_known_days(spark, sf):
    return st.describe_known(known(spark, sf))


def known(spark, sf):
    o = flows.labelled(spark, sf)
    return st.known_days(o, flows.trades(spark, sf, o=o).filter("executed"))


@register("stat_buckets", sq(f"symbol bucket {AGGC} max_drawdown:d", f"""SELECT symbol, bucket, {AGG}, least(0, min(eq - pk), min(eq - pnl + worst - pb)) AS max_drawdown FROM bk2 GROUP BY 1, 2""", {
    "bk0": "SELECT *, CASE WHEN stop_pts < 40 THEN '[0,40)' WHEN stop_pts < 60 THEN '[40,60)' WHEN stop_pts < 1000 THEN '[60,1000)' END AS bucket FROM ex WHERE config_id = 'c00-00'",
    "bk1": "SELECT *, sum(pnl) OVER (PARTITION BY symbol, bucket ORDER BY session, slot, side ROWS UNBOUNDED PRECEDING) AS eq FROM bk0 WHERE bucket IS NOT NULL",
    "bk2": "SELECT *, greatest(0, max(eq) OVER w) AS pk, greatest(0, max(eq) OVER v) AS pb FROM bk1 WINDOW w AS (PARTITION BY symbol, bucket ORDER BY session, slot, side ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY symbol, bucket ORDER BY session, slot, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"}))
def stat_buckets(spark, sf):
    t = flows.trades(spark, sf).filter("config_id = 'c00-00'")
    return st.bucket_stats(t, "stop_pts", [0, 40, 60, 1000], ["symbol"]).drop("profit_to_dd")


@register("stat_streaks", sq("config_id symbol max_win_streak:i avg_win_streak:d max_loss_streak:i avg_loss_streak:d", f"""SELECT {R}, coalesce(max(n) FILTER (w), 0) AS max_win_streak, coalesce(avg(n) FILTER (w), 0) AS avg_win_streak,
 coalesce(max(n) FILTER (NOT w), 0) AS max_loss_streak, coalesce(avg(n) FILTER (NOT w), 0) AS avg_loss_streak FROM (SELECT {R}, w, grp, count(*) AS n FROM (SELECT *, sum(chg) OVER (PARTITION BY {R} ORDER BY session, slot, side ROWS UNBOUNDED PRECEDING) AS grp
 FROM (SELECT *, pnl > 0 AS w, CASE WHEN (pnl > 0) = lag(pnl > 0) OVER (PARTITION BY {R} ORDER BY session, slot, side) THEN 0 ELSE 1 END AS chg FROM ex)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2"""))
def stat_streaks(spark, sf):
    return st.streaks(trades(spark, sf))


@register("stat_trade_sequence", sq("config_id symbol session slot:i trade_number:i prev_funded_pnl:d", f"""SELECT config_id, symbol, session, slot, row_number() OVER w AS trade_number,
 last_value(CASE WHEN executed THEN pnl END IGNORE NULLS) OVER (PARTITION BY {R}, session ORDER BY slot, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_funded_pnl FROM trd WINDOW w AS (PARTITION BY {R}, session ORDER BY slot, side)"""))
def stat_trade_sequence(spark, sf):
    return st.trade_sequence(flows.trades(spark, sf)).select("config_id", *KEYS, "slot", "trade_number", "prev_funded_pnl")


EQ = {"eq1": f"SELECT *, sum(pnl) OVER w AS equity, sum(r_multiple) OVER w AS equity_r FROM ex WINDOW w AS (PARTITION BY {R} ORDER BY session, slot, side ROWS UNBOUNDED PRECEDING)"}


@register("stat_equity_curve", sq("config_id symbol session slot:i equity:d equity_r:d", "SELECT * FROM eq1", EQ))
def stat_equity_curve(spark, sf):
    return st.equity_curve(trades(spark, sf), st.RESULT, st.ORDER).select("config_id", *KEYS, "slot", "equity", "equity_r")


DD = {"dd1": "SELECT *, sum(pnl) OVER w AS eq FROM dy WINDOW w AS (PARTITION BY config_id, symbol ORDER BY session ROWS UNBOUNDED PRECEDING)",
      "dd2": """SELECT *, greatest(0, max(eq) OVER w) AS pk, greatest(0, max(eq) OVER v) AS pb FROM dd1 WINDOW w AS (PARTITION BY config_id, symbol ORDER BY session ROWS UNBOUNDED PRECEDING),
 v AS (PARTITION BY config_id, symbol ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""}


@register("stat_drawdown", sq("config_id symbol max_drawdown:d", f"SELECT {R}, least(0, min(eq - pk)) AS max_drawdown FROM dd2 GROUP BY 1, 2", {**DAYS, **DD}))
def stat_drawdown(spark, sf):
    return st.drawdown(daily(spark, sf), st.RESULT, ["session"])


@register("stat_intratrade_drawdown", sq("config_id symbol max_drawdown:d", "SELECT config_id, symbol, max_drawdown FROM pst WHERE period = 'all'", PTH))
def stat_intratrade_drawdown(spark, sf):
    return st.intratrade_drawdown(trades(spark, sf), st.RESULT, st.ORDER)


@register("stat_worst_day", sq("config_id symbol worst_day:d", f"SELECT {R}, least(0, min(pnl)) AS worst_day FROM dy GROUP BY 1, 2", DAYS))
def stat_worst_day(spark, sf):
    return st.worst_day(daily(spark, sf))


@register("stat_day_cap", sq("config_id symbol session pnl:d", "SELECT config_id, symbol, session, greatest(pnl, -200) AS pnl FROM dy", DAYS))
def stat_day_cap(spark, sf):
    return st.day_cap(daily(spark, sf), 200.0).select("config_id", *KEYS, "pnl")


@register("stat_floor_screen", sq("config_id symbol breach_session floor_at_breach:d days:i", f"""SELECT {R}, min(session) FILTER (lo <= fl) AS breach_session, arg_min(fl, session) FILTER (lo <= fl) AS floor_at_breach, count(*) AS days
 FROM (SELECT *, least(100, pb - 800) AS fl, least(eq - pnl + worst, eq) AS lo FROM dd2) GROUP BY 1, 2""", {**DAYS, **DD}))
def stat_floor_screen(spark, sf):
    return st.floor_screen(daily(spark, sf), 800.0, 100.0)


FPS = {"fp0": f"SELECT *, row_number() OVER (PARTITION BY {R} ORDER BY session) AS i FROM dy",
       "fp1": """SELECT s.config_id, s.symbol, s.i AS s0, d.i - s.i + 1 AS n, sum(d.pnl) OVER w AS bal FROM fp0 s JOIN fp0 d ON s.config_id = d.config_id AND s.symbol = d.symbol AND d.i >= s.i
 WHERE (s.i - 1) % 5 = 0 WINDOW w AS (PARTITION BY s.config_id, s.symbol, s.i ORDER BY d.i ROWS UNBOUNDED PRECEDING)""",
       "fp2": """SELECT *, greatest(0, max(bal) OVER (PARTITION BY config_id, symbol, s0 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS hi FROM fp1""",
       "fp3": "SELECT config_id, symbol, s0, min(n) FILTER (bal <= greatest(-800, least(100, hi - 800))) AS nf, min(n) FILTER (bal >= 1000) AS np FROM fp2 GROUP BY 1, 2, 3",
       "fp4": "SELECT *, CASE WHEN nf IS NOT NULL AND nf <= coalesce(np, 1000000) THEN 'fail' WHEN np IS NOT NULL THEN 'pass' ELSE 'open' END AS res FROM fp3"}


@register("stat_first_passage", sq("config_id symbol starts:i pass_pct:d fail_pct:d open_pct:d median_days:d", f"""SELECT {R}, count(*) AS starts, 100 * avg(CASE WHEN res = 'pass' THEN 1.0 ELSE 0 END) AS pass_pct, 100 * avg(CASE WHEN res = 'fail' THEN 1.0 ELSE 0 END) AS fail_pct,
 100 * avg(CASE WHEN res = 'open' THEN 1.0 ELSE 0 END) AS open_pct, quantile_cont(np, 0.5) FILTER (res = 'pass') AS median_days FROM fp4 GROUP BY 1, 2""", {**DAYS, **FPS}))
def stat_first_passage(spark, sf):
    return st.first_passage(daily(spark, sf), 5, 1000.0, 800.0, 100.0)


# ---- screens and rankings --------------------------------------------------------

@register("screen_floors", sq(WCOLS, "SELECT * FROM wide WHERE trades >= 8 AND trades_validate >= 1 AND max_drawdown > -3500", WIDE))
def screen_floors(spark, sf):
    return st.screen(results(spark, sf), trades=8, trades_validate=1, max_drawdown=-3500.0)


@register("screen_promotion", sq(WCOLS, "SELECT * FROM wide WHERE net_validate > 0 AND net_test > 0 AND coalesce(pf_validate, 99) > 1 AND coalesce(pf_test, 99) > 1 AND max_drawdown > -90000 AND trades >= 5", WIDE))
def screen_promotion(spark, sf):
    return st.promotion_filter(results(spark, sf), -90000.0, 5)


@register("screen_credible", sq(WCOLS, "SELECT * FROM wide WHERE net >= 50 AND max_drawdown > -4000 AND trades >= 5 AND trades_train >= 1 AND trades_validate >= 1 AND trades_test >= 1 AND net_train > 0 AND net_validate > 0 AND net_test > 0 AND greatest(net_train, net_validate, net_test) / net <= 0.9", WIDE))
def screen_credible(spark, sf):
    return st.credible(results(spark, sf), 50.0, -4000.0, 5, 1, 0.9)


@register("screen_known_path", sq("config_id symbol net:d unknown_days:i event_days:i", f"""SELECT * FROM (SELECT {R}, sum(p) AS net, count(*) FILTER (NOT known) AS unknown_days, count(*) FILTER (known AND entries > 0) AS event_days, least(0, min(eq - pk)) AS mdd FROM kn2 GROUP BY 1, 2)
 WHERE unknown_days = 0 AND event_days >= 5 AND net > 0 AND mdd > -3000""", {**DAYS, **KNOWN}))
def screen_known_path(spark, sf):
    d = st.describe_known(known(spark, sf))
    return d.filter("unknown_days = 0 AND event_days >= 5 AND net > 0 AND max_drawdown > -3000").select("config_id", "symbol", "net", "unknown_days", "event_days")


@register("screen_stress", with_ctes(M, """SELECT config_id, symbol, round(min(n) + 3e-10, 6) + 0.0 AS worst_net FROM (SELECT config_id, symbol, stress_slip, sum(pnl_pts - CASE WHEN reason = 'target' THEN 1 ELSE 2 END * (stress_slip - 0.25)) AS n
 FROM sel, (VALUES (0.25), (0.5), (0.75)) v(stress_slip) GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING min(n) > 0""", T, recursive=True))
def screen_stress(spark, sf):
    """Settings that stay positive under every slippage."""
    from tidebar.operators import outcomes as out
    x = out.stress(flows.selected(spark, sf), [0.25, 0.5, 0.75]).groupBy("config_id", "symbol", "stress_slip").agg(F.sum("pnl_pts").alias("n"))
    return x.groupBy("config_id", "symbol").agg(F.min("n").alias("worst_net")).filter("worst_net > 0")


@register("screen_status", with_ctes(M, """SELECT k.config_id, k.symbol, CASE WHEN coalesce(u, 0) > 0 THEN 'NEEDS_DATA' WHEN coalesce(t, 0) = 0 THEN 'NO_TRADES' WHEN t < 15 THEN 'UNDERPOWERED' ELSE 'EVALUATED' END AS status
 FROM (SELECT 'c' || lpad(CAST(s AS VARCHAR), 2, '0') || '-' || lpad(CAST(e AS VARCHAR), 2, '0') AS config_id, symbol FROM (SELECT DISTINCT symbol FROM bars), range(3) a(s), range(8) b(e)) k
 LEFT JOIN (SELECT config_id, symbol, count(*) FILTER (is_unknown) AS u FROM outc GROUP BY 1, 2) USING (config_id, symbol)
 LEFT JOIN (SELECT config_id, symbol, count(*) AS t FROM ex GROUP BY 1, 2) USING (config_id, symbol)""", EXE, recursive=True))
def screen_status(spark, sf):
    """Statuses of a grid whose last signal has no events at all."""
    from tidebar.operators.joins import explode_axes
    sym = views.bars(spark, sf, M).select("symbol").distinct()
    g = explode_axes(sym, {"s": [0, 1, 2], "e": list(range(8))}).select("symbol", F.format_string("c%02d-%02d", "s", "e").alias("config_id"))
    o = flows.labelled(spark, sf)
    u = o.groupBy("config_id", "symbol").agg(F.count_if("is_unknown").alias("unknown"))
    t = flows.trades(spark, sf, o=o).filter("executed").groupBy("config_id", "symbol").agg(F.count(F.lit(1)).alias("trades"))
    r = u.join(t, ["config_id", "symbol"], "left")
    return st.classify_status(g, r, ["config_id", "symbol"], 15)


SCORE = {**WIDE, "sco": """SELECT *, CASE WHEN trades_train >= 3 AND trades_validate >= 3 AND net_train > 0 AND net_validate > 0 AND coalesce(pf_train, 99) > 1 AND coalesce(pf_validate, 99) > 1
 THEN least(net_train / greatest(1, abs(mdd_train)), net_validate / greatest(1, abs(mdd_validate))) * least(2, sqrt(least(trades_train, trades_validate) / 3.0)) END AS score,
 CASE WHEN net_train > 0 AND net_validate > 0 THEN least(net_train / greatest(100, abs(mdd_train)), net_validate / greatest(100, abs(mdd_validate))) + 0.25 * (net_train / greatest(100, abs(mdd_train)) + net_validate / greatest(100, abs(mdd_validate))) END AS evidence FROM wide"""}


def scored(spark, sf):
    return st.evidence_score(st.selection_score(results(spark, sf), 3))


@register("rank_scores", sq("config_id symbol score:d evidence:d", "SELECT * FROM sco", SCORE))
def rank_scores(spark, sf):
    return scored(spark, sf).select("config_id", "symbol", "score", "evidence")


RANK = {**WIDE, "rnk": "SELECT *, ln(greatest(0.01, coalesce(profit_factor, 99))) * sqrt(trades) + 0.25 * avg_r * sqrt(trades) AS rank_score FROM wide WHERE trades >= 8"}


@register("rank_results", sq("config_id symbol rank_score:d net:d", "SELECT * FROM rnk", RANK))
def rank_results(spark, sf):
    return st.rank_results(results(spark, sf), 8).select("config_id", "symbol", "rank_score", "net")


@register("rank_top_n", sq("config_id symbol rank_score:d", "SELECT * FROM rnk ORDER BY rank_score DESC, net DESC, config_id, symbol LIMIT 10", RANK))
def rank_top_n(spark, sf):
    return st.rank_results(results(spark, sf), 8).limit(10).select("config_id", "symbol", "rank_score")


@register("rank_top_per_family", sq("config_id symbol rank:i net:d", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net DESC, config_id) AS rank FROM wide) WHERE rank <= 3", WIDE))
def rank_top_per_family(spark, sf):
    return st.top_n_per(results(spark, sf), ["symbol"], [F.desc("net"), "config_id"], 3).select("config_id", "symbol", "rank", "net")


@register("rank_best_under", sq("symbol qualifying:i net:d config_id", "SELECT symbol, count(*) FILTER (max_drawdown > -800) AS qualifying, max(net) FILTER (max_drawdown > -800) AS net, arg_max(config_id, (net, config_id)) FILTER (max_drawdown > -800) AS config_id FROM wide GROUP BY 1", WIDE))
def rank_best_under(spark, sf):
    return st.best_under(results(spark, sf), ["symbol"], F.col("max_drawdown") > -800, "net", ["config_id"])


@register("rank_group_cap", sq("config_id symbol net:d", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net DESC, config_id, symbol) AS k FROM wide) WHERE k <= 4 ORDER BY net DESC, config_id, symbol LIMIT 12", WIDE))
def rank_group_cap(spark, sf):
    return st.ranked_with_group_cap(results(spark, sf), ["symbol"], [F.desc("net"), "config_id", "symbol"], 4, 12).select("config_id", "symbol", "net")


@register("rank_reserved_top", sq("config_id symbol net:d", """SELECT DISTINCT config_id, symbol, net FROM ((SELECT * FROM wide ORDER BY net_train + net_validate DESC, config_id, symbol LIMIT 6) UNION ALL (SELECT * FROM wide ORDER BY net DESC, config_id, symbol LIMIT 4))""", WIDE))
def rank_reserved_top(spark, sf):
    return st.reserved_top(materialize(results(spark, sf), "results"), [F.desc(F.col("net_train") + F.col("net_validate")), "config_id", "symbol"], 6,
                           [F.desc("net"), "config_id", "symbol"], 4, ["config_id", "symbol"]).select("config_id", "symbol", "net")


@register("stat_concentration", sq("symbol total:d top_share:d", """SELECT symbol, sum(net) AS total, CASE WHEN sum(net) > 0 THEN max(greatest(0, net)) / sum(net) ELSE 0 END AS top_share FROM (SELECT symbol, year, sum(pnl) AS net FROM ex GROUP BY 1, 2) GROUP BY 1"""))
def stat_concentration(spark, sf):
    return st.profit_concentration(trades(spark, sf).groupBy("symbol", "year").agg(F.sum("pnl").alias("net")), ["symbol"])


NAMES = ["c00-00", "c00-05", "c01-02", "c01-07"]


@register("stat_correlation", sq("a b corr:d", f"""SELECT a.config_id AS a, b.config_id AS b, CASE WHEN a.config_id = b.config_id THEN 1.0 ELSE coalesce(corr(a.p, b.p), 0) END AS corr FROM cz a JOIN cz b USING (session) GROUP BY 1, 2""", {
    "cz": f"SELECT k.config_id, s.session, coalesce(sum(d.pnl), 0) AS p FROM (SELECT DISTINCT config_id FROM ex WHERE config_id IN {tuple(NAMES)}) k JOIN (SELECT DISTINCT session FROM ex WHERE config_id IN {tuple(NAMES)}) s ON true LEFT JOIN ex d ON d.config_id = k.config_id AND d.session = s.session GROUP BY 1, 2"}))
def stat_correlation(spark, sf):
    d = daily(spark, sf).filter(F.col("config_id").isin(NAMES))
    return st.correlation_matrix(d, "config_id", NAMES)


@register("stat_correlation_all", sq("a b corr:d", "SELECT a.config_id AS a, b.config_id AS b, CASE WHEN a.config_id = b.config_id THEN 1.0 ELSE coalesce(corr(a.p, b.p), 0) END AS corr FROM cza a JOIN cza b USING (session) GROUP BY 1, 2", {
    "cza": "SELECT k.config_id, s.session, coalesce(sum(d.pnl), 0) AS p FROM (SELECT DISTINCT config_id FROM ex) k JOIN (SELECT DISTINCT session FROM ex) s ON true LEFT JOIN ex d ON d.config_id = k.config_id AND d.session = s.session GROUP BY 1, 2"}))
def stat_correlation_all(spark, sf):
    """Every setting of the data with every other."""
    return st.correlation_pairs(materialize(daily(spark, sf), "daily"), "config_id")


OPTS = "(SELECT i AS option_id, 'large' AS mode, i + 1.0 AS spec FROM range(4) a(i) UNION ALL SELECT 4 + i, 'small', [1.0, 5.0, 20.0][i + 1] FROM range(3) b(i) UNION ALL SELECT 7 + i, 'risk', [200.0, 500.0][i + 1] FROM range(2) c(i))"
BEST = {"so0": f"SELECT e.config_id, e.symbol, e.session, e.slot, e.side, e.pnl_pts, e.worst_pts, e.stop_pts, o.* FROM sel e, {OPTS} o",
        "so1": "SELECT *, CASE WHEN mode = 'risk' THEN {} ELSE mode END AS instrument, CASE WHEN mode = 'risk' THEN {} ELSE spec END AS qty FROM so0".format(*flows.size_sql("spec")),
        "so2": flows.money_sql("so1"),
        "so3": "SELECT *, sum(pnl) OVER (PARTITION BY config_id, symbol, option_id ORDER BY session, slot, side ROWS UNBOUNDED PRECEDING) AS eq FROM so2 WHERE qty > 0",
        "so4": "SELECT *, greatest(0, max(eq) OVER w) AS pk, greatest(0, max(eq) OVER v) AS pb FROM so3 WINDOW w AS (PARTITION BY config_id, symbol, option_id ORDER BY session, slot, side ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY config_id, symbol, option_id ORDER BY session, slot, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "so5": "SELECT config_id, symbol, option_id, count(*) AS trades, sum(pnl) AS net, least(0, min(eq - pk), min(eq - pnl + worst - pb)) AS mdd FROM so4 GROUP BY 1, 2, 3"}


def sized(spark, sf):
    from tidebar.operators import outcomes as out
    x = out.sizing_grid(flows.selected(spark, sf), [200.0, 500.0], smalls=[1, 5, 20]).filter("qty > 0")
    by = ["config_id", "symbol", "option_id"]
    x = st.equity_curve(x, by, st.ORDER)
    dd = F.least(F.lit(0.0), F.min(F.col("equity") - F.col("peak")), F.min(F.col("equity") - F.col("pnl") + F.col("worst") - F.col("peak_before")))
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("net"), dd.alias("mdd"))


@register("size_grid", sq("config_id symbol option_id:i trades:i net:d mdd:d", "SELECT * FROM so5", BEST))
def size_grid(spark, sf):
    return sized(spark, sf)


@register("size_best", sq("config_id symbol option_id:i net:d mdd:d", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_id, symbol ORDER BY net DESC, option_id) AS rn FROM so5 WHERE mdd > -1500) WHERE rn = 1", BEST))
def size_best(spark, sf):
    return st.top_n_per(sized(spark, sf).filter("mdd > -1500"), ["config_id", "symbol"], [F.desc("net"), "option_id"], 1).drop("rank", "trades")


@register("size_scaled_quantity", sq("config_id symbol mdd:d qty:i", "SELECT config_id, symbol, mdd, CASE WHEN mdd >= 0 THEN 40 ELSE least(40, floor((2000 - 1e-9) / abs(mdd))) END AS qty FROM so5 WHERE option_id = 4", BEST))
def size_scaled_quantity(spark, sf):
    from tidebar.operators import outcomes as out
    return sized(spark, sf).filter("option_id = 4").select("config_id", "symbol", "mdd", out.scaled_quantity(F.col("mdd"), 2000.0, 40).alias("qty"))


@register("size_risk_grid", sq("config_id symbol budget:d trades:i net:d", """SELECT config_id, symbol, spec AS budget, count(*) AS trades, sum(pnl) AS net FROM rg2 WHERE qty > 0 GROUP BY 1, 2, 3""", {
    "rg0": "SELECT e.*, b.spec FROM sel e, (VALUES (100.0), (150.0), (200.0), (250.0), (300.0), (400.0), (500.0), (750.0), (1000.0)) b(spec)",
    "rg1": "SELECT *, {} AS instrument, {} AS qty FROM rg0".format(*flows.size_sql("spec")), "rg2": flows.money_sql("rg1")}))
def size_risk_grid(spark, sf):
    from tidebar.operators import outcomes as out
    budgets = [100.0, 150.0, 200.0, 250.0, 300.0, 400.0, 500.0, 750.0, 1000.0]
    x = flows.selected(spark, sf).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    x = out.net_pnl(out.size_max_exposure(x, F.col("budget"))).filter("qty > 0")
    return x.groupBy("config_id", "symbol", "budget").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("net"))
