"""Queries for joins, sets, rules, grids, search, audits and portfolios."""
from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import functions as F

from tidebar.functions.quantiles import exact_quantiles
from tidebar.operators import features as feats
from tidebar.operators import ingest
from tidebar.operators import joins as jn
from tidebar.operators import outcomes as out
from tidebar.operators import portfolio as pf
from tidebar.operators import rules as rl
from tidebar.operators import search as se
from tidebar.operators import settings as sg
from tidebar.operators import stats as st
from tidebar.plans import flows, q_outcomes, q_triggers, views
from tidebar.plans import q_stats as qs
from tidebar.plans.oracle import pick, with_ctes
from tidebar.plans.q_ingest import K
from tidebar.plans.q_windows import H, M, SNAP, snapshots
from tidebar.plans.registry import register
from tidebar.plans.views import TEST, TRAIN, VALIDATE
from tidebar.sources.scratch import materialize

R = "config_id, symbol"


def sq(cols, body, extra=None):
    return with_ctes(M, pick(cols, f"({body})"), {**qs.EXE, **(extra or {})}, recursive=True)


# ---- joins and sets ------------------------------------------------------------

@register("join_with_daily", with_ctes(H, pick("symbol session slot:i close:d atr:d prev_close:d", "(SELECT b.symbol, b.session, b.slot, b.close, d.atr, d.prev_close FROM bars b JOIN daily d USING (symbol, session))")))
def join_with_daily(spark, sf):
    return jn.with_daily(views.bars(spark, sf, H), views.daily(spark, sf, H), ["atr", "prev_close"]).select(*K, "slot", "close", "atr", "prev_close")


@register("join_asof_prev", """SELECT CAST(o.o_orderkey AS BIGINT) AS o_orderkey, round(s.level + 3e-10, 6) + 0.0 AS level FROM orders o
 ASOF LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS level FROM lineitem GROUP BY 1) s ON CAST(o.o_orderdate AS DATE) > s.d""")
def join_asof_prev(spark, sf):
    o = views.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    s = views.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("obs_date")).agg(F.avg("l_quantity").alias("level0"))
    return jn.asof_prev(o, "d", s, "obs_date", "level0", "level").select("o_orderkey", "level")


@register("join_asof_prev_keyed", """SELECT CAST(o.o_orderkey AS BIGINT) AS o_orderkey, round(s.level + 3e-10, 6) + 0.0 AS level FROM orders o
 ASOF LEFT JOIN (SELECT l_linestatus AS k, CAST(l_shipdate AS DATE) AS d, avg(l_quantity) AS level FROM lineitem GROUP BY 1, 2) s ON o.o_orderstatus = s.k AND CAST(o.o_orderdate AS DATE) > s.d""")
def join_asof_prev_keyed(spark, sf):
    o = views.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("k"), F.to_date("o_orderdate").alias("d"))
    s = views.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("k"), F.to_date("l_shipdate").alias("obs_date")).agg(F.avg("l_quantity").alias("level0"))
    return jn.asof_prev(o, "d", s, "obs_date", "level0", "level", ("k",)).select("o_orderkey", "level")


@register("join_entry_to_deadline", with_ctes(H, pick("symbol session slot:i bars:i best:d last_close:d", """(SELECT e.symbol, e.session, e.slot, count(b.open) AS bars, max(b.high) AS best, arg_max(b.close, b.slot) AS last_close
 FROM (SELECT DISTINCT symbol, session, slot FROM evb WHERE signal_id = 0) e JOIN bars b ON b.symbol = e.symbol AND b.session = e.session AND b.slot BETWEEN e.slot + 1 AND least(23, e.slot + 5) GROUP BY 1, 2, 3)"""), flows.events_sql(H)))
def join_entry_to_deadline(spark, sf):
    e = flows.events_with_atr(spark, sf, H).filter("signal_id = 0").select(*K, "slot")
    x = jn.entry_to_deadline(e, views.bars(spark, sf, H), F.col("slot") + 1, F.least(F.lit(23), F.col("slot") + 5))
    return x.groupBy(*K, "slot").agg(F.count("bo").alias("bars"), F.max("bh").alias("best"), F.max_by("bc", "k").alias("last_close"))


@register("join_semi_sessions", with_ctes(H, pick("symbol session slot:i close:d", "bars WHERE (symbol, session) IN (SELECT (symbol, session) FROM g GROUP BY symbol, session HAVING count(open) = max(close_slot))")))
def join_semi_sessions(spark, sf):
    b = views.bars(spark, sf, H)
    g = ingest.complete_grid(b, views.calendar(b, H))
    keep = g.groupBy(*K).agg(F.count("open").alias("n"), F.max("close_slot").alias("c")).filter("n = c")
    return b.join(keep, K, "left_semi").select(*K, "slot", "close")


@register("set_union_latest", with_ctes(M, pick("id version:i close:d", """(SELECT symbol || '|' || session || '|' || slot AS id, CASE WHEN slot % 2 = 0 THEN 2 ELSE 1 END AS version,
 close + CASE WHEN slot % 2 = 0 THEN 1 ELSE 0 END AS close FROM bars)""")))
def set_union_latest(spark, sf):
    x = views.bars(spark, sf, M).withColumn("id", F.concat_ws("|", "symbol", F.col("session").cast("string"), F.col("slot").cast("string")))
    old = x.select("id", F.lit(1).alias("version"), "close")
    new = x.filter("slot % 2 = 0").select("id", F.lit(2).alias("version"), (F.col("close") + 1).alias("close"))
    return jn.union_latest([old, new], "id", "version")


@register("set_same", with_ctes(H, """SELECT only_in, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'left' AS only_in, symbol, session, slot FROM bars WHERE slot >= 20 UNION ALL SELECT 'right', symbol, session, slot FROM bars WHERE slot < 3) GROUP BY 1"""))
def set_same(spark, sf):
    b = views.bars(spark, sf, H).select(*K, "slot")
    return jn.same_set(b.filter("slot >= 3"), b.filter("slot < 20")).groupBy("only_in").agg(F.count(F.lit(1)).alias("n"))


@register("set_intersect_rules", with_ctes(H, pick("symbol session slot:i", "(SELECT symbol, session, slot FROM feat WHERE close > hi3 INTERSECT SELECT symbol, session, slot FROM feat WHERE close > vwap)")))
def set_intersect_rules(spark, sf):
    f = views.base(spark, sf, H)
    return f.filter("close > hi3").select(*K, "slot").intersect(f.filter("close > vwap").select(*K, "slot"))


# ---- rules ---------------------------------------------------------------------

RULES = {"calm_low": [("rv4", "<=", 1.5), ("from_low_atr", "<=", 0.5)], "late_high": [("time_frac", ">", 0.5), ("to_high_atr", "<=", 0.3)],
         "wide": [("or_width_atr", ">", 0.8)]}
SIDES = {"calm_low": 1, "late_high": -1, "wide": 1}
RULE_SQL = {**SNAP, "rule": " UNION ALL ".join(f"SELECT *, '{r}' AS rule_id FROM snap WHERE " + " AND ".join(f"{f} {o} {v}" for f, o, v in cs) for r, cs in RULES.items()),
            "rks": "SELECT symbol, session, slot, rule_id FROM rule"}


@register("rule_apply", with_ctes(M, pick("symbol session slot:i rule_id", "rks"), RULE_SQL))
def rule_apply(spark, sf):
    return rl.apply_rules(snapshots(spark, sf), RULES).select(*K, "slot", "rule_id")


@register("rule_apply_table", with_ctes(M, pick("symbol session slot:i rule_id", "rks"), RULE_SQL))
def rule_apply_table(spark, sf):
    rows = [(r, f, o, float(v)) for r, cs in RULES.items() for f, o, v in cs]
    t = spark.createDataFrame(rows, "rule_id string, feature string, op string, value double")
    return rl.apply_rule_table(snapshots(spark, sf), [*K, "slot"], list(feats.FEATURES), t)


@register("rule_events", with_ctes(M, pick("rule_id symbol session slot:i side:i", "(SELECT rule_id, symbol, session, min(slot) AS slot, CASE rule_id WHEN 'late_high' THEN -1 ELSE 1 END AS side FROM rule GROUP BY 1, 2, 3)"), RULE_SQL))
def rule_events(spark, sf):
    return rl.rule_events(snapshots(spark, sf), RULES, SIDES)


@register("flow_rule_trades", with_ctes(M, """SELECT rule_id, CAST(count(*) AS BIGINT) AS trades, round(sum(pnl_pts) + 3e-10, 6) + 0.0 AS net_pts, CAST(count(*) FILTER (reason = 'target') AS BIGINT) AS targets FROM outc WHERE NOT is_unknown GROUP BY 1""", {
    **RULE_SQL, "rev": "SELECT r.*, d.atr, 0.2 AS stop_atr, 2.0 AS target_r, 6 AS hold, row_number() OVER () AS eid FROM (SELECT rule_id, symbol, session, min(slot) AS slot, CASE rule_id WHEN 'late_high' THEN -1 ELSE 1 END AS side FROM rule GROUP BY 1, 2, 3) r JOIN daily d USING (symbol, session)",
    **flows.barrier_sql("rev", 27)}))
def flow_rule_trades(spark, sf):
    """Discovered rules traded once per session through the barrier label."""
    e = rl.rule_events(snapshots(spark, sf), RULES, SIDES).join(views.daily(spark, sf, M).select(*K, "atr"), K)
    e = e.withColumns({"stop_atr": F.lit(0.2), "target_r": F.lit(2.0), "hold": F.lit(6)})
    o = out.barrier_outcome(e, out.pack_bars(views.grid(spark, sf, M)), 27).filter("NOT is_unknown")
    return o.groupBy("rule_id").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl_pts").alias("net_pts"), F.count_if(F.col("reason") == "target").alias("targets"))


EDGE_F = ["gap_atr", "session_ret", "rv4", "vwap_dist_atr", "or_pos", "from_low_atr", "eff4"]


def in_(t):
    return "(" + ", ".join(map(str, t)) + ")"


EDGE = {**SNAP,
        "elg": " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, y2 AS y, year FROM snap WHERE {f} IS NOT NULL AND y2 IS NOT NULL" for f in EDGE_F),
        "eth": f"SELECT feature, list_sort(list_distinct([quantile_cont(x, 0.0), quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75), quantile_cont(x, 1.0)])) AS e FROM elg WHERE year IN {in_(TRAIN)} GROUP BY 1",
        "ebn": "SELECT l.*, least(len(list_filter(e, lambda v: x > v)) - 1, len(e) - 2) AS bin, e FROM elg l JOIN eth USING (feature) WHERE len(e) >= 3 AND len(list_filter(e, lambda v: x > v)) >= 1",
        "eag": f"""SELECT feature, bin, any_value(e[bin + 1]) AS low, count(*) FILTER (year IN {in_(TRAIN)}) AS n_train, count(*) FILTER (year IN {in_(VALIDATE)}) AS n_validate, count(*) FILTER (year IN {in_(TEST)}) AS n_test,
 avg(y) FILTER (year IN {in_(TRAIN)}) AS mt, avg(y) FILTER (year IN {in_(VALIDATE)}) AS mv, avg(y) FILTER (year IN {in_(TEST)}) AS mx FROM ebn GROUP BY 1, 2""",
        "edge": """SELECT feature, bin, low, side, n_train, n_validate, n_test, side * mt AS mean_train, side * mv AS mean_validate, side * mx AS mean_test
 FROM eag, (VALUES (1), (-1)) s(side) WHERE n_train >= 30 AND n_validate >= 10 AND n_test >= 10 AND side * mt > 0 AND side * mv > 0"""}
EDGE_COLS = "feature bin:i low:d side:i n_train:i n_validate:i n_test:i mean_train:d mean_validate:d mean_test:d"


def edges(spark, sf):
    return rl.edge_map(snapshots(spark, sf), EDGE_F, "y2", 4, TRAIN, VALIDATE, TEST, (30, 10, 10))


@register("rule_edge_map", with_ctes(M, pick(EDGE_COLS, "edge"), EDGE))
def rule_edge_map(spark, sf):
    return edges(spark, sf)


@register("rule_rank", with_ctes(M, pick("feature bin:i side:i rank_score:d", "(SELECT *, mean_validate * sqrt(n_validate) AS rank_score FROM edge ORDER BY rank_score DESC, feature, bin LIMIT 5)"), EDGE))
def rule_rank(spark, sf):
    return rl.rank_rules(edges(spark, sf)).orderBy(F.desc("rank_score"), "feature", "bin").limit(5).select("feature", "bin", "side", "rank_score")


CTX = {**flows.events_sql(M), "ctx": """SELECT e.symbol, e.session, e.slot, e.side, e.signal_id, f.volume_z, e.side * (f.close - f.p_close) / nullif(f.atr, 0) AS impulse_atr, e.side * (f.close - f.vwap) / nullif(f.atr, 0) AS vwap_side_atr,
 e.side * f.vwap_slope / nullif(f.atr, 0) AS vwap_slope_side_atr, e.side * (f.close - f.day_open) / nullif(f.atr, 0) AS session_move_side_atr,
 CASE WHEN e.side > 0 THEN CASE WHEN run_high > run_low THEN (close - run_low) / (run_high - run_low) ELSE 0.5 END ELSE 1 - CASE WHEN run_high > run_low THEN (close - run_low) / (run_high - run_low) ELSE 0.5 END END AS range_pos_side,
 e.side * (f.day_open - f.prev_close) / nullif(f.atr, 0) AS gap_side_atr, (f.run_high - f.run_low) / nullif(f.atr, 0) AS range_atr FROM evb e JOIN feat f USING (symbol, session, slot)"""}


def context(spark, sf):
    e = flows.events_with_atr(spark, sf, M).drop("atr")
    return rl.event_context(e, views.feat(spark, sf, M)).select(*K, "slot", "side", "signal_id", *rl.CONTEXT)


@register("rule_event_context", with_ctes(M, pick("symbol session slot:i side:i signal_id:i " + " ".join(f"{c}:d" for c in rl.CONTEXT), "ctx"), CTX))
def rule_event_context(spark, sf):
    return context(spark, sf)


@register("rule_train_quantiles", with_ctes(M, pick("symbol q:d threshold:d", f"""(SELECT symbol, q, CASE q WHEN 0.33 THEN t1 ELSE t2 END AS threshold FROM (SELECT symbol, quantile_cont(range_atr, 0.33) AS t1, quantile_cont(range_atr, 0.67) AS t2
 FROM ctx WHERE year(session) IN {in_(TRAIN)} GROUP BY 1), (VALUES (0.33), (0.67)) v(q))"""), CTX))
def rule_train_quantiles(spark, sf):
    return exact_quantiles(context(spark, sf).filter(F.year("session").isin(*TRAIN)), ["symbol"], "range_atr", [0.33, 0.67])


@register("rule_quantiles_large", """SELECT event_type, q, round(CASE q WHEN 0.1 THEN a WHEN 0.5 THEN b ELSE c END + 3e-10, 6) + 0.0 AS threshold FROM (SELECT event_type, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.995) AS c FROM events GROUP BY 1),
 (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.995 AS DOUBLE))) v(q)""")
def rule_quantiles_large(spark, sf):
    return exact_quantiles(views.table(spark, sf, "events"), ["event_type"], "value", [0.1, 0.5, 0.995])


PRED = rl.predicates()
MARK = {**CTX, "mrk": " UNION ALL ".join(f"SELECT symbol, session, slot, side, signal_id, '{n}' AS predicate FROM ctx WHERE {c}" for n, c in PRED)}


def marked(spark, sf):
    return rl.predicate_library(context(spark, sf), PRED).select(*K, "slot", "side", "signal_id", "predicate")


@register("rule_predicates", with_ctes(M, "SELECT symbol, CAST(signal_id AS BIGINT) AS signal_id, predicate, CAST(count(*) AS BIGINT) AS n FROM mrk GROUP BY 1, 2, 3", MARK))
def rule_predicates(spark, sf):
    return marked(spark, sf).groupBy("symbol", "signal_id", "predicate").agg(F.count(F.lit(1)).alias("n"))


@register("rule_dedupe_masks", with_ctes(M, f"""SELECT predicate, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ids ORDER BY rank) AS rn FROM (SELECT predicate, count(*) AS n, list_sort(list((symbol, session, slot, side, signal_id))) AS ids FROM mrk GROUP BY 1)
 JOIN (VALUES {', '.join(f"('{n}', {i})" for i, (n, _) in enumerate(PRED))}) o(predicate, rank) USING (predicate)) WHERE rn = 1""", MARK))
def rule_dedupe_masks(spark, sf):
    order = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(PRED)], "predicate string, rank int")
    return rl.dedupe_masks(marked(spark, sf), [*K, "slot", "side", "signal_id"], order)


TOPP = {**MARK, "tpp": "SELECT signal_id, predicate FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY n DESC, predicate) AS rn FROM (SELECT signal_id, predicate, count(*) AS n FROM mrk WHERE predicate <> 'ALL' GROUP BY 1, 2)) WHERE rn <= 5"}


def top_predicates(m):
    n = m.filter("predicate <> 'ALL'").groupBy("signal_id", "predicate").agg(F.count(F.lit(1)).alias("n"))
    return st.top_n_per(n, ["signal_id"], [F.desc("n"), "predicate"], 5).drop("rank", "n")


@register("rule_pairs", with_ctes(M, """SELECT CAST(a.signal_id AS BIGINT) AS signal_id, a.predicate || ' & ' || b.predicate AS predicate, CAST(count(*) AS BIGINT) AS n FROM mrk a JOIN mrk b USING (symbol, session, slot, side, signal_id)
 JOIN tpp p ON p.signal_id = a.signal_id AND p.predicate = a.predicate JOIN tpp q ON q.signal_id = b.signal_id AND q.predicate = b.predicate WHERE a.predicate < b.predicate GROUP BY 1, 2""", TOPP))
def rule_pairs(spark, sf):
    m = marked(spark, sf)
    return rl.pair_rules(m, top_predicates(m), [*K, "slot", "side"], ["signal_id"]).groupBy("signal_id", "predicate").agg(F.count(F.lit(1)).alias("n"))


#: Cuts of the range so far that training years give, as columns.
QUANTILES = ("range_atr_q33", "range_atr_q67")
MARKQ = {**CTX, "thr": f"SELECT symbol, quantile_cont(range_atr, 0.33) AS range_atr_q33, quantile_cont(range_atr, 0.67) AS range_atr_q67 FROM ctx WHERE year(session) IN {in_(TRAIN)} GROUP BY 1",
         "cq": "SELECT * FROM ctx JOIN thr USING (symbol)",
         "mrk": " UNION ALL ".join(f"SELECT symbol, signal_id, '{n}' AS predicate FROM cq WHERE {c}" for n, c in rl.predicates(QUANTILES))}


@register("rule_predicates_trained", with_ctes(M, "SELECT symbol, CAST(signal_id AS BIGINT) AS signal_id, predicate, CAST(count(*) AS BIGINT) AS n FROM mrk GROUP BY 1, 2, 3", MARKQ))
def rule_predicates_trained(spark, sf):
    """The whole library, cuts from training years included."""
    ctx = materialize(context(spark, sf), "context")
    cut = exact_quantiles(ctx.filter(F.year("session").isin(*TRAIN)), ["symbol"], "range_atr", [0.33, 0.67])
    cut = cut.groupBy("symbol").agg(*[F.max(F.when(F.col("q") == q, F.col("threshold"))).alias(n) for q, n in zip((0.33, 0.67), QUANTILES)])
    marks = rl.predicate_library(ctx.join(cut, "symbol"), rl.predicates(QUANTILES))
    return marks.groupBy("symbol", "signal_id", "predicate").agg(F.count(F.lit(1)).alias("n"))


FROZEN = [("f1", "side=1"), ("f1", "vwap_side_atr>=0.1"), ("f2", "gap_side_atr<0.0"), ("f2", "session_move_side_atr>=0.0"), ("f2", "side=-1")]


@register("rule_rebuild", with_ctes(M, pick("rule_id symbol session slot:i side:i signal_id:i", """(SELECT 'f1' AS rule_id, symbol, session, slot, side, signal_id FROM ctx WHERE side = 1 AND vwap_side_atr >= 0.1
 UNION ALL SELECT 'f2', symbol, session, slot, side, signal_id FROM ctx WHERE gap_side_atr < 0 AND session_move_side_atr >= 0 AND side = -1)"""), CTX))
def rule_rebuild(spark, sf):
    frozen = spark.createDataFrame(FROZEN, "rule_id string, predicate string")
    return rl.rebuild_rule(marked(spark, sf), frozen, [*K, "slot", "side", "signal_id"], [n for n, _ in PRED])


DISC = {**MARK, **flows.barrier_sql("eve", 27), **{k: v for k, v in flows.events_sql(M).items()},
        "dso": "SELECT o.* EXCLUDE (config_id), o.signal_id || '|' || m.predicate AS config_id, m.predicate FROM outc o JOIN mrk m USING (symbol, session, slot, side, signal_id) WHERE o.exec_id = 3",
        **flows.select_sql("dso", 3), "ex": "SELECT *, 1 AS qty, year(session) AS year, pnl_pts * 2 - 1 AS pnl, worst_pts * 2 - 1 AS worst, true AS executed, (pnl_pts * 2 - 1) / ((stop_pts + 0.25) * 2 + 1) AS r_multiple FROM sel",
        **qs.split_sql(), "dsc": qs.SCORE["sco"].replace("trades_train >= 3 AND trades_validate >= 3", "trades_train >= 2 AND trades_validate >= 2").replace("/ 3.0", "/ 2.0")}


def scored(x):
    """Select, unit-size statistics and score of labelled events by config_id."""
    t = out.select_non_overlapping(x, ["config_id", *K], *flows.WINDOW, max_n=3)
    t = out.net_pnl(t.withColumns({"instrument": F.lit("small"), "qty": F.lit(1)})).withColumns({"year": F.year("session"), "executed": F.lit(True)})
    return st.selection_score(st.wide_stats(t, TRAIN, VALIDATE, TEST), 2)


def discovered(x):
    """Capped ranking of labelled events by config_id, which begins with the signal."""
    s = scored(x).filter("score IS NOT NULL").withColumn("signal", F.element_at(F.split("config_id", r"\|"), 1))
    return st.ranked_with_group_cap(s, ["signal"], [F.desc("score"), F.desc("net"), "config_id", "symbol"], 8, 12).select("config_id", "symbol", "trades", "net", "score")


@register("rule_discover", with_ctes(M, pick("config_id symbol trades:i net:d score:d", "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split_part(config_id, '|', 1) ORDER BY score DESC, net DESC, config_id, symbol) AS k FROM dsc WHERE score IS NOT NULL) WHERE k <= 8 ORDER BY score DESC, net DESC, config_id, symbol LIMIT 12)"), DISC, recursive=True))
def rule_discover(spark, sf):
    """Every single predicate on every signal: label, select, unit-size statistics, score, capped ranking."""
    o = flows.outcomes(spark, sf, M).filter("exec_id = 3").drop("config_id")
    x = o.join(marked(spark, sf), [*K, "slot", "side", "signal_id"]).withColumn("config_id", F.concat_ws("|", F.col("signal_id").cast("string"), "predicate"))
    return discovered(x)


DISC_ALL = {**DISC, "dso": "SELECT o.* EXCLUDE (config_id), o.signal_id || '|' || o.exec_id || '|' || m.predicate AS config_id, m.predicate FROM outc o JOIN mrk m USING (symbol, session, slot, side, signal_id)"}


@register("rule_discover_all", with_ctes(M, pick("config_id symbol trades:i net:d score:d", "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split_part(config_id, '|', 1) ORDER BY score DESC, net DESC, config_id, symbol) AS k FROM dsc WHERE score IS NOT NULL) WHERE k <= 8 ORDER BY score DESC, net DESC, config_id, symbol LIMIT 12)"), DISC_ALL, recursive=True))
def rule_discover_all(spark, sf):
    """As ``rule_discover``, under every execution setting: config_id is signal, setting and predicate."""
    o = flows.outcomes(spark, sf, M).drop("config_id")
    x = o.join(marked(spark, sf), [*K, "slot", "side", "signal_id"]).withColumn("config_id", F.concat_ws("|", F.col("signal_id").cast("string"), F.col("exec_id").cast("string"), "predicate"))
    return discovered(x)


#: Best singles of a (signal, setting, symbol) that may form pairs, and the sizes of the final ranking.
TOP_SINGLES, PER_SIGNAL, RULES_KEPT = 6, 20, 40
_BY = "symbol, signal_id, exec_id"


def again(ctes: dict[str, str], source: dict[str, str]) -> dict[str, str]:
    """The expressions once more, under names that end in 2, over other sources."""
    names = {**{k: f"{k}2" for k in ctes}, **source}
    word = re.compile(r"\b(" + "|".join(names) + r")\b(?!\()")
    return {f"{k}2": word.sub(lambda m: names[m[1]], v) for k, v in ctes.items()}


_CHAIN = {**flows.select_sql("dso", 3), "ex": DISC["ex"], **qs.split_sql(), "dsc": DISC["dsc"]}
PAIRS = {**DISC_ALL,
         "dsk": f"""SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY rank DESC, ord) AS k FROM (SELECT symbol, CAST(split_part(config_id, '|', 1) AS BIGINT) AS signal_id, CAST(split_part(config_id, '|', 2) AS BIGINT) AS exec_id,
 split_part(config_id, '|', 3) AS predicate, round(CASE WHEN trades_train >= 2 AND net_train > 0 THEN net_train / greatest(1, abs(mdd_train)) ELSE -1e9 END, 9) AS rank FROM dsc) JOIN (VALUES {', '.join(f"('{n}', {i})" for i, (n, _) in enumerate(PRED))}) o(predicate, ord) USING (predicate)""",
         "dst": f"SELECT * FROM dsk WHERE k <= {TOP_SINGLES}",
         "dsp": f"""SELECT {_BY}, a.predicate AS pa, b.predicate AS pb, a.k AS ka, b.k AS kb, list_sort(list((m.session, m.slot, m.side))) AS ids FROM dst a JOIN dst b USING ({_BY}) JOIN mrk m ON m.symbol = a.symbol AND m.signal_id = a.signal_id AND m.predicate = a.predicate
 JOIN mrk n ON n.symbol = m.symbol AND n.session = m.session AND n.slot = m.slot AND n.side = m.side AND n.signal_id = m.signal_id AND n.predicate = b.predicate WHERE a.k <= b.k GROUP BY ALL""",
         "dsv": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_BY}, ids ORDER BY CASE WHEN ka = kb THEN 0 ELSE 1 END, ka, kb) AS rn FROM dsp) WHERE rn = 1 AND ka < kb",
         "dsu": f"SELECT {_BY}, pa, pb, unnest(ids) AS id FROM dsv",
         "dsq": "SELECT o.* EXCLUDE (config_id), o.signal_id || '|' || o.exec_id || '|' || u.pa || ' & ' || u.pb AS config_id FROM outc o JOIN dsu u ON u.symbol = o.symbol AND u.signal_id = o.signal_id AND u.exec_id = o.exec_id AND u.id = (o.session, o.slot, o.side)",
         **again(_CHAIN, {"dso": "dsq"}),
         "dsr": "SELECT *, 1 AS level FROM dsc UNION ALL SELECT *, 2 FROM dsc2"}


@register("rule_discover_pairs", with_ctes(M, pick("config_id symbol level:i trades:i net:d score:d", f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split_part(config_id, '|', 1) ORDER BY round(score, 9) DESC, round(net_validate, 9) DESC, trades DESC, config_id, symbol) AS k
 FROM dsr WHERE score IS NOT NULL) WHERE k <= {PER_SIGNAL} ORDER BY round(score, 9) DESC, round(net_validate, 9) DESC, trades DESC, config_id, symbol LIMIT {RULES_KEPT})"""), PAIRS, recursive=True))
def rule_discover_pairs(spark, sf):
    """Discovery to its end: singles are labelled and scored, the best of each by its training years alone form pairs on bitmaps, and only pairs
    that select some events, and others than the rules before them, are labelled. Singles and pairs are ranked together."""
    by = ["symbol", "signal_id", "exec_id"]
    ctx = materialize(context(spark, sf), "context")
    o = materialize(flows.outcomes(spark, sf, M).drop("config_id"), "outcomes")
    rule = lambda *name: F.concat_ws("|", F.col("signal_id").cast("string"), F.col("exec_id").cast("string"), *name)
    one = materialize(scored(o.join(rl.predicate_library(ctx, PRED).select(*K, "slot", "side", "signal_id", "predicate"), [*K, "slot", "side", "signal_id"]).withColumn("config_id", rule("predicate"))), "singles")
    number = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(PRED) for x in (n, i)])
    part = F.split("config_id", r"\|")
    fit = (F.col("trades_train") >= 2) & (F.col("net_train") > 0)
    rank = F.when(fit, F.col("net_train") / F.greatest(F.lit(1.0), F.abs("mdd_train"))).otherwise(-1e9)
    singles = one.select("symbol", F.get(part, 0).cast("int").alias("signal_id"), F.get(part, 1).cast("int").alias("exec_id"), F.element_at(number, F.get(part, 2)).alias("predicate"), F.round(rank, 9).alias("train_rank"))
    top = materialize(st.top_n_per(singles, by, [F.desc("train_rank"), "predicate"], TOP_SINGLES).select(*by, "predicate", "rank"), "top")
    words = materialize(rl.predicate_bitmaps(ctx, PRED, ["symbol", "signal_id"]), "bitmaps")
    # bits know no execution setting; the short lists do
    each = words.withColumn("exec_id", F.explode(F.sequence(F.lit(0), F.lit(len(flows.exec_settings(flows.EXEC)) - 1))))
    left = rl.pair_events(each, rl.pair_candidates(each, top, by), by)
    names = F.array(*[F.lit(n) for n, _ in PRED])
    two = scored(o.join(left, [*by, "session", "slot", "side"]).withColumn("config_id", rule(F.concat_ws(" & ", F.get(names, F.col("a")), F.get(names, F.col("b"))))))
    every = one.withColumn("level", F.lit(1)).unionByName(two.withColumn("level", F.lit(2))).filter("score IS NOT NULL").withColumn("signal", F.element_at(F.split("config_id", r"\|"), 1))
    order = [F.desc(F.round("score", 9)), F.desc(F.round("net_validate", 9)), F.desc("trades"), "config_id", "symbol"]
    return st.ranked_with_group_cap(every, ["signal"], order, PER_SIGNAL, RULES_KEPT).select("config_id", "symbol", "level", "trades", "net", "score")


# ---- grids and audits ----------------------------------------------------------

AXES = {"lookback": [3, 5, 8], "buffer_atr": [0.0, 0.03], "direction": [-1, 0, 1]}
GRID_SQL = "SELECT symbol, l.v AS lookback, b.v AS buffer_atr, d.v AS direction FROM (SELECT DISTINCT symbol FROM bars), (VALUES (3), (5), (8)) l(v), (VALUES (0.0), (0.03)) b(v), (VALUES (-1), (0), (1)) d(v)"


def symbol_grid(spark, sf, axes):
    return jn.explode_axes(views.bars(spark, sf, M).select("symbol").distinct(), axes)


@register("grid_build", with_ctes(M, pick("symbol lookback:i buffer_atr:d direction:i", "grd"), {"grd": GRID_SQL}))
def grid_build(spark, sf):
    g = symbol_grid(spark, sf, AXES)
    twice = g.unionByName(g.filter("direction = 0")).withColumn("canonical", se.canonical_id("symbol", *AXES))
    return twice.dropDuplicates(["canonical"]).drop("canonical")


@register("grid_ids", with_ctes(H, """SELECT 'G-' || lpad(CAST(b.slot + 24 * t.i AS VARCHAR), 7, '0') AS config_id, CAST(b.slot AS BIGINT) AS slot, round(t.tgt + 3e-10, 6) + 0.0 AS target,
 CAST(count(*) AS BIGINT) AS bars FROM bars b, (VALUES (0, 0.0), (1, 1.5)) t(i, tgt) GROUP BY 1, 2, 3"""))
def grid_ids(spark, sf):
    """Bars available to each setting of a numbered grid."""
    g = jn.grid_table(spark, {"slot": list(range(24)), "target": [0.0, 1.5]}, "G")
    n = views.bars(spark, sf, H).groupBy("slot").agg(F.count(F.lit(1)).alias("bars"))
    return g.join(n, "slot").select("config_id", "slot", "target", "bars")


@register("grid_family_counts", with_ctes(M, "SELECT symbol AS family, CAST(count(*) AS BIGINT) AS n, CAST(18 AS BIGINT) AS expected, count(*) = 18 AS ok FROM grd GROUP BY 1", {"grd": GRID_SQL}))
def grid_family_counts(spark, sf):
    g = symbol_grid(spark, sf, AXES).withColumnRenamed("symbol", "family")
    want = views.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("family")).distinct().withColumn("expected", F.lit(18))
    return se.family_counts(g, want)


@register("grid_canonical", with_ctes(M, """SELECT symbol, CAST(least(c.v, f.v - 1) AS BIGINT) AS cutoff, CAST(f.v AS BIGINT) AS flat, CAST(count(*) AS BIGINT) AS aliases FROM (SELECT DISTINCT symbol FROM bars), (VALUES (20), (24), (26), (30)) c(v), (VALUES (23), (27)) f(v) GROUP BY 1, 2, 3"""))
def grid_canonical(spark, sf):
    return se.canonical_grid(symbol_grid(spark, sf, {"cutoff": [20, 24, 26, 30], "flat": [23, 27]}), ["symbol", "cutoff", "flat"])


FULL = "SELECT 'c' || lpad(CAST(s AS VARCHAR), 2, '0') || '-' || lpad(CAST(e AS VARCHAR), 2, '0') AS config_id, symbol, CAST(s AS VARCHAR) AS signal FROM (SELECT DISTINCT symbol FROM bars), range(3) a(s), range(8) b(e)"


def full_grid(spark, sf):
    return symbol_grid(spark, sf, {"s": [0, 1, 2], "e": list(range(8))}).select(
        F.format_string("c%02d-%02d", "s", "e").alias("config_id"), "symbol", F.col("s").cast("string").alias("signal"))


@register("grid_completion", sq("signal expected:i recovered:i status", f"SELECT signal, count(*) AS expected, count(k.config_id) AS recovered, CASE WHEN count(*) = count(k.config_id) THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS status FROM ful f LEFT JOIN (SELECT DISTINCT config_id, symbol FROM ex) k ON f.config_id = k.config_id AND f.symbol = k.symbol GROUP BY ROLLUP (signal)", {"ful": FULL}))
def grid_completion(spark, sf):
    return se.completion_rollup(full_grid(spark, sf), qs.trades(spark, sf), ["config_id", "symbol"], "signal")


@register("audit_coverage", sq("config_id problem", "SELECT DISTINCT config_id, 'missing' AS problem FROM ful WHERE config_id NOT IN (SELECT config_id FROM ex) UNION ALL SELECT DISTINCT config_id, 'foreign' FROM ex WHERE config_id NOT IN (SELECT config_id FROM ful WHERE config_id <> 'c00-00')", {"ful": FULL}))
def audit_coverage(spark, sf):
    g, t = full_grid(spark, sf), materialize(qs.trades(spark, sf).select("config_id"), "ids")
    x = jn.coverage_audit(g, t).filter("problem = 'missing'")
    y = jn.coverage_audit(g.filter("config_id <> 'c00-00'"), t).filter("problem = 'foreign'")
    return x.unionByName(y)


@register("audit_conflicts", with_ctes(M, "SELECT symbol, CAST(count(*) AS BIGINT) AS conflicts FROM (SELECT symbol, session FROM bars GROUP BY 1, 2 HAVING count(DISTINCT close) > 1) GROUP BY 1"))
def audit_conflicts(spark, sf):
    b = views.bars(spark, sf, M).withColumn("id", F.concat_ws("|", "symbol", F.col("session").cast("string")))
    return jn.conflict_audit(b, "id", ["close"]).groupBy(F.element_at(F.split("id", r"\|"), 1).alias("symbol")).agg(F.count(F.lit(1)).alias("conflicts"))


@register("audit_payload", with_ctes(M, "SELECT symbol || '|' || session || '|' || slot AS id FROM bars WHERE slot % 9 = 0"))
def audit_payload(spark, sf):
    b = views.bars(spark, sf, M).withColumn("id", F.concat_ws("|", "symbol", F.col("session").cast("string"), F.col("slot").cast("string")))
    r = b.withColumn("close", F.when(F.col("slot") % 9 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return jn.payload_mismatch(b, r, "id", ["open", "close"])


@register("audit_lag", with_ctes(M, "SELECT f.field, CAST(0 AS BIGINT) AS mismatches, CAST(count(CASE f.field WHEN 'prev_open' THEN prev_open WHEN 'prev_high' THEN prev_high WHEN 'prev_low' THEN prev_low ELSE prev_close END) AS BIGINT) AS covered, true AS ok FROM daily, (VALUES ('prev_open'), ('prev_high'), ('prev_low'), ('prev_close')) f(field) GROUP BY 1"))
def audit_lag(spark, sf):
    return se.lag_audit(views.daily(spark, sf, M), 50)


def counted(**frames):
    """Row counts of several frames in one row."""
    names = list(frames)
    u = None
    for n, df in frames.items():
        part = df.select(*[F.lit(1 if m == n else 0).alias(m) for m in names])
        u = part if u is None else u.unionByName(part)
    return u.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


@register("audit_causality", with_ctes(H, "SELECT CAST(0 AS BIGINT) AS violations, CAST(count(*) AS BIGINT) AS compared FROM feat JOIN (SELECT symbol, max(session) AS last FROM bars GROUP BY 1) USING (symbol) WHERE session < last OR slot <= 12"))
def audit_causality(spark, sf):
    """Features recomputed after the last session's later bars are changed."""
    b = views.bars(spark, sf, H)
    last = b.groupBy("symbol").agg(F.max("session").alias("_last"))
    hit = (F.col("session") == F.col("_last")) & (F.col("slot") > 12)
    alt = b.join(last, "symbol").withColumns(
        {c: F.when(hit, F.col(c) * 1.5 + 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}).drop("_last")

    def build(x):
        g = ingest.complete_grid(x, views.calendar(x, H))
        d = feats.daily_features(g, 5, 3)
        f = feats.clock_stats(feats.opening_range_columns(feats.intraday(g.join(d, K)), 3), 5, 3)
        cols = ("atr", "prev_close", "vwap", "hi3", "lo5", "ret", "run_high", "volume_z", "noise", "ret_z", "p_vwap")
        return f.join(last, "symbol").select(*K, "slot", "_last", *cols)

    a, known = build(b), "session < _last OR slot <= 12"
    return counted(violations=se.causality_violations(a, build(alt), known), compared=a.filter(known))


@register("audit_execution", sq("trades:i violations:i", "SELECT count(*) AS trades, count(*) FILTER (entry_slot <= slot OR exit_slot < entry_slot OR exit_slot > 27 OR planned_risk > 400 + 1e-9 OR pnl_pts < worst_pts - 1e-9 OR qty < 0) AS violations FROM trd"))
def audit_execution(spark, sf):
    t = materialize(flows.trades(spark, sf), "trades")
    return counted(trades=t, violations=se.execution_violations(t, 27, 400.0))


@register("audit_expected", sq("metric value:d expected:d ok", "SELECT 'net' AS metric, sum(pnl) AS value, sum(pnl) AS expected, true AS ok FROM ex UNION ALL SELECT 'trades', count(*), count(*), true FROM ex UNION ALL SELECT 'absent', NULL, 1.0, false"))
def audit_expected(spark, sf):
    t = qs.trades(spark, sf)
    rep = t.agg(F.sum("pnl").alias("net"), F.count(F.lit(1)).cast("double").alias("trades")).unpivot([], ["net", "trades"], "metric", "value")
    d = qs.daily(spark, sf).agg(F.sum("pnl").alias("net"), F.sum("entries").cast("double").alias("trades"), F.lit(1.0).alias("absent")).unpivot([], ["net", "trades", "absent"], "metric", "expected")
    return se.compare_expected(rep, d, 1e-6)


# ---- search --------------------------------------------------------------------

@register("search_evaluate_grid", sq("config_id signal_id:i stop_atr:d target_r:d hold:i symbol trades:i net:d max_drawdown:d", """SELECT w.config_id, CAST(substr(w.config_id, 2, 2) AS INT) AS signal_id, x.stop_atr, x.target_r, x.hold, w.symbol, w.trades, w.net, w.max_drawdown
 FROM wide w JOIN exe x ON x.exec_id = CAST(substr(w.config_id, 5, 2) AS INT)""", qs.WIDE))
def search_evaluate_grid(spark, sf):
    """Signals and executions stay separate until selection; settings rejoin the results by id."""
    r = qs.results(spark, sf)
    ex = spark.createDataFrame([(i, float(a), float(t), h) for i, (a, t, h) in enumerate(product(*flows.EXEC.values()))],
                               "exec_id int, stop_atr double, target_r double, hold int")
    r = r.withColumns({"signal_id": F.substring("config_id", 2, 2).cast("int"), "exec_id": F.substring("config_id", 5, 2).cast("int")})
    return r.join(ex, "exec_id").select("config_id", "signal_id", "stop_atr", "target_r", "hold", "symbol", "trades", "net", "max_drawdown")


POL = "(VALUES ('static', 0.0, 0.0, 0.0, 0, 0.0), ('breakeven', 0.5, 0.0, 0.0, 0, 0.0), ('trail', 0.0, 0.5, 0.4, 0, 0.0), ('progress', 0.0, 0.0, 0.0, 3, 0.8)) pol(policy, be_r, trail_act_r, trail_dist_r, progress_bars, progress_r)"


def management_sql():
    from tidebar.plans.flows import away
    cand = f"""CASE policy WHEN 'breakeven' THEN CASE WHEN mfe / stop_pts >= 0.5 THEN {away('entry_px')} END WHEN 'trail' THEN CASE WHEN mfe / stop_pts >= 0.5 THEN {away('entry_px + side * mfe - side * 0.4 * stop_pts')} END END"""
    sql = q_outcomes.managed_sql(M, cand, "policy = 'progress' AND k - entry_slot + 1 >= 3 AND mfe / stop_pts < 0.8")
    sql = sql.replace("8 AS hold FROM evb WHERE signal_id = 0", f"8 AS hold, pol.* FROM evb, {POL} WHERE signal_id = 0")
    sql = sql.replace("mo AS (SELECT e.symbol,", "mo AS (SELECT e.policy, e.symbol,")
    head = sql[:sql.rindex("SELECT symbol, session, CAST(slot")]
    sel = flows.select_sql("mo2", 2, group="policy", cooldown=1)
    sel["mo2"] = "SELECT *, reason = 'unknown' AS is_unknown FROM mo"
    order = ["mo2", "sc0", "scr", "sel"]
    return head.rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + ",\n".join(f"{n} AS ({sel[n]})" for n in order) + """
SELECT policy, symbol, CAST(count(*) AS BIGINT) AS trades, round(sum(pnl_pts) + 3e-10, 6) + 0.0 AS net_pts, CAST(count(*) FILTER (reason = 'managed') AS BIGINT) AS managed FROM sel GROUP BY 1, 2"""


@register("search_management_grid", management_sql())
def search_management_grid(spark, sf):
    """Exit policies as rows of a grid: one plan labels the events under all of them."""
    p = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(be).alias("be_r"), F.lit(a).alias("trail_act_r"), F.lit(d).alias("trail_dist_r"),
                           F.lit(b).cast("double").alias("progress_bars"), F.lit(r).alias("progress_r")) for n, be, a, d, b, r in (
        ("static", 0.0, 0.0, 0.0, 0, 0.0), ("breakeven", 0.5, 0.0, 0.0, 0, 0.0), ("trail", 0.0, 0.5, 0.4, 0, 0.0), ("progress", 0.0, 0.0, 0.0, 3, 0.8))])
    e = q_outcomes.one_setting(spark, sf, M).select("*", F.inline(p))
    o = out.managed_outcome(e, out.pack_bars(views.grid(spark, sf, M)), 27)
    s = out.select_non_overlapping(o, ["policy", *K], *flows.WINDOW, max_n=2, cooldown=1)
    return s.groupBy("policy", "symbol").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl_pts").alias("net_pts"), F.count_if(F.col("reason") == "managed").alias("managed"))


@register("search_finalists", sq("config_id symbol net:d rank:i", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net_train + net_validate DESC, config_id) AS rank FROM wide) WHERE rank <= 4", qs.WIDE))
def search_finalists(spark, sf):
    r = qs.results(spark, sf)
    return st.top_n_per(r, ["symbol"], [F.desc(F.col("net_train") + F.col("net_validate")), "config_id"], 4).select("config_id", "symbol", "net", "rank")


WF = {"wk": "SELECT symbol, session, row_number() OVER (PARTITION BY symbol ORDER BY session) AS k FROM cal",
      "wst": "SELECT symbol, year(session) AS y, min(k) AS f FROM wk GROUP BY 1, 2 HAVING min(k) - greatest(1, min(k) - 24) >= 12",
      "wtr": "SELECT d.config_id, s.symbol, s.y, d.session, CASE WHEN d.known THEN d.p ELSE 0 END AS p, d.known, d.entries FROM wst s JOIN wk ON wk.symbol = s.symbol AND wk.k BETWEEN greatest(1, s.f - 24) AND s.f - 1 JOIN kn d ON d.symbol = s.symbol AND d.session = wk.session",
      "wt1": "SELECT *, sum(p) OVER (PARTITION BY config_id, symbol, y ORDER BY session) AS eq FROM wtr",
      "wt2": "SELECT *, greatest(0, max(eq) OVER (PARTITION BY config_id, symbol, y ORDER BY session)) AS pk FROM wt1",
      "wt3": "SELECT config_id, symbol, y, sum(p) AS train_net FROM wt2 GROUP BY 1, 2, 3 HAVING bool_and(known) AND sum(entries) >= 3 AND min(eq - pk) > -2500 AND sum(p) > 0",
      "wbest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, y ORDER BY train_net DESC, config_id) AS rn FROM wt3) WHERE rn = 1"}


@register("search_walk_forward", sq("symbol period config_id train_net:d test_net:d unknown_days:i", """SELECT b.symbol, make_date(b.y, 1, 1) AS period, b.config_id, b.train_net, sum(d.p) AS test_net, count(*) FILTER (NOT known) AS unknown_days
 FROM wbest b JOIN kn d ON d.config_id = b.config_id AND d.symbol = b.symbol AND year(d.session) = b.y GROUP BY 1, 2, 3, 4""", {**qs.DAYS, **qs.KNOWN, **WF}))
def search_walk_forward(spark, sf):
    b = views.bars(spark, sf, M)
    d = materialize(qs.known(spark, sf).withColumn("pnl", F.coalesce("pnl", F.lit(0.0))), "days")
    return se.walk_forward(d, views.calendar(b, M), "year", 24, 12, 3, -2500.0)


BOOT = {"bs0": "SELECT config_id, symbol, list(pnl ORDER BY session) AS x, count(*) AS n FROM dy GROUP BY 1, 2",
        "bs1": "SELECT *, CAST(ceil(n / 4.0) AS INT) AS nb FROM bs0, range(40) d(draw)",
        "bs2": "SELECT config_id, symbol, n, draw, list_transform(range(0, n), lambda j: x[((CAST('0x' || substr(md5('s-' || draw || '-' || (j // 4)), 1, 8) AS BIGINT) % n + j % 4) % n) + 1]) AS v FROM bs1"}


@register("search_bootstrap", sq("config_id symbol days:i ci_low:d ci_high:d", f"SELECT {R}, any_value(n) AS days, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (SELECT *, list_sum(v) / n AS m FROM bs2) GROUP BY 1, 2", {**qs.DAYS, **BOOT}))
def search_bootstrap(spark, sf):
    return se.bootstrap_ci(qs.daily(spark, sf), ["config_id", "symbol"], 4, 40)


def _cdf_sql(x: str) -> str:
    """The normal distribution function by the same rational approximation, written out."""
    t = f"(1 / (1 + {se.ERF_P} * abs({x}) / sqrt(2)))"
    poly = " + ".join(f"({a}) * pow({t}, {k})" for k, a in enumerate(se.ERF_A, 1))
    return f"CASE WHEN {x} >= 0 THEN 1 - ({poly}) * exp(-{x} * {x} / 2) / 2 ELSE ({poly}) * exp(-{x} * {x} / 2) / 2 END"


SHARPE = {**qs.DAYS, "mo": f"SELECT {R}, count(*) AS n, avg(pnl) AS m, stddev_pop(pnl) AS s FROM dy GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_pop(pnl) > 0",
          "hm": "SELECT config_id, symbol, any_value(n) AS n, any_value(m / s) AS sr, avg(pow((pnl - m) / s, 3)) AS sk, avg(pow((pnl - m) / s, 4)) AS ku FROM dy JOIN mo USING (config_id, symbol) GROUP BY 1, 2",
          "ds": f"SELECT *, (sr - {se.best_of_skilless(16)!r} / sqrt(n - 1)) * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - sk * sr + (ku - 1) * sr * sr / 4)) AS stat FROM hm"}


@register("search_deflated_sharpe", sq("config_id symbol n:i stat:d probability:d", f"SELECT *, {_cdf_sql('stat')} AS probability FROM ds", SHARPE))
def search_deflated_sharpe(spark, sf):
    return se.deflated_sharpe(qs.daily(spark, sf), ["config_id", "symbol"], 16)


@register("search_controls", sq("symbol common_days:i candidate_net:d control_net:d difference:d", "SELECT a.symbol, count(*) AS common_days, sum(a.p) AS candidate_net, sum(b.p) AS control_net, sum(a.p - b.p) AS difference FROM kn a JOIN kn b USING (symbol, session) WHERE a.config_id = 'c00-03' AND b.config_id = 'c01-00' AND a.known AND b.known GROUP BY 1", {**qs.DAYS, **qs.KNOWN}))
def search_controls(spark, sf):
    d = materialize(qs.known(spark, sf), "days")
    return se.matched_compare(d.filter("config_id = 'c00-03'"), d.filter("config_id = 'c01-00'"))


@register("search_decision", sq("config_id symbol decision", f"""SELECT config_id, symbol, CASE WHEN u > 0 THEN 'NEEDS_DATA' WHEN e < 8 THEN 'UNDERPOWERED' WHEN net > 0 AND ok THEN 'ADVANCE' ELSE 'REJECT' END AS decision FROM (SELECT {R}, sum(p) AS net, count(*) FILTER (NOT known) AS u, count(*) FILTER (known AND entries > 0) AS e FROM kn GROUP BY 1, 2)
 JOIN (SELECT config_id, symbol, min(n) > 0 AS ok FROM (SELECT config_id, symbol, s, sum(pnl_pts - CASE WHEN reason = 'target' THEN 1 ELSE 2 END * (s - 0.25)) AS n FROM sel, (VALUES (0.25), (0.5)) v(s) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (config_id, symbol)""", {**qs.DAYS, **qs.KNOWN}))
def search_decision(spark, sf):
    o = flows.labelled(spark, sf)
    days = st.known_days(o, flows.trades(spark, sf, o=o).filter("executed"))
    d = st.describe_known(days)
    s = out.stress(flows.selected(spark, sf, o=o), [0.25, 0.5]).groupBy("config_id", "symbol", "stress_slip").agg(F.sum("pnl_pts").alias("n"))
    s = s.groupBy("config_id", "symbol").agg((F.min("n") > 0).alias("all_stress_ok"))
    return se.decision_label(d.join(s, ["config_id", "symbol"]), 8).select("config_id", "symbol", "decision")


@register("search_neighbors", sq("config_id symbol axis neighbor_id net:d neighbor_net:d", """SELECT a.config_id, a.symbol, CASE WHEN a.s <> b.s THEN 'signal_id' WHEN a.stop_atr <> b.stop_atr THEN 'stop_atr' WHEN a.target_r <> b.target_r THEN 'target_r' ELSE 'hold' END AS axis, b.config_id AS neighbor_id, a.net, b.net AS neighbor_net
 FROM nb a JOIN nb b ON a.symbol = b.symbol WHERE (a.s <> b.s)::INT + (a.stop_atr <> b.stop_atr)::INT + (a.target_r <> b.target_r)::INT + (a.hold <> b.hold)::INT = 1""",
 {**qs.WIDE, "nb": "SELECT w.config_id, w.symbol, w.net, CAST(substr(w.config_id, 2, 2) AS INT) AS s, x.stop_atr, x.target_r, x.hold FROM wide w JOIN exe x ON x.exec_id = CAST(substr(w.config_id, 5, 2) AS INT)"}))
def search_neighbors(spark, sf):
    r = search_evaluate_grid(spark, sf)
    return se.neighbors(r, ["signal_id", "stop_atr", "target_r", "hold"], ["symbol"])


CATALOG = [(0, "three-bar range break", "direct"), (1, "five-bar range break", "direct")]


@register("search_catalog", sq("config_id symbol net:d source fidelity", "SELECT w.config_id, w.symbol, w.net, CASE substr(w.config_id, 2, 2) WHEN '00' THEN 'three-bar range break' ELSE 'five-bar range break' END AS source, 'direct' AS fidelity FROM wide w", qs.WIDE))
def search_catalog(spark, sf):
    dim = spark.createDataFrame(CATALOG, "signal_id int, source string, fidelity string")
    r = qs.results(spark, sf).withColumn("signal_id", F.substring("config_id", 2, 2).cast("int"))
    return r.join(dim, "signal_id", "left").select("config_id", "symbol", "net", "source", "fidelity")


@register("search_standardize", sq("source symbol session entry_slot:i exit_slot:i side:i pnl_pts:d stop_pts:d entry_px:d worst_pts:d", """SELECT source, t.symbol, t.session, entry_slot, exit_slot, side, pnl_pts, stop_pts, entry_px, least(0, min(CASE WHEN side > 0 THEN b.low - 0.25 - entry_px ELSE entry_px - b.high - 0.25 END), any_value(pnl_pts)) AS worst_pts
 FROM (SELECT 'fast' AS source, * FROM sel WHERE config_id = 'c00-00' UNION ALL SELECT 'slow', * FROM sel WHERE config_id = 'c01-03') t JOIN bars b ON b.symbol = t.symbol AND b.session = t.session AND b.slot BETWEEN entry_slot AND exit_slot GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9"""))
def search_standardize(spark, sf):
    s = flows.selected(spark, sf)
    return se.standardize_trades([("fast", s.filter("config_id = 'c00-00'")), ("slow", s.filter("config_id = 'c01-03'"))], views.bars(spark, sf, M), 0.25)


# ---- portfolios ----------------------------------------------------------------

OPTS = pf.sleeve_options([1.0, 2.0, 5.0])
SLV = {**flows.trades_sql(), "slv": "SELECT *, symbol AS sleeve FROM sel WHERE config_id = 'c01-07'",
       "spt": """SELECT t.sleeve, t.symbol, t.session, b.slot, sum(CASE WHEN b.slot = t.exit_slot THEN t.pnl_pts * 2 - 1 ELSE 0 END) AS delta,
 sum(least(0, CASE WHEN side > 0 THEN b.low - 0.25 - entry_px ELSE entry_px - b.high - 0.25 END) * 2 - 1) AS adverse, count(*) AS exposure
 FROM slv t JOIN bars b ON b.symbol = t.symbol AND b.session = t.session AND b.slot BETWEEN entry_slot AND exit_slot GROUP BY 1, 2, 3, 4""",
       "ud": "SELECT sleeve, session, sum(pnl_pts * 2 - 1) AS pnl FROM slv GROUP BY 1, 2",
       "op": "SELECT * FROM (VALUES (1, 1.0), (2, 2.0), (3, 5.0)) o(option_id, scale)",
       "od": "SELECT sleeve, session, option_id, scale, pnl * scale AS pnl FROM ud, op"}


class Study:
    """Sleeves of one portfolio study: trades written once, everything else derived from them."""

    def __init__(self, spark, sf):
        t = flows.selected(spark, sf).filter("config_id = 'c01-07'").withColumn("sleeve", F.col("symbol"))
        self.sleeves = materialize(t, "sleeves")
        self.spark, self.sf = spark, sf

    def paths(self):
        return pf.sleeve_path(self.sleeves, views.bars(self.spark, self.sf, M), ["sleeve"], 0.25)

    def daily(self):
        return self.sleeves.groupBy("sleeve", "session").agg(F.sum(F.col("pnl_pts") * 2 - 1).alias("pnl"))

    def options(self):
        return pf.option_daily(self.daily(), OPTS)

    def seeds(self):
        return pf.seed_portfolios(pf.option_scores(self.options(), TRAIN, VALIDATE), 2)

    def samples(self):
        return pf.sample_portfolios(self.sleeves.select("sleeve"), 60, (2, 4), OPTS)

    def members(self):
        return materialize(self.seeds().unionByName(self.samples()), "members")

    def screened(self, members):
        return pf.portfolio_daily_screen(members, self.daily(), OPTS, TRAIN, VALIDATE, 12.0, -20000.0)

    def exact(self, members):
        return pf.portfolio_exact(members, self.paths(), OPTS)


def pq(cols, body, extra=None):
    return with_ctes(M, pick(cols, f"({body})"), {**SLV, **(extra or {})}, recursive=True)


@register("portfolio_sleeve_path", pq("sleeve symbol session slot:i delta:d adverse:d exposure:i", "SELECT * FROM spt"))
def portfolio_sleeve_path(spark, sf):
    return Study(spark, sf).paths()


@register("portfolio_option_daily", pq("sleeve session option_id:i scale:d pnl:d", "SELECT * FROM od"))
def portfolio_option_daily(spark, sf):
    return Study(spark, sf).options()


OSC = {"os1": f"SELECT *, year(session) AS y, sum(pnl) OVER (PARTITION BY sleeve, option_id ORDER BY session) AS eq FROM od WHERE year(session) IN {in_(TRAIN + VALIDATE)}",
       "os2": "SELECT *, greatest(0, max(eq) OVER (PARTITION BY sleeve, option_id ORDER BY session)) AS pk FROM os1",
       "osc": f"SELECT sleeve, option_id, sum(pnl) AS net, min(eq - pk) AS mdd, sum(pnl) FILTER (y IN {in_(TRAIN)}) AS nt, sum(pnl) / greatest(100, abs(min(eq - pk))) AS score FROM os2 GROUP BY 1, 2",
       "bst": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sleeve ORDER BY score DESC, option_id) AS rn FROM osc) WHERE rn <= 2",
       "sed": """SELECT sleeve || ':' || option_id AS portfolio_id, sleeve, option_id FROM bst UNION ALL SELECT a.sleeve || ':' || a.option_id || '|' || b.sleeve || ':' || b.option_id, unnest([a.sleeve, b.sleeve]), unnest([a.option_id, b.option_id]) FROM bst a JOIN bst b ON a.sleeve < b.sleeve"""}


@register("portfolio_seeds", pq("portfolio_id sleeve option_id:i", "SELECT * FROM sed", OSC))
def portfolio_seeds(spark, sf):
    return Study(spark, sf).seeds()


def u_sql(*parts):
    return "((CAST('0x' || substr(md5(" + " || '-' || ".join(parts) + "), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


SMP = {"sm0": "SELECT i, (SELECT count(DISTINCT sleeve) FROM slv) AS ns FROM range(60) r(i)",
       "sm1": f"SELECT *, CAST(floor(2 + {u_sql(chr(39) + 'k' + chr(39), 'i')} * (least(4, ns) - 2 + 1)) AS INT) AS k FROM sm0",
       "sm2": f"SELECT s.i, s.k, v.sleeve, row_number() OVER (PARTITION BY s.i ORDER BY {u_sql(chr(39) + 'a' + chr(39), 's.i', 'v.sleeve')}) AS rn FROM sm1 s, (SELECT DISTINCT sleeve FROM slv) v",
       "sm3": f"SELECT i, sleeve, option_id, row_number() OVER (PARTITION BY i, sleeve ORDER BY -ln({u_sql(chr(39) + 'o' + chr(39), 'i', 'sleeve', 'option_id')}) * pow(1 + scale, 0.55)) AS rn FROM sm2, op WHERE rn <= k",
       "smp": "SELECT 'R' || lpad(CAST(i AS VARCHAR), 6, '0') AS portfolio_id, sleeve, option_id FROM sm3 WHERE rn = 1"}


@register("portfolio_samples", pq("portfolio_id sleeve option_id:i", "SELECT * FROM smp", SMP))
def portfolio_samples(spark, sf):
    return Study(spark, sf).samples()


DSC = {**OSC, **SMP, "mem": "SELECT * FROM sed UNION ALL SELECT * FROM smp",
       "ds1": "SELECT m.portfolio_id, d.session, sum(d.pnl) AS pnl FROM mem m JOIN od d USING (sleeve, option_id) GROUP BY 1, 2",
       "ds2": "SELECT *, sum(pnl) OVER (PARTITION BY portfolio_id ORDER BY session) AS eq FROM ds1",
       "ds3": "SELECT *, greatest(0, max(eq) OVER (PARTITION BY portfolio_id ORDER BY session)) AS pk FROM ds2",
       "dsx": "SELECT portfolio_id, sum(scale) AS exposure FROM mem JOIN op USING (option_id) GROUP BY 1",
       "dse": f"""SELECT portfolio_id, sum(pnl) AS net, least(0, min(eq - pk)) AS mdd_daily, coalesce(sum(pnl) FILTER (year(session) IN {in_(TRAIN)}), 0) AS net_train, coalesce(sum(pnl) FILTER (year(session) IN {in_(VALIDATE)}), 0) AS net_validate FROM ds3 GROUP BY 1""",
       "dsf": """SELECT *, exposure <= 12 AND net_train > 0 AND net_validate > 0 AND mdd_daily > -20000 AS evidence_ok, exposure <= 12 AND net > 0 AND mdd_daily > -20000 AS oracle_ok FROM dse JOIN dsx USING (portfolio_id)"""}


@register("portfolio_daily_screen", pq("portfolio_id net:d mdd_daily:d net_train:d net_validate:d exposure:d evidence_ok oracle_ok", "SELECT * FROM dsf", DSC))
def portfolio_daily_screen(spark, sf):
    s = Study(spark, sf)
    return s.screened(s.members())


EXA = {**DSC, "ea0": "SELECT m.portfolio_id, p.sleeve, p.session, p.slot, p.delta * o.scale AS delta, p.adverse * o.scale AS adverse, p.exposure * o.scale AS exposure FROM mem m JOIN spt p USING (sleeve) JOIN op o USING (option_id)",
       "ea1": "SELECT portfolio_id, session, slot, sum(delta) AS delta, sum(adverse) AS adverse, sum(exposure) AS exposure FROM ea0 GROUP BY 1, 2, 3",
       "ea2": "SELECT *, sum(delta) OVER (PARTITION BY portfolio_id ORDER BY session, slot) AS eq FROM ea1",
       "ea3": "SELECT *, greatest(0, max(eq) OVER w) AS pk, greatest(0, max(eq) OVER v) AS pb FROM ea2 WINDOW w AS (PARTITION BY portfolio_id ORDER BY session, slot), v AS (PARTITION BY portfolio_id ORDER BY session, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
       "ea4": "SELECT portfolio_id, sum(delta) AS net, least(0, min(eq - pk), min(eq - delta + adverse - pb)) AS max_drawdown, max(exposure) AS max_exposure FROM ea3 GROUP BY 1",
       "ea5": "SELECT portfolio_id, count(*) AS active, max(greatest(0, n)) AS top FROM (SELECT portfolio_id, sleeve, sum(delta) AS n FROM ea0 GROUP BY 1, 2) GROUP BY 1",
       "ea6": "SELECT portfolio_id, least(0, min(d)) AS worst_day FROM (SELECT portfolio_id, session, sum(delta) AS d FROM ea1 GROUP BY 1, 2) GROUP BY 1",
       "exa": "SELECT portfolio_id, net, max_drawdown, max_exposure, active, worst_day, CASE WHEN net > 0 THEN top / net ELSE 0 END AS top_share FROM ea4 JOIN ea5 USING (portfolio_id) JOIN ea6 USING (portfolio_id)"}
XC = "portfolio_id net:d max_drawdown:d max_exposure:d active:i worst_day:d top_share:d"


@register("portfolio_exact", pq(XC, "SELECT * FROM exa", EXA))
def portfolio_exact(spark, sf):
    s = Study(spark, sf)
    return s.exact(s.members())


@register("portfolio_two_stage", pq(XC, "SELECT exa.* FROM exa JOIN dsf USING (portfolio_id) WHERE evidence_ok OR oracle_ok", EXA))
def portfolio_two_stage(spark, sf):
    """Bar-level evaluation only for portfolios that pass the daily screen."""
    s = Study(spark, sf)
    m = s.members()
    return s.exact(m.join(s.screened(m).filter("evidence_ok OR oracle_ok"), "portfolio_id", "left_semi"))


@register("portfolio_credible", pq(XC, "SELECT * FROM exa WHERE net > -5000 AND max_drawdown > -20000 AND max_exposure <= 10 AND active >= 2 AND top_share <= 3", EXA))
def portfolio_credible(spark, sf):
    s = Study(spark, sf)
    return s.exact(s.members()).filter("net > -5000 AND max_drawdown > -20000 AND max_exposure <= 10 AND active >= 2 AND top_share <= 3")


@register("portfolio_leaderboards", pq("board portfolio_id net:d max_drawdown:d", """SELECT * FROM ((SELECT 'disciplined' AS board, e.* FROM lbd e WHERE selection IS NOT NULL ORDER BY selection DESC, net DESC, portfolio_id LIMIT 5) UNION ALL (SELECT 'oracle', e.* FROM lbd e ORDER BY net DESC, portfolio_id LIMIT 5))""", {
    **EXA, "lbd": "SELECT exa.*, CASE WHEN net_train > 0 AND net_validate > 0 THEN (net_train + net_validate) / greatest(100, abs(mdd_daily)) END AS selection FROM exa JOIN (SELECT portfolio_id, net_train, net_validate, mdd_daily FROM dsf) USING (portfolio_id) WHERE max_drawdown > -9000 AND max_exposure <= 12"}))
def portfolio_leaderboards(spark, sf):
    s = Study(spark, sf)
    m = s.members()
    x, d = materialize(s.exact(m), "exact"), materialize(s.screened(m), "screened")
    return pf.leaderboards(x, d, -9000.0, 12.0, 5).select("board", "portfolio_id", "net", "max_drawdown")


@register("portfolio_sum_paths", pq("session slot:i delta:d adverse:d exposure:i", "SELECT session, slot, sum(delta) AS delta, sum(adverse) AS adverse, sum(exposure) AS exposure FROM spt GROUP BY 1, 2"))
def portfolio_sum_paths(spark, sf):
    return pf.sum_paths(Study(spark, sf).paths(), [])


@register("portfolio_minute_drawdown", pq("sleeve net:d max_drawdown:d max_exposure:i", "SELECT sleeve, sum(delta) AS net, least(0, min(eq - pk), min(eq - delta + adverse - pb)) AS max_drawdown, max(exposure) AS max_exposure FROM md2 GROUP BY 1", {
    "md1": "SELECT *, sum(delta) OVER (PARTITION BY sleeve ORDER BY session, slot) AS eq FROM spt",
    "md2": "SELECT *, greatest(0, max(eq) OVER w) AS pk, greatest(0, max(eq) OVER v) AS pb FROM md1 WINDOW w AS (PARTITION BY sleeve ORDER BY session, slot), v AS (PARTITION BY sleeve ORDER BY session, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"}))
def portfolio_minute_drawdown(spark, sf):
    return pf.minute_drawdown(Study(spark, sf).paths(), ["sleeve"])


# ---- portfolios of every setting under whole sizing plans -----------------------

RISKS = [250.0, 400.0]
PLAN = pf.sizing_plan([1, 2, 5], [1], RISKS)
_SIZED = " UNION ALL ".join(["SELECT *, 'small' AS leg, 'small' AS instrument, 1 AS qty FROM wsl", "SELECT *, 'large', 'large', 1 FROM wsl",
                             *["SELECT *, 'risk {:g}', {}, {} FROM wsl".format(b, *flows.size_sql(str(b))) for b in RISKS]])
_OPT = "option_id, scale"
WHOLE = {**flows.trades_sql(), "wsl": "SELECT *, config_id || '|' || symbol AS sleeve FROM sel", "wsz": f"SELECT * FROM ({_SIZED}) WHERE qty > 0", "wmo": flows.money_sql("wsz"),
         "spt": """SELECT t.sleeve || '/' || t.leg AS leg, t.session, b.slot, sum(CASE WHEN b.slot = t.exit_slot THEN t.pnl ELSE 0 END) AS delta,
 sum(t.qty * (least(0, CASE WHEN side > 0 THEN b.low - 0.25 - entry_px ELSE entry_px - b.high - 0.25 END) * CASE WHEN instrument = 'large' THEN 20 ELSE 2 END - CASE WHEN instrument = 'large' THEN 3.5 ELSE 1 END)) AS adverse, sum(t.exposure) AS exposure
 FROM wmo t JOIN bars b ON b.symbol = t.symbol AND b.session = t.session AND b.slot BETWEEN entry_slot AND exit_slot GROUP BY 1, 2, 3""",
         "op": "SELECT * FROM (VALUES " + ", ".join(f"({o.option_id}, '{o.label}', '{o.leg}', {o.scale})" for o in PLAN if o.scale) + ") o(option_id, label, leg, scale)",
         "od": "SELECT sleeve, session, option_id, scale, sum(pnl) * scale AS pnl FROM wmo JOIN op USING (leg) GROUP BY sleeve, session, option_id, scale",
         **{k: OSC[k] for k in ("os1", "os2")}, "osc": OSC["osc"].replace("AS nt,", f"AS nt, sum(pnl) FILTER (y IN {in_(VALIDATE)}) AS nv,"),
         "bst": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sleeve ORDER BY score DESC, option_id) AS rn FROM osc WHERE net > 0 AND nt > 0 AND nv > 0) WHERE rn <= 1", "sed": OSC["sed"],
         **{k: v.replace("FROM slv", "FROM wsl") for k, v in SMP.items()}, "mem": "SELECT * FROM sed UNION ALL SELECT * FROM smp",
         "ea0": "SELECT m.portfolio_id, m.sleeve, p.session, p.slot, p.delta * o.scale AS delta, p.adverse * o.scale AS adverse, p.exposure * o.scale AS exposure FROM mem m JOIN op o USING (option_id) JOIN spt p ON p.leg = m.sleeve || '/' || o.leg",
         **{k: v for k, v in EXA.items() if k in ("ea1", "ea2", "ea3", "ea4", "ea5", "ea6", "exa")}}


class WholeStudy:
    """Every setting of every symbol as a sleeve, under fixed small and large quantities and risk budgets."""

    def __init__(self, spark, sf):
        self.trades = materialize(flows.selected(spark, sf).withColumn("sleeve", F.concat_ws("|", "config_id", "symbol")), "sleeves")
        self.sized = materialize(pf.sized_trades(self.trades, RISKS), "sized")
        self.spark, self.sf = spark, sf

    def paths(self):
        return pf.sized_path(self.sized, views.bars(self.spark, self.sf, M), ["sleeve", "leg"])

    def options(self):
        return pf.plan_daily(self.sized.groupBy("sleeve", "leg", "session").agg(F.sum("pnl").alias("pnl")), PLAN)

    def members(self):
        seeds = pf.seed_portfolios(pf.option_scores(self.options(), TRAIN, VALIDATE), 1, positive=True)
        return materialize(seeds.unionByName(pf.sample_portfolios(self.trades.select("sleeve"), 60, (2, 4), [(o.option_id, o.scale) for o in PLAN])), "members")


def wq(cols, body):
    return with_ctes(M, pick(cols, f"({body})"), WHOLE, recursive=True)


@register("portfolio_sizing_plan", wq("sleeve option_id:i label trades:i net:d max_exposure:d", """SELECT t.sleeve, o.option_id, o.label, t.trades, t.net * o.scale AS net, x.e * o.scale AS max_exposure FROM op o JOIN (SELECT sleeve, leg, count(*) AS trades, sum(pnl) AS net FROM wmo GROUP BY 1, 2) t USING (leg)
 JOIN (SELECT leg, max(exposure) AS e FROM spt GROUP BY 1) x ON x.leg = t.sleeve || '/' || o.leg"""))
def portfolio_sizing_plan(spark, sf):
    """Trades, net and largest exposure of every sizing option of every sleeve."""
    s = WholeStudy(spark, sf)
    by = ["sleeve", "leg"]
    t = s.sized.groupBy(*by).agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("net")).join(s.paths().groupBy(*by).agg(F.max("exposure").alias("e")), by)
    return t.join(pf.plan_rows(spark, PLAN), "leg").select("sleeve", "option_id", "label", "trades", (F.col("net") * F.col("scale")).alias("net"), (F.col("e") * F.col("scale")).alias("max_exposure"))


@register("portfolio_exact_all", wq(XC, "SELECT * FROM exa"))
def portfolio_exact_all(spark, sf):
    """Seeds and samples from every sleeve of every setting, evaluated bar by bar."""
    s = WholeStudy(spark, sf)
    return pf.exact_of_plan(s.members(), s.paths(), PLAN)


# ---- a search driven by a table of settings -------------------------------------

_EXE1 = {"stop_atr": [0.2], "target_r": [2.0], "hold": [8]}
#: Blocks of the table; a volume gate counts only behind the VWAP filter of one breakout block.
BLOCKS = [("rolling_breakout", {"lookback": [3, 5], "buffer_atr": [0.0, 0.03], "vwap_filter": [0, 1], "volume_z": [None], "stop_atr": [0.1, 0.2], "target_r": [0.0, 2.0], "hold": [4, 8]}),
          ("rolling_breakout", {"lookback": [3, 5], "buffer_atr": [0.0], "vwap_filter": [1], "volume_z": [-0.5, 0.0], **_EXE1}),
          ("impulse_continuation", {"lookback": [2, 4], "impulse_atr": [0.08, 0.15], "volume_z": [-0.5, 0.0], "stop_atr": [0.2], "target_r": [0.0, 2.0], "hold": [8]}),
          ("vwap_stretch_reversal", {"stretch_atr": [0.1, 0.3], "max_slope_atr": [0.05, 0.3], "slope_bars": [1, 4], "stop_atr": [0.2], "target_r": [2.0], "hold": [4, 8]})]


def setting_rows() -> dict[str, list[dict]]:
    """The table's rows per family, counted out by hand for the twin."""
    rows, n = {}, 0
    for family, values in BLOCKS:
        for combo in product(*reversed(values.values())):
            rows.setdefault(family, []).append({"setting_id": n, **dict(zip(values, reversed(combo)))})
            n += 1
    return rows


def _family_sql(family: str, source: str, on: str, up: str, dn: str) -> str:
    rows = setting_rows()[family]
    cell = lambda v: "NULL::DOUBLE" if v is None else repr(v)
    vals = f"(VALUES {', '.join('(' + ', '.join(map(cell, r.values())) + ')' for r in rows)}) v({', '.join('p_' + k if k in ('volume_z',) else k for k in rows[0])})"
    return f"""SELECT symbol, session, slot, side, atr, setting_id, stop_atr, target_r, hold FROM (SELECT *, CASE WHEN coalesce({up}, false) AND NOT coalesce({dn}, false) THEN 1 WHEN coalesce({dn}, false) AND NOT coalesce({up}, false) THEN -1 END AS side
 FROM {source} JOIN {vals} ON {on}) WHERE side IS NOT NULL AND atr > 0 AND is_normal AND slot < {flows.LAST[M]}"""


_BUSY = "(p_volume_z IS NULL OR volume_z >= p_volume_z)"
SETTINGS = {
    "sxa": " UNION ALL ".join(f"({q_triggers.extremes(n)})" for n in (3, 5)), "sxm": " UNION ALL ".join(f"({q_triggers.moves(n)})" for n in (2, 4)), "sxs": " UNION ALL ".join(f"({q_triggers.slopes(n)})" for n in (1, 4)),
    "sea": _family_sql("rolling_breakout", "sxa", "n = lookback", f"close > hi + buffer_atr * atr AND p_close <= phi + buffer_atr * atr AND (vwap_filter = 0 OR close > vwap) AND {_BUSY}",
                       f"close < lo - buffer_atr * atr AND p_close >= plo - buffer_atr * atr AND (vwap_filter = 0 OR close < vwap) AND {_BUSY}"),
    "sem": _family_sql("impulse_continuation", "sxm", "n = lookback", f"mv_ > impulse_atr AND pmv <= impulse_atr AND close > p_high AND {_BUSY}", f"mv_ < -impulse_atr AND pmv >= -impulse_atr AND close < p_low AND {_BUSY}"),
    "ses": _family_sql("vwap_stretch_reversal", "feat JOIN sxs USING (symbol, session, slot)", "k = slope_bars", "p_close - p_vwap < -stretch_atr * atr AND close > p_high AND abs(slope) <= max_slope_atr * atr", "p_close - p_vwap > stretch_atr * atr AND close < p_low AND abs(slope) <= max_slope_atr * atr"),
    **{**flows.trades_sql(), "eve": "SELECT *, row_number() OVER () AS eid, setting_id AS config_id FROM (SELECT * FROM sea UNION ALL SELECT * FROM sem UNION ALL SELECT * FROM ses)"},
    "ex": qs.EXE["ex"], **qs.WIDE,
    "fam": " UNION ALL ".join(f"SELECT {r['setting_id']} AS config_id, '{f}' AS family" for f, rows in setting_rows().items() for r in rows)}


@register("grid_settings", with_ctes(M, """SELECT family, CAST(count(DISTINCT (symbol, session, slot, side)) AS BIGINT) AS events, CAST(count(*) AS BIGINT) AS wanted, CAST(count(DISTINCT (symbol, session, slot, side, stop_atr, target_r, hold)) AS BIGINT) AS labels
 FROM (SELECT f.family, symbol, session, slot, side, stop_atr, target_r, hold FROM eve JOIN fam f USING (config_id)) GROUP BY 1""", SETTINGS))
def grid_settings(spark, sf):
    """Per family of the table: bars that raise an event, outcomes that its settings want, and labels that have to be computed for them."""
    s = materialize(sg.settings_table(spark, BLOCKS), "settings")
    made = []
    for family in sorted({f for f, _ in BLOCKS}):
        own = s.filter(F.col("family") == family)
        d = sg.dispatched(sg.events_of(views.feat(spark, sf, M), own, flows.LAST[M]), own)
        made.append(d.agg(F.lit(family).alias("family"), F.count_distinct("symbol", "session", "slot", "side").alias("events"), F.sum(F.size("setting_ids")).alias("wanted"), F.count(F.lit(1)).alias("labels")))
    return reduce(lambda x, y: x.unionByName(y), made)


@register("search_evaluate_settings", with_ctes(M, pick("setting_id:i family symbol trades:i net:d max_drawdown:d", "(SELECT config_id AS setting_id, family, symbol, trades, net, max_drawdown FROM wide JOIN fam USING (config_id))"), SETTINGS, recursive=True))
def search_evaluate_settings(spark, sf):
    """Three families with axes of their own in one plan, driven by a table: signals by dispatch, each distinct (event, stop, target, hold) labelled once."""
    s = materialize(sg.settings_table(spark, BLOCKS), "settings")
    wanted = sg.dispatched(sg.events_of(views.feat(spark, sf, M), s, flows.LAST[M]), s)
    o = out.barrier_outcome(wanted, out.pack_bars(views.grid(spark, sf, M)), views.MODELS[M].flat)
    t = out.select_non_overlapping(o.withColumn("config_id", F.explode("setting_ids")).drop("setting_ids"), ["config_id", *K], *flows.WINDOW, max_n=3)
    t = out.net_pnl(out.size_max_exposure(t, F.lit(400.0))).withColumns({"year": F.year("session"), "executed": F.col("qty") > 0})
    r = st.wide_stats(t, TRAIN, VALIDATE, TEST).withColumnRenamed("config_id", "setting_id")
    return r.join(s.select("setting_id", "family"), "setting_id").select("setting_id", "family", "symbol", "trades", "net", "max_drawdown")
