"""Queries for fitted models, forecasts, remaining sequence detectors and streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.functions.core import by_day, prior, ratio, sgn
from tidebar.operators import detect as det
from tidebar.operators import features as feats
from tidebar.operators import folds, models
from tidebar.operators import rules as rl
from tidebar.plans import flows, views
from tidebar.plans.oracle import pick, with_ctes
from tidebar.plans.q_detect import EV, hourly, mirror_sql
from tidebar.plans.q_ingest import K
from tidebar.plans.q_windows import H, M, snapshots
from tidebar.plans.registry import register
from tidebar.plans.views import TEST, TRAIN, VALIDATE
from tidebar.streaming import streams

TREE_F = ["gap_atr", "session_ret", "rv4", "vwap_dist_atr", "or_pos", "from_low_atr", "to_high_atr", "eff4", "time_frac"]


# ---- zones and levels; the twins are joins of zones with bars, and recursion only where one entry excludes another

def zone_sql(formed: str, lo: str, hi: str, extra: dict[str, str], fired: str, start: int = 3, bodies: int = 0) -> str:
    """Twin of a zone detector: ``zrw`` bars of both sides, ``zon`` zones; ``fired`` selects symbol, session, side, slot and the zone's bar g."""
    mb = f", CASE WHEN count(c - o) OVER b >= {bodies} THEN quantile_cont(abs(c - o), 0.5) OVER b END AS mb" if bodies else ""
    win = f" WINDOW b AS (PARTITION BY symbol, session, side ORDER BY slot ROWS BETWEEN {bodies} PRECEDING AND 1 PRECEDING)" if bodies else ""
    x = {**mirror_sql(3), "zr0": f"SELECT *, lag(h, 2) OVER (PARTITION BY symbol, session, side ORDER BY slot) AS h2, lag(l, 2) OVER (PARTITION BY symbol, session, side ORDER BY slot) AS l2{mb} FROM mir{win}",
         "zrw": f"SELECT *, coalesce(c > dn AND c < up, false) AS inside FROM zr0 WHERE slot >= {start} AND slot < 21",
         "zon": f"SELECT symbol, session, side, slot AS g, {lo} AS lo, {hi} AS hi FROM zrw WHERE c IS NOT NULL AND bl IS NOT NULL AND {formed}", **extra, "zfr": fired,
         "zst": "SELECT f.symbol, f.session, f.side, f.slot, min(r.l) * f.side AS stop_ref FROM zfr f JOIN mir r ON r.symbol = f.symbol AND r.session = f.session AND r.side = f.side AND r.slot BETWEEN f.g - 2 AND f.slot GROUP BY f.symbol, f.session, f.side, f.slot",
         "zlo": "SELECT z.* FROM zst z JOIN (SELECT symbol, session, slot FROM zst GROUP BY 1, 2, 3 HAVING count(*) = 1) USING (symbol, session, slot)"}
    return with_ctes(H, pick(EV + " stop_ref:d", "zlo"), x, recursive=True)


_SAME = "r.symbol = z.symbol AND r.session = z.session AND r.side = z.side"
#: The bar that closes through each opposing gap while the session has no missing bar, and the newest such gap of a bar.
BROKEN = {"zbk": f"SELECT * FROM (SELECT z.symbol, z.session, z.side, z.g, z.lo, z.hi, min(r.slot) FILTER (r.c > z.hi) AS t, min(r.slot) FILTER (r.c IS NULL) AS gap FROM zon z JOIN zrw r ON {_SAME} AND r.slot > z.g GROUP BY ALL) WHERE t - g <= 10 AND coalesce(gap > t, true)",
          "znw": "SELECT symbol, session, side, t AS slot, max(g) AS g, arg_max(lo, g) AS lo, arg_max(hi, g) AS hi FROM zbk GROUP BY 1, 2, 3, 4"}
#: One entry at a time: the gap closed through last waits for a return of at most 8 bars.
RETEST = {**BROKEN,
          "zrr": "SELECT r.*, n.g AS ng, n.lo AS nlo, n.hi AS nhi, row_number() OVER (PARTITION BY r.symbol, r.session, r.side ORDER BY r.slot) AS rn FROM zrw r LEFT JOIN znw n USING (symbol, session, side, slot)",
          "zre": """SELECT DISTINCT symbol, session, side, CAST(0 AS BIGINT) AS rn, CAST(NULL AS INTEGER) AS slot, CAST(NULL AS INTEGER) AS g, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS INTEGER) AS inv, CAST(NULL AS INTEGER) AS hit FROM zrr
 UNION ALL SELECT symbol, session, side, rn, slot, CASE WHEN c IS NULL THEN NULL WHEN taken THEN ng WHEN kept THEN g END, CASE WHEN taken THEN nlo ELSE lo END, CASE WHEN taken THEN nhi ELSE hi END, CASE WHEN taken THEN slot ELSE inv END, CASE WHEN back AND inside THEN g END
 FROM (SELECT *, NOT kept AND NOT (back AND inside) AND ng IS NOT NULL AND inside AS taken FROM (SELECT *, g IS NOT NULL AND NOT ended AND NOT back AS kept FROM (SELECT *, g IS NOT NULL AND NOT ended AND l <= hi AND h >= lo AND c > hi AS back FROM
 (SELECT r.*, s.g, s.lo, s.hi, s.inv, coalesce(r.c IS NULL OR r.slot - s.inv > 8 OR r.c < s.lo OR r.h >= r.up, true) AS ended FROM zre s JOIN zrr r ON r.symbol = s.symbol AND r.session = s.session AND r.side = s.side AND r.rn = s.rn + 1))))"""}
#: Gaps that a pull back may test, newest first; a test uses the newest one up.
PULL = {"zdt": f"SELECT z.symbol, z.session, z.side, z.g, z.lo, z.hi, coalesce(min(r.slot) FILTER (r.c IS NULL OR r.slot - z.g > 10 OR r.c < z.lo OR r.h >= r.up), 99) AS dead FROM zon z LEFT JOIN zrw r ON {_SAME} AND r.slot > z.g GROUP BY ALL",
        "zcd": "SELECT r.*, row_number() OVER (PARTITION BY r.symbol, r.session, r.side ORDER BY r.slot) AS rn, z.gs FROM zrw r LEFT JOIN (SELECT r.symbol, r.session, r.side, r.slot, list({'g': z.g, 'lo': z.lo, 'hi': z.hi} ORDER BY z.g DESC) AS gs FROM zrw r JOIN zdt z ON " + _SAME + " AND r.slot > z.g AND r.slot < z.dead GROUP BY 1, 2, 3, 4) z USING (symbol, session, side, slot)",
        "zus": """SELECT DISTINCT symbol, session, side, CAST(0 AS BIGINT) AS rn, CAST(NULL AS INTEGER) AS slot, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS hit FROM zcd
 UNION ALL SELECT symbol, session, side, rn, slot, CASE WHEN test THEN list_append(used, z.g) ELSE used END, CASE WHEN test AND inside THEN z.g END FROM (SELECT *, coalesce(l <= z.hi AND h >= z.lo AND c > z.hi, false) AS test FROM
 (SELECT r.*, s.used, list_filter(r.gs, lambda x: NOT list_contains(s.used, x.g))[1] AS z FROM zus s JOIN zcd r ON r.symbol = s.symbol AND r.session = s.session AND r.side = s.side AND r.rn = s.rn + 1))"""}
_NEWEST = "SELECT n.symbol, n.session, n.side, n.slot, n.g FROM znw n JOIN zrw r USING (symbol, session, side, slot) WHERE r.inside"


def zones(name, seq, sql, start=3, bodies=None):
    def plan(spark, sf):
        ev = folds.run_sequence(folds.mirror(views.feat(spark, sf, H), 3, 3, start, bodies), seq, False, 21)
        return folds.lone_side(ev)
    register(name, sql)(plan)


zones("detect_gap_retest", folds.gap_retest(1, 10), zone_sql("l - h2 >= 0.25 AND h2 > dn AND l < up", "h2", "l", PULL, "SELECT symbol, session, side, slot, hit AS g FROM zus WHERE hit IS NOT NULL"))
zones("detect_inverse_gap", folds.inverse_gap(1, 10), zone_sql("l2 - h >= 0.25", "h", "l2", BROKEN, _NEWEST))
zones("detect_inverse_gap_retest", folds.inverse_gap_retest(1, 10, 8), zone_sql("l2 - h >= 0.25", "h", "l2", RETEST, "SELECT symbol, session, side, slot, hit AS g FROM zre WHERE hit IS NOT NULL"))
# gaps formed while the opening range is still open, here of six bars, and a closing bar with a displacement
zones("detect_inverse_gap_opening", folds.inverse_gap(1, 10, 6, "opening"), zone_sql("l2 - h >= 0.25 AND slot < 6", "h", "l2", BROKEN, _NEWEST + " AND n.slot >= 6", 0), 0)
zones("detect_inverse_gap_displaced", folds.inverse_gap(1, 10, 3, "post", (1.0, 0.4)),
      zone_sql("l2 - h >= 0.25", "h", "l2", BROKEN, _NEWEST + " AND r.mb > 0 AND r.c > r.o AND r.c - r.o >= r.mb AND r.c - r.o >= 0.4 * (r.h - r.l) AND r.h - r.c <= 0.2 * (r.h - r.l)", 3, 4), 3, 4)


#: Levels open at pivots far from open ones of their kind; each then counts its bounces on its own; entries wait out a hold.
LEVELS = {
    "ag0": """SELECT symbol, session, slot, high, low, close, greatest(0.25, atr * 0.05) AS b, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session ORDER BY slot) AS gone,
 CASE WHEN count(close) OVER f = 5 AND lag(low, 2) OVER o = min(low) OVER f THEN lag(low, 2) OVER o END AS plo, CASE WHEN count(close) OVER f = 5 AND lag(high, 2) OVER o = max(high) OVER f THEN lag(high, 2) OVER o END AS phi
 FROM feat WHERE atr > 0 WINDOW o AS (PARTITION BY symbol, session ORDER BY slot), f AS (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "agb": "SELECT * FROM ag0 WHERE gone = 0 AND slot >= 2 AND slot < 22",
    "agp": "SELECT *, row_number() OVER (PARTITION BY symbol, session, kind ORDER BY slot) AS rn FROM (SELECT symbol, session, slot, b, -1 AS kind, phi AS px FROM agb WHERE phi IS NOT NULL UNION ALL SELECT symbol, session, slot, b, 1, plo FROM agb WHERE plo IS NOT NULL)",
    "ago": """SELECT DISTINCT symbol, session, kind, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(px DOUBLE, born INTEGER)[]) AS lv FROM agp
 UNION ALL SELECT p.symbol, p.session, p.kind, p.rn, CASE WHEN len(list_filter(s.lv, lambda z: p.slot - z.born <= 15 AND abs(z.px - p.px) < 2 * p.b)) = 0 THEN list_append(s.lv, {'px': p.px, 'born': p.slot}) ELSE s.lv END
 FROM ago s JOIN agp p ON p.symbol = s.symbol AND p.session = s.session AND p.kind = s.kind AND p.rn = s.rn + 1""",
    "agl": "SELECT symbol, session, kind, z.px AS px, z.born AS born FROM (SELECT symbol, session, kind, unnest(arg_max(lv, rn)) AS z FROM ago GROUP BY 1, 2, 3)",
    "agr": """SELECT symbol, session, kind, px, born, born AS slot, 0 AS n, false AS wait, false AS ready FROM agl
 UNION ALL SELECT s.symbol, s.session, s.kind, s.px, s.born, r.slot, s.n + CASE WHEN s.wait AND s.kind * (r.close - s.px) > r.b THEN 1 ELSE 0 END, CASE WHEN s.wait THEN abs(r.close - s.px) <= r.b ELSE r.low <= s.px + r.b AND r.high >= s.px - r.b END,
 s.wait AND s.kind * (r.close - s.px) > r.b AND s.n >= 1 FROM agr s JOIN agb r ON r.symbol = s.symbol AND r.session = s.session AND r.slot = s.slot + 1 WHERE r.slot - s.born <= 15""",
    "age": "SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY slot) AS rn FROM (SELECT symbol, session, slot, arg_min(kind, born * 2 + CASE WHEN kind > 0 THEN 1 ELSE 0 END) AS side FROM agr WHERE ready GROUP BY 1, 2, 3)",
    "agf": """SELECT DISTINCT symbol, session, CAST(0 AS BIGINT) AS rn, CAST(NULL AS INTEGER) AS slot, 0 AS side, -1 AS last, false AS fired FROM age
 UNION ALL SELECT e.symbol, e.session, e.rn, e.slot, e.side, CASE WHEN e.slot > s.last THEN e.slot + 2 ELSE s.last END, e.slot > s.last FROM agf s JOIN age e ON e.symbol = s.symbol AND e.session = s.session AND e.rn = s.rn + 1"""}


@register("detect_ageing_levels", with_ctes(H, pick("symbol session slot:i side:i target_ref:d", "(SELECT f.symbol, f.session, f.slot, f.side, b.close + f.side * 2 * b.b AS target_ref FROM agf f JOIN agb b USING (symbol, session, slot) WHERE f.fired)"), LEVELS, recursive=True))
def detect_ageing_levels(spark, sf):
    return folds.ageing_levels(views.feat(spark, sf, H), 2, 1, 15, 2, 0.05, 22)


#: Pivots in runs of one kind; a shape is read off the extreme so far of the present run and those of the four before it.
TRIANGLE = {
    "tr0": """SELECT *, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session ORDER BY slot) AS gone, lag(sm) OVER o AS v, lag(sm, 2) OVER o AS bf FROM
 (SELECT *, close + 0 * lag(close) OVER (PARTITION BY symbol, session ORDER BY slot) AS sm FROM feat WHERE atr > 0 AND is_normal AND or_high IS NOT NULL) WINDOW o AS (PARTITION BY symbol, session ORDER BY slot)""",
    "tr1": """SELECT symbol, session, slot, v, CASE WHEN slot < 5 OR v <= or_low OR v >= or_high THEN 0 WHEN v > bf AND v > sm THEN 1 WHEN v < bf AND v < sm THEN -1 ELSE 0 END AS k, CASE WHEN close > or_high THEN 1 WHEN close < or_low THEN -1 ELSE 0 END AS side
 FROM tr0 WHERE gone = 0 AND slot >= 3 AND slot < 21""",
    "tr2": "SELECT *, sum(turn) OVER (PARTITION BY symbol, session ORDER BY slot) AS run FROM (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY symbol, session ORDER BY slot) THEN 0 ELSE 1 END AS turn FROM tr1 WHERE k <> 0)",
    "tr3": "SELECT symbol, session, run, any_value(k) * max(k * v) AS v FROM tr2 GROUP BY 1, 2, 3",
    "tr4": "SELECT a.symbol, a.session, a.slot, a.k, a.k * max(a.k * a.v) OVER (PARTITION BY a.symbol, a.session, a.run ORDER BY a.slot) AS v5, d.v AS v4, c.v AS v3, b.v AS v2, e.v AS v1 FROM tr2 a " + " ".join(
        f"JOIN tr3 {n} ON {n}.symbol = a.symbol AND {n}.session = a.session AND {n}.run = a.run - {i}" for n, i in (("d", 1), ("c", 2), ("b", 3), ("e", 4))),
    "tr5": "SELECT symbol, session, min(slot) AS shape FROM tr4 WHERE k * (v5 - v3) < 0 AND -k * (v4 - v2) < 0 AND k * (v3 - v1) < 0 AND v2 <> v1 AND abs(v5 - v4) <= 0.9 * abs(v2 - v1) GROUP BY 1, 2",
    "tr6": "SELECT t.symbol, t.session, t.shape, min(r.slot) AS slot FROM tr5 t JOIN tr1 r USING (symbol, session) WHERE r.side <> 0 GROUP BY 1, 2, 3"}


@register("detect_triangle", with_ctes(H, pick("symbol session slot:i side:i shape_slot:i", "(SELECT t.symbol, t.session, t.slot, r.side, t.shape AS shape_slot FROM tr6 t JOIN tr1 r USING (symbol, session, slot) WHERE t.slot > t.shape AND t.slot <= t.shape + 10)"), TRIANGLE))
def detect_triangle(spark, sf):
    f = feats.local_linear(views.feat(spark, sf, H), 2)
    return folds.triangle(f, 3, 1, 0.1, 10, 21)


def ridge_frame(spark, sf):
    """Previous return, gap, volatility, weekday and interactions; return from slot 1 to slot 20."""
    f = views.feat(spark, sf, M)
    d = f.groupBy(*K).agg(F.first("prev_ret").alias("prev_ret"), F.first("gap").alias("gap"), F.first("vol").alias("vol"), F.first("day_open").alias("day_open"),
                          F.max(F.when(F.col("slot") == 1, F.col("open"))).alias("_a"), F.max(F.when(F.col("slot") == 20, F.col("open"))).alias("_b"))
    return d.withColumns({"monday": (F.dayofweek("session") == 2).cast("double"), "sign_x": (sgn(F.col("prev_ret")) * sgn(F.col("gap"))).cast("double"),
                          "prod_x": F.col("prev_ret") * F.col("gap"), "y": F.try_divide("_b", "_a") - 1})


RIDGE_X = ["prev_ret", "gap", "vol", "monday", "sign_x", "prod_x"]


def ridge_sql(source: str, xs: list[str], y: str, n: int, lam: float, minimum: int) -> dict[str, str]:
    """Twin of ``rolling_ridge`` by Gauss-Jordan elimination: ``rg`` is ``source`` with pred, unc and b0, b1, ... (slopes)."""
    k = len(xs)
    ok = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, y])
    names = [f"CASE WHEN {ok} THEN {c} END" for c in [*xs, y]]
    at = lambda i, j: f"c{max(i, j)}_{min(i, j)}"
    total = lambda f: " + ".join(f(i) for i in range(k))
    mom = [f"count({names[k]}) OVER w AS n", *[f"avg({v}) OVER w AS m{i}" for i, v in enumerate(names)], *[f"covar_pop({names[i]}, {names[j]}) OVER w AS c{i}_{j}" for i in range(k + 1) for j in range(i + 1)]]
    out = {"rg0": f"SELECT *, {', '.join(mom)} FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)",
           "rg1": f"SELECT *, {', '.join(f'CASE WHEN sqrt({at(i, i)}) > 1e-10 THEN sqrt({at(i, i)}) ELSE 1 END AS s{i}' for i in range(k))} FROM rg0 WHERE n >= {minimum}"}
    # columns of the system: the matrix with lam on its diagonal, the moments with y, the standardised values
    cells = [f"{at(i, j)} / s{i} / s{j} + {lam if i == j else 0} AS e0_{i}_{j}" for i in range(k) for j in range(k)]
    cells += [f"c{k}_{i} / s{i} AS e0_{i}_{k}" for i in range(k)] + [f"({x} - m{i}) / s{i} AS e0_{i}_{k + 1}" for i, x in enumerate(xs)]
    out["rge0"] = f"SELECT *, {', '.join(cells)} FROM rg1"
    for p in range(k):
        made = [f"e{p}_{p}_{m} / e{p}_{p}_{p} AS e{p + 1}_{p}_{m}" if i == p else f"e{p}_{i}_{m} - e{p}_{i}_{p} / e{p}_{p}_{p} * e{p}_{p}_{m} AS e{p + 1}_{i}_{m}" for i in range(k) for m in range(k + 2)]
        out[f"rge{p + 1}"] = f"SELECT *, {', '.join(made)} FROM rge{p}"
    b, z = lambda i: f"e{k}_{i}_{k}", lambda i: f"e{k}_{i}_{k + 1}"
    fitted = " + ".join(f"{b(i)} * {b(j)} * {at(i, j)} / s{i} / s{j}" for i in range(k) for j in range(k))
    out["rg"] = f"""SELECT *, m{k} + {total(lambda i: f'{b(i)} * e0_{i}_{k + 1}')} AS pred, sqrt(greatest(0, (c{k}_{k} - 2 * ({total(lambda i: f'{b(i)} * e0_{i}_{k}')}) + {fitted}) * (1 + {total(lambda i: f'e0_{i}_{k + 1} * {z(i)}')}) / n)) AS unc,
 {', '.join(f'{b(i)} / s{i} AS b{i}' for i in range(k))} FROM rge{k}"""
    return out


SIGN = lambda c: f"(CASE WHEN {c} > 0 THEN 1 WHEN {c} < 0 THEN -1 WHEN {c} = 0 THEN 0 END)"
RIDGE = {"rfr": f"""SELECT *, CASE WHEN dayofweek(session) = 1 THEN 1.0 ELSE 0.0 END AS monday, CAST({SIGN('prev_ret')} * {SIGN('gap')} AS DOUBLE) AS sign_x, prev_ret * gap AS prod_x, b / nullif(a, 0) - 1 AS y
 FROM (SELECT symbol, session, min(prev_ret) AS prev_ret, min(gap) AS gap, min(vol) AS vol, min(day_open) AS day_open, max(open) FILTER (slot = 1) AS a, max(open) FILTER (slot = 20) AS b FROM feat GROUP BY 1, 2)""",
         **ridge_sql("rfr", RIDGE_X, "y", 60, 0.1, 12)}


@register("win_rolling_ridge", with_ctes(M, pick("symbol session pred:d unc:d", "rfr LEFT JOIN (SELECT symbol, session, pred, CASE WHEN pred IS NOT NULL THEN unc END AS unc FROM rg) USING (symbol, session)"), RIDGE))
def win_rolling_ridge(spark, sf):
    return models.rolling_ridge(ridge_frame(spark, sf), RIDGE_X, "y", 60, 0.1, 12).select(*K, "pred", "unc")


@register("detect_conditional_forecast", with_ctes(M, pick("symbol session side:i pred:d", f"(SELECT symbol, session, CASE WHEN abs(pred) > 0.01 / day_open + 0.25 * unc THEN {SIGN('pred')} ELSE 0 END AS side, pred FROM rg WHERE pred IS NOT NULL)"), RIDGE))
def detect_conditional_forecast(spark, sf):
    x = models.rolling_ridge(ridge_frame(spark, sf), RIDGE_X, "y", 60, 0.1, 12).filter("pred IS NOT NULL")
    go = F.abs("pred") > 0.01 / F.col("day_open") + 0.25 * F.col("unc")
    return x.select(*K, F.when(go, sgn(F.col("pred"))).otherwise(0).alias("side"), "pred")


VOLUME = {"rvf": """SELECT *, x1 * (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS x2 FROM (SELECT *, (oc - oo) / nullif(atr, 0) AS x1, (e - oc) / nullif(atr, 0) AS y
 FROM (SELECT symbol, session, min(atr) AS atr, min(or_volume) AS v, min(or_close) AS oc, min(or_open) AS oo, max(open) FILTER (slot = 15) AS e FROM feat GROUP BY 1, 2))
 WINDOW w AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""", **ridge_sql("rvf", ["x1", "x2"], "y", 60, 0.001, 12),
          "itc": "SELECT * FROM (SELECT *, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session ORDER BY slot) AS gn FROM feat WHERE slot < 14) WHERE gn = 0",
          "rvg": "SELECT f.*, r.oc + r.pred * r.atr AS goal, r.b1 * r.x2 AS part FROM itc f JOIN (SELECT symbol, session, oc, pred, atr, b1, x2 FROM rg WHERE pred IS NOT NULL) r USING (symbol, session)"}


@register("detect_return_volume_forecast", with_ctes(M, pick("symbol session side:i slot:i", """(SELECT symbol, session, CASE WHEN close > or_high THEN 1 ELSE -1 END AS side, min(slot) AS slot FROM rvg
 WHERE slot >= 3 AND slot < 24 AND atr > 0 AND is_normal AND abs(part) >= 0.005 AND ((close > or_high AND goal - close > 1) OR (close < or_low AND close - goal > 1)) GROUP BY 1, 2, 3)"""), VOLUME))
def detect_return_volume_forecast(spark, sf):
    """Opening move and its product with abnormal opening volume forecast the remaining move."""
    f = views.feat(spark, sf, M)
    d = f.groupBy(*K).agg(F.first("atr").alias("atr"), F.first("or_volume").alias("v"), F.first("or_close").alias("oc"), F.first("or_open").alias("oo"),
                          F.max(F.when(F.col("slot") == 15, F.col("open"))).alias("_e"))
    w = prior(by_day(), 20)
    d = d.withColumn("vz", ratio(F.col("v") - F.avg("v").over(w), F.nullif(F.stddev_samp("v").over(w), F.lit(0.0))))
    d = d.withColumns({"x1": ratio(F.col("oc") - F.col("oo"), F.col("atr")), "y": ratio(F.col("_e") - F.col("oc"), F.col("atr"))})
    d = models.rolling_ridge(d.withColumn("x2", F.col("x1") * F.col("vz")), ["x1", "x2"], "y", 60, 0.001, 12).filter("pred IS NOT NULL")
    d = d.withColumns({"goal": F.col("oc") + F.col("pred") * F.col("atr"), "part": F.get("beta", F.lit(1)) * F.col("x2")})
    x = f.join(d.select(*K, "goal", "part"), K).filter("slot < 14")
    strong = F.abs("part") >= 0.005  # the product has to move the forecast
    return det.first_breaks(x, 3, strong & (F.col("goal") - F.col("close") > 1.0), strong & (F.col("close") - F.col("goal") > 1.0), 24)


@register("model_tree_rules")
def model_tree_rules(spark, sf):
    s = snapshots(spark, sf)
    rules = models.tree_rules(s, TREE_F, "y2", TRAIN, 3, 20)
    return models.rule_means(rl.apply_rules(s, rules), "y2", TRAIN, VALIDATE, TEST)


def gate_frame(spark, sf):
    d = views.daily(spark, sf, M)
    o = feats.opening_ranges(views.bars(spark, sf, M), [3]).select(*K, "or_high", "or_low", "or_width", "or_close", F.col("or_dir").cast("double").alias("or_dir"))
    return d.join(o, K).withColumns({"up": (F.col("day_close") > F.col("or_close")).cast("double"), "day_range": F.col("day_high") - F.col("day_low")})


GATE_X = ["or_width", "or_dir", "gap", "prev_ret", "atr", "vol"]


@register("model_classifier")
def model_classifier(spark, sf):
    return models.classifier_scores(gate_frame(spark, sf), GATE_X, "up", TRAIN, [8]).select(*K, "p_up")


@register("model_range_forecast")
def model_range_forecast(spark, sf):
    return models.range_forecast(gate_frame(spark, sf), GATE_X, "day_range", TRAIN, 3).select(*K, "pred_range", "day_range")


@register("entry_classifier_gate")
def entry_classifier_gate(spark, sf):
    p = models.classifier_scores(gate_frame(spark, sf), GATE_X, "up", TRAIN, [8]).select(*K, "p_up")
    x = views.feat(spark, sf, M).filter("or_high IS NOT NULL").join(p, K)
    x = x.withColumn("direction", F.when(F.col("p_up") >= 0.55, "LONG").when(F.col("p_up") <= 0.45, "SHORT")).filter("direction IS NOT NULL")
    return det.breach_entry(x.withColumns({"upper": F.col("or_high"), "lower": F.col("or_low")}), "CLOSE", F.lit(3), 20)


@register("entry_range_gate")
def entry_range_gate(spark, sf):
    p = models.range_forecast(gate_frame(spark, sf), GATE_X, "day_range", TRAIN, 3).filter(F.col("pred_range") / F.col("or_width") >= 1.1).select(*K)
    x = views.feat(spark, sf, M).filter("or_high IS NOT NULL").join(p, K, "left_semi")
    return det.breach_entry(x.withColumns({"upper": F.col("or_high"), "lower": F.col("or_low"), "direction": F.lit("BOTH")}), "CLOSE", F.lit(3), 20)


@register("outcome_posterior_exit")
def outcome_posterior_exit(spark, sf):
    f = views.feat(spark, sf, H)
    post = models.run_length_posterior(f.select(*K, "slot", "ret_z"), 0.1, 4)
    o = flows.outcomes(spark, sf, H).filter("NOT is_unknown AND exec_id = 1")
    return models.exit_posterior(o, post, f, 0.5, 1).select("config_id", *K, "slot", "side", "early_slot", "early_pnl_pts")


# ---- streams: compared on the windows the watermark has closed --------------------

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
#: The watermark: what the stream has closed once it has seen everything.
STOP = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def stream(spark, sf):
    return streams.event_stream(spark, f"{sf}/events.parque[t]", SCHEMA, "10 minutes")


@register("stream_bars", f"""SELECT event_type AS symbol, CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS bar_epoch, round(first(value ORDER BY ts, event_id) + 3e-10, 6) + 0.0 AS open,
 round(max(value) + 3e-10, 6) + 0.0 AS high, round(min(value) + 3e-10, 6) + 0.0 AS low, round(last(value ORDER BY ts, event_id) + 3e-10, 6) + 0.0 AS close, CAST(count(*) AS BIGINT) AS volume
 FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= {STOP}""")
def stream_bars(spark, sf):
    b = streams.drain(streams.stream_bars(stream(spark, sf), "1 hour"), "stream-bars")
    return b.select("symbol", F.unix_timestamp("bar_ts").alias("bar_epoch"), "open", "high", "low", "close", "volume")


@register("stream_sessions", f"""SELECT CAST(user_id AS BIGINT) AS user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_epoch, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) + 0.0 AS value FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM
 (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= {STOP}""")
def stream_sessions(spark, sf):
    s = streams.drain(streams.stream_sessions(stream(spark, sf), "30 minutes"), "stream-sessions")
    return s.select("user_id", F.floor(F.unix_micros("session_start") / 1000000).cast("bigint").alias("start_epoch"), "events", F.round("value", 4).alias("value"))


@register("stream_quality", f"""SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS window_epoch, CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) FILTER (value IS NULL OR isnan(value)) AS BIGINT) AS bad_value,
 CAST(count(*) FILTER (value < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (abs(value / 0.25 - round(value / 0.25)) > 1e-8) AS BIGINT) AS off_tick FROM events GROUP BY 1, time_bucket(INTERVAL 6 HOUR, ts) HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= {STOP}""")
def stream_quality(spark, sf):
    q = streams.drain(streams.stream_quality(stream(spark, sf), "6 hours"), "stream-quality")
    return q.select(F.unix_timestamp("window_start").alias("window_epoch"), "row_count", "bad_value", "negative", "off_tick")


@register("stream_quality_updates", """SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS window_epoch, CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) FILTER (value IS NULL OR isnan(value)) AS BIGINT) AS bad_value,
 CAST(count(*) FILTER (value < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (abs(value / 0.25 - round(value / 0.25)) > 1e-8) AS BIGINT) AS off_tick FROM events GROUP BY 1, time_bucket(INTERVAL 6 HOUR, ts)""")
def stream_quality_updates(spark, sf):
    """All windows, those the watermark has not closed included, as the last batch left them."""
    q, _ = streams.upsert(streams.stream_quality(stream(spark, sf), "6 hours"), ["window_start"], "stream-quality")
    return q.select(F.unix_timestamp("window_start").alias("window_epoch"), "row_count", "bad_value", "negative", "off_tick")
