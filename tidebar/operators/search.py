"""Grids, walk-forward choice, resampling, audits and comparisons (X operators)."""
from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidebar.functions.core import KEYS

RESULT = ["config_id", "symbol"]


def family_counts(grid: DataFrame, expected: DataFrame) -> DataFrame:
    """Settings per family beside the expected number; both sides are kept."""
    got = grid.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    return got.join(expected, "family", "full").select(
        "family", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"),
        (F.coalesce("n", F.lit(0)) == F.coalesce("expected", F.lit(0))).alias("ok"))


def completion_rollup(grid: DataFrame, done: DataFrame, key: list[str], family: str) -> DataFrame:
    """Expected and recovered settings per family and in total."""
    x = grid.select(*key, family).join(done.select(*key).distinct().withColumn("_d", F.lit(1)), key, "left")
    return x.rollup(family).agg(F.count(F.lit(1)).alias("expected"), F.count("_d").alias("recovered")).withColumn(
        "status", F.when(F.col("expected") == F.col("recovered"), "COMPLETE").otherwise("INCOMPLETE"))


def canonical_grid(grid: DataFrame, axes: list[str]) -> DataFrame:
    """Clamp the cut-off under the flat slot, then collapse equal settings and count them."""
    x = grid.withColumn("cutoff", F.least("cutoff", F.col("flat") - 1))
    return x.groupBy(*axes).agg(F.count(F.lit(1)).alias("aliases"))


def canonical_id(*cols: str):
    """Identity of a setting: hash of its canonical JSON, keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def walk_forward(daily: DataFrame, calendar: DataFrame, unit: str, history: int, min_known: int, min_events: int,
                 mdd_floor: float, by: list[str] = RESULT) -> DataFrame:
    """At each period start pick the best setting on the preceding sessions, use it in the period.

    ``daily``: every (setting, session) of the calendar with pnl, known, entries. Training windows
    are the session ranks just before the period. Which sessions serve which periods is settled on the
    calendar, so days are joined by (symbol, session), never by the symbol alone. Ties go to the smaller id."""
    cal = calendar.select("symbol", "session").withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy("session")))
    cal = cal.withColumn("period", F.trunc("session", unit))
    starts = cal.groupBy("symbol", "period").agg(F.min("_k").alias("_first")).withColumn("_from", F.greatest(F.lit(1), F.col("_first") - history))
    starts = starts.filter(F.col("_first") - F.col("_from") >= min_known)
    d = daily.join(cal.select("symbol", "session"), ["symbol", "session"])
    serves = cal.drop("period").join(starts, "symbol").filter(F.col("_k").between(F.col("_from"), F.col("_first") - 1)).select("symbol", "session", "period")
    tr = daily.join(serves, ["symbol", "session"])
    w = W.partitionBy(*by, "period").orderBy("session")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    tr = tr.withColumn("_eq", F.sum(F.when(F.col("known"), F.col("pnl")).otherwise(0.0)).over(run))
    tr = tr.withColumn("_pk", F.greatest(F.lit(0.0), F.max("_eq").over(run)))
    s = tr.groupBy(*by, "period").agg(F.sum(F.when(F.col("known"), F.col("pnl")).otherwise(0.0)).alias("train_net"),
                                      F.min(F.col("_eq") - F.col("_pk")).alias("_dd"), F.bool_and("known").alias("_ok"),
                                      F.sum("entries").alias("_ev"))
    s = s.filter(F.col("_ok") & (F.col("_ev") >= min_events) & (F.col("_dd") > mdd_floor) & (F.col("train_net") > 0))
    best = s.groupBy("symbol", "period").agg(F.max("train_net").alias("train_net"), F.min_by("config_id", F.struct(-F.col("train_net"), "config_id")).alias("config_id"))
    test = d.withColumn("period", F.trunc("session", unit)).join(best, ["symbol", "period", "config_id"])
    return test.groupBy("symbol", "period", "config_id", "train_net").agg(
        F.sum(F.when(F.col("known"), F.col("pnl")).otherwise(0.0)).alias("test_net"), F.count_if(~F.col("known")).alias("unknown_days"))


def bootstrap_ci(daily: DataFrame, by: list[str], block: int, draws: int) -> DataFrame:
    """Circular block resample of the daily mean: hashed start indices stand for random ones.

    Prefix sums over the doubled series turn a block into one difference, so a draw is
    ceil(n / block) lookups; the series of a result is bounded by the calendar."""
    g = daily.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("session", "pnl"))), lambda r: r["pnl"]).alias("_x"))
    g = g.withColumn("_n", F.size("_x"))
    x = g.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    nb = F.ceil(F.col("_n") / block).cast("int")
    start = lambda b: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit("s"), F.col("draw"), b)), 1, 8), 16, 10).cast("bigint"), F.col("_n"))
    idx = F.flatten(F.transform(F.sequence(F.lit(0), nb - 1), lambda b: F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.pmod(start(b) + i, F.col("_n")))))
    x = x.withColumn("_i", F.slice(idx, F.lit(1), F.col("_n")))
    mean = F.aggregate(F.transform("_i", lambda i: F.element_at("_x", (i + 1).cast("int"))), F.lit(0.0), lambda s, v: s + v) / F.col("_n")
    x = x.withColumn("_mean", mean)
    return x.groupBy(*by).agg(F.first("_n").alias("days"), F.percentile("_mean", F.lit(0.025)).alias("ci_low"),
                              F.percentile("_mean", F.lit(0.975)).alias("ci_high"))


# The rational approximation 7.1.26 of Abramowitz and Stegun, off by at most 1.5e-7
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function in plain columns."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    half = poly * F.exp(-z * z) / 2
    return F.when(x >= 0, 1 - half).otherwise(half)


def best_of_skilless(trials: int) -> float:
    """Expected largest of ``trials`` standard normal values."""
    if trials <= 1:
        return 0.0
    nd, euler = NormalDist(), 0.5772156649
    return (1 - euler) * nd.inv_cdf(1 - 1 / trials) + euler * nd.inv_cdf(1 - 1 / (trials * math.e))


def deflated_sharpe(daily: DataFrame, by: list[str], trials: int) -> DataFrame:
    """Probability that the Sharpe ratio beats the best of ``trials`` skill-less ones."""
    m = daily.groupBy(*by).agg(F.count("pnl").alias("n"), F.avg("pnl").alias("m"), F.stddev_pop("pnl").alias("s"),
                               F.skewness("pnl").alias("sk"), (F.kurtosis("pnl") + 3).alias("ku")).filter("n >= 5 AND s > 0")
    sr = F.col("m") / F.col("s")
    stat = (sr - F.lit(best_of_skilless(trials)) / F.sqrt(F.col("n") - 1)) * F.sqrt(F.col("n") - 1) / F.sqrt(
        F.greatest(F.lit(1e-12), 1 - F.col("sk") * sr + (F.col("ku") - 1) * sr * sr / 4))
    return m.withColumn("stat", stat).select(*by, "n", "stat", normal_cdf(F.col("stat")).alias("probability"))


def matched_compare(cand: DataFrame, control: DataFrame) -> DataFrame:
    """Candidate against control on sessions known to both."""
    a = cand.filter("known").select("symbol", "session", F.coalesce("pnl", F.lit(0.0)).alias("pa"))
    b = control.filter("known").select("symbol", "session", F.coalesce("pnl", F.lit(0.0)).alias("pb"))
    return a.join(b, list(KEYS)).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("common_days"), F.sum("pa").alias("candidate_net"), F.sum("pb").alias("control_net"),
        F.sum(F.col("pa") - F.col("pb")).alias("difference"))


def decision_label(r: DataFrame, min_events: int) -> DataFrame:
    """NEEDS_DATA, UNDERPOWERED, REJECT or ADVANCE; ADVANCE needs every stress row positive."""
    return r.withColumn("decision", F.when(F.col("unknown_days") > 0, "NEEDS_DATA").when(F.col("event_days") < min_events, "UNDERPOWERED")
                        .when((F.col("net") > 0) & F.col("all_stress_ok"), "ADVANCE").otherwise("REJECT"))


def neighbors(results: DataFrame, axes: list[str], family: list[str], key: str = "config_id") -> DataFrame:
    """Settings that differ in exactly one axis.

    Each setting is posted once per axis under the values of the other axes; only settings that
    share such an address meet, so no other pair is ever formed."""
    post = F.array(*[F.struct(F.lit(a).alias("axis"), F.to_json(F.struct(*[F.col(b) for b in axes if b != a])).alias("addr"),
                              F.col(a).cast("string").alias("val")) for a in axes])
    x = results.select(*family, key, "net", F.inline(post))
    a = x.select(*family, "axis", "addr", F.col(key), F.col("net"), F.col("val"))
    b = x.select(*family, "axis", "addr", F.col(key).alias("neighbor_id"), F.col("net").alias("neighbor_net"), F.col("val").alias("_v"))
    return a.join(b, [*family, "axis", "addr"]).filter(F.col("val") != F.col("_v")).select(*family, key, "net", "axis", "neighbor_id", "neighbor_net")


def compare_expected(report: DataFrame, expected: DataFrame, tol: float) -> DataFrame:
    """Metric by metric against expected values; an absent metric does not match."""
    x = expected.join(report, "metric", "left")
    return x.withColumn("ok", F.coalesce(F.abs(F.col("value") - F.col("expected")) <= tol, F.lit(False)))


def causality_violations(base: DataFrame, perturbed: DataFrame, known: str) -> DataFrame:
    """Rows known by the cut that changed when only later bars changed: must be empty."""
    a, b = base.filter(known), perturbed.filter(known)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def perturbed_copies(bars: DataFrame, cuts: list[tuple], level: float = 100.0) -> DataFrame:
    """One copy of the bars for each cut ``(session, slot)``, its symbol marked with the cut's number; from the bar behind the cut on prices are
    mirrored at half of ``level``, so that highs become lows, and volumes differ."""
    rows = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(d).cast("date").alias("_d"), F.lit(s).alias("_s")) for i, (d, s) in enumerate(cuts)])
    x = bars.select("*", F.inline(rows))
    after = (F.col("session") > F.col("_d")) | ((F.col("session") == F.col("_d")) & (F.col("slot") > F.col("_s")))
    x = x.withColumns({c: F.when(after, level - F.col(other)).otherwise(F.col(c)) for c, other in (("open", "open"), ("high", "low"), ("low", "high"), ("close", "close"))})
    return x.withColumns({"volume": F.when(after, F.col("volume") * 2 + 1).otherwise(F.col("volume")), "symbol": F.concat_ws("#", "symbol", F.col("cut").cast("string"))}).drop("cut", "_d", "_s")


def event_violations(base: DataFrame, changed: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``(detector, violations)``: events known at a cut that a detector raises on the bars as they are, or on those that differ behind the cut, but not on both.

    ``base (detector, symbol, session, slot, side)`` are events of the bars, ``changed`` those of ``perturbed_copies``. All cuts and detectors go
    through one grouping: an event counts +1 where it is raised and -1 where it is raised again."""
    key = ["detector", "symbol", "session", "slot", "side"]
    rows = F.array(*[F.struct(F.lit(i).alias("cut"), F.lit(d).cast("date").alias("_d"), F.lit(s).alias("_s")) for i, (d, s) in enumerate(cuts)])
    known = (F.col("session") < F.col("_d")) | ((F.col("session") == F.col("_d")) & (F.col("slot") <= F.col("_s")))
    part = F.split("symbol", "#")
    again = changed.select("detector", F.get(part, 0).alias("symbol"), "session", "slot", "side", F.get(part, 1).cast("int").alias("cut")).select("*", F.inline(F.filter(rows, lambda r: r["cut"] == F.col("cut"))).alias("_c", "_d", "_s"))
    both = base.select(*key, F.inline(rows)).filter(known).select(*key, "cut", F.lit(1).alias("n")).unionByName(again.filter(known).select(*key, "cut", F.lit(-1).alias("n")))
    return both.groupBy(*key, "cut").agg(F.sum("n").alias("n")).groupBy("detector").agg(F.sum(F.abs("n")).alias("violations"))


def lag_audit(daily: DataFrame, minimum: int) -> DataFrame:
    """Stored previous-session fields against a fresh lag, and their coverage."""
    w = W.partitionBy("symbol").orderBy("session")
    checks = []
    for f in ("open", "high", "low", "close"):
        checks.append(F.struct(F.lit(f"prev_{f}").alias("field"), F.col(f"prev_{f}").alias("stored"), F.lag(f"day_{f}").over(w).alias("fresh")))
    x = daily.select("symbol", F.array(*checks).alias("_c")).select("symbol", F.inline("_c"))
    return x.groupBy("field").agg(F.count_if(~F.col("stored").eqNullSafe(F.col("fresh"))).alias("mismatches"), F.count("stored").alias("covered")).withColumn(
        "ok", (F.col("mismatches") == 0) & (F.col("covered") >= minimum))


def execution_violations(trades: DataFrame, flat: int, budget: float) -> DataFrame:
    """Trades that break an execution rule, with the rule: must be empty."""
    bad = [("entry_not_after_signal", F.col("entry_slot") <= F.col("slot")), ("exit_before_entry", F.col("exit_slot") < F.col("entry_slot")),
           ("late_exit", F.col("exit_slot") > flat), ("risk_over_budget", F.col("planned_risk") > budget + 1e-9),
           ("loss_beyond_worst", F.col("pnl_pts") < F.col("worst_pts") - 1e-9), ("negative_quantity", F.col("qty") < 0)]
    return trades.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad]))))


def standardize_trades(sources: list[tuple[str, DataFrame]], bars: DataFrame, slip: float) -> DataFrame:
    """Trades of different origin in one form, worst excursion recomputed from the held bars."""
    cols = [*KEYS, "entry_slot", "exit_slot", "side", "pnl_pts", "stop_pts", "entry_px"]
    u = None
    for name, df in sources:
        part = df.select(*[F.col(c) for c in cols], F.lit(name).alias("source"))
        u = part if u is None else u.unionByName(part)
    b = bars.select(*KEYS, F.col("slot").alias("_k"), "high", "low")
    x = u.join(b, list(KEYS)).filter(F.col("_k").between(F.col("entry_slot"), F.col("exit_slot")))
    adv = F.when(F.col("side") > 0, F.col("low") - slip - F.col("entry_px")).otherwise(F.col("entry_px") - F.col("high") - slip)
    return x.groupBy("source", *cols).agg(F.least(F.lit(0.0), F.min(adv), F.first("pnl_pts")).alias("worst_pts"))
