"""Causality of whole detectors: events on the bars as they are against events on bars that differ behind a cut."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.core import by_session
from tidebar.operators import detect as det
from tidebar.operators import features as feats
from tidebar.operators import folds, ingest
from tidebar.operators import search as se
from tidebar.plans import views
from tidebar.plans.oracle import with_ctes
from tidebar.plans.q_ingest import K
from tidebar.plans.q_windows import H
from tidebar.plans.registry import register
from tidebar.sources.scratch import materialize

#: Constant settings of the rule families.
RULES = {
    "range_break": {"length": 3}, "range_break_vwap": {"length": 3, "buffer_atr": 0.05}, "range_break_rvol": {"length": 3, "minimum": 0.9}, "range_break_vol_state": {"length": 3, "high": True},
    "range_break_gap": {"length": 3, "minimum": 0.05, "relation": "ANY", "follow": True}, "range_break_open_trend": {"length": 3, "minimum": 0.3}, "noise_momentum": {"start": 3},
    "close_momentum": {"at": 12, "minimum": 0.05}, "gap_reversal": {"at": 1, "minimum": 0.05, "relation": "ANY"}, "open_shock_reversal": {"at": 2, "minimum_atr": 0.1}, "overnight_drift": {"at": 4, "maximum": 0.5},
    "trend_pullback": {"fast": 2, "slow": 6, "slope_bars": 1, "slope_atr": 0.0, "vwap_filter": 0}, "rolling_breakout": {"lookback": 3, "buffer_atr": 0.0, "vwap_filter": 0, "volume_z": None},
    "failed_breakout": {"lookback": 3, "overshoot_atr": 0.0, "reclaim_atr": 0.0, "volume_z": None}, "vwap_stretch_reversal": {"stretch_atr": 0.1, "max_slope_atr": 0.3, "slope_bars": 1},
    "impulse_continuation": {"lookback": 2, "impulse_atr": 0.08, "volume_z": None}, "impulse_reversal": {"lookback": 2, "impulse_atr": 0.08, "volume_z": None},
    "compression_breakout": {"lookback": 3, "max_range_atr": 0.9, "buffer_atr": 0.0}, "vwap_trend_reclaim": {"streak": 2, "slope_bars": 1, "tolerance_atr": 0.08, "slope_atr": 0.0},
    "implied_band_reversion": {"multiple": 0.5, "regime": "ALL", "entry": "BREACH", "low": 20.0, "high": 30.0}}
#: Sequences with the bars of their window, and whether they stop at the first missing bar.
SEQUENCES = {
    "repeated_pressure": (folds.repeated_pressure(1, 0.35, 0.4), 2, True), "second_attempt": (folds.second_attempt(0.1, 1, 12), 2, True), "external_flag": (folds.external_flag(0.02, 1, 9.0, 20), 1, True),
    "vwap_reclaim_break": (folds.vwap_reclaim_break(1, 12), 2, True), "two_scale_change": (folds.two_scale_change(0.02, 6.0, 15), 2, True), "retest": (folds.retest(8, 3.0, 0.5, "boundary"), 2, True),
    "edge_rejection": (folds.edge_rejection(0.35, 10), 1, False), "failed_break_hold": (folds.failed_break_hold(1, 10), 2, False), "midpoint_reclaim": (folds.reference_reclaim("mid", 1, 10), 2, False),
    "vwap_reclaim_inside": (folds.reference_reclaim("vw", 1, 10), 2, False), "wick_excursion": (folds.wick_excursion(1, False, 5), 2, False),
    "wick_confirmed": (folds.wick_excursion(1, True, 8), 2, False), "double_test": (folds.double_test(0.4, 0.1, 0.3, 15), 2, False), "gap_retest": (folds.gap_retest(1, 10), 3, False),
    "inverse_gap": (folds.inverse_gap(1, 10), 3, False), "inverse_gap_retest": (folds.inverse_gap_retest(1, 10, 8), 3, False)}
LAST = 22
#: A detector that reads the next close: the audit has to find it.
PLANTED = "planted_look_ahead"


def frame(b: DataFrame, kind: str) -> DataFrame:
    """Every column that the detectors read, from bars alone; the external level is a constant."""
    m = views.MODELS[kind]
    g = ingest.complete_grid(b, views.calendar(b, kind))
    d = feats.rolling_quantile(feats.daily_features(g, m.lookback, m.minimum), "vol", 10, 0.5, 3, "vol_q")
    f = feats.opening_range_columns(feats.intraday(g.join(d, K)), m.length)
    f = feats.noise_band(feats.clock_stats(f, m.lookback, m.minimum), 0.9)
    return f.join(feats.opening_rvol(b, m.length, 5).select(*K, "rvol"), K, "left").withColumn("ref_level", F.lit(25.0))


def detectors() -> dict:
    """Name -> events of a frame."""
    made = {name: lambda f, n=name, p=params: det.detect(f, n, LAST, **p) for name, params in RULES.items()}
    made |= {name: lambda f, s=s, k=k, whole=whole: folds.run_sequence(folds.mirror(f, 3, k), s, whole, 21) for name, (s, k, whole) in SEQUENCES.items()}
    return made | {"ageing_levels": lambda f: folds.ageing_levels(f, 2, 1, 15, 2, 0.05, LAST),
                   "first_breaks": lambda f: det.first_breaks(f, 3, F.lit(True), F.lit(True), 21),
                   "failed_side": lambda f: det.failed_side(f, 3, 8, 21),
                   PLANTED: lambda f: f.withColumn("side", F.when(F.lead("close").over(by_session()) > F.col("close"), 1)).filter("side = 1")}


def raised(f: DataFrame) -> DataFrame:
    every = [make(f).select(F.lit(name).alias("detector"), *K, F.col("slot").cast("int").alias("slot"), F.col("side").cast("int").alias("side")) for name, make in detectors().items()]
    return reduce(DataFrame.unionByName, every)


def cuts_of(b: DataFrame, n: int) -> list[tuple]:
    """Cuts spread over the sessions, at slots of their own; a list of n rows."""
    days = b.select("session").distinct().selectExpr("array_sort(collect_list(session)) AS d").first().d
    return [(days[(i + 1) * len(days) // (n + 1)], 5 + 3 * i) for i in range(n)] if days else []


CUTS = 4
_DAYS = f"(SELECT list_sort(list(DISTINCT session)) AS d FROM bars), range({CUTS}) c(i)"


@register("audit_causality_events", with_ctes(H, f"""SELECT detector, CAST(sum(n) AS BIGINT) AS violations FROM (SELECT unnest([{', '.join(f"'{n}'" for n in detectors() if n != PLANTED)}]) AS detector, 0 AS n
 UNION ALL SELECT '{PLANTED}', count(*) FILTER ((ahead > close) <> (100 - ahead > close)) FROM (SELECT symbol, session, slot, close, lead(close) OVER (PARTITION BY symbol, session ORDER BY slot) AS ahead FROM g)
 JOIN (SELECT CAST(d[(i + 1) * len(d) // {CUTS + 1} + 1] AS DATE) AS session, 5 + 3 * i AS slot FROM {_DAYS}) USING (session, slot)) GROUP BY 1"""))
def audit_causality_events(spark, sf):
    """Each detector on the bars and on copies that differ behind four cuts. Bars and copies make one frame of features, written once, and every detector runs over it once."""
    b = views.bars(spark, sf, H)
    cuts = cuts_of(b, CUTS)
    both = materialize(raised(materialize(frame(b.unionByName(se.perturbed_copies(b, cuts)), H), "frame")), "raised")
    copy = F.col("symbol").contains("#")
    found = se.event_violations(both.filter(~copy), both.filter(copy), cuts)
    names = spark.createDataFrame([(n,) for n in detectors()], "detector string")
    return names.join(found, "detector", "left").select("detector", F.coalesce("violations", F.lit(0)).alias("violations"))
