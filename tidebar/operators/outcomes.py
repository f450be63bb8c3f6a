"""Outcome labels, stop and exit policies, selection, sizing and costs (O operators).

Bars of a session are packed into one array, slot = position, and joined to events on
(symbol, session): one row per event, nothing exploded. Each label looks only at later bars.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.core import GUARD, KEYS, TICK, away_tick, ceil_tick, floor_tick, signed, toward_tick

REASONS = {1: "stop", 2: "target", 3: "time", 4: "managed", 9: "unknown"}


@dataclass(frozen=True)
class Costs:
    """Contract terms in price points and money; large and small contract of one market."""
    slip: float = 0.25
    large_value: float = 20.0
    small_value: float = 2.0
    large_fee: float = 3.5
    small_fee: float = 1.0
    max_large: int = 4
    max_small: int = 40


COSTS = Costs()


def pack_bars(grid: DataFrame, extra: tuple = ()) -> DataFrame:
    """One array of bars per session; its size is the session length."""
    bar = F.struct(F.col("slot").alias("k"), F.col("open").alias("o"), F.col("high").alias("h"),
                   F.col("low").alias("l"), F.col("close").alias("c"), *extra)
    return grid.groupBy(*KEYS).agg(F.sort_array(F.collect_list(bar)).alias("_path"))


def stop_ref(spec: Column, side: Column, entry: Column, hi: Column, lo: Column, atr: Column) -> Column:
    """Stop price by specification name."""
    w = hi - lo
    back = lambda d: entry - side * d
    return (F.when(spec == "OPPOSITE", signed(side, lo, hi)).when(spec == "MID", (hi + lo) / 2)
            .when(spec == "WIDTH_0.5", back(0.5 * w)).when(spec == "WIDTH_1.0", back(w))
            .when(spec == "ATR_1.0", back(atr)).when(spec == "ATR_1.5", back(1.5 * atr)))


def settings_array(rows: list[dict]) -> str:
    """Settings as one SQL array literal: parsed once, whatever their number."""
    lit = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else repr(v)
    return "array(" + ", ".join("struct(" + ", ".join(f"{lit(v)} AS {k}" for k, v in r.items()) + ")" for r in rows) + ")"


def entries(events: DataFrame, packed: DataFrame, flat: int, slip: float, settings: list[dict] | None = None) -> DataFrame:
    """Events with an executable next-bar entry: entry price, stop, target and deadline.

    Events carry ``atr`` and, unless ``settings`` supply them, ``stop_atr``, ``target_r``
    (0 = none) and ``hold``. Settings multiply the rows only after the join, so neither a shuffle
    nor the planner's size estimate sees the multiplied side."""
    e = events.join(packed, list(KEYS)).withColumn("entry_slot", F.col("slot") + 1)
    if settings:
        e = e.select("*", F.expr(f"inline({settings_array(settings)})"))
    e = e.withColumn("_o", F.get(F.col("_path"), F.col("entry_slot"))["o"])
    e = e.filter(F.col("_o").isNotNull() & F.col("atr").isNotNull() & (F.col("entry_slot") < flat))
    s = F.col("side")
    e = e.withColumn("entry_px", F.col("_o") + s * slip)
    e = e.withColumn("stop_px", away_tick(F.col("entry_px") - s * F.col("stop_atr") * F.col("atr"), s))
    e = e.withColumn("stop_pts", s * (F.col("entry_px") - F.col("stop_px"))).filter("stop_pts > 0")
    tgt = toward_tick(F.col("entry_px") + s * F.col("target_r") * F.col("stop_pts"), s)
    e = e.withColumn("target_px", F.when(F.col("target_r") > 0, tgt))
    e = e.filter(F.col("target_px").isNull() | (s * (F.col("target_px") - F.col("entry_px")) > 0))
    return e.withColumn("deadline", F.least(F.lit(flat), F.col("entry_slot") + F.col("hold"))).drop("_o")


def _held(e: DataFrame) -> DataFrame:
    return e.withColumn("_w", F.slice("_path", F.col("entry_slot") + 1, F.col("deadline") - F.col("entry_slot") + 1)).drop("_path")


def barrier_outcome(events: DataFrame, packed: DataFrame, flat: int, slip: float = COSTS.slip,
                    settings: list[dict] | None = None) -> DataFrame:
    """First of gap stop, gap target, deadline, stop, target, in that order inside a bar.

    The deciding bar is the first element of one filter over the held slice."""
    e = _held(entries(events, packed, flat, slip, settings))
    s = F.col("side")

    def code(r):
        stop_hit = F.when(s > 0, r["l"] <= F.col("stop_px")).otherwise(r["h"] >= F.col("stop_px"))
        tgt_hit = F.when(s > 0, r["h"] >= F.col("target_px")).otherwise(r["l"] <= F.col("target_px"))
        return (F.when(r["o"].isNull(), 9).when(s * (r["o"] - F.col("stop_px")) <= 0, 11)
                .when(s * (r["o"] - F.col("target_px")) >= 0, 12).when(r["k"] == F.col("deadline"), 3)
                .when(stop_hit & F.coalesce(tgt_hit, F.lit(False)), 21).when(stop_hit, 1).when(tgt_hit, 2))

    e = e.withColumn("_hit", F.get(F.filter("_w", lambda r: code(r).isNotNull()), F.lit(0)))
    e = e.withColumn("_code", F.coalesce(code(F.col("_hit")), F.lit(9)))
    o = F.col("_hit.o")
    px = (F.when(F.col("_code").isin(11, 3), o - s * slip).when(F.col("_code").isin(12, 2), F.col("target_px"))
          .when(F.col("_code").isin(1, 21), F.col("stop_px") - s * slip))
    e = e.withColumns({"exit_px": px, "exit_slot": F.when(F.col("_code") != 9, F.col("_hit.k"))})
    inside = F.col("_code").isin(1, 2, 21)
    lived = F.filter("_w", lambda r: (r["k"] < F.col("exit_slot")) | ((r["k"] == F.col("exit_slot")) & inside))
    adv = F.transform(lived, lambda r: F.when(s > 0, r["l"] - slip - F.col("entry_px")).otherwise(F.col("entry_px") - r["h"] - slip))
    fav = F.transform(lived, lambda r: F.when(s > 0, r["h"] - F.col("entry_px")).otherwise(F.col("entry_px") - r["l"]))
    e = e.withColumns({"pnl_pts": s * (F.col("exit_px") - F.col("entry_px")), "_mae": F.array_min(adv), "_mfe": F.array_max(fav)})
    base = F.least(F.lit(0.0), F.col("_mae"))
    known = F.col("_code") != 9
    return e.withColumns({
        "worst_pts": F.when(known, F.least(base, F.col("pnl_pts"))), "mae_pts": F.when(known, base),
        "mfe_pts": F.when(known, F.greatest(F.lit(0.0), F.col("_mfe"))),
        "reason": _reason(F.col("_code")), "hold_bars": F.col("exit_slot") - F.col("entry_slot"),
        "ambiguous": F.col("_code") == 21, "is_unknown": ~known}).drop("_w", "_hit", "_code", "_mae", "_mfe")


def _reason(code: Column) -> Column:
    return (F.when(code.isin(1, 11, 21), "stop").when(code.isin(2, 12), "target").when(code == 3, "time")
            .when(code == 4, "managed").otherwise("unknown"))


MANAGED_DEFAULTS = {"be_r": 0.0, "trail_act_r": 0.0, "trail_dist_r": 0.0, "progress_bars": 0, "progress_r": 0.0,
                    "vwap_off": None, "chand_k": None, "close_bars": 0, "close_r": 0.0}


def managed_outcome(events: DataFrame, packed: DataFrame, flat: int, slip: float = COSTS.slip, **policy) -> DataFrame:
    """As ``barrier_outcome`` with a stop that may tighten and exits for lack of progress.

    A completed bar changes the stop for the next bar. Policies, from columns or constants:
    ``be_r`` breakeven trigger, ``trail_act_r``/``trail_dist_r`` trail from the best excursion,
    ``vwap_off`` ratchet to VWAP (bars carry ``vw``), ``chand_k`` extreme minus k mean true ranges
    (bars carry ``tr``), ``progress_bars``/``progress_r`` low excursion, ``close_bars``/``close_r``
    best close too low after exactly that many bars."""
    e = _held(entries(events, packed, flat, slip))
    for name, default in MANAGED_DEFAULTS.items():
        if name not in e.columns:
            e = e.withColumn(name, F.lit(policy.get(name, default)).cast("double"))
    fields = {f.name for f in packed.schema["_path"].dataType.elementType.fields}
    up = lambda x: f"(floor({x} / {TICK} + {GUARD}) * {TICK})"
    dn = lambda x: f"(ceil({x} / {TICK} - {GUARD}) * {TICK})"
    away = lambda x: f"(CASE WHEN side > 0 THEN {up(x)} ELSE {dn(x)} END)"
    live = "(s.code = 0)"
    gap_stop, gap_tgt = "(side * (r.o - s.stop) <= 0)", "(coalesce(side * (r.o - target_px) >= 0, false))"
    due = "(s.pending OR r.k = deadline)"
    hit = "(CASE WHEN side > 0 THEN r.l <= s.stop ELSE r.h >= s.stop END)"
    tgt = "coalesce(CASE WHEN side > 0 THEN r.h >= target_px ELSE r.l <= target_px END, false)"
    at_open = f"({gap_stop} OR {gap_tgt} OR {due})"
    stop_code = "(CASE WHEN side * (s.stop - stop_px) > 0 THEN 4 ELSE 1 END)"
    code = (f"(CASE WHEN r.o IS NULL THEN 9 WHEN {gap_stop} THEN {stop_code} WHEN {gap_tgt} THEN 2 WHEN {due} THEN 3 "
            f"WHEN {hit} THEN {stop_code} WHEN {tgt} THEN 2 ELSE 0 END)")
    px = (f"(CASE WHEN {gap_stop} THEN r.o - side * {slip} WHEN {gap_tgt} THEN target_px WHEN {due} THEN r.o - side * {slip} "
          f"WHEN {hit} THEN s.stop - side * {slip} ELSE target_px END)")
    seen = f"({live} AND r.o IS NOT NULL AND NOT {at_open})"
    fav = "(CASE WHEN side > 0 THEN r.h - entry_px ELSE entry_px - r.l END)"
    adv = f"(CASE WHEN side > 0 THEN r.l - {slip} - entry_px ELSE entry_px - r.h - {slip} END)"
    mfe = f"(CASE WHEN {seen} THEN greatest(s.mfe, {fav}) ELSE s.mfe END)"
    cands = [
        f"(CASE WHEN be_r > 0 AND {mfe} / stop_pts >= be_r THEN {away('entry_px')} END)",
        f"(CASE WHEN trail_act_r > 0 AND trail_dist_r > 0 AND {mfe} / stop_pts >= trail_act_r THEN "
        f"{away(f'(entry_px + side * {mfe} - side * trail_dist_r * stop_pts)')} END)"]
    if "vw" in fields:
        cands.append(f"(CASE WHEN vwap_off IS NOT NULL THEN {away('(r.vw - side * vwap_off * atr)')} END)")
    if "tr" in fields:
        cands.append(f"(CASE WHEN chand_k IS NOT NULL THEN {away(f'(entry_px + side * {mfe} - side * chand_k * r.tr)')} END)")
    every = ", ".join(cands)
    stop = (f"(CASE WHEN {seen} AND {code} = 0 THEN CASE WHEN side > 0 THEN greatest(s.stop, {every}) "
            f"ELSE least(s.stop, {every}) END ELSE s.stop END)")
    best_close = f"(CASE WHEN {seen} THEN greatest(s.best, side * (r.c - entry_px)) ELSE s.best END)"
    pending = (f"(s.pending OR (progress_bars > 0 AND r.k - entry_slot + 1 >= progress_bars AND {mfe} / stop_pts < progress_r) "
               f"OR (close_bars > 0 AND r.k - entry_slot + 1 = close_bars AND {best_close} < close_r * stop_pts))")
    step = {
        "code": f"CASE WHEN {live} THEN {code} ELSE s.code END",
        "px": f"CASE WHEN {live} AND {code} NOT IN (0, 9) THEN {px} ELSE s.px END",
        "k": f"CASE WHEN {live} AND {code} NOT IN (0, 9) THEN r.k ELSE s.k END",
        "stop": stop, "mfe": mfe,
        "mae": f"CASE WHEN {seen} THEN least(s.mae, {adv}) ELSE s.mae END", "best": best_close,
        "amb": f"s.amb OR ({seen} AND {hit} AND {tgt})", "pending": pending}
    init = {"code": "0", "px": "CAST(NULL AS DOUBLE)", "k": "CAST(NULL AS INT)", "stop": "CAST(stop_px AS DOUBLE)",
            "mfe": "CAST(0.0 AS DOUBLE)", "mae": "CAST(0.0 AS DOUBLE)", "best": "CAST(0.0 AS DOUBLE)", "amb": "false", "pending": "false"}
    types = {"code": "int", "px": "double", "k": "int", "stop": "double", "mfe": "double", "mae": "double", "best": "double",
             "amb": "boolean", "pending": "boolean"}
    named = lambda d: ", ".join(f"'{n}', CAST({x} AS {types[n]})" for n, x in d.items())
    e = e.withColumn("_s", F.expr(f"aggregate(_w, named_struct({named(init)}), (s, r) -> named_struct({named(step)}))"))
    known = ~F.col("_s.code").isin(0, 9)
    pnl = F.col("side") * (F.col("_s.px") - F.col("entry_px"))
    return e.withColumns({
        "exit_px": F.col("_s.px"), "exit_slot": F.col("_s.k"), "pnl_pts": pnl,
        "worst_pts": F.when(known, F.least(F.col("_s.mae"), pnl)), "mae_pts": F.when(known, F.col("_s.mae")),
        "mfe_pts": F.when(known, F.col("_s.mfe")), "reason": _reason(F.col("_s.code")),
        "hold_bars": F.col("_s.k") - F.col("entry_slot"), "ambiguous": F.col("_s.amb") & known,
        "is_unknown": ~known}).drop("_w", "_s", *MANAGED_DEFAULTS)


def limit_fill(events: DataFrame, packed: DataFrame, life: int, flat: int) -> DataFrame:
    """Resting limit: filled by a one-tick trade-through within ``life`` bars, cancelled by a
    missing bar or an opposite close first. The fill improves to the open."""
    e = events.join(packed, list(KEYS))
    last = F.least(F.lit(flat - 1), F.col("slot") + life)
    w = F.slice("_path", F.col("slot") + 2, F.greatest(F.lit(0), last - F.col("slot")))
    s, lim = F.col("side"), F.col("limit_px")

    def crossed(r):
        return F.when(s > 0, r["l"] <= lim - TICK).otherwise(r["h"] >= lim + TICK)

    def ends(r):
        lost = F.when(s > 0, r["c"] < F.col("cancel_low")).otherwise(r["c"] > F.col("cancel_high"))
        return r["o"].isNull() | crossed(r) | lost

    e = e.withColumn("_f", F.get(F.filter(w, ends), F.lit(0)))
    done = F.col("_f.o").isNotNull() & F.coalesce(crossed(F.col("_f")), F.lit(False))
    px = F.when(s > 0, F.least(F.col("_f.o"), lim)).otherwise(F.greatest(F.col("_f.o"), lim))
    return e.withColumns({"filled": done, "fill_slot": F.when(done, F.col("_f.k")), "fill_px": F.when(done, px)}).drop("_path", "_f")


def partial_legs(events: DataFrame, packed: DataFrame, flat: int, fraction: float, at_r: float,
                 slip: float = COSTS.slip) -> DataFrame:
    """A part exits at ``at_r``, the rest runs to its own target: two labelled legs, one trade.

    A trade of which only one leg can be entered is there with ``complete`` false and no P&L; equal events
    stay as many trades."""
    legs = F.array(F.struct(F.lit("part").alias("leg"), F.lit(fraction).alias("weight"), F.lit(at_r).alias("_t")),
                   F.struct(F.lit("rest").alias("leg"), F.lit(1 - fraction).alias("weight"), F.col("target_r").alias("_t")))
    keys = [c for c in events.columns if c != "target_r"]
    x = events.withColumn("_leg", F.explode(legs)).select(
        *keys, F.col("_leg.leg").alias("leg"), F.col("_leg.weight").alias("weight"), F.col("_leg._t").alias("target_r"))
    o = barrier_outcome(x, packed, flat, slip)
    return o.groupBy(*[k for k in keys if k not in ("atr",)]).agg(
        F.sum(F.col("weight") * F.col("pnl_pts")).alias("_pnl"), F.max("exit_slot").alias("exit_slot"),
        F.max(F.when(F.col("leg") == "part", F.col("reason"))).alias("part_reason"),
        F.max(F.when(F.col("leg") == "rest", F.col("reason"))).alias("rest_reason"),
        F.bool_or("is_unknown").alias("is_unknown"), F.count_if(F.col("leg") == "part").alias("_part"), F.count_if(F.col("leg") == "rest").alias("_rest"),
    ).withColumns({"complete": F.col("_part") == F.col("_rest"), "_n": F.greatest("_part", "_rest")}).withColumns({
        "pnl_pts": F.when(F.col("complete"), F.col("_pnl") / F.col("_n")), "_copy": F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))
    }).drop("_pnl", "_part", "_rest", "_n", "_copy")


def adverse_cut(trades: DataFrame, marks: DataFrame, share: float, after: int, fraction: float) -> DataFrame:
    """Cut ``fraction`` at the open after the first held bar whose adverse return share and size
    are both high. ``marks``: packed bars with ``bad_long``, ``bad_short`` flags computed causally."""
    e = trades.join(marks, list(KEYS))
    w = F.filter("_path", lambda r: (r["k"] >= F.col("entry_slot") + after) & (r["k"] < F.col("exit_slot"))
                 & F.when(F.col("side") > 0, r["bad_long"]).otherwise(r["bad_short"]))
    e = e.withColumn("cut_slot", F.get(F.transform(w, lambda r: r["k"] + 1), F.lit(0)))
    e = e.withColumn("_px", F.get("_path", F.col("cut_slot"))["o"])
    part = F.col("side") * (F.col("_px") - F.col("entry_px"))
    pnl = F.when(F.col("_px").isNotNull(), fraction * part + (1 - fraction) * F.col("pnl_pts")).otherwise(F.col("pnl_pts"))
    return e.withColumn("cut_pnl_pts", pnl).drop("_path", "_px")


# ---- selection -------------------------------------------------------------------

def select_non_overlapping(outcomes: DataFrame, group: list[str], start: int, end: int, direction: int = 0,
                           max_n: int = 12, cooldown: int = 0) -> DataFrame:
    """Earliest first, skip while a position is open, up to ``max_n`` a session.

    Greedy choice is inherently ordered, so the candidates of one (group, session), bounded by the
    bars of a session, are folded inside the JVM."""
    x = outcomes.filter((F.col("slot") >= start) & (F.col("slot") < end) & ~F.col("is_unknown"))
    if direction:
        x = x.filter(F.col("side") == direction)
    rest = [c for c in x.columns if c not in (*group, *ORDERED)]
    g = x.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*ORDERED, *rest))).alias("_c"))
    return g.select(*group, F.inline(F.expr(_greedy(g, "_c", max_n, cooldown))))


ORDERED = ["slot", "side", "exit_slot"]


def _greedy(g: DataFrame, source: str, max_n: int, cooldown: int) -> str:
    """Fold keeping each candidate that starts after the last kept one is over."""
    row_t = g.schema["_c"].dataType.elementType.simpleString()
    return (f"aggregate({source}, named_struct('free', -1, 'used', 0, 'kept', CAST(array() AS array<{row_t}>)), (s, r) -> "
            f"CASE WHEN r.slot > s.free AND s.used < {max_n} THEN named_struct('free', r.exit_slot + {cooldown}, "
            f"'used', s.used + 1, 'kept', concat(s.kept, array(r))) ELSE s END, s -> s.kept)")


def select_shared(outcomes: DataFrame, group: list[str], start: int, end: int, max_n: int = 12, cooldown: int = 0) -> DataFrame:
    """``select_non_overlapping`` for every signal at once.

    Rows carry the array ``signals`` of all settings that raise the event. The candidates of a
    (group, session) are gathered once, and each signal folds its own subset of them, so rows
    are not multiplied by the signals before the grouping."""
    x = outcomes.filter((F.col("slot") >= start) & (F.col("slot") < end) & ~F.col("is_unknown"))
    rest = [c for c in x.columns if c not in (*group, *ORDERED, "is_unknown")]
    g = x.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*ORDERED, *rest))).alias("_c"))
    g = g.withColumn("signal_id", F.explode(F.array_distinct(F.flatten(F.transform("_c", lambda r: r["signals"])))))
    own = "filter(_c, r -> array_contains(r.signals, signal_id))"
    return g.select(*group, "signal_id", F.inline(F.expr(_greedy(g, own, max_n, cooldown)))).drop("signals")


def one_per_session(outcomes: DataFrame, group: list[str]) -> DataFrame:
    """First executable event; a candidate that never filled does not use up the session."""
    rest = [c for c in outcomes.columns if c not in group]
    x = outcomes.filter(~F.col("is_unknown"))
    return x.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct("slot", "side")).alias("_r")).select(*group, "_r.*")


def inside_entry_checks(outcomes: DataFrame, min_rr: float, cell: str) -> DataFrame:
    """Entry strictly inside the range, in the location cell, with enough reward to the far edge."""
    s = F.col("side")
    hi, lo, px = F.col("or_high"), F.col("or_low"), F.col("entry_px")
    v = signed(s, px - lo, hi - px) / (hi - lo)
    loc = F.when(v <= 0.25, "origin").when(v >= 0.75, "destination").otherwise("interior")
    edge = signed(s, hi, lo)
    return outcomes.withColumn("location", loc).filter(
        (px > lo) & (px < hi) & (F.col("location") == cell) & (s * (edge - px) / F.col("stop_pts") >= min_rr))


# ---- sizing and costs --------------------------------------------------------------

def _fit(budget: Column, unit: Column, cap: int) -> Column:
    return F.least(F.lit(cap), F.floor(budget / unit).cast("int"))


def size_large_first(df: DataFrame, budget: Column, c: Costs = COSTS) -> DataFrame:
    """Whole large contracts if one fits the budget, else small ones, else none."""
    d = F.col("stop_pts")
    ql = _fit(budget, d * c.large_value + c.large_fee, c.max_large)
    qs = _fit(budget, d * c.small_value + c.small_fee, c.max_small)
    x = df.withColumns({"_ql": ql, "_qs": qs})
    return x.withColumns({
        "instrument": F.when(F.col("_ql") >= 1, "large").when(F.col("_qs") >= 1, "small"),
        "qty": F.when(F.col("_ql") >= 1, F.col("_ql")).when(F.col("_qs") >= 1, F.col("_qs")).otherwise(0)}).drop("_ql", "_qs")


def size_max_exposure(df: DataFrame, budget: Column, c: Costs = COSTS) -> DataFrame:
    """Whichever contract carries more exposure within the budget; a tie takes the large one."""
    d = F.col("stop_pts") + c.slip
    ql = _fit(budget, d * c.large_value + c.large_fee, c.max_large)
    qs = _fit(budget, d * c.small_value + c.small_fee, c.max_small)
    x = df.withColumns({"_ql": ql, "_qs": qs})
    el, es = F.col("_ql") * c.large_value, F.col("_qs") * c.small_value
    large = (el >= es) & (el > 0)
    return x.withColumns({"instrument": F.when(large, "large").when(es > 0, "small"),
                          "qty": F.when(large, F.col("_ql")).when(es > 0, F.col("_qs")).otherwise(0)}).drop("_ql", "_qs")


def sizing_options(risks: list[float], c: Costs = COSTS, smalls: list[int] | None = None) -> Column:
    """Array of sizing options: fixed large, fixed small, risk budgets."""
    smalls = smalls or list(range(1, c.max_small + 1))
    opts = [("large", float(q)) for q in range(1, c.max_large + 1)] + [("small", float(q)) for q in smalls] + [("risk", float(b)) for b in risks]
    return F.array(*[F.struct(F.lit(i).alias("option_id"), F.lit(m).alias("mode"), F.lit(v).alias("spec"))
                     for i, (m, v) in enumerate(opts)])


def sizing_grid(trades: DataFrame, risks: list[float], c: Costs = COSTS, smalls: list[int] | None = None) -> DataFrame:
    """Every trade under every sizing option, generated in place and costed."""
    x = trades.withColumn("_o", F.explode(sizing_options(risks, c, smalls)))
    x = x.withColumns({k: F.col(f"_o.{k}") for k in ("option_id", "mode", "spec")}).drop("_o")
    x = size_max_exposure(x, F.col("spec"), c)
    fixed = F.col("mode") != "risk"
    x = x.withColumns({"instrument": F.when(fixed, F.col("mode")).otherwise(F.col("instrument")),
                       "qty": F.when(fixed, F.col("spec").cast("int")).otherwise(F.col("qty"))})
    return net_pnl(x, c)


def net_pnl(df: DataFrame, c: Costs = COSTS) -> DataFrame:
    """Points to money for the funded quantity, fees included; R against the planned risk."""
    large = F.col("instrument") == "large"
    value, fee = F.when(large, c.large_value).otherwise(c.small_value), F.when(large, c.large_fee).otherwise(c.small_fee)
    q = F.col("qty")
    x = df.withColumns({
        "pnl": q * (F.col("pnl_pts") * value - fee), "worst": q * (F.col("worst_pts") * value - fee),
        "planned_risk": q * ((F.col("stop_pts") + c.slip) * value + fee),
        "exposure": q * F.when(large, c.large_value / c.small_value).otherwise(1.0)})
    return x.withColumn("r_multiple", F.try_divide("pnl", "planned_risk"))


def scaled_quantity(mdd: Column, cap: float, limit: int) -> Column:
    """Largest linear quantity whose drawdown stays under the cap."""
    return F.when(mdd >= 0, limit).otherwise(F.least(F.lit(limit), F.floor((cap - 1e-9) / F.abs(mdd)).cast("int")))


def stress(trades: DataFrame, slips: list[float], base: float = COSTS.slip) -> DataFrame:
    """The same exits under other slippage: entry always pays, target exits do not."""
    x = trades.withColumn("stress_slip", F.explode(F.array(*[F.lit(s) for s in slips])))
    paid = F.when(F.col("reason") == "target", 1).otherwise(2)
    return x.withColumn("pnl_pts", F.col("pnl_pts") - paid * (F.col("stress_slip") - base))
