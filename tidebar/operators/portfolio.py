"""Sleeves, sizing options and portfolios of sleeves (O23, X12-X17)."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tidebar.functions.core import KEYS
from tidebar.operators.outcomes import COSTS, Costs, net_pnl, size_max_exposure
from tidebar.sources.scratch import materialize


def sleeve_path(trades: DataFrame, bars: DataFrame, group: list[str], slip: float, value: float = 2.0, fee: float = 1.0) -> DataFrame:
    """Per bar: P&L booked at the exit bar, adverse mark and exposure of every held bar."""
    b = bars.filter(F.col("open").isNotNull()).select(*KEYS, F.col("slot").alias("k"), "high", "low")
    t = trades.select(*group, *KEYS, "entry_slot", "exit_slot", "side", "pnl_pts", "entry_px")
    x = t.join(b, list(KEYS)).filter(F.col("k").between(F.col("entry_slot"), F.col("exit_slot")))
    mark = F.least(F.lit(0.0), F.when(F.col("side") > 0, F.col("low") - slip - F.col("entry_px")).otherwise(F.col("entry_px") - F.col("high") - slip))
    return x.groupBy(*group, *KEYS, F.col("k").alias("slot")).agg(
        F.sum(F.when(F.col("k") == F.col("exit_slot"), F.col("pnl_pts") * value - fee).otherwise(0.0)).alias("delta"),
        F.sum(mark * value - fee).alias("adverse"), F.count(F.lit(1)).alias("exposure"))


@dataclass(frozen=True)
class Option:
    """A sizing option of every sleeve: ``scale`` times the path of its ``leg``, which trades one small or large contract or what a risk budget buys."""
    option_id: int
    label: str
    leg: str
    scale: float


def sizing_plan(small: list[int], large: list[int], risks: list[float]) -> list[Option]:
    """Option 0 is OFF; then fixed small and large quantities, then risk budgets."""
    made = [("OFF", "", 0.0), *[(f"{q} small", "small", float(q)) for q in small], *[(f"{q} large", "large", float(q)) for q in large], *[(f"risk {b:g}", f"risk {b:g}", 1.0) for b in risks]]
    return [Option(i, *m) for i, m in enumerate(made)]


def sized_trades(trades: DataFrame, risks: list[float], c: Costs = COSTS) -> DataFrame:
    """Each trade once for every leg of a sizing plan, costed; trades that a budget cannot fund are left out."""
    legs = [("small", "small", None), ("large", "large", None), *[(f"risk {b:g}", None, b) for b in risks]]
    kinds = F.array(*[F.struct(F.lit(n).alias("leg"), F.lit(k).cast("string").alias("fixed"), F.lit(b).cast("double").alias("budget")) for n, k, b in legs])
    x = size_max_exposure(trades.select("*", F.inline(kinds)), F.col("budget"), c)
    fixed = F.col("fixed").isNotNull()
    x = x.withColumns({"instrument": F.coalesce("fixed", "instrument"), "qty": F.when(fixed, 1).otherwise(F.col("qty"))}).drop("fixed", "budget")
    return net_pnl(x.filter("qty > 0"), c)


def sized_path(sized: DataFrame, bars: DataFrame, group: list[str], c: Costs = COSTS) -> DataFrame:
    """As ``sleeve_path`` for trades with an instrument and a quantity; exposure counts in small contracts."""
    b = bars.filter(F.col("open").isNotNull()).select(*KEYS, F.col("slot").alias("k"), "high", "low")
    t = sized.select(*group, *KEYS, "entry_slot", "exit_slot", "side", "pnl", "entry_px", "qty", "instrument", F.col("exposure").alias("_e"))
    x = t.join(b, list(KEYS)).filter(F.col("k").between(F.col("entry_slot"), F.col("exit_slot")))
    large = F.col("instrument") == "large"
    value, fee = F.when(large, c.large_value).otherwise(c.small_value), F.when(large, c.large_fee).otherwise(c.small_fee)
    mark = F.least(F.lit(0.0), F.when(F.col("side") > 0, F.col("low") - c.slip - F.col("entry_px")).otherwise(F.col("entry_px") - F.col("high") - c.slip))
    return x.groupBy(*group, *KEYS, F.col("k").alias("slot")).agg(
        F.sum(F.when(F.col("k") == F.col("exit_slot"), F.col("pnl")).otherwise(0.0)).alias("delta"),
        F.sum(F.col("qty") * (mark * value - fee)).alias("adverse"), F.sum("_e").alias("exposure"))


def plan_rows(spark, plan: list[Option]) -> DataFrame:
    return spark.createDataFrame([(o.option_id, o.label, o.leg, o.scale) for o in plan], "option_id int, label string, leg string, scale double")


def plan_daily(daily: DataFrame, plan: list[Option]) -> DataFrame:
    """Daily P&L of each (sleeve, option) but OFF; ``daily`` has sleeve, leg, session, pnl. Options of a leg stand in one array, so that rows
    are made in place."""
    of = F.create_map(*[v for leg in dict.fromkeys(o.leg for o in plan if o.scale > 0) for v in (F.lit(leg), F.array(
        *[F.struct(F.lit(o.option_id).alias("option_id"), F.lit(o.scale).alias("scale")) for o in plan if o.leg == leg]))])
    return daily.select("sleeve", "session", "pnl", F.inline(F.element_at(of, F.col("leg")))).select("sleeve", "session", "option_id", "scale", (F.col("pnl") * F.col("scale")).alias("pnl"))


def sleeve_options(scales: list[float]) -> list[tuple[int, float]]:
    """Option 0 is OFF; the others scale the unit sleeve."""
    return [(0, 0.0), *[(i + 1, s) for i, s in enumerate(scales)]]


def option_daily(unit_daily: DataFrame, options: list[tuple[int, float]]) -> DataFrame:
    """Daily P&L of each (sleeve, option) other than OFF."""
    arr = F.array(*[F.struct(F.lit(i).alias("option_id"), F.lit(s).alias("scale")) for i, s in options if s > 0])
    x = unit_daily.select("*", F.inline(arr))
    return x.withColumn("pnl", F.col("pnl") * F.col("scale"))


def option_scores(od: DataFrame, train: tuple, validate: tuple) -> DataFrame:
    """Selection-period profit per drawdown of each option; the drawdown is composed of one summary per month."""
    y = F.year("session")
    x = od.filter(y.isin(*train, *validate))
    part = day_summaries(x, ["sleeve", "option_id"])
    s = composed(part, ["sleeve", "option_id"]).select("sleeve", "option_id", "net", F.col("max_drawdown").alias("mdd"))
    n = x.groupBy("sleeve", "option_id").agg(*[F.sum(F.when(y.isin(*t), F.col("pnl")).otherwise(0.0)).alias(f"net_{k}") for k, t in (("train", train), ("validate", validate))])
    return s.join(n, ["sleeve", "option_id"]).withColumn("score", F.col("net") / F.greatest(F.lit(100.0), F.abs("mdd")))


def seed_portfolios(scores: DataFrame, per_sleeve: int, positive: bool = False) -> DataFrame:
    """Singles and pairs of the best options of the sleeves, as portfolio member rows; with ``positive`` only
    of options that earn in training, in validation and in both together.

    Only the best options, a few per sleeve, are numbered; a pair is made where its second option stands, from the numbers
    that its first one sends out, so pairs are dealt out like any other rows."""
    if positive:
        scores = scores.filter("net > 0 AND net_train > 0 AND net_validate > 0")
    best = scores.withColumn("_r", F.row_number().over(W.partitionBy("sleeve").orderBy(F.desc("score"), "option_id"))).filter(F.col("_r") <= per_sleeve)
    best = best.withColumn("_n", F.row_number().over(W.orderBy("sleeve", "option_id"))).select("_n", F.struct("sleeve", "option_id").alias("m"), F.count(F.lit(1)).over(W.partitionBy()).alias("_all"))
    ahead = F.when(F.col("_n") < F.col("_all"), F.sequence(F.col("_n") + 1, F.col("_all"))).otherwise(F.array().cast("array<int>"))
    sent = best.select(F.col("m").alias("a"), F.explode(ahead).alias("_n"))
    pairs = sent.join(best.select("_n", F.col("m").alias("b")), "_n").filter("a.sleeve <> b.sleeve").select(F.array("a", "b").alias("_m"))
    p = best.select(F.array("m").alias("_m")).unionByName(pairs)
    pid = F.array_join(F.transform("_m", lambda m: F.concat_ws(":", m["sleeve"], m["option_id"].cast("string"))), "|")
    return p.select(pid.alias("portfolio_id"), F.inline("_m"))


def sample_portfolios(sleeves: DataFrame, n: int, active: tuple[int, int], options: list[tuple[int, float]]) -> DataFrame:
    """``n`` hashed random portfolios: each draws how many sleeves are active, which, and an
    option for each, smaller scales being likelier. Draw i depends on i alone, so the rows of a range are
    generated in parallel and reproducibly; numbers come from md5, not from a random state."""
    names = sleeves.agg(F.array_sort(F.collect_set("sleeve")).alias("_s"))
    base = sleeves.sparkSession.range(n).select(F.col("id").alias("_i")).withColumn("_s", names.scalar())
    u = lambda *parts: (F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    lo, hi = active
    x = base.withColumn("_k", F.floor(F.lit(lo) + u(F.lit("k"), F.col("_i")) * (F.least(F.lit(hi), F.size("_s")) - lo + 1)).cast("int"))
    keyed = F.array_sort(F.transform("_s", lambda s: F.struct(u(F.lit("a"), F.col("_i"), s).alias("u"), s.alias("s"))))
    x = x.withColumn("_m", F.slice(keyed, F.lit(1), F.col("_k"))).select("_i", F.explode("_m").alias("_m"))
    x = x.select("_i", F.col("_m.s").alias("sleeve"))
    live = [(i, s) for i, s in options if s > 0]
    draw = F.array(*[F.struct((-F.ln(u(F.lit("o"), F.col("_i"), F.col("sleeve"), F.lit(str(i)))) * (1 + s) ** 0.55).alias("key"), F.lit(i).alias("option_id")) for i, s in live])
    return x.withColumn("option_id", F.array_min(draw)["option_id"]).select(F.format_string("R%06d", "_i").alias("portfolio_id"), "sleeve", "option_id")


# ---- drawdown as a summary that composes -------------------------------------------

#: Portfolios that travel together, and blocks of them that one task evaluates over one stretch of time.
BLOCK, BLOCKS = 64, 256
#: What a stretch of a path does to equity: its sum, the highest prefix, the lowest mark and the deepest fall, all
#: from its start, and the largest exposure.
SUMMARY = ("total", "high", "low", "fall", "exposure")


def summaries(delta: np.ndarray, adverse: np.ndarray, exposure: np.ndarray) -> list[np.ndarray]:
    """``SUMMARY`` of each row of bars. A mark is the equity at a bar's close or its adverse extreme before; it falls from the highest close before it."""
    equity = np.cumsum(delta, 1)
    peak = np.maximum(np.maximum.accumulate(equity, 1), 0.0)
    before = np.hstack([np.zeros((len(delta), 1)), peak[:, :-1]])
    worst = equity - delta + adverse
    low = np.minimum(equity, worst).min(1, initial=0.0)
    fall = np.minimum((equity - peak).min(1, initial=0.0), (worst - before).min(1, initial=0.0))
    return [delta.sum(1), peak.max(1, initial=0.0), low, fall, exposure.max(1, initial=0.0)]


def composed(parts: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, net, max_drawdown, max_exposure, worst)`` from ``parts (*group, chunk, *SUMMARY)``: a fold over the stretches in order.

    A fall that crosses from stretch a to b starts at the highest prefix of a and ends at the lowest mark of b. What is gathered
    for a group is a summary for each stretch of the calendar; ``worst`` is the least sum of one."""
    row = F.array_sort(F.collect_list(F.struct("chunk", *SUMMARY)))
    start = F.struct(*[F.lit(0.0).alias(c) for c in (*SUMMARY, "worst")])

    def join(a, b):
        return F.struct((a["total"] + b["total"]).alias("total"), F.greatest(a["high"], a["total"] + b["high"]).alias("high"), F.least(a["low"], a["total"] + b["low"]).alias("low"),
                        F.least(a["fall"], b["fall"], a["total"] + b["low"] - a["high"]).alias("fall"), F.greatest(a["exposure"], b["exposure"]).alias("exposure"), F.least(a["worst"], b["total"]).alias("worst"))
    x = parts.groupBy(*group).agg(F.aggregate(row, start, join).alias("_x"))
    return x.select(*group, F.col("_x.total").alias("net"), F.col("_x.fall").alias("max_drawdown"), F.col("_x.exposure").alias("max_exposure"), "_x.worst")


def day_summaries(daily: DataFrame, group: list[str]) -> DataFrame:
    """Summaries per month of daily P&L, one mark a day."""
    step = F.struct(*[F.lit(0.0).alias(c) for c in ("total", "high", "low", "fall")])

    def day(a, p):
        t = a["total"] + p
        return F.struct(t.alias("total"), F.greatest(a["high"], t).alias("high"), F.least(a["low"], t).alias("low"), F.least(a["fall"], t - a["high"]).alias("fall"))
    x = daily.groupBy(*group, F.trunc("session", "month").alias("chunk")).agg(
        F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("session", "pnl"))), lambda d: d["pnl"]), step, day).alias("_x"))
    return x.select(*group, "chunk", "_x.*", F.lit(0.0).alias("exposure"))


def _evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch: its legs come first and become matrices of leg by bar, then blocks of portfolios stream by."""
    legs, matrices = {}, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == 0:
                names = sorted({x["leg"] for x in r["path"]})
                at = sorted({x["pos"] for x in r["path"]})
                legs, place = {n: i for i, n in enumerate(names)}, {p: i for i, p in enumerate(at)}
                matrices = np.zeros((3, len(names), len(at)))
                for x in r["path"]:
                    matrices[:, legs[x["leg"]], place[x["pos"]]] = x["delta"], x["adverse"], x["exposure"]
                continue
            ids = sorted({m["portfolio_id"] for m in r["members"]})
            row = {p: i for i, p in enumerate(ids)}
            weight = np.zeros((len(ids), len(legs)))
            for m in r["members"]:
                if m["leg"] in legs:
                    weight[row[m["portfolio_id"]], legs[m["leg"]]] += m["weight"]
            columns = summaries(*(weight @ x for x in matrices))
            yield pa.record_batch([pa.array(ids), pa.array([r["chunk"]] * len(ids), pa.date32()), *[pa.array(c) for c in columns]], ["portfolio_id", "chunk", *SUMMARY])


def portfolio_summaries(members: DataFrame, paths: DataFrame) -> DataFrame:
    """``(portfolio_id, chunk, *SUMMARY)`` for each portfolio and stretch of time.

    ``members``: portfolio_id, leg, weight; ``paths``: leg, chunk, pos, delta, adverse, exposure. Rows meet by stretch of time, never by leg, of
    which there are few. A stretch's legs are packed into one row, bounded by legs and bars; portfolios come in blocks of ``BLOCK``, and
    where there are many blocks a stretch is copied, so that a task evaluates ``BLOCKS`` of them on it."""
    n = members.select("portfolio_id").distinct().count()
    blocks = max(1, -(-n // BLOCK))
    copies = -(-blocks // BLOCKS)
    packed = paths.groupBy("chunk").agg(F.collect_list(F.struct("leg", "pos", "delta", "adverse", F.col("exposure").cast("double").alias("exposure"))).alias("path"))
    packed = materialize(packed, "stretches")
    block = F.pmod(F.xxhash64("portfolio_id"), F.lit(blocks)).alias("block")
    dealt = members.select(block, F.struct("portfolio_id", "leg", F.col("weight").cast("double").alias("weight")).alias("m")).groupBy("block").agg(F.collect_list("m").alias("members"))
    times = packed.agg(F.array_sort(F.collect_list("chunk")).alias("t"))  # the calendar
    dealt = dealt.withColumn("chunk", F.explode(times.scalar())).select("chunk", (F.col("block") % copies).cast("int").alias("copy"), F.lit(1).alias("kind"), F.lit(None).cast(packed.schema["path"].dataType).alias("path"), "members")
    laid = packed.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), "path", F.lit(None).cast(dealt.schema["members"].dataType).alias("members"))
    both = laid.unionByName(dealt).repartition("chunk", "copy").sortWithinPartitions("chunk", "copy", "kind")
    return both.mapInArrow(_evaluate, "portfolio_id string, chunk date, " + ", ".join(f"{c} double" for c in SUMMARY))


def _scale(options: list[tuple[int, float]]):
    return F.element_at(F.create_map(*[F.lit(x) for i, s in options for x in (i, s)]), F.col("option_id"))


def portfolio_daily_screen(members: DataFrame, daily: DataFrame, options: list[tuple[int, float]], train: tuple, validate: tuple, soft_cap: float, mdd: float) -> DataFrame:
    """Cheap necessary test: a portfolio whose daily drawdown breaks the cap breaks it per bar too.

    ``daily``: sleeve, session, pnl of the unit sleeve; the calendar is cut into months."""
    m = members.select("portfolio_id", F.col("sleeve").alias("leg"), _scale(options).alias("weight"))
    p = daily.select(F.col("sleeve").alias("leg"), F.trunc("session", "month").alias("chunk"), F.dayofmonth("session").alias("pos"), F.col("pnl").alias("delta"), F.col("pnl").alias("adverse"), F.lit(0.0).alias("exposure"))
    parts = materialize(portfolio_summaries(m, p), "months")
    y = F.year("chunk")
    nets = parts.groupBy("portfolio_id").agg(*[F.sum(F.when(y.isin(*t), F.col("total")).otherwise(0.0)).alias(f"net_{k}") for k, t in (("train", train), ("validate", validate))])
    cap = m.groupBy("portfolio_id").agg(F.sum("weight").alias("exposure"))
    s = composed(parts, ["portfolio_id"]).select("portfolio_id", "net", F.col("max_drawdown").alias("mdd_daily")).join(nets, "portfolio_id").join(cap, "portfolio_id")
    return s.withColumns({
        "evidence_ok": (F.col("exposure") <= soft_cap) & (F.col("net_train") > 0) & (F.col("net_validate") > 0) & (F.col("mdd_daily") > mdd),
        "oracle_ok": (F.col("exposure") <= soft_cap) & (F.col("net") > 0) & (F.col("mdd_daily") > mdd)})


def portfolio_exact(members: DataFrame, paths: DataFrame, options: list[tuple[int, float]]) -> DataFrame:
    """Bar-level sum of scaled sleeves, see ``exact_of_legs``."""
    m = members.select("portfolio_id", F.col("sleeve").alias("leg"), _scale(options).alias("weight"))
    return exact_of_legs(m, paths.withColumn("leg", F.col("sleeve")))


def exact_of_plan(members: DataFrame, paths: DataFrame, plan: list[Option]) -> DataFrame:
    """As ``portfolio_exact`` for the options of a sizing plan; ``paths`` has sleeve and leg."""
    leg = F.element_at(F.create_map(*[F.lit(x) for o in plan for x in (o.option_id, o.leg)]), F.col("option_id"))
    m = members.select("portfolio_id", F.concat_ws("/", "sleeve", leg).alias("leg"), _scale([(o.option_id, o.scale) for o in plan]).alias("weight"))
    return exact_of_legs(m, paths.withColumn("leg", F.concat_ws("/", "sleeve", "leg")))


def exact_of_legs(m: DataFrame, paths: DataFrame) -> DataFrame:
    """Bar-level sum of a portfolio's weighted legs: drawdown within the session, largest exposure, concentration.

    The bars of a session are summed and summarised where the session is; only summaries are composed over the calendar."""
    p = materialize(paths.select("leg", F.col("session").alias("chunk"), F.col("slot").alias("pos"), "delta", "adverse", "exposure"), "paths")
    s = composed(portfolio_summaries(m, p), ["portfolio_id"])
    sums = p.groupBy("leg").agg(F.sum("delta").alias("_u"))  # one row a leg
    share = m.join(sums, "leg").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("active"), F.max(F.greatest(F.lit(0.0), F.col("_u") * F.col("weight"))).alias("_top"))
    return s.join(share, "portfolio_id").select("portfolio_id", "net", "max_drawdown", "max_exposure", "active", F.col("worst").alias("worst_day"),
                                                F.when(F.col("net") > 0, F.col("_top") / F.col("net")).otherwise(0.0).alias("top_share"))


def minute_equity(path: DataFrame, group: list[str]) -> DataFrame:
    w = W.partitionBy(*group).orderBy("session", "slot")
    run, prev = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    x = path.withColumn("_eq", F.sum("delta").over(run))
    return x.withColumns({"_pk": F.greatest(F.lit(0.0), F.max("_eq").over(run)), "_pb": F.greatest(F.lit(0.0), F.max("_eq").over(prev))})


def minute_mdd():
    return F.least(F.lit(0.0), F.min(F.col("_eq") - F.col("_pk")), F.min(F.col("_eq") - F.col("delta") + F.col("adverse") - F.col("_pb")))


def minute_drawdown(path: DataFrame, group: list[str]) -> DataFrame:
    """Drawdown of a bar-level path, open positions marked at their adverse extreme."""
    return minute_equity(path, group).groupBy(*group).agg(F.sum("delta").alias("net"), minute_mdd().alias("max_drawdown"), F.max("exposure").alias("max_exposure"))


def sum_paths(paths: DataFrame, group: list[str]) -> DataFrame:
    """Union of sleeve paths summed per bar."""
    return paths.groupBy(*group, "session", "slot").agg(F.sum("delta").alias("delta"), F.sum("adverse").alias("adverse"), F.sum("exposure").alias("exposure"))


def leaderboards(exact: DataFrame, daily: DataFrame, mdd: float, max_exposure: float, n: int) -> DataFrame:
    """Disciplined board ranks on selection evidence, the oracle board on the full period."""
    x = exact.join(daily.select("portfolio_id", "net_train", "net_validate", "mdd_daily"), "portfolio_id").filter(
        (F.col("max_drawdown") > mdd) & (F.col("max_exposure") <= max_exposure))
    x = x.withColumn("selection", F.when((F.col("net_train") > 0) & (F.col("net_validate") > 0),
                                         (F.col("net_train") + F.col("net_validate")) / F.greatest(F.lit(100.0), F.abs("mdd_daily"))))
    a = x.filter("selection IS NOT NULL").orderBy(F.desc("selection"), F.desc("net"), "portfolio_id").limit(n).withColumn("board", F.lit("disciplined"))
    b = x.orderBy(F.desc("net"), "portfolio_id").limit(n).withColumn("board", F.lit("oracle"))
    return a.unionByName(b)
