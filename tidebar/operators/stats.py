"""Statistics of trades, days and settings (A operators, path windows, rankings, screens).

A result is one (config_id, symbol). Path windows are partitioned by it, so a partition holds
at most sessions x daily trade cap rows, whatever share of the raw data the symbol has.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

RESULT = ["config_id", "symbol"]
PERIODS_PER_YEAR = 252.0


def pos(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(0.0)


def neg(x: Column) -> Column:
    return F.when(x < 0, -x).otherwise(0.0)


def trade_aggs(pnl: str = "pnl") -> list[Column]:
    p = F.col(pnl)
    return [F.count(F.lit(1)).alias("trades"), F.sum(p).alias("net"),
            F.try_divide(F.sum(pos(p)), F.nullif(F.sum(neg(p)), F.lit(0.0))).alias("profit_factor"),
            F.avg(F.when(p > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(p).alias("avg_trade"),
            F.avg("r_multiple").alias("avg_r"), F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_win"),
            F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)).alias("avg_loss"),
            F.max(p).alias("largest_win"), F.min(p).alias("largest_loss")]


def trade_stats(trades: DataFrame, by: list[str] = RESULT) -> DataFrame:
    """Totals, ratios and extremes in one aggregate."""
    return trades.groupBy(*by).agg(*trade_aggs())


def long_short_split(trades: DataFrame, by: list[str] = RESULT) -> DataFrame:
    p, s = F.col("pnl"), F.col("side")
    return trades.groupBy(*by).agg(F.sum(F.when(s > 0, p).otherwise(0.0)).alias("long_net"),
                                   F.sum(F.when(s < 0, p).otherwise(0.0)).alias("short_net"))


def uncertainty_flags(trades: DataFrame, by: list[str] = RESULT) -> DataFrame:
    return trades.groupBy(*by).agg(F.count_if("ambiguous").alias("ambiguous"), F.count_if("is_unknown").alias("unknown"),
                                   F.count_if(F.col("qty") == 0).alias("size_skips"))


def equity_curve(trades: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Running money and R, with the equity and peak before each row (peak includes zero)."""
    w = W.partitionBy(*group).orderBy(*order)
    run, prev = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    x = trades.withColumn("equity", F.sum("pnl").over(run))
    if "r_multiple" in trades.columns:
        x = x.withColumn("equity_r", F.sum("r_multiple").over(run))
    return x.withColumns({
        "peak": F.greatest(F.lit(0.0), F.max("equity").over(run)),
        "peak_before": F.greatest(F.lit(0.0), F.max("equity").over(prev))})


def drawdown(daily: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Worst fall of closed equity below its running peak, never above zero."""
    x = equity_curve(daily, group, order)
    return x.groupBy(*group).agg(F.least(F.lit(0.0), F.min(F.col("equity") - F.col("peak"))).alias("max_drawdown"))


def intratrade_drawdown(trades: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """As ``drawdown`` and also marks each trade at its worst excursion."""
    x = equity_curve(trades, group, order)
    before = F.col("equity") - F.col("pnl")
    return x.groupBy(*group).agg(F.least(
        F.lit(0.0), F.min(F.col("equity") - F.col("peak")), F.min(before + F.col("worst") - F.col("peak_before"))).alias("max_drawdown"))


ORDER = ["session", "slot", "side"]


def path_stats(trades: DataFrame, by: list[str] = RESULT) -> DataFrame:
    """Trade totals and intratrade drawdown over all years and for each year on its own.

    Each trade is labelled with both periods, so one window and one aggregate serve all."""
    x = trades.filter("executed").withColumn("period", F.explode(F.array(F.lit("all"), F.col("year").cast("string"))))
    g = [*by, "period"]
    x = equity_curve(x, g, ORDER)
    dd = F.least(F.lit(0.0), F.min(F.col("equity") - F.col("peak")),
                 F.min(F.col("equity") - F.col("pnl") + F.col("worst") - F.col("peak_before")))
    return x.groupBy(*g).agg(*trade_aggs(), dd.alias("max_drawdown")).withColumn(
        "profit_to_dd", F.try_divide("net", F.abs(F.nullif(F.col("max_drawdown"), F.lit(0.0)))))


def wide_stats(trades: DataFrame, train: tuple, validate: tuple, test: tuple, by: list[str] = RESULT) -> DataFrame:
    """One row per result: totals, drawdown and the three splits side by side."""
    split = F.when(F.col("year").isin(*train), "train").when(F.col("year").isin(*validate), "validate").when(
        F.col("year").isin(*test), "test")
    x = trades.filter("executed").withColumn("period", F.explode(F.array(F.lit("all"), split)))
    x = equity_curve(x, [*by, "period"], ORDER)
    dd = F.least(F.lit(0.0), F.min(F.col("equity") - F.col("peak")),
                 F.min(F.col("equity") - F.col("pnl") + F.col("worst") - F.col("peak_before")))
    p = F.col("pnl")
    per = x.groupBy(*by, "period").agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("net"), F.sum(pos(p)).alias("gw"), F.sum(neg(p)).alias("gl"),
        dd.alias("dd"), F.avg("r_multiple").alias("r"))
    at = lambda c, t: F.max(F.when(F.col("period") == t, F.col(c)))
    cols = [at("n", "all").alias("trades"), at("net", "all").alias("net"), at("dd", "all").alias("max_drawdown"),
            at("r", "all").alias("avg_r"), F.try_divide(at("gw", "all"), F.nullif(at("gl", "all"), F.lit(0.0))).alias("profit_factor")]
    for t in ("train", "validate", "test"):
        cols += [F.coalesce(at("n", t), F.lit(0)).alias(f"trades_{t}"), F.coalesce(at("net", t), F.lit(0.0)).alias(f"net_{t}"),
                 F.coalesce(at("dd", t), F.lit(0.0)).alias(f"mdd_{t}"),
                 F.try_divide(at("gw", t), F.nullif(at("gl", t), F.lit(0.0))).alias(f"pf_{t}")]
    return per.groupBy(*by).agg(*cols)


def period_stats(trades: DataFrame, unit: str, by: list[str] = RESULT) -> DataFrame:
    return trades.filter("executed").groupBy(*by, F.trunc("session", unit).alias("period")).agg(*trade_aggs())


def sharpe_sortino(daily: DataFrame, by: list[str] = RESULT) -> DataFrame:
    """Over the days that traded; more than two days and a positive deviation required."""
    p = F.col("pnl")
    n, sd = F.count(p), F.nullif(F.stddev_samp(p), F.lit(0.0))
    nd = F.count(F.when(p < 0, p))
    down = F.nullif(F.stddev_samp(F.when(p < 0, p)), F.lit(0.0))
    k = PERIODS_PER_YEAR ** 0.5
    return daily.groupBy(*by).agg(F.when(n > 2, F.try_divide(F.avg(p), sd) * k).alias("sharpe"),
                                  F.when(nd > 2, F.try_divide(F.avg(p), down) * k).alias("sortino"))


def sharpe_all_days(daily: DataFrame, calendar: DataFrame, by: list[str] = RESULT) -> DataFrame:
    """Over all sessions of the symbol, days without a trade counting as zero.

    Zero rows add nothing to the sums, so only their number is needed and none is built."""
    n = calendar.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    m = daily.groupBy(*by).agg(F.sum("pnl").alias("_s"), F.sum(F.col("pnl") * F.col("pnl")).alias("_q")).join(n, "symbol")
    mean = F.col("_s") / F.col("_n")
    var = (F.col("_q") - F.col("_n") * mean * mean) / (F.col("_n") - 1)
    sd = F.nullif(F.sqrt(F.greatest(F.lit(0.0), var)), F.lit(0.0))
    return m.select(*by, F.col("_n").alias("sessions"), (F.try_divide(mean, sd) * PERIODS_PER_YEAR ** 0.5).alias("sharpe_all"))


def describe_known(days: DataFrame, by: list[str] = RESULT) -> DataFrame:
    """Unknown days give no P&L and are counted apart. ``days``: pnl, known, entries per session."""
    x = days.withColumn("pnl", F.when(F.col("known"), F.coalesce("pnl", F.lit(0.0))).otherwise(0.0))
    x = equity_curve(x, by, ["session"])
    p, ok = F.col("pnl"), F.col("known")
    return x.groupBy(*by).agg(
        F.sum(p).alias("net"), F.sum(F.when(ok, F.col("entries")).otherwise(0)).alias("trades"),
        F.count_if(ok & (F.col("entries") > 0)).alias("event_days"), F.count_if(~ok).alias("unknown_days"),
        F.min(p).alias("worst_day"), F.least(F.lit(0.0), F.min(F.col("equity") - F.col("peak"))).alias("max_drawdown"))


def known_days(outcomes: DataFrame, money: DataFrame, by: list[str] = RESULT) -> DataFrame:
    """Per session: P&L, number of entries and whether every path of the day is known."""
    u = outcomes.groupBy(*by, "session").agg((F.count_if("is_unknown") == 0).alias("known"))
    d = money.groupBy(*by, "session").agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("entries"))
    return u.join(d, [*by, "session"], "left").withColumn("entries", F.coalesce("entries", F.lit(0)))


def bucket_stats(trades: DataFrame, feature: str, cuts: list[float], by: list[str]) -> DataFrame:
    """Path statistics per fixed ``[a, b)`` bucket of a feature."""
    label = F.lit(None).cast("string")
    for a, b in zip(cuts[:-1], cuts[1:]):
        label = F.when((F.col(feature) >= a) & (F.col(feature) < b), F.lit(f"[{a},{b})")).otherwise(label)
    return path_stats(trades.withColumn("bucket", label).filter("bucket IS NOT NULL"), [*by, "bucket"]).filter("period = 'all'").drop("period")


def streaks(trades: DataFrame, by: list[str] = RESULT) -> DataFrame:
    """Longest and mean runs of wins and losses, as gaps and islands."""
    w = W.partitionBy(*by).orderBy(*ORDER)
    win = F.col("pnl") > 0
    x = trades.withColumn("_w", win)
    x = x.withColumn("_i", F.row_number().over(w) - F.row_number().over(W.partitionBy(*by, "_w").orderBy(*ORDER)))
    r = x.groupBy(*by, "_w", "_i").agg(F.count(F.lit(1)).alias("_n"))
    pick = lambda f, flag: F.coalesce(f(F.when(F.col("_w") == flag, F.col("_n"))), F.lit(0))
    return r.groupBy(*by).agg(pick(F.max, True).alias("max_win_streak"), pick(F.avg, True).alias("avg_win_streak"),
                              pick(F.max, False).alias("max_loss_streak"), pick(F.avg, False).alias("avg_loss_streak"))


def trade_sequence(trades: DataFrame, by: list[str] = RESULT) -> DataFrame:
    """Number of the trade in its session and the previous funded result of that session."""
    w = W.partitionBy(*by, "session").orderBy("slot", "side")
    funded = F.when(F.col("executed"), F.col("pnl"))
    return trades.withColumns({
        "trade_number": F.row_number().over(w),
        "prev_funded_pnl": F.last(funded, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))})


def worst_day(daily: DataFrame, by: list[str] = RESULT) -> DataFrame:
    return daily.groupBy(*by).agg(F.least(F.lit(0.0), F.min("pnl")).alias("worst_day"))


def day_cap(daily: DataFrame, cap: float) -> DataFrame:
    return daily.withColumn("pnl", F.greatest(F.col("pnl"), F.lit(-cap)))


def floor_screen(daily: DataFrame, loss: float, lock: float, by: list[str] = RESULT) -> DataFrame:
    """First day on which balance plus the day's worst mark reaches the trailing floor.

    The floor is ``least(lock, peak - loss)`` of completed days and never falls."""
    x = equity_curve(daily, by, ["session"])
    floor = F.least(F.lit(lock), F.col("peak_before") - loss)
    before = F.col("equity") - F.col("pnl")
    x = x.withColumns({"_f": floor, "_low": F.least(before + F.col("worst"), F.col("equity"))})
    hit = F.when(F.col("_low") <= F.col("_f"), F.col("session"))
    return x.groupBy(*by).agg(F.min(hit).alias("breach_session"), F.min_by("_f", hit).alias("floor_at_breach"),
                              F.count(F.lit(1)).alias("days"))


def first_passage(daily: DataFrame, every: int, target: float, loss: float, lock: float, by: list[str] = RESULT) -> DataFrame:
    """Started on every n-th day: does equity reach the target or the trailing floor first?

    The days of a result (at most the calendar) sit in one array; each start folds its tail."""
    g = daily.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("session", "pnl"))), lambda r: r["pnl"]).alias("_p"))
    s = g.withColumn("_start", F.explode(F.sequence(F.lit(1), F.size("_p"), F.lit(every))))
    fold = f"""aggregate(slice(_p, _start, size(_p)), named_struct('bal', CAST(0.0 AS DOUBLE), 'hi', CAST(0.0 AS DOUBLE), 'n', 0, 'res', 'open'),
 (s, p) -> CASE WHEN s.res <> 'open' THEN s ELSE named_struct('bal', s.bal + p, 'hi', greatest(s.hi, s.bal + p), 'n', s.n + 1,
 'res', CASE WHEN s.bal + p <= greatest(-{loss}D, least({lock}D, s.hi - {loss}D)) THEN 'fail' WHEN s.bal + p >= {target}D THEN 'pass' ELSE 'open' END) END)"""
    s = s.withColumn("_r", F.expr(fold))
    res = lambda r: 100.0 * F.avg(F.when(F.col("_r.res") == r, 1.0).otherwise(0.0))
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("starts"), res("pass").alias("pass_pct"), res("fail").alias("fail_pct"),
                              res("open").alias("open_pct"),
                              F.percentile(F.when(F.col("_r.res") == "pass", F.col("_r.n")), F.lit(0.5)).alias("median_days"))


# ---- screens ---------------------------------------------------------------------

def screen(results: DataFrame, **floors) -> DataFrame:
    """Rows at or above every floor; ``max_drawdown`` must stay strictly above its value."""
    for name, v in floors.items():
        results = results.filter(F.col(name) > v if name == "max_drawdown" else F.col(name) >= v)
    return results


def promotion_filter(r: DataFrame, mdd: float, trades: int) -> DataFrame:
    """Validation and test both profitable with a profit factor above one."""
    pf = lambda c: F.col(c).isNull() | (F.col(c) > 1)
    return r.filter((F.col("net_validate") > 0) & (F.col("net_test") > 0) & pf("pf_validate") & pf("pf_test")
                    & (F.col("max_drawdown") > mdd) & (F.col("trades") >= trades))


def credible(r: DataFrame, net: float, mdd: float, trades: int, per_split: int, share: float) -> DataFrame:
    """Every split traded enough and positive, and no split carries too much of the profit."""
    nets = [F.col(f"net_{t}") for t in ("train", "validate", "test")]
    ok = (F.col("net") >= net) & (F.col("max_drawdown") > mdd) & (F.col("trades") >= trades) & (
        F.greatest(*nets) / F.nullif(F.col("net"), F.lit(0.0)) <= share)
    for t in ("train", "validate", "test"):
        ok = ok & (F.col(f"trades_{t}") >= per_split) & (F.col(f"net_{t}") > 0)
    return r.filter(ok)


def classify_status(grid: DataFrame, results: DataFrame, key: list[str], floor: int) -> DataFrame:
    """Every setting gets a status, those without a single event included."""
    x = grid.select(*key).join(results.select(*key, "trades", "unknown"), key, "left")
    return x.withColumn("status", F.when(F.coalesce("unknown", F.lit(0)) > 0, "NEEDS_DATA").when(
        F.coalesce("trades", F.lit(0)) == 0, "NO_TRADES").when(F.col("trades") < floor, "UNDERPOWERED").otherwise("EVALUATED")).select(*key, "status")


# ---- scores and rankings ------------------------------------------------------------

def selection_score(r: DataFrame, min_trades: int) -> DataFrame:
    """Smaller of train and validation profit per drawdown, scaled by support; NULL if unfit."""
    ratio_ = lambda t: F.col(f"net_{t}") / F.greatest(F.lit(1.0), F.abs(F.col(f"mdd_{t}")))
    support = F.least(F.lit(2.0), F.sqrt(F.least("trades_train", "trades_validate") / min_trades))
    fit = ((F.col("trades_train") >= min_trades) & (F.col("trades_validate") >= min_trades) & (F.col("net_train") > 0)
           & (F.col("net_validate") > 0) & (F.coalesce("pf_train", F.lit(99.0)) > 1) & (F.coalesce("pf_validate", F.lit(99.0)) > 1))
    return r.withColumn("score", F.when(fit, F.least(ratio_("train"), ratio_("validate")) * support))


def evidence_score(r: DataFrame) -> DataFrame:
    a = F.col("net_train") / F.greatest(F.lit(100.0), F.abs("mdd_train"))
    b = F.col("net_validate") / F.greatest(F.lit(100.0), F.abs("mdd_validate"))
    return r.withColumn("evidence", F.when((F.col("net_train") > 0) & (F.col("net_validate") > 0), F.least(a, b) + 0.25 * (a + b)))


def rank_results(r: DataFrame, min_trades: int) -> DataFrame:
    """Log profit factor and mean R, both scaled by the root of the trade count."""
    n = F.sqrt("trades")
    score = F.ln(F.greatest(F.lit(0.01), F.coalesce("profit_factor", F.lit(99.0)))) * n + 0.25 * F.col("avg_r") * n
    return r.filter(F.col("trades") >= min_trades).withColumn("rank_score", score).orderBy(
        F.desc("rank_score"), F.desc("net"), *RESULT)


def top_n_per(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` per group; the rank filter is applied before the shuffle as a group limit."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def best_under(df: DataFrame, group: list[str], ok: Column, by: str, tie: list[str]) -> DataFrame:
    """Best qualifying row per group, NULL when none qualifies."""
    key = F.struct(F.col(by), *[F.col(c) for c in tie])
    return df.groupBy(*group).agg(F.max(F.when(ok, key)).alias("_b"), F.count_if(ok).alias("qualifying")).select(
        *group, "qualifying", "_b.*")


def ranked_with_group_cap(df: DataFrame, group: list[str], order: list, cap: int, total_: int) -> DataFrame:
    """Best rows overall with at most ``cap`` per group: the cap first, then the overall limit."""
    return top_n_per(df, group, order, cap).orderBy(*order).limit(total_)


def reserved_top(df: DataFrame, first: list, n_first: int, second: list, n_second: int, key: list[str]) -> DataFrame:
    """Two leaderboards with their own quotas, united without duplicates."""
    a = df.orderBy(*first).limit(n_first).select(*df.columns)
    b = df.orderBy(*second).limit(n_second).select(*df.columns)
    return a.unionByName(b).dropDuplicates(key)


def profit_concentration(parts: DataFrame, whole: list[str]) -> DataFrame:
    """Largest positive part over the whole."""
    return parts.groupBy(*whole).agg(F.sum("net").alias("total"), F.max(F.greatest(F.lit(0.0), F.col("net"))).alias("_m")).withColumn(
        "top_share", F.when(F.col("total") > 0, F.col("_m") / F.col("total")).otherwise(0.0)).drop("_m")


def correlation_matrix(daily: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Pairwise correlation of daily P&L of the named sleeves, missing days zero, undefined 0.

    The sleeves become columns of one row per session and a single aggregate yields every pair."""
    wide = daily.groupBy("session").pivot(key, names).agg(F.sum("pnl")).fillna(0.0)
    q = lambda n: F.col(f"`{n}`")
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                      (F.lit(1.0) if a == b else F.coalesce(F.corr(q(a), q(b)), F.lit(0.0))).alias("corr"))
             for a in names for b in names]
    return wide.agg(F.array(*pairs).alias("_p")).select(F.inline("_p"))


def correlation_pairs(daily: DataFrame, key: str) -> DataFrame:
    """``(a, b, corr)`` of all sleeves of the data, missing days zero, undefined 0, each with itself 1.

    Days are filled per sleeve from the calendar; sleeves meet by session, and a combined aggregate keeps centred moments for
    each pair, of which there are as many as the matrix has entries."""
    p = daily.groupBy(key, "session").agg(F.sum("pnl").alias("pnl"))
    days = p.agg(F.array_sort(F.collect_set("session")).alias("d"))
    whole = p.select(key).distinct().withColumn("session", F.explode(days.scalar())).join(p, [key, "session"], "left").select(F.col(key).alias("a"), "session", F.coalesce("pnl", F.lit(0.0)).alias("pa"))
    other = whole.select(F.col("a").alias("b"), "session", F.col("pa").alias("pb"))
    c = whole.join(other, "session").groupBy("a", "b").agg(F.try_divide(F.covar_pop("pa", "pb"), F.stddev_pop("pa") * F.stddev_pop("pb")).alias("c"))
    return c.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("corr"))
