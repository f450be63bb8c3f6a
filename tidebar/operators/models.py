"""Forecasts and fitted models: windowed ridge, trees, classifiers, run-length posterior.

Spark aggregates, shuffles and fits; Python sees only small systems in Arrow batches.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.core import KEYS, by_day, by_session, prior


def rolling_ridge(df: DataFrame, xs: list[str], y: str, n: int, lam: float, minimum: int) -> DataFrame:
    """Ridge on the prior ``n`` rows of the symbol: ``pred``, ``unc`` and slopes ``beta``; ``lam`` is positive.

    Window aggregates keep centred moments, merged without sums of raw products, so nothing cancels at high price levels. An Arrow
    batch of the small standardised systems is solved at once by Cholesky factors. Rows with a missing value are not
    imputed and have no forecast."""
    w, k = prior(by_day(), n), len(xs)
    names = [*xs, y]
    ok = reduce(lambda a, c: a & F.col(c).isNotNull(), names, F.lit(True))
    v = [F.when(ok, F.col(c).cast("double")) for c in names]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    none = F.lit(float("nan"))
    moments = [F.count(v[k]).over(w).cast("double"), *[F.coalesce(F.avg(c).over(w), none) for c in v], *[F.coalesce(F.covar_pop(v[i], v[j]).over(w), none) for i, j in pairs]]
    now = F.array(*[F.coalesce(F.col(x).cast("double"), none) for x in xs])

    @F.pandas_udf("pred double, unc double, beta array<double>")
    def solve(m: pd.Series, x: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"pred": np.nan, "unc": np.nan, "beta": [None] * len(m)}, index=m.index, dtype=object)
        a = np.array(m.tolist(), float).reshape(len(m), -1)
        z = np.array(x.tolist(), float).reshape(len(m), -1)
        good = np.flatnonzero((a[:, 0] >= minimum) & np.isfinite(z).all(1)) if len(m) else []
        if not len(good):
            return out
        a, z = a[good], z[good]
        cnt, mean, cov = a[:, 0], a[:, 1:k + 2], np.zeros((len(good), k + 1, k + 1))
        for c, (i, j) in enumerate(pairs):
            cov[:, i, j] = cov[:, j, i] = a[:, k + 2 + c]
        sd = np.sqrt(cov[:, range(k), range(k)])
        sd = np.where(sd > 1e-10, sd, 1.0)
        corr = cov[:, :k, :k] / sd[:, :, None] / sd[:, None, :]
        rhs, now_z = cov[:, :k, k] / sd, (z - mean[:, :k]) / sd
        low = np.linalg.cholesky(corr + lam * np.eye(k))
        half = np.linalg.solve(low, np.stack([rhs, now_z], 2))  # both right-hand sides go along
        beta = np.linalg.solve(low.transpose(0, 2, 1), half[:, :, :1])[:, :, 0]
        mse = cov[:, k, k] - 2 * (beta * rhs).sum(1) + np.einsum("ni,nij,nj->n", beta, corr, beta)
        lever = (1 + (half[:, :, 1] ** 2).sum(1)) / cnt
        out.loc[good, "pred"], out.loc[good, "unc"] = mean[:, k] + (beta * now_z).sum(1), np.sqrt(np.maximum(0, mse * lever))
        out.loc[good, "beta"] = pd.Series(list(beta / sd), index=good)
        return out

    x = df.withColumn("_r", solve(F.array(*moments), now))
    nan = lambda c: F.when(~F.isnan(c), c)
    return x.withColumns({"pred": nan(F.col("_r.pred")), "unc": nan(F.col("_r.unc")), "beta": F.col("_r.beta")}).drop("_r")


def run_length_posterior(df: DataFrame, hazard: float, recent: int) -> DataFrame:
    """Per bar: probability that a recent shift made the mean return negative / positive.

    Sessions are packed, bounded by their length; one Arrow batch carries many sessions."""
    g = df.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("slot", F.col("ret_z").alias("z")))).alias("_b"))

    @F.pandas_udf("array<struct<slot: int, down: double, up: double>>")
    def posterior(batch: pd.Series) -> pd.Series:
        sizes = batch.map(len).to_numpy()
        n, longest = len(sizes), int(sizes.max(initial=0))
        z = np.full((n, longest), np.nan)
        slots = np.zeros((n, longest), np.int64)
        flat = [(r["slot"], np.nan if r["z"] is None else r["z"]) for rows in batch for r in rows]
        inside = np.arange(longest) < sizes[:, None]
        if flat:
            slots[inside], z[inside] = (np.array(c) for c in zip(*flat))
        down, up = _shift_posterior(z, hazard, recent)
        out = pd.Series(np.empty(n, object))
        for i, size in enumerate(sizes):
            out.iloc[i] = [{"slot": int(k), "down": None if math.isnan(d) else d, "up": None if math.isnan(u) else u}
                           for k, d, u in zip(slots[i, :size], down[i, :size].tolist(), up[i, :size].tolist())]
        return out

    return g.select(*KEYS, F.inline(posterior("_b")))


def _shift_posterior(z: np.ndarray, hazard: float, recent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bayesian run-length recursion on all sessions of a batch at once, a column of bars at a time.

    Column r of the state holds what is known if the last shift was r bars ago; a missing bar ends a
    session's path. Returns the probabilities of a shift within ``recent`` bars to a negative and to a
    positive mean, NaN where there is no path."""
    n, bars = z.shape
    prob, mean, prec = np.zeros((n, bars + 1)), np.zeros((n, bars + 1)), np.ones((n, bars + 1))
    prob[:, 0] = 1
    down, up = np.full((n, bars), np.nan), np.full((n, bars), np.nan)
    half = np.frompyfunc(lambda v: 0.5 * (1 + math.erf(v)), 1, 1)
    for t in range(bars):
        v = z[:, t:t + 1]
        live = np.isfinite(v[:, 0]) & (prob.sum(1) > 0)
        v = np.where(live[:, None], v, 0.0)
        p, m, k = prob[:, :t + 1], mean[:, :t + 1], prec[:, :t + 1]
        var = 1 + 1 / k
        weight = p * np.exp(-0.5 * (v - m) ** 2 / var) / np.sqrt(2 * np.pi * var)
        grown = np.concatenate((weight.sum(1, keepdims=True) * hazard, weight * (1 - hazard)), axis=1)
        whole = grown.sum(1)
        live &= whole > 0
        prob[:, :t + 2] = np.where(live[:, None], grown / np.where(live, whole, 1)[:, None], 0.0)
        mean[:, 1:t + 2], prec[:, 1:t + 2] = (m * k + v) / (k + 1), k + 1
        mean[:, 0], prec[:, 0] = 0.0, 1.0
        near = slice(1, min(recent, t + 1) + 1)
        below = half(-mean[:, near] * np.sqrt(prec[:, near] / 2)).astype(float)
        down[live, t] = (prob[:, near] * below).sum(1)[live]
        up[live, t] = (prob[:, near] * (1 - below)).sum(1)[live]
    return down, up


def exit_posterior(trades: DataFrame, post: DataFrame, bars: DataFrame, level: float, after: int) -> DataFrame:
    """Exit at the open after the first held bar whose adverse probability reaches ``level``."""
    p = post.join(bars.select(*KEYS, "slot", "open"), [*KEYS, "slot"])
    packed = p.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("slot", "down", "up", "open"))).alias("_b"))
    x = trades.join(packed, list(KEYS))
    bad = F.filter("_b", lambda r: (r["slot"] >= F.col("entry_slot") + after - 1) & (r["slot"] < F.col("exit_slot") - 1)
                   & (F.when(F.col("side") > 0, r["down"]).otherwise(r["up"]) >= level))
    x = x.withColumn("early_slot", F.get(bad, F.lit(0))["slot"] + 1)
    nxt = F.get(F.filter("_b", lambda r: r["slot"] == F.col("early_slot")), F.lit(0))["open"]
    x = x.withColumn("_px", nxt)
    return x.withColumn("early_pnl_pts", F.when(F.col("_px").isNotNull(), F.col("side") * (F.col("_px") - F.col("entry_px"))).otherwise(F.col("pnl_pts"))).drop("_b", "_px")


def _features(df: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="skip").transform(df.dropna(subset=cols))


def tree_rules(snap: DataFrame, cols: list[str], label: str, train: tuple, depth: int, leaf: int) -> dict[str, list]:
    """Shallow regression tree on the training years; each leaf as a conjunction of conditions."""
    from pyspark.ml.regression import DecisionTreeRegressor
    x = _features(snap.filter(F.col("year").isin(*train) & F.col(label).isNotNull()), cols)
    if x.isEmpty():
        return {}
    model = DecisionTreeRegressor(featuresCol="_x", labelCol=label, maxDepth=depth, minInstancesPerNode=leaf, seed=5).fit(x)
    rules: dict[str, list] = {}

    def walk(node, conds):
        if node.numDescendants() == 0:
            rules[f"leaf{len(rules):02d}"] = conds
            return
        s = node.split()
        name, thr = cols[s.featureIndex()], float(s.threshold())
        walk(node.leftChild(), [*conds, (name, "<=", thr)])
        walk(node.rightChild(), [*conds, (name, ">", thr)])

    walk(model._java_obj.rootNode(), [])
    return {k: v for k, v in rules.items() if v}


def rule_means(matched: DataFrame, label: str, train: tuple, validate: tuple, test: tuple) -> DataFrame:
    """Counts and means of the label per rule and split."""
    at = lambda f, t: f(F.when(F.col("year").isin(*t), F.col(label)))
    return matched.filter(F.col(label).isNotNull()).groupBy("rule_id").agg(*[
        a for n, t in (("train", train), ("validate", validate), ("test", test)) for a in (
            at(F.count, t).alias(f"n_{n}"), at(F.avg, t).alias(f"mean_{n}"))])


def classifier_scores(daily: DataFrame, cols: list[str], label: str, train: tuple, hidden: list[int]) -> DataFrame:
    """Probability of the label from a small network on features standardised on the training years."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array
    x = _features(daily, cols)
    pipe = Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
                            MultilayerPerceptronClassifier(featuresCol="_z", labelCol=label, layers=[len(cols), *hidden, 2], seed=7, maxIter=60)])
    model = pipe.fit(x.filter(F.year("session").isin(*train) & F.col(label).isNotNull()))
    return model.transform(x).withColumn("p_up", F.get(vector_to_array("probability"), F.lit(1))).select(*daily.columns, "p_up")


def range_forecast(daily: DataFrame, cols: list[str], label: str, train: tuple, depth: int) -> DataFrame:
    """Boosted-tree forecast of the session range."""
    from pyspark.ml.regression import GBTRegressor
    x = _features(daily, cols)
    model = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=15, maxDepth=depth, seed=7).fit(
        x.filter(F.year("session").isin(*train) & F.col(label).isNotNull()))
    return model.transform(x).withColumnRenamed("prediction", "pred_range").select(*daily.columns, "pred_range")
