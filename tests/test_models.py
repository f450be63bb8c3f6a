"""Numerical helpers against direct computation."""
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions.quantiles import exact_quantiles
from tidebar.operators import models, rules, search
from tidebar.operators import features as feats


def test_rolling_ridge(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 3))
    y = x @ [0.5, -1.0, 0.2] + rng.normal(size=70) * 0.3
    rows = [("X", dt.date(2024, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), None if i % 11 == 0 else float(y[i])) for i in range(70)]
    d = spark.createDataFrame(rows, "symbol string, session date, a double, b double, c double, y double")
    got = models.rolling_ridge(d, ["a", "b", "c"], "y", 30, 0.1, 15).orderBy("session").collect()
    for i in (20, 45, 69):
        idx = [j for j in range(max(0, i - 30), i) if j % 11]
        xx, yy = x[idx], y[idx]
        mu, sd = xx.mean(0), xx.std(0)
        z = np.c_[np.ones(len(idx)), (xx - mu) / sd]
        pen = np.diag([0, 1, 1, 1]) * 0.1 * len(idx)
        inv = np.linalg.inv(z.T @ z + pen)
        beta, now = inv @ z.T @ yy, np.r_[1, (x[i] - mu) / sd]
        assert got[i].pred == pytest.approx(now @ beta, abs=1e-9)
        res = yy - z @ beta
        assert got[i].unc == pytest.approx(math.sqrt(np.mean(res ** 2) * (now @ inv @ now)), abs=1e-9)


def test_ridge_at_high_price_levels(spark):
    """Prices near 20,000 that move by thousandths: raw moments would lose every digit of the covariance."""
    rng = np.random.default_rng(8)
    off = rng.normal(size=(50, 2)) * 1e-3
    z = off @ [2.0, -1.0] + rng.normal(size=50) * 1e-4
    d = lambda x, y: spark.createDataFrame([("X", dt.date(2024, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), float(y[i])) for i in range(50)], "symbol string, session date, a double, b double, y double")
    low = models.rolling_ridge(d(off, z), ["a", "b"], "y", 30, 0.01, 15).orderBy("session").collect()
    high = models.rolling_ridge(d(off + 20_000, z + 20_000), ["a", "b"], "y", 30, 0.01, 15).orderBy("session").collect()
    assert sum(r.pred is not None for r in high) == 35
    for p, q in zip(low, high):
        if p.pred is not None:
            assert q.pred - 20_000 == pytest.approx(p.pred, abs=1e-9) and q.unc == pytest.approx(p.unc, rel=1e-5)


def test_ridge_without_variance_or_values(spark):
    rows = [("X", dt.date(2024, 1, 1) + dt.timedelta(days=i), 5.0, None if i == 20 else float(i), 1.0) for i in range(25)]
    got = models.rolling_ridge(spark.createDataFrame(rows, "symbol string, session date, a double, b double, y double"), ["a", "b"], "y", 10, 0.1, 5).orderBy("session").collect()
    assert got[3].pred is None and got[20].pred is None and got[24].pred == pytest.approx(1.0)
    assert models.rolling_ridge(spark.createDataFrame([], "symbol string, session date, a double, y double"), ["a"], "y", 10, 0.1, 5).count() == 0


def test_forecast_ignores_the_current_target(spark):
    rows = [("X", dt.date(2024, 1, 1) + dt.timedelta(days=i), math.sin(i), math.cos(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "symbol string, session date, x double, y double")
    from tidebar.functions.core import by_day, prior
    f = lambda q: [r.pred for r in feats.prior_ridge_1(q, "x", "y", prior(by_day(), 30), 10, 0.1).orderBy("session").collect()]
    a, b = f(d), f(d.withColumn("y", F.when(F.col("session") >= dt.date(2024, 2, 10), 99.0).otherwise(F.col("y"))))
    assert a[:41] == b[:41] and a[42:] != b[42:]


@pytest.mark.parametrize("kind", ["skewed", "ties", "normal"])
def test_exact_quantiles(spark, kind):
    rnd = random.Random(7)
    vals = {"skewed": [rnd.paretovariate(0.7) for _ in range(3000)], "ties": [float(rnd.choice([1, 1, 1, 1, 2, 3])) for _ in range(3000)],
            "normal": [rnd.gauss(0, 1) for _ in range(2999)]}[kind]
    rows = [("hot", v) for v in vals] + [("small", float(i)) for i in range(3)]
    d = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.33, 0.5, 0.975, 1.0]
    got = {(r.g, r.q): r.threshold for r in exact_quantiles(d, ["g"], "v", qs).collect()}
    for q in qs:
        assert got[("hot", q)] == pytest.approx(float(np.quantile(vals, q)), rel=1e-12)
        assert got[("small", q)] == pytest.approx(float(np.quantile([0, 1, 2], q)))


def test_deflated_sharpe(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0.3, 1.0, 80)
    d = spark.createDataFrame([("c", float(v)) for v in x], "config_id string, pnl double")
    r = search.deflated_sharpe(d, ["config_id"], 1).collect()[0]
    z = (x - x.mean()) / x.std()
    sr = x.mean() / x.std()
    stat = sr * math.sqrt(79) / math.sqrt(1 - (z ** 3).mean() * sr + ((z ** 4).mean() - 1) * sr * sr / 4)
    assert r.stat == pytest.approx(stat) and r.probability == pytest.approx(0.5 * (1 + math.erf(stat / math.sqrt(2))))
    many = search.deflated_sharpe(d, ["config_id"], 1000).collect()[0]
    assert many.probability < r.probability


def test_run_length_posterior_reacts_to_a_shift(spark):
    z = [0.1, -0.1, 0.0, 0.1, -3.0, -3.0, -3.0]
    rows = [("X", dt.date(2024, 1, 2), i, v) for i, v in enumerate(z)]
    d = spark.createDataFrame(rows, "symbol string, session date, slot int, ret_z double")
    p = {r.slot: (r.down, r.up) for r in models.run_length_posterior(d, 0.1, 4).collect()}
    assert p[6][0] > 0.8 > p[3][0] and all(0 <= a + b <= 1.0000001 for a, b in p.values())


def test_rules_need_every_condition(spark):
    d = spark.createDataFrame([("X", dt.date(2024, 1, 2), 0, 1.0, 2.0), ("X", dt.date(2024, 1, 2), 1, 3.0, 4.0), ("X", dt.date(2024, 1, 2), 2, 5.0, 1.0), ("X", dt.date(2024, 1, 2), 3, 9.0, None)],
                              "symbol string, session date, slot int, a double, b double")
    r = {"r": [("a", ">", 2.0), ("b", "<=", 4.0)]}
    assert sorted(x.slot for x in rules.apply_rules(d, r).collect()) == [1, 2]
    t = spark.createDataFrame([("r", "a", ">", 2.0), ("r", "b", "<=", 4.0)], "rule_id string, feature string, op string, value double")
    assert sorted(x.slot for x in rules.apply_rule_table(d, ["slot"], ["a", "b"], t).collect()) == [1, 2]


def test_neighbors_differ_in_one_axis(spark):
    rows = [(f"c{a}{b}", "f", a, b, 1.0) for a in range(3) for b in range(2)]
    d = spark.createDataFrame(rows, "config_id string, family string, a int, b int, net double")
    n = search.neighbors(d, ["a", "b"], ["family"]).collect()
    assert len(n) == 6 * 3 and all((r.config_id[1] == r.neighbor_id[1]) != (r.config_id[2] == r.neighbor_id[2]) for r in n)


def test_walk_forward_ignores_the_test_period(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=30 * i) for i in range(36)]
    rng = random.Random(2)
    rows = [(c, "X", d, rng.gauss(1, 3), True, 1) for c in ("a", "b", "c") for d in days]
    d = spark.createDataFrame(rows, "config_id string, symbol string, session date, pnl double, known boolean, entries int")
    cal = d.select("symbol", "session").distinct()
    run = lambda q: {r.period: r.config_id for r in search.walk_forward(q, cal, "year", 24, 12, 5, -1e9).collect()}
    cut = dt.date(2022, 1, 1)
    changed = d.withColumn("pnl", F.when((F.col("session") >= cut) & (F.col("config_id") == "b"), 1000.0).otherwise(F.col("pnl")))
    a, b = run(d), run(changed)
    assert a and a == b


def test_run_length_posterior_equals_the_plain_recursion(spark):
    z = {"a": [0.3, -1.2, 2.0, 1.5, None, 0.7], "b": [None, 1.0], "c": [0.0, 0.1, -2.5]}
    rows = [(s, dt.date(2024, 1, 2), k, v) for s, vs in z.items() for k, v in enumerate(vs)]
    d = spark.createDataFrame(rows, "symbol string, session date, slot int, ret_z double")
    got = {(r.symbol, r.slot): r.down for r in models.run_length_posterior(d, 0.1, 2).collect()}
    for s, vs in z.items():
        state, live = [(1.0, 0.0, 1.0)], True
        for t, v in enumerate(vs):
            live = live and v is not None
            if not live:
                assert got[s, t] is None
                continue
            lik = [p * math.exp(-0.5 * (v - m) ** 2 / (1 + 1 / k)) / math.sqrt(2 * math.pi * (1 + 1 / k)) for p, m, k in state]
            state = [(0.1 * sum(lik), 0.0, 1.0)] + [(0.9 * w, (m * k + v) / (k + 1), k + 1) for w, (_, m, k) in zip(lik, state)]
            total = sum(p for p, _, _ in state)
            state = [(p / total, m, k) for p, m, k in state]
            want = sum(p * 0.5 * (1 + math.erf(-m * math.sqrt(k / 2))) for p, m, k in state[1:3])
            assert math.isclose(got[s, t], want, rel_tol=1e-9)
