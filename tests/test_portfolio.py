import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import portfolio as pf
from tidebar.plans import catalog


def plain(bars):
    """Net, drawdown and largest exposure of bars (delta, adverse, exposure) in order."""
    equity = peak = fall = 0.0
    for d, a, _ in bars:
        fall = min(fall, equity + a - peak)
        equity += d
        peak = max(peak, equity)
        fall = min(fall, equity - peak)
    return sum(d for d, _, _ in bars), fall, max((e for _, _, e in bars), default=0.0)


def made(legs, days, slots, seed=1):
    pick = random.Random(seed)
    return [(leg, dt.date(2024, 1, 1) + dt.timedelta(d), s, pick.uniform(-3, 3), pick.uniform(-4, 0), float(pick.randrange(3)))
            for leg in legs for d in range(days) for s in range(slots) if pick.random() < 0.6]


def frame(spark, rows):
    return spark.createDataFrame(rows, "leg string, chunk date, pos int, delta double, adverse double, exposure double")


@pytest.mark.parametrize("seed", range(4))
def test_summaries_compose_wherever_a_path_is_cut(spark, seed):
    pick = random.Random(seed)
    bars = [(pick.uniform(-2, 2), pick.uniform(-3, 0), float(pick.randrange(4))) for _ in range(40)]
    cuts = [0, *sorted(pick.sample(range(1, 40), 6)), 40]
    parts = [[float(x[0]) for x in pf.summaries(*(np.array([[b[k] for b in bars[i:j]]]) for k in range(3)))] for i, j in zip(cuts, cuts[1:])]
    rows = spark.createDataFrame([("p", k, *x) for k, x in enumerate(parts)], "g string, chunk int, " + ", ".join(f"{c} double" for c in pf.SUMMARY))
    got = pf.composed(rows.repartition(3), ["g"]).first()
    assert np.allclose([got.net, got.max_drawdown, got.max_exposure], plain(bars)) and np.isclose(got.worst, min(0, min(x[0] for x in parts)))


def test_known_drawdowns(spark):
    one = lambda d, a: [float(x[0]) for x in pf.summaries(np.array([d]), np.array([a]), np.array([[0.0] * len(d)]))]
    assert one([100.0, -50.0, -100.0, 80.0], [100.0, -50.0, -100.0, 80.0])[3] == -150
    assert one([0.0, 50.0], [-100.0, 50.0])[3] == -100
    assert one([], [])[:4] == [0, 0, 0, 0]


@pytest.mark.parametrize("block, blocks", [(64, 256), (2, 3)])
def test_portfolios_against_plain_paths(spark, monkeypatch, block, blocks):
    """Many small blocks and copied stretches give the same as one block."""
    monkeypatch.setattr(pf, "BLOCK", block)
    monkeypatch.setattr(pf, "BLOCKS", blocks)
    paths = made("abcd", 9, 6)
    pick = random.Random(7)
    members = {f"p{i}": {leg: pick.choice([1.0, 2.0, 0.5]) for leg in pick.sample("abcde", pick.randrange(1, 5))} for i in range(25)}
    m = spark.createDataFrame([(p, leg, w) for p, x in members.items() for leg, w in x.items()], "portfolio_id string, leg string, weight double")
    got = {r.portfolio_id: r for r in pf.composed(pf.portfolio_summaries(m, frame(spark, paths)), ["portfolio_id"]).collect()}
    assert got.keys() == members.keys()
    for p, weights in members.items():
        bars = {}
        for leg, day, slot, *v in paths:
            if leg in weights:
                bars[day, slot] = [a + weights[leg] * b for a, b in zip(bars.get((day, slot), (0, 0, 0)), v)]
        assert np.allclose([got[p].net, got[p].max_drawdown, got[p].max_exposure], plain([bars[k] for k in sorted(bars)]))


def test_empty_members_and_paths(spark):
    m = spark.createDataFrame([], "portfolio_id string, leg string, weight double")
    assert pf.portfolio_summaries(m, frame(spark, made("a", 2, 2))).count() == 0
    one = spark.createDataFrame([("p", "a", 1.0)], "portfolio_id string, leg string, weight double")
    assert pf.portfolio_summaries(one, frame(spark, [])).count() == 0


def test_no_join_on_sleeves_with_every_row(spark):
    """Paths and portfolios meet by stretch of time in one exchange, without a join."""
    m = spark.createDataFrame([("p", "a", 1.0)], "portfolio_id string, leg string, weight double")
    plan = pf.portfolio_summaries(m, frame(spark, made("a", 2, 2)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_seeds_are_all_singles_and_pairs(spark):
    scores = spark.createDataFrame([("a", 1, 3.0, 1.0, 1.0, 1.0), ("a", 2, 2.0, 1.0, 1.0, 1.0), ("a", 3, 1.0, 1.0, 1.0, 1.0), ("b", 1, 1.0, -1.0, 1.0, 1.0), ("c", 2, 1.0, 1.0, 1.0, 1.0)],
                                   "sleeve string, option_id int, score double, net double, net_train double, net_validate double")
    ids = lambda df: sorted({r.portfolio_id for r in df.collect()})
    assert ids(pf.seed_portfolios(scores, 2)) == sorted(["a:1", "a:2", "b:1", "c:2", "a:1|b:1", "a:2|b:1", "a:1|c:2", "a:2|c:2", "b:1|c:2"])
    assert ids(pf.seed_portfolios(scores, 1, positive=True)) == ["a:1", "a:1|c:2", "c:2"]


def test_sized_legs(spark):
    """Distance 1 and 250 dollars: large contracts; a budget that buys nothing leaves the trade out."""
    rows = [("s", "X", dt.date(2024, 1, 2), 1, 2, 1, 5.0, -1.0, 1.0, 100.0), ("s", "X", dt.date(2024, 1, 3), 1, 2, 1, 5.0, -1.0, 4000.0, 100.0)]
    t = spark.createDataFrame(rows, "sleeve string, symbol string, session date, entry_slot int, exit_slot int, side int, pnl_pts double, worst_pts double, stop_pts double, entry_px double")
    got = {(r.leg, r.session.day): (r.instrument, r.qty, r.pnl) for r in pf.sized_trades(t, [250.0]).collect()}
    assert got["small", 2] == ("small", 1, 9.0) and got["large", 2] == ("large", 1, 96.5) and got["risk 250", 2][0] == "large" and ("risk 250", 3) not in got


@pytest.mark.parametrize("name, least", [("portfolio_sizing_plan", 100), ("portfolio_exact_all", 60)])
def test_whole_study(spark, name, least):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() >= least
