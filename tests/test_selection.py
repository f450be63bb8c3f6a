import datetime as dt
import random

import numpy as np
import pytest

from tidebar.functions.quantiles import exact_quantiles
from tidebar.operators.joins import asof_prev

QS = [0.0, 0.05, 0.33, 0.5, 0.995, 1.0]


def values(kind, n=4000):
    rng = np.random.default_rng(5)
    return {"normal": rng.normal(size=n), "one value": np.full(n, 2.5), "heavy value": np.where(rng.random(n) < 0.97, 1.0, rng.normal(size=n)),
            "wide": 10.0 ** rng.uniform(-200, 200, n) * rng.choice([-1, 1], n), "two": rng.choice([0.0, 1e-300], n), "few": rng.normal(size=3)}[kind]


@pytest.mark.parametrize("kind", ["normal", "one value", "heavy value", "wide", "two", "few"])
def test_one_group_with_small_tasks(spark, kind):
    """A group far larger than a task is cut over several rounds and still gives the exact ranks."""
    x = values(kind)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("b", 7.0)], "g string, v double").repartition(3)
    got = {(r.g, r.q): r.threshold for r in exact_quantiles(df, ["g"], "v", QS, task=50).collect()}
    srt = np.sort(x)
    for q in QS:
        pos = (len(x) - 1) * q
        lo, hi = srt[int(np.floor(pos))], srt[int(np.ceil(pos))]
        assert got["a", q] == pytest.approx(lo + (hi - lo) * (pos - np.floor(pos)), rel=1e-12)
        assert got["b", q] == 7.0
    assert len(got) == 2 * len(QS)


def test_no_values_and_no_group(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, [], "v", [0.5]).count() == 0
    assert exact_quantiles(spark.range(5).selectExpr("cast(id as double) as v"), [], "v", [0.5], task=2).first().threshold == 2.0


def brute(left, series, keyed):
    out = {}
    for k, d in left:
        past = [(o, v) for kk, o, v in series if v is not None and o < d and (not keyed or kk == k)]
        out[k, d] = max((v for o, v in past if o == max(p[0] for p in past)), default=None) if past else None
    return out


@pytest.mark.parametrize("keyed", [False, True])
def test_asof_over_many_ranges(spark, keyed):
    """Ranges without an observation, and keys that end inside a range, take what is carried to them."""
    pick = random.Random(4)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    left = [(pick.choice("ab") if pick.random() < 0.9 else "c", day(pick.randrange(900))) for _ in range(400)] + [("a", day(0))]
    series = [(pick.choice("ab"), day(i), pick.choice([None, float(i), -1.0])) for i in [5, 5, 6, *pick.sample(range(900), 25)]]
    ldf = spark.createDataFrame(left, "k string, d date")
    sdf = spark.createDataFrame(series, "k string, o date, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof_prev(ldf, "d", sdf, "o", "v", "x", ("k",) if keyed else ()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute(left, series, keyed)
    assert len(got) == len(left) and {(r.k, r.d): r.x for r in got} == want


def test_asof_has_no_single_window(spark):
    left = spark.createDataFrame([(dt.date(2024, 1, 2),)], "d date")
    series = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "o date, v double")
    plan = asof_prev(left, "d", series, "o", "v", "x")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_near" in line]
    assert windows and all("[_p" in w for w in windows)  # rows are ordered inside their range only
    assert asof_prev(left, "d", series.filter("v > 5"), "o", "v", "x").first().x is None
