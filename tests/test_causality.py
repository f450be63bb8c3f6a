import datetime as dt


from tidebar.operators import search as se
from tidebar.plans import catalog, q_causality


def test_only_the_planted_detector_looks_ahead(spark):
    got = {r.detector: r.violations for r in catalog.QUERIES["audit_causality_events"](spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == q_causality.detectors().keys()
    assert got.pop(q_causality.PLANTED) > 0 and set(got.values()) == {0}


def test_copies_differ_only_behind_their_cut(spark):
    day = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    rows = [("X", d, s, 10.0, 12.0, 8.0, 11.0, 5.0) for d in day for s in range(4)]
    b = spark.createDataFrame(rows, "symbol string, session date, slot int, open double, high double, low double, close double, volume double")
    got = se.perturbed_copies(b, [(day[1], 1), (day[0], 3)]).collect()
    assert len(got) == 24 and {r.symbol for r in got} == {"X#0", "X#1"}
    for r in got:
        cut = (day[1], 1) if r.symbol == "X#0" else (day[0], 3)
        want = (90.0, 92.0, 88.0, 89.0, 11.0) if (r.session, r.slot) > cut else (10.0, 12.0, 8.0, 11.0, 5.0)
        assert (r.open, r.high, r.low, r.close, r.volume) == want and r.low <= min(r.open, r.close) <= max(r.open, r.close) <= r.high


def test_differences_are_counted_both_ways_and_only_before_the_cut(spark):
    d = dt.date(2024, 1, 1)
    kind = "detector string, symbol string, session date, slot int, side int"
    base = spark.createDataFrame([("a", "X", d, 1, 1), ("a", "X", d, 2, 1), ("b", "X", d, 9, 1)], kind)
    changed = spark.createDataFrame([("a", "X#0", d, 1, 1), ("a", "X#0", d, 3, -1), ("c", "X#0", d, 9, 1)], kind)
    got = {r.detector: r.violations for r in se.event_violations(base, changed, [(d, 5)]).collect()}
    assert got == {"a": 2}
    assert se.event_violations(base.filter("false"), changed.filter("false"), [(d, 5)]).count() == 0


def test_every_rule_family_is_covered():
    from tidebar.operators import detect
    assert detect.RULES.keys() <= q_causality.detectors().keys()
