import pytest
from pyspark.sql import functions as F

from tidebar.operators import detect as det
from tidebar.operators import settings as sg
from tidebar.plans import catalog, q_search, views

@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"


EXE = {"stop_atr": [0.1], "target_r": [2.0], "hold": [4]}
IMPULSE = {"lookback": [2, 3], "impulse_atr": [0.08], "volume_z": [None, 0.0]}


def test_table_has_every_combination_once(spark):
    rows = sg.settings_table(spark, q_search.BLOCKS).collect()
    want = {r["setting_id"]: (f, {k: v for k, v in r.items() if k not in ("setting_id", *sg.EXECUTION)}, *(r[k] for k in sg.EXECUTION)) for f, rs in q_search.setting_rows().items() for r in rs}
    assert {r.setting_id: (r.family, r.axes, r.stop_atr, r.target_r, r.hold) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("family, axes", [
    ("no_family", IMPULSE), ("impulse_continuation", {**IMPULSE, "colour": [1.0]}), ("impulse_continuation", {"lookback": [2], "impulse_atr": [0.1]}),
    ("impulse_continuation", {**IMPULSE, "lookback": [2.5]}), ("impulse_continuation", {**IMPULSE, "lookback": [0]}), ("impulse_continuation", {**IMPULSE, "lookback": [None]})])
def test_unknown_families_and_axes_are_refused(spark, sf, family, axes):
    s = sg.settings_table(spark, [(family, {**axes, **EXE})])
    with pytest.raises(ValueError):
        sg.events_of(views.feat(spark, sf, "monthly"), s, 26)


@pytest.mark.parametrize("block", [4096, 1])
def test_same_events_as_the_literal_grid(spark, sf, monkeypatch, block):
    """Signals of a table, in one block or many, raise what a grid of literals raises."""
    monkeypatch.setattr(sg, "BLOCK", block)
    f = views.feat(spark, sf, "monthly")
    s = sg.settings_table(spark, [("impulse_continuation", {**IMPULSE, **EXE})])
    keys = [F.element_at("axes", F.lit(a)).alias(a) for a in sg.AXES["impulse_continuation"]]
    got = sg.events_of(f, s, 26).join(s.select(sg.signal_key().alias("signal"), *keys), "signal")
    cols = ["symbol", "session", "slot", "side", *sg.AXES["impulse_continuation"]]
    want = det.detect_grid(f, "impulse_continuation", 26, IMPULSE)
    assert got.count() == want.count() > 0
    assert got.select(*[F.col(c).cast("string") for c in cols]).exceptAll(want.select(*[F.col(c).cast("double").cast("string") if c == "lookback" else F.col(c).cast("string") for c in cols])).count() == 0


def test_each_event_is_labelled_once(spark, sf):
    s = sg.settings_table(spark, q_search.BLOCKS)
    ev = sg.events_of(views.feat(spark, sf, "monthly"), s, 26)
    d = sg.dispatched(ev, s)
    assert d.count() == d.select("symbol", "session", "slot", "side", *sg.EXECUTION).distinct().count()
    assert d.select(F.sum(F.size("setting_ids"))).first()[0] == ev.join(s.select(sg.signal_key().alias("signal")), "signal").count()


def test_three_families_in_one_result(spark):
    got = catalog.QUERIES["search_evaluate_settings"](spark, "/root/testdata/sf0.01")
    assert {r.family for r in got.select("family").distinct().collect()} == {"rolling_breakout", "impulse_continuation", "vwap_stretch_reversal"}
