import itertools
import random

from pyspark.sql import functions as F

from tidebar.operators import rules as rl
from tidebar.plans import catalog

PREDS = [("ALL", "true"), ("x>3", "x > 3"), ("x>3 again", "x >= 4"), ("y", "y = 1"), ("late", "slot >= 70"), ("never", "x > 99"), ("null", "z > 0")]
BY = ["symbol", "signal_id"]


def events(n, seed):
    pick = random.Random(seed)
    seen = {(pick.choice("AB"), pick.randrange(2), f"2024-01-{pick.randrange(1, 9):02d}", pick.randrange(96), pick.choice([1, -1])) for _ in range(n)}
    return [(*k, pick.randrange(8), pick.randrange(2), None) for k in sorted(seen)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, signal_id int, session string, slot int, side int, x int, y int, z int")


def holds(p, r):
    return [True, r[5] > 3, r[5] >= 4, r[6] == 1, r[3] >= 70, False, False][p]


def brute(rows, lists):
    """{group: {(a, b): events}} of the pairs that differ from every predicate of the list and every earlier pair."""
    out = {}
    for g, ps in lists.items():
        mine = [r for r in rows if r[:2] == g]
        mask = lambda a, b: frozenset(r[:5] for r in mine if holds(a, r) and holds(b, r))
        seen = {mask(p, p) for p in ps}
        for a, b in itertools.combinations(ps, 2):
            if (m := mask(a, b)) and m not in seen:
                seen.add(m)
                out.setdefault(g, {})[a, b] = m
    return out


def test_pairs_against_brute_force(spark):
    rows = events(400, 1)
    lists = {("A", 0): [1, 3, 4, 2, 0], ("A", 1): [5, 3, 6], ("B", 0): [4, 3, 1], ("B", 1): [0, 3]}
    top = spark.createDataFrame([(*g, p, k) for g, ps in lists.items() for k, p in enumerate(ps)], "symbol string, signal_id int, predicate int, rank int")
    words = rl.predicate_bitmaps(frame(spark, rows), PREDS, BY)
    pairs = rl.pair_candidates(words, top, BY)
    want = brute(rows, lists)
    got = {}
    for r in rl.pair_events(words, pairs, BY).collect():
        got.setdefault((r.symbol, r.signal_id), {}).setdefault((r.a, r.b), set()).add((r.symbol, r.signal_id, r.session, r.slot, r.side))
    assert got == want and len(want) == 2  # single-predicate copies, empty and equal masks are gone
    assert {(r.symbol, r.signal_id, r.a, r.b): r.support for r in pairs.collect()} == {(*g, *ab): len(m) for g, x in want.items() for ab, m in x.items()}
    few = rl.pair_candidates(words, top, BY, min_support=40)
    assert few.count() == sum(len(m) >= 40 for x in want.values() for m in x.values())


def test_all_64_bits_and_empty_events(spark):
    rows = [("A", 0, "2024-01-01", s, 1, 5, 1, None) for s in range(130)]
    words = rl.predicate_bitmaps(frame(spark, rows), PREDS, BY)
    assert words.agg(F.sum(F.bit_count(F.get("masks", 0)))).first()[0] == 130 and words.count() == 3
    top = spark.createDataFrame([("A", 0, 4, 1), ("A", 0, 3, 2)], "symbol string, signal_id int, predicate int, rank int")
    assert rl.pair_candidates(words, top, BY).count() == 0  # the pair is the predicate "late" again
    assert rl.pair_candidates(rl.predicate_bitmaps(frame(spark, []), PREDS, BY), top, BY).count() == 0


def test_no_event_rows_before_pruning(spark):
    """Masks come from one hash aggregate; nothing is exploded below it."""
    plan = rl.predicate_bitmaps(frame(spark, events(5, 2)), PREDS, BY)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Generate" not in plan and "SortAggregate" not in plan


def test_discovery_scores_pairs(spark):
    rows = catalog.QUERIES["rule_discover_pairs"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) >= 20 and {r.level for r in rows} == {1, 2}
    assert all((" & " in r.config_id) == (r.level == 2) for r in rows)
