import random

import pytest

import brute
from tidebar.llm import prefix_trie

SCHEMA = "path string, conv_id long, turn long, role string, text string, kind int"
WORDS = ["", "ja", "né", "a b", "yes\n", "x" * 40]


def frame(spark, rows):
    return spark.createDataFrame([("p", *r, None) for r in rows], SCHEMA).repartition(3)


def nodes(df):
    return sorted(tuple(r[c] for c in prefix_trie.NODE) for r in df.collect())


def made(seed, n, depth):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        size = pick.randrange(1, depth)
        turns = pick.sample(range(3 * depth), size)
        for k, t in enumerate(sorted(turns)):
            rows.append((c, None if k == 0 and c % 7 == 0 else t, pick.choice(["user", None, "u"]), pick.choice(WORDS) if pick.random() < 0.9 else None))
    return rows


@pytest.fixture
def small_tasks(monkeypatch):
    """Few turns in a task: many stretches, and edges peeled in several passes."""
    monkeypatch.setattr(prefix_trie, "TURNS", 20)
    monkeypatch.setattr(prefix_trie, "IDS", 3)


@pytest.mark.parametrize("seed, n, depth", [(1, 40, 4), (2, 120, 3), (3, 60, 9)])
def test_against_brute_force(spark, small_tasks, seed, n, depth):
    rows = made(seed, n, depth)
    assert nodes(prefix_trie.conversation_trie(frame(spark, rows), shared=True)) == sorted(brute.trie(brute.rebuilt(rows)))
    plain = prefix_trie.conversation_trie(frame(spark, rows))
    assert nodes(plain) == sorted(brute.trie(brute.rebuilt(rows, every=1)))


def test_one_conversation_held_by_many(spark, small_tasks):
    """Equal conversations fill several stretches; their list of ends is hashed in order over all of them."""
    rows = [(c, t, "user", f"turn {t}") for c in range(150) for t in range(3)] + [(1000 + c, 0, "user", "turn 0") for c in range(20)] + [(2000, 0, "bot", "turn 0")]
    assert nodes(prefix_trie.conversation_trie(frame(spark, rows))) == sorted(brute.trie(brute.rebuilt(rows, every=1)))


def test_one_deep_path(spark):
    rows = [(c, t, "user", "same" if t < 390 else f"{c} {t}") for c in (3, 4, 9) for t in range(400)]
    got = nodes(prefix_trie.conversation_trie(frame(spark, rows)))
    assert got == sorted(brute.trie(brute.rebuilt(rows, every=1)))


def test_edge_rows(spark):
    assert nodes(prefix_trie.conversation_trie(frame(spark, []), shared=True)) == []
    rows = [(None, 0, "user", "no conversation"), (1, 0, "user", "base is absent"), (-3, 5, None, None)]
    got = nodes(prefix_trie.conversation_trie(frame(spark, rows)))
    assert got == sorted(brute.trie(brute.rebuilt(rows, every=1)))
    assert [r[:4] for r in nodes(prefix_trie.conversation_trie(frame(spark, [(1, 0, "user", "x")]), shared=True))] == [(1, 0, None, 1)]  # turnless: the root's member


def test_repeated_rows_and_equal_turns(spark):
    """Repeated rows are turns; equal turn numbers have one order whatever the order of the rows."""
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "b", "y"), (2, 0, "b", "y"), (2, 0, "a", "x"), (2, 0, "a", "x")]
    got = nodes(prefix_trie.conversation_trie(frame(spark, rows)))
    assert [r[:4] for r in got] == [(1, 0, None, 2), (1, 1, 1, 2), (1, 2, 1, 2), (1, 3, 1, 2)]


def test_role_and_text_are_told_apart(spark):
    got = nodes(prefix_trie.conversation_trie(frame(spark, [(1, 0, "ab", "c"), (2, 0, "a", "bc")])))
    assert [r[:5] for r in got] == [(1, 0, None, 2, 2), (1, 1, 1, 1, 0), (2, 1, 1, 1, 0)]
