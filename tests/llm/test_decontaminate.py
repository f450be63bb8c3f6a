import pytest

import brute
from tidebar.llm import decontaminate

W = [f"w{i}" for i in range(200)]
ITEMS = [(1, " ".join(W[:30])), (2, "Short item, five words here"), (3, None), (4, ""), (5, " ".join(W[20:60])), (5, " ".join(W[100:113])), (None, " ".join(W[150:170])), (6, "one"), (7, "again " * 14)]
DOCS = [(1, " ".join(["z"] * 40 + W[3:20] + ["z"] * 9)), (2, "SHORT item five--words HERE and more"), (3, None), (4, ""), (5, " ".join(W[:12])), (6, " ".join(W)), (None, " ".join(W[18:40])),
        (8, "again " * 40), (8, "again " * 40), (9, "short item five words there"), (10, " ".join(W[155:168] + ["q"])), (11, "plain words only")]


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, [0]) for i, t in docs], "doc_id long, text string, spans array<int>")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contaminated(d, b, **how).select("*", decontaminate.hit_words().alias("n_hit")).collect()
    return sorted(((r.id or -1, r.n_words, r.n_hit, list(r["items"])) for r in out))


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_edge_rows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    want = brute.contaminated(DOCS, ITEMS)
    assert run(spark, DOCS, ITEMS) == sorted((i or -1, *want[i]) for i, _ in DOCS)


def test_partial_containment(spark):
    """With 0.5 an item window with a changed word still occurs; with 1.0 it does not."""
    words = W[:13]
    changed = words[:2] + ["other"] + words[3:]
    assert run(spark, [(1, " ".join(changed))], [(1, " ".join(words))], containment=0.5) == [(1, 13, 13, [1])]
    assert run(spark, [(1, " ".join(changed))], [(1, " ".join(words))]) == [(1, 13, 0, [])]


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    assert run(spark, [(1, "some words")], []) == [(1, 2, 0, [])]


def test_contaminated_rows_go(spark):
    docs = spark.createDataFrame([(1, " ".join(W[:13] + ["z"] * 240), 7), (1, " ".join(W[:13] + ["z"] * 260), 8), (None, " ".join(W[:13]), 9), (None, "fine", None)], "doc_id long, text string, bad_id int")
    items = spark.createDataFrame([(1, " ".join(W[:13]))], "item_id long, text string")
    assert sorted(r.bad_id or 0 for r in decontaminate.drop_contaminated(docs, items).collect()) == [0, 8]
