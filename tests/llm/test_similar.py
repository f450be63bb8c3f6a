import itertools
import random

import numpy as np

import corpus_pipeline
import pytest
from tidebar.llm import components, similar

SCHEMA = "doc_id long, text string, n_chars long"


def brute_kept(rows):
    """Smallest id of each component of texts with a five-word Jaccard similarity of 0.8 or more."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d for d in root if find(d) == d}


def corpus(seed):
    """Copies at shingle similarities about and above 0.8, chains, a passage in many texts, short and blank texts."""
    rng, out = random.Random(seed), []
    word = lambda: f"w{rng.randrange(100_000)}"
    passage = [word() for _ in range(40)]
    for k in range(12):
        base = [word() for _ in range(240)]
        out.append(base)
        for edits in (2, 4, 5, 6, 7):
            copy = list(base)
            for at in rng.sample(range(5, 230), edits):
                copy[at] = word()
            out.append(copy)
            base = copy if k % 3 == 0 else base
    out += [passage + [word() for _ in range(160)] for _ in range(20)]
    out += [["one", "two"], ["one", "two"], ["one", "two", "three"], [], []]
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("common", [3, 1000])
def test_near_duplicate_stage_equals_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(similar, "COMMON", common)
    rows = corpus(7)
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], SCHEMA)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_kept(rows)


def test_planted_copies_are_dropped(spark):
    """Copies of 244 words with 1 to 5 words replaced far apart: similarities of 0.96 down to 0.81."""
    rng, rows = random.Random(3), []
    for k in range(30):
        base = [f"w{rng.randrange(100_000)}" for _ in range(244)]
        rows.append((10 * k, " ".join(base)))
        for edits in range(1, 6):
            copy = list(base)
            for at in range(edits):
                copy[20 + 40 * at] = f"x{k}y{edits}z{at}"
            rows.append((10 * k + edits, " ".join(copy)))
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {10 * k for k in range(30)}


def test_long_text_in_pieces():
    words = [f"w{i % 977}x{i % 89}" for i in range(200_000)]
    want = {" ".join(words[i:i + 5]) for i in range(len(words) - 4)}
    got = similar.shingle_set(" ".join(words).encode(), 5, 42)
    assert len(got) == len(want) and np.all(np.diff(got) > 0)


@pytest.mark.parametrize("block, radius", [(3, 0), (7, 3)])
def test_split_buckets_lose_no_link(spark, monkeypatch, block, radius):
    """Buckets in pairs of small blocks, and groups that fingerprints hardly join."""
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "RADIUS", radius)
    rows = corpus(11)
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == brute_kept(rows)


def test_large_group_of_near_copies(spark):
    """5,000 texts with two words of their own each, all similar to the first: one stays, beside the clean ones."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(100_000)}" for _ in range(150)]
    rows = [(k, " ".join(base[:40] + [f"a{k}"] + base[41:110] + [f"b{k}"] + base[111:])) for k in range(5000)]
    rows += [(5000 + k, " ".join(f"w{rng.randrange(100_000)}" for _ in range(150))) for k in range(50)]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, *range(5000, 5050)}


@pytest.mark.parametrize("common", [None, 10**9])
def test_shared_passage_makes_few_pairs(spark, monkeypatch, common):
    """600 texts of 60 words of their own and a passage of 40 words: no bucket pairs them all, whether summaries list the passage or its buckets do."""
    if common:
        monkeypatch.setattr(similar, "COMMON", common)
    made, candidates = [], similar._candidates

    def counted(*args):
        pairs = candidates(*args)
        made.append(pairs.count())
        return pairs
    monkeypatch.setattr(similar, "_candidates", counted)
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(40)]
    rows = [(k, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])) for k in range(600)]
    rows += [(600 + k, t.replace(" ", " x ", 1)) for k, (_, t) in enumerate(rows[:50])]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(range(600))
    assert len(made) == 2 and sum(made) < 20 * len(rows)


def test_summary_keeps_the_frequent():
    """Counts fall by what has to go, so that a shingle of more than a counter's share stays."""
    rng = np.random.default_rng(1)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(20):
        new = np.concatenate((rng.integers(100, 1 << 40, 500), np.repeat(np.arange(3), 40)))
        keys, counts = similar._summed(np.concatenate((keys, new)), np.concatenate((counts, np.ones(len(new), np.int64))), 50)
    assert len(keys) <= 50 and {0, 1, 2} <= set(keys.tolist()) and counts.max() <= 800


def shuffled(spark):
    """Bytes that the session's stages have written for shuffles so far."""
    sc = spark.sparkContext
    listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (listed.apply(i) for i in range(listed.size()))}


def test_rows_stay_where_they_stand(spark, tmp_path):
    """Texts without candidates, and the columns beside them, are in no shuffle: their prefixes are all that moves."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    rng = random.Random(9)
    rows = [(k, " ".join(f"w{rng.randrange(10**9)}" for _ in range(1000)), 0) for k in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    before = shuffled(spark)
    try:
        assert corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "").count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    after = shuffled(spark)
    assert sum(v for k, v in after.items() if k not in before) < 0.7 * sum(len(t) for _, t, _ in rows)


@pytest.mark.parametrize("small", [0, 40, 1 << 16])
def test_components_of_graphs_of_any_size(spark, small, monkeypatch):
    """Rounds alone, rounds and one task for what they leave, one task alone: the same roots, and few jobs in the last."""
    rng = np.random.default_rng(3)
    pairs = [(i, i + 1) for i in range(0, 90) if i % 30] + [(int(a), int(b)) for a, b in rng.integers(-200, -100, (70, 2))] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3), (1, 2), (2, 1)]
    written = []
    one = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label, *by: written.append(label) or one(df, label, *by))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint"), small).collect()}
    root = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in root:
        for a, b in pairs:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert ("roots" in written) == (small < len(pairs)) and (small < len(pairs) or len(written) == 2)
    assert not components.components(spark.createDataFrame([], "a bigint, b bigint"), small).collect()
