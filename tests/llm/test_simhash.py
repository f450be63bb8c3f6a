import itertools
import re

import pytest
import xxhash

from tidebar.llm import simhash
from tidebar.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, fp string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: {id: fingerprint}."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in fps}


def test_every_pair_within_the_radius_meets():
    masks = simhash.covering_masks(3, list(range(64)))
    assert len(masks) == 15
    for k in (1, 2, 3):
        for bits in itertools.combinations(range(64), k):
            x = sum(1 << b for b in bits)
            assert any(not x & m for m in masks)


@pytest.mark.parametrize("bucket", [4, 1024])
def test_dense_fingerprints_keep_every_component(spark, monkeypatch, bucket):
    """Chains and dense balls of fingerprints, with buckets small enough that they are split again."""
    import random
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            x ^= sum(1 << rng.randrange(64) for _ in range(rng.choice((1, 2, 3, 4))))
            fps.add(x)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << i) for i in range(60)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.covering_links(spark.createDataFrame(signed, "fp long"), 3)
    got = {}
    for r in simhash.components(links).collect():
        got.setdefault(r.root, set()).add(r.node)
    want = {}
    for i, c in brute_components(dict(enumerate(fps))).items():
        want.setdefault(c, set()).add(signed[i][0])
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_edge_rows(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "Same words here", "x"), (4, "Same words here", "x"), (9, "same  WORDS\nhere", None),
            (None, "same words here", "x"), (7, long_text, "x"), (8, long_text.replace(" ", "\n"), "x"), (10, "one", "x"), (11, "zwei Wörter É", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect())
    comp = {1: 1, 2: 1, 3: 1, 4: 4, 9: 4, None: 4, 7: 7, 8: 7, 10: 10, 11: 11}
    assert got == sorted((-1 if i is None else i, brute_fingerprint(t), comp[i]) for i, t, _ in rows)


def test_empty_table(spark):
    out = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_query_equals_brute_force(spark, sf):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    comp = brute_components(fps)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op9_simhash"](spark, sf).collect()}
    assert got == {i: (f, comp[i]) for i, f in fps.items()}
