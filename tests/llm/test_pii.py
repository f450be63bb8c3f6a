import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from tidebar.llm import pii
from tidebar.llm.queries import QUERIES

TEXT = st.lists(st.sampled_from(["a", "B", ".", "@", "-", "+", " ", "(", ")", "1", "23", "4111111111111111", "192.168", "255", "256", ".com", "x@y.z", "é", "\n", "+1 (555) 010-9999", "%"])).map("".join)


@given(TEXT)
@settings(max_examples=1500, deadline=None)
def test_base_spans_equal_the_patterns(text):
    got = [(pii.KINDS[k], a, b) for k, a, b in sorted(pii.base_spans(text)[0], key=lambda s: (s[1], s[0]))]
    assert got == brute.pii_base(text)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_base_stays_and_spans_are_ordered(text):
    found = pii.candidates(text)
    assert [(pii.KINDS[k], a, b) for k, a, b, base in found if base] == brute.pii_base(text)
    assert [(a, k) for k, a, _, _ in found] == sorted((a, k) for k, a, _, _ in found)
    for k, a, b, _ in found:
        kind, vote, _ = pii._open_code(pii.code(text, k, a, b))
        assert kind == k and tuple(vote) == pii.votes(text, k, a, b)


def test_reliabilities_are_found():
    """Votes made from known reliabilities: the good labelers come out good, and the classes apart."""
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.6, 0.9, 0.8, 0.5])
    table = np.where(rng.random((4000, 7)) < right, truth[:, None], ~truth[:, None]).astype(int)
    table[rng.random((4000, 7)) < 0.2] = -1
    q, found = pii.estimate(np.zeros(4000, int), table, np.ones(4000))
    assert ((q > 0.5) == truth).mean() > 0.95
    assert np.abs(found["hit"] - right).max() < 0.08


def test_edge_rows(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, None), (2, ""), (3, "no data at all"), (4, f'token = "{key}" and a@b.com'), (4, f'token = "{key}" and a@b.com'), (None, "call +1 (555) 010-9999"), (5, "1" * 50_000), (6, "a@" * 20_000), (7, "é 10.0.0.1 ü")]
    docs = spark.createDataFrame([(d, t, "x", [1]) for d, t in rows], "doc_id long, text string, found string, spans array<int>")
    got = sorted((r.id or -1, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in pii.find_pii(docs).collect())
    assert got == sorted((d or -1, brute.pii_base(t) if d != 6 else []) for d, t in rows)
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_query(spark, sf):
    sf = sf.replace("0.001", "0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    secrets = 0
    for r in QUERIES["op8_pii"](spark, sf).collect():
        base = brute.pii_base(texts[r.doc_id])
        named = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in brute.PII]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(named) <= set(spans)
        marked = sum(s.startswith("secret") for s in spans)
        assert marked == texts[r.doc_id].lower().count('token = "')
        secrets += marked
    assert secrets
