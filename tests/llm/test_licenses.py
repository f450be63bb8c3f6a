import brute
from tidebar.llm import licenses

NOTICE = licenses.NOTICES[1][1]
ROWS = [(1, "Licensed under the Apache License, Version 2.0."), (2, None), (3, ""), (4, "cc by cc by"), (5, "MIT\n\nlicense, mit license"), (5, "MIT\n\nlicense, mit license"), (None, "the GNU general public license"),
        (6, " ".join(["pad"] * 62 + ["gnu", "general", "public", "license"] + ["pad"] * 40)), (7, " ".join(NOTICE.split()[:19])), (8, " ".join(NOTICE.split()[:12])),
        (9, " ".join(["q"] * 50_000 + NOTICE.split() + ["q"] * 50_000)), (10, "gnu general\x85public license"), (11, "mıt license MİT license"), (12, "license apache")]


def expected(text):
    w = brute.plain_words(text)
    places = sorted(i for p in licenses.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
    base = {label for p, label in licenses.PHRASES.items() if any(w[i:i + len(p.split())] == p.split() for i in range(len(w)))}
    labels, score = set(base), 1.0 if base else 0.0
    for t in licenses.templates():
        for b in range(0, len(w), licenses.STRIDE):
            common = len(set(w[b:b + licenses.BLOCK]) & set(t.words))
            if not t.phrase and common >= t.need:
                labels.add(t.label)
                score = max(score, common / len(set(t.words)))
    return len(w), places, sorted(base), sorted(labels), score


def test_edge_rows(spark):
    docs = spark.createDataFrame([(d, t, "l", 1) for d, t in ROWS], "doc_id long, text string, labels string, w int")
    got = sorted((r.doc_id or -1, r.n_words, r.places, r.base_labels, r.labels, r.score) for r in licenses.find_licenses(docs).collect())
    assert got == sorted((d or -1, *expected(t)) for d, t in ROWS)
    assert licenses.find_licenses(docs.limit(0)).count() == 0


def test_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = licenses.find_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_notices_need_every_word(spark):
    """A plain CC BY 4.0 line has all words of the NC notice but one."""
    rows = [(1, "Licensed under CC BY 4.0."), (2, "Licensed under CC BY-NC 4.0."), (3, "4 0 by under licensed " + "pad " * 20 + "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base_labels, r.labels) for r in licenses.find_licenses(docs).collect()}
    assert got == {1: (["cc-by"], ["cc-by"]), 2: (["cc-by"], ["cc-by", "cc-by-nc"]), 3: ([], [])}


def test_no_label_without_its_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = licenses.find_licenses(docs).filter("array_contains(labels, 'cc-by-nc')").join(docs, "doc_id")
    assert all("nc" in brute.plain_words(r.text) for r in found.collect())
