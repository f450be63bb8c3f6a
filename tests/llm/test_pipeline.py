import public_tokenizers
import sentencepiece

import brute
import corpus_pipeline
from tidebar.llm import quality_rules
from tidebar.llm.text import table
from test_similar import brute_kept

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def expected(rows, items, kept):
    """rows: [(doc_id, text)] in, {doc_id: text} out of the stages before the last."""
    rows = [(d, t) for d, t in rows if kept(d)]
    deduped = {d: x[2] for d, x in brute.line_dedup(rows).items()}
    first = brute_kept(list(deduped.items()))
    single = [(d, t) for d, t in deduped.items() if d in first]
    bad = brute.contaminated(single, items)
    return {d: t for d, t in single if not (bad[d][1] > 0 and 20 * bad[d][1] >= bad[d][0])}


def test_run_equals_brute_force(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_rules.fit_quality(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def kept(doc, texts=dict(rows)):
        n = brute.rule_counts(texts[doc])
        return n[0] >= 50 and 100 * n[4] <= 50 * n[0] and model.probability(texts[doc].encode()) >= quality_rules.MIN_GOOD

    want = expected(rows, [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()], kept)
    got = {r.doc_id: (r.ids, r.decoded, r.n_ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {d: (ids := LIBRARY.encode(t), t, len(ids)) for d, t in want.items()}
    assert 20 < len(got) < len(rows)


def test_stages_take_odd_rows(spark, sf):
    """Nulls in every column, repeated rows, clashing extra columns; and no rows at all."""
    text = table(spark, sf, "documents").filter("n_chars > 1500").first().text
    cols = "doc_id long, text string, lang string, source string, n_chars long, kept string, text_key int, id string, row int, ids string"
    extra = ("k", 1, "i", 2, "x")
    rows = [(900, text, "en", None, 5, *extra), (900, text, "en", None, 5, *extra), (901, text, None, "s", None, *extra), (None, None, None, None, None, None, None, None, None, None),
            (None, text + " some more words", "en", "s", 1, *extra), (902, "", "en", "s", 0, *extra), (None, "a text of its own " * 30, "en", "s", 1, *extra), (903, text[::-1], "en", "s", 1, *extra)]
    docs = spark.createDataFrame(rows, cols)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf)
            assert out.columns == docs.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, sf).count() == frame.count()
    near = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sum(r.doc_id == 900 for r in near) == 1 and not any(r.doc_id == 901 for r in near)
    assert any(r.text and r.text.startswith("a text of its own") for r in near)
    lined = {(r.doc_id, r.n_chars, len(r.text)) for r in corpus_pipeline.lines(spark, docs, sf).collect()}
    assert all(n == m for _, n, m in lined)
