import brute
from tidebar.llm import line_dedup

ROWS = [(5, "A shared line here\nonly in five\n  a SHARED line here \t"), (2, "x\na shared line here\r\nx"), (None, "null ids come first\nshort"), (9, None), (8, ""), (7, "\n\n"),
        (1, "null IDS come first\nshort\nÉcole primaire\nécole primaire"), (3, "école primaire\nÉcole primaire\nshort"), (11, "tail line 123\n"), (12, "tail line 123")]
SCHEMA = "kept_text string, doc_id long, text string, drop int, n_lines string"


def frame(spark, rows):
    return spark.createDataFrame([("k", d, t, None, "n") for d, t in rows], SCHEMA)


def test_edge_rows(spark):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(frame(spark, ROWS)).collect()}
    assert got == brute.line_dedup(ROWS)


def test_repeated_rows_are_one_document(spark):
    out = line_dedup.dedup_lines(frame(spark, [(4, "the same long line\nmore of it"), (4, "the same long line\nmore of it"), (6, "the same long line")]))
    assert sorted((r.doc_id, r.kept_text) for r in out.collect()) == [(4, "the same long line\nmore of it")] * 2 + [(6, "")]


def test_threshold_of_three_documents(spark):
    rows = [(i, "twice seen line" if i < 2 else "thrice seen line") for i in range(5)]
    out = line_dedup.dedup_lines(frame(spark, rows), min_docs=3)
    assert {r.doc_id: r.kept_text for r in out.collect()} == {0: "twice seen line", 1: "twice seen line", 2: "thrice seen line", 3: "", 4: ""}


def test_long_text_and_empty_table(spark):
    long_text = "\n".join(f"line number {i % 5000}" for i in range(60_000))
    rows = [(1, long_text), (2, long_text)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: (60_000, 0, long_text), 2: (60_000, 60_000, "")}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
