import random

import numpy as np
import pytest

import brute
from tidebar.llm import exact_dedup

SCHEMA = "text_sha256 string, doc_id long, text string, kept int, row string, suspect boolean"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([("s", d, t, None, "r", None) for d, t in rows], SCHEMA).repartition(parts)


def check(spark, rows):
    got = exact_dedup.mark_copies(frame(spark, rows)).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == sorted(brute.exact_copies(rows))


def test_edge_rows(spark):
    check(spark, [(3, "a  b"), (1, "a\tb"), (2, " a b"), (7, None), (5, ""), (9, " "), (8, "\r\n"), (4, "a b"), (6, "A b"), (10, "é\x0b\x0cü"), (11, "é ü"), (-4, "é\nü")])


def test_many_copies_and_long_texts(spark):
    pick = random.Random(3)
    rows = [(i, "copy of all" if i % 3 == 0 else f"text {pick.randrange(500)}  x" if i % 3 == 1 else f"own {i}") for i in range(3000)]
    check(spark, rows + [(5000, "z y" * 300_000), (5001, "z y" * 300_000), (5002, "z y" * 300_000 + "!")])


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(4, "same"), (4, "same"), (6, "same"), (None, "only nulls"), (None, "only nulls"), (None, "one id"), (8, "one id")]
    got = exact_dedup.mark_copies(frame(spark, rows)).collect()
    assert sorted((r.id, r.keep_id, r.group_size) for r in got if r.kept and r.id) == [(4, 4, 3), (8, 8, 2)]
    assert sum(r.kept for r in got) == 3 and len(got) == 7
    assert exact_dedup.mark_copies(frame(spark, [])).count() == 0


def test_columns_come_back_and_other_ids_are_refused(spark):
    out = exact_dedup.drop_copies(frame(spark, [(2, "x  y"), (1, "x y"), (3, None)]))
    assert out.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((r.doc_id, r.text, r.row) for r in out.collect()) == [(1, "x y", "r"), (3, None, "r")]
    with pytest.raises(TypeError):
        exact_dedup.mark_copies(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("n, span", [(0, 100), (1, 1), (1, 1 << 40), (7, 7), (1000, 1500), (4096, 1 << 50)])
def test_golomb_round_trip(n, span):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, span, n)) if n != span else np.arange(n)
    width, code = exact_dedup.pack_sorted(values + 5, 5, span)
    assert (exact_dedup.unpack_sorted(code, len(values), width, 5) == values + 5).all()
    if n > 100:
        assert len(code) * 8 <= len(values) * (np.log2(span / len(values)) + 2.7) + 16  # close to the entropy of the gaps


def test_owners_answer_only_for_shared_fingerprints(spark):
    """Two senders, two owners: what one alone holds twice is no other sender's business."""
    import pyarrow as pa
    send, answer, mark = exact_dedup._send(10, 1), exact_dedup._answer(10, 1), exact_dedup._mark(10, 1)
    rows = {0: [5, 5, 700, 900], 1: [700, 3, 1023, 1023]}
    tables = {s: pa.table({"sender": pa.array([s] * 4, pa.int64()), "fp": pa.array(f, pa.int64()), "pos": pa.array(range(4), pa.int64())}) for s, f in rows.items()}
    messages = pa.concat_tables([send(t) for t in tables.values()])
    bitmaps = pa.concat_tables([answer(messages.filter(pa.compute.equal(messages["owner"], o))) for o in (0, 1)])
    bits = {s: mark(t, bitmaps.filter(pa.compute.equal(bitmaps["sender"], s))).column("bits")[0].as_py()[0] for s, t in tables.items()}
    assert bits == {0: 0b0111, 1: 0b1101}


def test_no_shuffle_of_whole_rows(spark, sf):
    """Texts reach an exchange only behind the partial aggregate of suspects."""
    plan = exact_dedup.mark_copies(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 3 and "ShuffledHashJoin" in plan and "SortAggregate" not in plan
