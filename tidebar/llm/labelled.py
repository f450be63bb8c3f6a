"""Bounded samples of labelled rows, on which the classifiers are fitted."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20_011


def label_counts(labels: DataFrame, target: str) -> dict[int, int]:
    """How many rows carry label 0 and 1: a count over all of them."""
    got = labels.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("label IN (0, 1)").collect()
    return {0: 0, 1: 0} | {int(r.label): r.n for r in got}


def sample_labels(labels: DataFrame, target: str, rows: dict[int, int], id_col: str = "doc_id") -> DataFrame:
    """``(id, label)``: of each label at most ``rows[label]`` rows, the first in the order of a hash of their ids.

    Rows without an id or with another label are left out; an id with both labels counts as 1."""
    one = labels.select(F.col(id_col).alias("id"), F.col(target).cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    one = one.groupBy("id").agg(F.max("label").alias("label"))
    parts = [one.filter(F.col("label") == k).orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(n) for k, n in rows.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def with_texts(sample: DataFrame, docs: DataFrame, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(label, text)`` of a sample of at most ``bound`` rows; only this bounded side is broadcast."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(sample.limit(bound)), "id").select("label", "text")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids are in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
