"""A corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, SentencePiece ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns rows with its columns; the last
returns ids and the text decoded from them. Between stages rows are written to the shared folder, so a
lost executor costs no earlier stage. Null texts count as empty; an empty table passes through every stage.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import decontaminate, line_dedup, pieces, quality_rules, similar
from tidebar.llm.text import table
from tidebar.sources.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; the classifier learns from the labelled rows of ``docs``."""
    return quality_rules.keep_good(docs, quality_rules.fit_quality(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that a smaller doc_id holds too; ``n_chars`` follows the text."""
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return line_dedup.dedup_lines(docs).select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of texts linked by a similarity of five-word shingles of 0.8 or more."""
    return similar.drop_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by ``benchmark``."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_ids, ids, decoded)``."""
    coded = pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids", "decoded")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", benchmark), ("sentencepiece", sentencepiece)]
#: A fitted classifier and a tokenizer have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
