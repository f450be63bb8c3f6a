"""Words, lines and cases as the text operators take them.

Columns for plans that stay in the JVM, and byte helpers for Arrow batches. Both agree: only A-Z
is lower-cased, and white space is ``[\\x20\\x09-\\x0D]``.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\x0b\f\r"
#: What separates words of letters and digits, before lower-casing.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: The same words in bytes: all bytes over 0x7F belong to characters over U+007F.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; texts in pure ASCII take the fast path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and characters over U+007F; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def byte_column(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The texts of an Arrow batch as UTF-8 bytes, one at a time, null as none."""
    return (t.as_py() or b"" for t in batch.column(name).cast(pa.binary()))


def int_lists(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The lists of an Arrow batch as views of one array, null as an empty one."""
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return (flat[end - size:end] for size, end in zip(sizes.tolist(), ends.tolist()))


def list_column(lists: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of arrays."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def space_words(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between white space, in lists of about ``size`` bytes of text, so that a very long
    text never stands in memory as one list."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + size)
        end = cut.start() if cut else len(data)
        found = data[at:end].split()
        if found:
            yield found
        at = end + 1


def plain_words(data: bytes) -> list[bytes]:
    """As ``words``, from UTF-8 bytes."""
    return _WORD.findall(data.lower())
