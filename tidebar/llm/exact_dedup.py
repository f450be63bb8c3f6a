"""Exact copies of whole texts by an exchange of Golomb-coded fingerprints.

Partitions are senders. Each hashes its texts, sends the sorted distinct fingerprints of every owner's range as a
Golomb code, and gets back one bit for each of them: whether another sender has it too. Rows with a set bit are
suspects. Only their texts are shuffled, and compared byte by byte; all other rows stay where they are.
"""
from __future__ import annotations

import math
import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.sources.scratch import materialize, scratch_path

#: A text without a copy becomes a suspect in about one of 2**SPARE_BITS cases.
SPARE_BITS = 10
#: Fingerprints that one owner compares at a time.
OWNED = 1 << 20
#: Rows of a sender count in the lower bits of its row numbers.
_ROW_BITS = 33


def rice_width(span: int, n: int) -> int:
    """Bits of the remainder: the power of two next below the best divisor, ln 2 times the mean gap."""
    return max(0, math.floor(math.log2(max(1.0, math.log(2) * span / max(1, n)))))


def golomb_encode(gaps: np.ndarray, width: int) -> bytes:
    """Golomb code with divisor ``2**width``: all quotients in unary, then all remainders in binary."""
    quotient, rest = gaps >> width, gaps & ((1 << width) - 1)
    ends = np.cumsum(quotient + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 0
    binary = (rest[:, None] >> np.arange(width) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(binary).tobytes()


def golomb_decode(code: bytes, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    at = -(-(int(ends[-1]) + 1) // 8) * 8 if n else 0
    binary = bits[at:at + n * width].reshape(n, width).astype(np.int64)
    return (quotient << width) + (binary << np.arange(width)).sum(1)


def pack_sorted(values: np.ndarray, start: int, span: int) -> tuple[int, bytes]:
    """``(width, code)`` of ascending distinct values of ``[start, start + span)``."""
    width = rice_width(span, len(values))
    return width, golomb_encode(np.diff(values, prepend=start - 1) - 1, width)


def unpack_sorted(code: bytes, n: int, width: int, start: int) -> np.ndarray:
    return np.cumsum(golomb_decode(code, n, width) + 1) + start - 1


def _send(bits: int, owner_bits: int):
    """Messages of one sender: ``(sender, owner, n, width, code)``."""
    span = 1 << (bits - owner_bits)

    def run(rows: pa.Table) -> pa.Table:
        values = np.unique(rows.column("fp").to_numpy())
        owners, at = np.unique(values >> (bits - owner_bits), return_index=True)
        parts = np.split(values, at[1:])
        coded = [pack_sorted(p, int(o) * span, span) for o, p in zip(owners.tolist(), parts)]
        sender = rows.column("sender")[0].as_py()
        return pa.table({"sender": pa.array([sender] * len(parts), pa.int64()), "owner": pa.array(owners, pa.int64()), "n": pa.array([len(p) for p in parts], pa.int64()),
                         "width": pa.array([w for w, _ in coded], pa.int32()), "code": pa.array([c for _, c in coded], pa.binary())})
    return run


def _answer(bits: int, owner_bits: int):
    """Bitmaps of one owner: for each message, which of its fingerprints came from another sender too."""
    span = 1 << (bits - owner_bits)

    def run(messages: pa.Table) -> pa.Table:
        owner = messages.column("owner")[0].as_py()
        got = [unpack_sorted(c, n, w, owner * span) for n, w, c in zip(*(messages.column(k).to_pylist() for k in ("n", "width", "code")))]
        values, seen = np.unique(np.concatenate(got), return_counts=True)
        shared = [np.isin(g, values[seen > 1]) for g in got]
        keep = [k for k, s in enumerate(shared) if s.any()]
        sender = messages.column("sender").to_pylist()
        return pa.table({"sender": pa.array([sender[k] for k in keep], pa.int64()), "owner": pa.array([owner] * len(keep), pa.int64()),
                         "bitmap": pa.array([np.packbits(shared[k]).tobytes() for k in keep], pa.binary())})
    return run


def _mark(bits: int, owner_bits: int):
    """One bit per row of a sender: its fingerprint stands in another row too, here or elsewhere."""
    def run(rows: pa.Table, bitmaps: pa.Table) -> pa.Table:
        values, at, here = np.unique(rows.column("fp").to_numpy(), return_inverse=True, return_counts=True)
        suspect = here > 1
        for owner, bitmap in zip(bitmaps.column("owner").to_pylist(), bitmaps.column("bitmap").to_pylist()):
            a, b = np.searchsorted(values, [owner << (bits - owner_bits), owner + 1 << (bits - owner_bits)])
            suspect[a:b] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: b - a].astype(bool)
        pos = rows.column("pos").to_numpy()
        flags = np.zeros(-(-(int(pos.max()) + 1) // 64) * 64, np.uint8)
        flags[pos] = suspect[at]
        words = np.packbits(flags, bitorder="little").view("<i8")
        return pa.table({"sender": rows.column("sender")[:1], "bits": pa.array([words], pa.list_(pa.int64()))})
    return run


def normal_text(text):
    """White space ``[\\x20\\x09-\\x0D]+`` as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _held(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """The rows with their fingerprints, written once, in buckets of senders: later joins by sender move no row."""
    spark = docs.sparkSession
    number = F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("row"), number.alias("number"))
    rows = rows.select("id", "text", "row", "number", F.shiftright("number", _ROW_BITS).alias("sender"), normal_text(F.col("text")).alias("normal"))
    rows = rows.select("id", "text", "row", "number", "sender", F.xxhash64("normal").alias("hash"), F.sha2("normal", 256).alias("text_sha256"))
    name = f"tidebar_held_{uuid.uuid4().hex}"
    buckets = min(100_000, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows.write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, "held")).bucketBy(buckets, "sender").saveAsTable(name)
    return spark.table(name)


def _marks(held: DataFrame) -> DataFrame:
    """``(sender, bits array<bigint>)``: the suspects among the rows of every sender, by position."""
    n = held.count()
    bits = min(62, max(1, n).bit_length() + SPARE_BITS)
    owner_bits = min(bits, max(0, (max(1, n) - 1) // OWNED).bit_length())
    rows = held.select("sender", F.shiftrightunsigned("hash", 64 - bits).alias("fp"), F.col("number").bitwiseAND((1 << _ROW_BITS) - 1).alias("pos"))
    messages = rows.groupBy("sender").applyInArrow(_send(bits, owner_bits), "sender bigint, owner bigint, n bigint, width int, code binary")
    bitmaps = messages.groupBy("owner").applyInArrow(_answer(bits, owner_bits), "sender bigint, owner bigint, bitmap binary")
    marks = rows.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInArrow(_mark(bits, owner_bits), "sender bigint, bits array<bigint>")
    return materialize(marks, "marks")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256, row)`` for every row of ``docs``; ``row`` has the columns of ``carry``.

    Texts are equal when the same after each run of white space becomes one space; null counts as empty. Of equal
    texts the row with the smallest id stays, and of several such rows one. Rows without an id stay only where no row of
    their group has one; ``keep_id`` is null then. Ids are integers, others are refused. An empty table gives no rows; columns
    may have any names.

    The texts of suspects are grouped by their bytes. Each task first combines its own equal texts, so a text that a
    third of all rows hold is one row per task; its rows then meet the group's result by SHA-256, without their texts,
    and without suspects a row is never moved. A sender holds 8 bytes a row, an owner about ``OWNED`` fingerprints."""
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer column")
    held = _held(docs, id_col, text_col, list(carry or []))
    word = F.get("bits", F.shiftright(F.col("number").bitwiseAND((1 << _ROW_BITS) - 1), 6).cast("int"))
    flag = F.getbit(word, F.col("number").bitwiseAND(63).cast("int")) == 1
    marked = held.join(_marks(held).hint("shuffle_hash"), "sender", "left").withColumn("suspect", F.coalesce(flag, F.lit(False)))
    # id and row number in one number, so that the aggregate stays a hash aggregate
    scale = F.lit(Decimal(1 << 63))
    order = F.col("id").cast("decimal(19,0)") * scale + F.col("number")
    groups = (marked.filter("suspect").select("text_sha256", normal_text(F.col("text")).alias("normal"), "id", "number", order.cast("decimal(38,0)").alias("first"))
              .groupBy("text_sha256", "normal").agg(F.min("id").alias("keep_id"), F.min("first").alias("first"), F.min("number").alias("any"), F.count(F.lit(1)).alias("group_size"))
              .select("text_sha256", "keep_id", "group_size", F.coalesce((F.col("first") - F.col("keep_id").cast("decimal(19,0)") * scale).cast("long"), "any").alias("winner")))
    alone = marked.filter("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "row")
    again = marked.filter("suspect").select("id", "number", "text_sha256", "row").join(groups, "text_sha256").select(
        "id", "keep_id", "group_size", (F.col("number") == F.col("winner")).alias("kept"), "text_sha256", "row")
    return alone.unionByName(again)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; see ``mark_copies``."""
    kept = mark_copies(docs, id_col, text_col, docs.columns).filter("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
