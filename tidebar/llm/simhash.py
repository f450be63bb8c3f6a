"""SimHash near-duplicates by covering locality-sensitive hashing."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.components import components
from tidebar.llm.text import byte_column, space_words
from tidebar.sources.scratch import drop, materialize

BITS = 64
#: Fingerprints of one bucket that are compared with each other; larger buckets are split.
BUCKET = 1024
_STEP = 1 << 15


def simhash(data: bytes, shingle: int, seed: int) -> int:
    """Fingerprint of one text: the majority of the bits of its shingles' XXH64."""
    total, count = 0, np.zeros(BITS, np.int64)
    held: list[bytes] = []

    def add(grams: list[bytes]) -> None:
        nonlocal total, count
        for at in range(0, len(grams), _STEP):
            part = grams[at:at + _STEP]
            h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in part), np.uint64, len(part))
            count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(part)

    for found in space_words(data.lower()):
        run = held + found
        joined = b" ".join(run)
        ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        add([joined[a:b] for a, b in zip(starts[: len(run) - shingle + 1].tolist(), ends[shingle - 1:].tolist())])
        held = run[max(0, len(run) - shingle + 1):]
    if not total:
        if not held:
            return 0
        add([b" ".join(held)])
    return sum(1 << i for i in np.flatnonzero(2 * count > total).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, fp long)`` of every row; ``text_key`` is XXH64 of the text. Null and blank texts have fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((simhash(t, shingle, seed) for t in byte_column(batch, "text")), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column("id"), batch.column("text_key"), pa.array(fp.view(np.int64))], ["id", "text_key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, text_key bigint, fp bigint")


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """Masks over the given bit positions such that any two words that differ there in at most
    ``radius`` positions agree under one mask at least.

    Position i gets a vector m(i) over GF(2) with radius + 1 entries, and the mask of a non-zero
    vector v holds the positions with <m(i), v> = 1. The vectors of ``radius`` positions do not span
    the space, so some v is orthogonal to all of them and its mask avoids these positions."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << p for i, p in enumerate(bits) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _mask(table: int, level: int, radius: int) -> int:
    """Bits fixed in a bucket table; ``table`` has one digit per level."""
    n = (1 << (radius + 1)) - 1
    fixed = 0
    for k in range(level, -1, -1):
        free = [b for b in range(BITS) if not fixed >> b & 1]
        fixed |= covering_masks(radius, free)[table // n**k % n]
    return fixed


def _spread(level: int, radius: int):
    """Bucket rows of each fingerprint: one for each table below its present one."""
    n = (1 << (radius + 1)) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, int] = {}
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            above = batch.column("bucket_table").to_numpy(zero_copy_only=False).astype(np.int64)
            for v in range(n):
                tables = above * n + v
                mask = np.empty(len(fp), np.uint64)
                for t in np.unique(tables).tolist():
                    if t not in masks:
                        masks[t] = _mask(t, level, radius)
                    mask[tables == t] = masks[t]
                yield pa.record_batch([pa.array(tables), pa.array((fp & mask).view(np.int64)), batch.column("fp")], ["bucket_table", "bucket", "fp"])
    return run


def _forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one bucket: fewer than its members."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            hit = left[near]
            a.append(np.full(len(hit), fp[x]))
            b.append(fp[hit])
            queue.extend(hit.tolist())
            left = left[~near]
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _link(radius: int, last: bool):
    """Links within each bucket of a partition that is sorted by bucket.

    Buckets stream by. Those of more than ``BUCKET`` fingerprints are not compared but passed on,
    to be split by the masks of the next level."""
    def out(kind, tables, a, b):
        return pa.record_batch([pa.array(np.full(len(a), kind)), pa.array(tables), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                               ["is_link", "bucket_table", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        passing = None  # the large bucket whose rows are being passed on

        def settle(table, bucket, fp, closed: bool):
            nonlocal held, passing
            new = np.flatnonzero((table[1:] != table[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            starts = np.concatenate(([0], new))
            sizes = np.diff(np.concatenate((starts, [len(fp)])))
            large = (sizes > BUCKET) & (not last)
            if passing is not None and len(fp) and (table[0], bucket[0]) == passing:
                large[0] = True
            passing = (table[-1], bucket[-1]) if large[-1] else None
            keep_from = len(fp) if closed or large[-1] else starts[-1]
            held = [x[keep_from:] for x in (table, bucket, fp)]
            done = starts < keep_from
            starts, sizes, large = starts[done], sizes[done], large[done]
            rows = np.repeat(large, sizes)
            if rows.any():
                yield out(False, table[:keep_from][rows], fp[:keep_from][rows], fp[:keep_from][rows])
            a, b = [], []
            small = ~large & (sizes > 1) & (sizes <= 8)
            for shift in range(1, int(sizes[small].max(initial=1))):
                wide = small & (sizes > shift)
                offset = np.arange(sizes[wide].sum() - shift * wide.sum())
                each = sizes[wide] - shift
                first = np.repeat(starts[wide] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + offset
                near = np.bitwise_count(fp[first] ^ fp[first + shift]) <= radius
                a.append(fp[first[near]])
                b.append(fp[first[near] + shift])
            for s, n in zip(starts[~large & (sizes > 8)].tolist(), sizes[~large & (sizes > 8)].tolist()):
                x, y = _forest(fp[s:s + n], radius)
                a.append(x)
                b.append(y)
            if a and sum(map(len, a)):
                a, b = np.concatenate(a), np.concatenate(b)
                yield out(True, np.zeros(len(a), np.int64), a, b)

        for batch in batches:
            if batch.num_rows:
                got = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("bucket_table", "bucket", "fp")]
                got[2] = got[2].view(np.uint64)
                yield from settle(*(np.concatenate(x) for x in zip(held, got)), closed=False)
        if len(held[0]):
            yield from settle(*held, closed=True)
    return run


def covering_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` within ``radius`` bits of each other.

    A fingerprint goes to 2^(radius+1) - 1 tables, under the bits that each table's mask keeps. Every
    pair within the radius meets in one bucket. Within a bucket only links of a spanning forest come
    out, never all pairs. A bucket of more than ``BUCKET`` fingerprints is split by covering masks
    of its free bits; the free bits halve each time, so after four levels a bucket holds few
    distinct fingerprints however dense they lie, and no link is lost."""
    level, links, frame = 0, [], distinct.select("fp", F.lit(0).cast("long").alias("bucket_table"))
    while True:
        last = level == 3
        met = (frame.mapInArrow(_spread(level, radius), "bucket_table long, bucket long, fp long")
               .repartition("bucket_table", "bucket").sortWithinPartitions("bucket_table", "bucket")
               .mapInArrow(_link(radius, last), "is_link boolean, bucket_table long, a long, b long"))
        met = materialize(met, "buckets")
        links.append(met.filter("is_link").select("a", "b"))
        rest = met.filter("not is_link").select(F.col("a").alias("fp"), "bucket_table")
        if last or rest.isEmpty():
            break
        frame, level = rest, level + 1
    found = links[0]
    for more in links[1:]:
        found = found.unionAll(more)
    return found


def groups(docs: DataFrame, radius: int, shingle: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_key, fp, root, component_id)``: ``root`` is the smallest fingerprint of the row's component."""
    marked = materialize(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("least"))
    links = covering_links(distinct, radius)
    joined = components(links)
    drop(links)
    node = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    node = materialize(node, "nodes")
    best = node.groupBy("root").agg(F.min("least").alias("component_id"))
    named = node.join(best, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("id", "text_key", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id reachable by links. Equal fingerprints are one node, so a group of copies of any
    size is one row of the search. Null and blank texts have fingerprint zero and are linked with
    each other. A null id is never a component's id unless the component has no other. Repeated rows
    come out repeated. Other columns are ignored."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups(docs, radius, shingle, seed, id_col, text_col).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row with the smallest id of each component of ``grouped (id, text_key, root, component_id)``, with its columns."""
    kept = grouped.filter(F.col("id").eqNullSafe(F.col("component_id")))
    kept = kept.groupBy("root", "id").agg(F.min("text_key").alias("text_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    both = rows.join(kept.select(F.col("id").alias("kept_id"), F.col("text_key").alias("kept_key")), F.col("text_key").eqNullSafe(F.col("kept_key")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    return both.dropDuplicates(["id", "text_key"]).select("row.*")


def drop_near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each component of ``near_duplicates``, with its columns. Of repeated rows, and of
    rows of a component that share its id, one stays; a component without ids keeps one row."""
    return keep_first(docs, groups(docs, radius, shingle, seed, id_col, text_col), id_col, text_col)
