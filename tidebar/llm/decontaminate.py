"""Benchmark passages in documents: a prefix-filtered join of word shingles."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.text import byte_column, int_lists, list_column, plain_words
from tidebar.sources.scratch import materialize

#: Words of benchmark text whose windows are searched for in one pass; a larger benchmark takes several.
BLOCK_WORDS = 200_000


class Windows:
    """The windows of a block of items. Equal shingles share an id, equal windows share a row."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int, shingle: int):
        self.vocab: dict[bytes, int] = {}
        grams: dict[tuple[int, ...], int] = {}
        rows: dict[tuple[int, ...], int] = {}
        owners: list[set[int]] = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                row = rows.setdefault(tuple(ids[at:at + window]), len(rows))
                if row == len(owners):
                    owners.append(set())
                if item is not None:
                    owners[row].add(item)
        self.owners = [sorted(x) for x in owners]
        self.sizes = [len(k) for k in rows]
        #: Shingle ids of each window in order; the words of a short window are one shingle.
        self.shingles = [np.array([grams.setdefault(k[i:i + shingle], len(grams)) for i in range(max(1, len(k) - shingle + 1))], np.int64) for k in rows]
        self.gram_sizes = np.array([len(g) for g in grams], np.int64)
        #: Shingle ids by the bytes of their word ids, for each length.
        self.keys: dict[int, dict[bytes, int]] = {}
        for g, i in grams.items():
            self.keys.setdefault(len(g), {})[np.array(g, np.int32).tobytes()] = i


def _occurrences(vocab: dict[bytes, int], keys: dict[int, dict[bytes, int]]):
    """Per document: its number of words, and where which benchmark shingles start in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = vocab.get
        for batch in batches:
            n_words, places, grams = [], [], []
            for data in byte_column(batch, "text"):
                words = plain_words(data)
                ids = np.fromiter((word(w, -1) for w in words), np.int32, len(words))
                run_of = np.concatenate(([0], np.cumsum(ids >= 0)))
                at_all, gram_all = [], []
                for n, ids_of in keys.items():
                    at = np.flatnonzero(run_of[n:] - run_of[:-n] == n)  # all n words are benchmark words
                    for first in range(0, len(at), 1 << 16):
                        part = at[first:first + (1 << 16)]
                        flat = ids[part[:, None] + np.arange(n)].tobytes()
                        got = np.fromiter((ids_of.get(flat[k:k + 4 * n], -1) for k in range(0, len(flat), 4 * n)), np.int64, len(part))
                        at_all.append(part[got >= 0])
                        gram_all.append(got[got >= 0])
                n_words.append(len(words))
                places.append(np.concatenate(at_all) if at_all else np.zeros(0, np.int64))
                grams.append(np.concatenate(gram_all) if gram_all else np.zeros(0, np.int64))
            lists = [list_column(x, pa.int32()) for x in (places, grams)]
            yield pa.record_batch([batch.column("id"), batch.column("text_key"), pa.array(n_words, pa.int64()), *lists], ["id", "text_key", "n_words", "places", "grams"])
    return run


def _verify(windows: Windows, counts: dict[int, int], shingle: int, containment: float):
    """Per document: the words inside occurring windows and the items these belong to."""
    shingles, sizes, owners, gram_sizes = windows.shingles, windows.sizes, windows.owners, windows.gram_sizes
    prefix: dict[int, list[tuple[int, int]]] = {}
    need = [max(1, math.ceil(containment * len(g) - 1e-9)) for g in shingles]
    for w, grams in enumerate(shingles):
        # any occurrence of the window holds one of its rarest (all - needed + 1) shingles
        for i in sorted(range(len(grams)), key=lambda i: (counts.get(int(grams[i]), 0), int(grams[i])))[: len(grams) - need[w] + 1]:
            prefix.setdefault(int(grams[i]), []).append((w, i))
    leads = np.zeros(len(gram_sizes), bool)
    leads[list(prefix)] = True

    def search(n: int, at: np.ndarray, gram: np.ndarray) -> tuple[list[list[int]], list[int]]:
        lead = np.flatnonzero(leads[gram])
        line: dict[int, np.ndarray] = {}  # the shingle at each word, by shingle length
        tried, hits, items = set(), [], set()
        for c in lead.tolist():
            for w, i in prefix[int(gram[c])]:
                start, size = int(at[c]) - i, sizes[w]
                # the matched place fixes where the window stands: it has to lie inside the document
                if start < 0 or start + size > n or (w, start) in tried:
                    continue
                tried.add((w, start))
                m = min(size, shingle)
                if m not in line:
                    line[m] = np.full(n, -1, np.int64)
                    own = gram_sizes[gram] == m
                    line[m][at[own]] = gram[own]
                if np.count_nonzero(line[m][start:start + len(shingles[w])] == shingles[w]) >= need[w]:
                    hits.append((start, start + size))
                    items.update(owners[w])
        merged: list[list[int]] = []
        for a, b in sorted(hits):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return merged, sorted(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("n_words").to_pylist(), int_lists(batch, "places"), int_lists(batch, "grams"))
            found = [search(n, at.astype(np.int64), gram.astype(np.int64)) for n, at, gram in rows]
            yield pa.record_batch([*(batch.column(k) for k in ("id", "text_key", "n_words")), pa.array([s for s, _ in found], pa.list_(pa.list_(pa.int32()))), pa.array([i for _, i in found], pa.list_(pa.int64()))],
                                  ["id", "text_key", "n_words", "spans", "items"])
    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks of at most ``BLOCK_WORDS`` words (or one item), streamed from the table."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).toLocalIterator():
        words = plain_words((row.text or "").encode())
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row.item, words))
        size += len(words)
    yield block


def _merged(spans):
    """Sorted spans with those that meet made one."""
    def add(done, span):
        last = F.get(done, F.size(done) - 1)
        meets = (F.size(done) > 0) & (F.get(span, F.lit(0)) <= F.get(last, F.lit(1)))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.get(last, F.lit(0)), F.greatest(F.get(last, F.lit(1)), F.get(span, F.lit(1))))))).otherwise(
            F.concat(done, F.array(span)))
    return F.aggregate(F.array_sort(spans), F.array().cast("array<array<int>>"), add)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, containment: float = 1.0,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id, text_key, n_words, spans, items)`` for every row of ``docs``: its id, XXH64 of its text, its
    number of words, the word spans ``[from, to)`` inside occurring windows (merged, in order) and
    the ids of the items these belong to.

    Windows are ``window`` consecutive words of an item; a shorter item is one window. A window
    occurs where at least ``containment`` of its ``shingle``-word shingles stand at their places in
    as many words of the document; at 1.0 these are its exact words. Shingles are ordered by their
    number in all documents, and only the rarest of a window, of which any occurrence holds one,
    are looked up.

    Null and empty texts have no words and no spans; an item without words has no window and one
    without an id is marked but not listed; repeated rows come out repeated, repeated items count
    once. Other columns are ignored. The benchmark is searched in blocks of bounded size, so what a
    task holds does not grow with it; texts are read once for each block."""
    kind = docs.schema[id_col].dataType.simpleString()
    head = f"id {kind}, text_key long, n_words long"
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    found, blocks = None, 0
    for block in _blocks(benchmark, item_col, item_text):
        windows = Windows(block, window, shingle)
        met = materialize(source.mapInArrow(_occurrences(windows.vocab, windows.keys), f"{head}, places array<int>, grams array<int>"), "shingles")
        # one row for each shingle of the block at most
        counts = {r.gram: r.n for r in met.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
        part = met.mapInArrow(_verify(windows, counts, shingle, containment), f"{head}, spans array<array<int>>, items array<long>")
        part = part.withColumn("block", F.lit(blocks))
        found, blocks = part if found is None else found.unionAll(part), blocks + 1
    if blocks == 1:
        return found.drop("block")
    # equal rows have equal results, so a set holds one entry for each block
    rows = found.groupBy("id", "text_key").agg(F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("n"), F.collect_set(F.struct("block", "spans", "items")).alias("parts"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("n") / blocks).cast("int"))))
    return rows.select("id", "text_key", "n_words", _merged(F.flatten("parts.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten("parts.items"))).alias("items"))


def hit_words(spans: str = "spans"):
    """Words inside the spans of a row."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))


def is_contaminated(n_hit, n_words):
    """At least a twentieth of the words is benchmark text."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns; repeated rows stay or go together."""
    found = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    bad = found.filter(is_contaminated(hit_words(), F.col("n_words"))).select(F.col("id").alias("bad_id"), F.col("text_key").alias("bad_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"))
    return rows.join(bad, F.col("text_key").eqNullSafe(F.col("bad_key")) & F.col("id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")
