"""Quality rules: exact counts, and a calibrated n-gram classifier against fixed thresholds."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebar.llm import features as ft
from tidebar.llm.labelled import SEED, label_counts, sample_labels, with_texts
from tidebar.llm.text import byte_column

#: Hash slots of each n-gram group: words, word pairs, three and four bytes.
BITS, GROUPS = 13, 4
#: Rows of each label that the classifier is fitted on, at most; a fifth of them calibrates it.
ROWS = 1500
#: Fixed thresholds: texts below the least number of words, with a greater share (in percent) of words in
#: repeated windows, or with a smaller probability of being good are rejected.
MIN_WORDS, MAX_REPEATED, MIN_GOOD = 50, 50, 0.25
_AGAIN = np.uint32(0x5BD1E995)
_SLOT = np.min_scalar_type((GROUPS << BITS) - 1)
_WORD_SPACE = bytes((9, 10, 11, 12, 13, 32))


def text_features(data: bytes) -> np.ndarray:
    """Square roots of the shares of the hashed n-grams in each group. A word pair of one word twice is
    the same feature for all words, so that repetition shows in any language."""
    counts = np.zeros((GROUPS, 1 << BITS), np.float32)
    for buf in ft.parts(data):
        starts, ends = ft.word_bounds(buf)
        word = ft.word_hashes(buf, starts, ends)
        pair = word[:-1] * np.uint32(0x85EBCA6B) + word[1:]
        pair[word[:-1] == word[1:]] = _AGAIN
        for group, h in enumerate((word, pair, ft.char_grams(buf, 3), ft.char_grams(buf, 4))):
            counts[group] += np.bincount(ft.slots(h, BITS), minlength=1 << BITS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).ravel()


@dataclass
class Model:
    """A logistic regression and the line that makes its scores probabilities."""
    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, data: bytes) -> float:
        return float(ft.sigmoid(np.array(self.slope * (self.weights @ text_features(data)) + self.shift)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, share: float, epochs: int = 30, rate: float = 0.02, ridge: float = 1e-5, batch: int = 64) -> Model:
    """Fit on four fifths of sparse rows, calibrate on the rest with weights that restore the share of label 1."""
    size = GROUPS << BITS
    if len(set(label.tolist())) < 2:
        return Model(np.zeros(size, np.float32), 1.0, float(np.log(share / (1 - share))))
    table = ft.Rows([r[0] for r in rows], [r[1] for r in rows])
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(label))
    own = order[len(order) // 5:] if len(order) >= 50 else order
    rest = order[: len(order) // 5] if len(order) >= 50 else order
    balance = np.where(label == 1, 0.5 / max(1, (label[own] == 1).sum()), 0.5 / max(1, (label[own] == 0).sum())) * len(own)
    values = {"w": np.zeros(size, np.float32), "b": np.zeros(1, np.float32)}
    adam = ft.Adam(values, rate)
    for epoch in range(epochs):
        adam.rate = rate * (1.05 - epoch / epochs)
        for part in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            flat, value, row = table.take_values(part)
            z = np.bincount(row, values["w"][flat] * value, len(part)) + values["b"][0]
            g = balance[part] * (ft.sigmoid(z) - label[part]) / len(part)
            w = np.bincount(flat, g[row] * value, size) + ridge * values["w"]
            adam.step({"w": w.astype(np.float32), "b": np.array([g.sum()], np.float32)})
    flat, value, row = table.take_values(rest)
    z = np.bincount(row, values["w"][flat] * value, len(rest)) + values["b"][0]
    weight = np.where(label[rest] == 1, share / max(1, (label[rest] == 1).sum()), (1 - share) / max(1, (label[rest] == 0).sum())) * len(rest)
    slope, shift = ft.platt(z, label[rest], weight)
    return Model(values["w"], slope, shift + slope * float(values["b"][0]))


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``ROWS`` rows of each label, the first in the order of a hash of their ids. Features are
    made in tasks, and one task fits the model, so that only its weights come to the driver. The share of label 1 is
    counted over all of ``labels``. Without rows of both labels the probability is that share for every text."""
    counts = label_counts(labels, target)
    share = min(0.99, max(0.01, counts[1] / (counts[0] + counts[1]) if sum(counts.values()) else 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, data in zip(batch.column("label").to_pylist(), byte_column(batch, "text")):
                x = text_features(data)
                used = np.flatnonzero(x)
                yield pa.record_batch([pa.array([label], pa.int32()), pa.array([used.astype(_SLOT).tobytes()]), pa.array([x[used].tobytes()])], ["label", "slots", "shares"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, rows = [], []
        for batch in batches:
            label.extend(batch.column("label").to_pylist())
            rows.extend((np.frombuffer(x.as_buffer(), _SLOT), np.frombuffer(y.as_buffer(), np.float32)) for x, y in zip(batch.column("slots"), batch.column("shares")))
        model = fit_rows(rows, np.array(label), share)
        yield pa.record_batch([pa.array([model.weights.tobytes()]), pa.array([model.slope]), pa.array([model.shift])], ["weights", "slope", "shift"])

    sample = sample_labels(labels, target, {0: ROWS, 1: ROWS}, id_col)
    found = with_texts(sample, docs, 2 * ROWS, id_col, text_col).mapInArrow(run, "label int, slots binary, shares binary")
    ordered = found.repartition(1).sortWithinPartitions("label", "slots", "shares")  # whatever order tasks end in
    got = ordered.mapInArrow(fit, "weights binary, slope double, shift double").collect()
    if not got:  # no task ran, as there are no rows
        return fit_rows([], np.zeros(0), share)
    return Model(np.frombuffer(got[0].weights, np.float32), got[0].slope, got[0].shift)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a run of ``window`` words which stands in the text twice or more."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids
    for k in range(1, window):
        # numbers of runs of k + 1 words; numbers stay below the count of words, so products fit
        key = key[:-1] * len(number) + ids[k:]
        if k + 1 < window:
            key = np.unique(key, return_inverse=True)[1] if len(number) > 1 << 20 else key
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int(np.count_nonzero(np.cumsum(change[:-1])))


def counts(data: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in them, symbols, repeated lines and words in repeated windows."""
    words = data.split()
    points = len(data.decode("utf-8", "replace")) - sum(data.count(c) for c in _WORD_SPACE)
    symbols = sum(data.count(c) for c in b"#*$%&|<>")
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), points, symbols, len(lines) - len(set(lines)), repeated_words(words)


_OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability")


def apply_rules(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``carry``) plus ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    probability, base_failed, kept``, which replace columns of these names.

    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEATED`` percent of the words in repeated windows.
    ``kept``: not ``base_failed``, and the classifier's probability reaches ``MIN_GOOD``. Null and blank texts have no words
    and fail; repeated rows come out repeated; any column may be null."""
    own = [c for c in (docs.columns if carry is None else carry) if c not in (*_OUT, "base_failed", "kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*counts(t), model.probability(t)) for t in byte_column(batch, "__text")]
            new = [pa.array([f[i] for f in found], pa.float64() if i == 5 else pa.int64()) for i in range(6)]
            yield pa.record_batch([*(batch.column(c) for c in own), *new], [*own, *_OUT])

    source = docs.select(*own, F.col(text_col).alias("__text"))
    schema = T.StructType([f for f in source.schema if f.name != "__text"])
    for c in _OUT:
        schema.add(c, T.DoubleType() if c == "probability" else T.LongType())
    rows = source.mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= MIN_GOOD))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns. The text stands in the row, so nothing is shuffled."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return apply_rules(packed, model, carry=["row"]).filter("kept").select("row.*")
