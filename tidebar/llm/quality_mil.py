"""Quality classifier: attention-based multiple-instance learning over passages."""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import features as ft
from tidebar.llm.labelled import SEED, label_counts, sample_labels, with_texts
from tidebar.llm.text import byte_column

#: Words of a passage.
PASSAGE = 64
#: Encoded features of a passage: shares of bytes, of hashed byte triples, of repetition.
TRIPLES, EXTRA = 8, 4
WIDTH = 256 + (1 << TRIPLES) + EXTRA
HIDDEN, ATTENTION = 48, 24
#: Rows of each label and passages in all that the model is fitted on, at most.
ROWS, PASSAGES = 1500, 60_000


def encode_passages(data: bytes) -> Iterator[np.ndarray]:
    """A row of features for each passage of a text, in one table for each part of a very long text; a text
    without words is one empty passage."""
    empty = True
    for buf in ft.parts(data):
        starts, ends = ft.word_bounds(buf)
        if not len(starts):
            continue
        n = -(-len(starts) // PASSAGE)
        first = starts[::PASSAGE]
        owner = np.zeros(len(buf), np.int64)
        owner[first[1:]] = 1
        owner = np.cumsum(owner)
        table = np.zeros((n, WIDTH), np.float32)
        table[:, :256] = np.bincount(owner * 256 + buf, minlength=n * 256).reshape(n, 256)
        grams = ft.slots(ft.char_grams(buf, 3), TRIPLES)
        table[:, 256:-EXTRA] = np.bincount((owner[: len(grams)] << TRIPLES) + grams, minlength=n << TRIPLES).reshape(n, -1)
        for a, b in ((0, 256), (256, WIDTH - EXTRA)):
            table[:, a:b] = np.sqrt(table[:, a:b] / np.maximum(table[:, a:b].sum(1, keepdims=True), 1))
        word = ft.word_hashes(buf, starts, ends)
        of = np.arange(len(word)) // PASSAGE
        size = np.bincount(of, minlength=n)
        again = np.concatenate(([False], (word[1:] == word[:-1]) & (of[1:] == of[:-1])))
        distinct = np.bincount(np.unique(of * (1 << 32) + word) >> 32, minlength=n)
        table[:, -4] = np.bincount(of[again], minlength=n) / size
        table[:, -3] = distinct / size
        table[:, -2] = np.bincount(of, ends - starts, n) / size / 16
        table[:, -1] = size / PASSAGE
        empty = False
        yield table
    if empty:
        yield np.zeros((1, WIDTH), np.float32)


@dataclass
class Model:
    """Encoder, gated attention and classifier, with the line that makes scores probabilities."""
    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of documents whose passages stand end to end from ``starts``."""
        p = self.p
        z = np.tanh(x @ p["W"] + p["c"])
        t, s = np.tanh(z @ p["V"]), ft.sigmoid(z @ p["U"])
        e = (t * s) @ p["w"]
        size = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), size))
        a = e / np.repeat(np.add.reduceat(e, starts), size)
        rep = np.add.reduceat(a[:, None] * z, starts)
        return rep @ p["o"] + p["b"][0], (x, starts, size, z, t, s, a, rep)

    def gradients(self, held: tuple, g: np.ndarray) -> dict[str, np.ndarray]:
        p, (x, starts, size, z, t, s, a, rep) = self.p, held
        d_rep = np.repeat(g[:, None] * p["o"], size, 0)
        d_a = (d_rep * z).sum(1)
        d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, starts), size))
        d_t, d_s = d_e[:, None] * p["w"] * s * (1 - t * t), d_e[:, None] * p["w"] * t * s * (1 - s)
        d_z = (a[:, None] * d_rep + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - z * z)
        return {"W": x.T @ d_z, "c": d_z.sum(0), "V": z.T @ d_t, "U": z.T @ d_s, "w": (t * s).T @ d_e, "o": rep.T @ g, "b": np.array([g.sum()])}

    def score_parts(self, tables: Iterator[np.ndarray]) -> float:
        """The score of one long text, its attention pooled part by part."""
        p, top, total, pooled = self.p, -np.inf, 0.0, 0.0
        for x in tables:
            z = np.tanh(x @ p["W"] + p["c"])
            e = (np.tanh(z @ p["V"]) * ft.sigmoid(z @ p["U"])) @ p["w"]
            new = max(top, float(e.max()))
            a = np.exp(e - new)
            total, pooled, top = total * np.exp(top - new) + a.sum(), pooled * np.exp(top - new) + a @ z, new
        logit = pooled @ p["o"] / total + p["b"][0]
        return float(ft.sigmoid(np.array(self.slope * logit + self.shift)))

    def score(self, tables: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *(len(t) for t in tables[:-1])])
        logit, _ = self.logits(np.concatenate(tables), starts)
        return ft.sigmoid(self.slope * logit.astype(np.float64) + self.shift)


def fit_bags(bags: list[np.ndarray], label: np.ndarray, share: float, epochs: int = 12, rate: float = 0.004, ridge: float = 1e-4, batch: int = 32) -> Model:
    """Train on four fifths of the documents, calibrate on the rest with weights that restore the share of label 1."""
    rng = np.random.default_rng(SEED)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    model = Model({"W": draw(WIDTH, HIDDEN) * 2, "c": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION), "o": draw(HIDDEN), "b": np.zeros(1, np.float32)})
    if len(set(label.tolist())) < 2:
        model.p["o"][:] = 0
        model.shift = float(np.log(share / (1 - share)))
        return model
    order = rng.permutation(len(label))
    enough = len(order) >= 50
    own, rest = (order[len(order) // 5:], order[: len(order) // 5]) if enough else (order, order)
    balance = np.where(label == 1, 0.5 / max(1, (label[own] == 1).sum()), 0.5 / max(1, (label[own] == 0).sum())) * len(own)
    adam = ft.Adam(model.p, rate)
    for epoch in range(epochs):
        adam.rate = rate * (1.05 - epoch / epochs)
        for part in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            starts = np.cumsum([0, *(len(bags[i]) for i in part[:-1])])
            logit, held = model.logits(np.concatenate([bags[i] for i in part]), starts)
            g = balance[part] * (ft.sigmoid(logit) - label[part]) / len(part)
            grads = model.gradients(held, g.astype(np.float32))
            adam.step({k: (v + (ridge * model.p[k] if k in "WVU" else 0)).astype(np.float32) for k, v in grads.items()})
    starts = np.cumsum([0, *(len(bags[i]) for i in rest[:-1])])
    logit, _ = model.logits(np.concatenate([bags[i] for i in rest]), starts)
    weight = np.where(label[rest] == 1, share / max(1, (label[rest] == 1).sum()), (1 - share) / max(1, (label[rest] == 0).sum())) * len(rest)
    model.slope, model.shift = ft.platt(logit.astype(np.float64), label[rest], weight)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``ROWS`` labelled rows of each label, texts up to ``features.PART`` bytes, and ``PASSAGES`` passages
    of whole texts: rows in the order of a hash of their ids. Passages are encoded in tasks; the share of label 1 is counted over all of
    ``labels``. Without rows of both labels every text gets that share."""
    counts = label_counts(labels, target)
    share = min(0.99, max(0.01, counts[1] / (counts[0] + counts[1]) if sum(counts.values()) else 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, data in zip(batch.column("label").to_pylist(), byte_column(batch, "text")):
                if len(data) > ft.PART:  # one document never fills the sample
                    continue
                x = np.concatenate(list(encode_passages(data)))
                yield pa.record_batch([pa.array([label], pa.int32()), pa.array([x.astype("<f2").tobytes()], pa.binary())], ["label", "bag"])

    sample = sample_labels(labels, target, {0: ROWS, 1: ROWS}, id_col)
    found = with_texts(sample, docs, 2 * ROWS, id_col, text_col).mapInArrow(run, "label int, bag binary").toLocalIterator()
    rows = sorted(((r.label, bytes(r.bag)) for r in found), key=lambda r: (zlib.crc32(r[1]), r))
    bags, label, total = [], [], 0
    for k, data in rows:
        bag = np.frombuffer(data, "<f2").astype(np.float32).reshape(-1, WIDTH)
        if total + len(bag) <= PASSAGES:
            total += len(bag)
            bags.append(bag)
            label.append(k)
    return fit_bags(bags, np.array(label, np.int64), share)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row: the probability of label 1 from all passages of its whole text.

    A null or blank text is one empty passage; repeated rows come out repeated; other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, places, size = np.zeros(batch.num_rows), [], [], 0
            for i, data in enumerate(byte_column(batch, "text")):
                if len(data) > ft.PART:
                    out[i] = model.score_parts(encode_passages(data))
                    continue
                held.extend(encode_passages(data))
                places.append(i)
                size += len(held[-1])
                if size >= 512:
                    out[places] = model.score(held)
                    held, places, size = [], [], 0
            if held:
                out[places] = model.score(held)
            yield pa.record_batch([batch.column("id"), pa.array(out)], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
