"""Toxicity by non-negative positive-unlabelled learning."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import features as ft
from tidebar.llm.labelled import SEED, label_counts, sample_labels, with_texts
from tidebar.llm.text import byte_column, list_column

BITS = 18
#: Toxic rows and unlabelled rows that a classifier is fitted on, at most.
TOXIC_ROWS, PLAIN_ROWS = 3000, 9000
#: Features that a classifier uses: those whose share of rows differs most between both samples, in standard errors.
SELECTED, LEAST_ERRORS = 2000, 4.0
_HEADS = range(3, 7)


def text_features(data: bytes) -> np.ndarray:
    """The hashed words and word beginnings of a text, each once."""
    found = [np.zeros(0, np.int64)]
    for buf in ft.parts(data):
        starts, ends = ft.word_bounds(buf, plain=True)
        found.append(np.unique(ft.slots(np.concatenate([ft.word_hashes(buf, starts, ends), *ft.word_heads(buf, starts, ends, _HEADS)]), BITS)))
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


@dataclass
class Model:
    weights: np.ndarray
    offset: float

    def score(self, data: bytes) -> float:
        return float(ft.sigmoid(np.array(self.weights[text_features(data)].sum() + self.offset)))


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Which features tell the samples apart: rare ones would only be learned by heart."""
    n, m = len(positive), len(unlabelled)
    p, u = (np.bincount(np.concatenate(rows), minlength=1 << BITS) for rows in (positive, unlabelled))
    share = (p + u + 1) / (n + m + 2)
    error = np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    z = np.abs(p / n - u / m) / error
    keep = np.zeros(1 << BITS, bool)
    order = np.argsort(-z, kind="stable")[:SELECTED]
    keep[order[z[order] >= LEAST_ERRORS]] = True
    return keep


def fit_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 40, rate: float = 0.05, ridge: float = 1e-4, batch: int = 512) -> Model:
    """A logistic classifier from positives and unlabelled rows.

    The risk is prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)): the share of
    positives among the unlabelled is taken out of the negative risk. Where a batch makes that part
    negative, which is overfitting, the step goes up its gradient instead."""
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Model(np.zeros(1 << BITS, np.float32), start)
    keep = telling(positive, unlabelled)
    pos, unl = (ft.Rows([r[keep[r]] for r in rows]) for rows in (positive, unlabelled))
    values = {"w": np.zeros(1 << BITS, np.float32), "b": np.array([start], np.float32)}
    adam, rng = ft.Adam(values, rate), np.random.default_rng(SEED)
    steps = max(1, len(unl.sizes) // batch)
    for epoch in range(epochs):
        adam.rate = rate * (1.05 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(unl.sizes)), steps):
            own = rng.choice(len(pos.sizes), min(batch, len(pos.sizes)), replace=False)
            (pf, pr), (uf, ur) = pos.take(own), unl.take(part)
            pz, uz = (np.bincount(row, values["w"][flat], len(index)) + values["b"][0] for flat, row, index in ((pf, pr, own), (uf, ur, part)))
            # logistic losses: calling a row negative costs log(1 + e^z)
            minus = np.logaddexp(0, uz).mean() - prior * np.logaddexp(0, pz).mean()
            up, uu = ft.sigmoid(pz), ft.sigmoid(uz)
            gp, gu = (prior * (up - 1) - prior * up, uu) if minus >= 0 else (prior * up, -uu)
            gp, gu = gp / len(own), gu / len(part)
            g = np.bincount(pf, gp[pr], 1 << BITS) + np.bincount(uf, gu[ur], 1 << BITS) + ridge * values["w"]
            adam.step({"w": g.astype(np.float32), "b": np.array([gp.sum() + gu.sum()], np.float32)})
    pz, uz = (np.bincount(row, values["w"][flat], len(rows.sizes)) + values["b"][0] for rows in (pos, unl) for flat, row in [rows.take(np.arange(len(rows.sizes)))])
    slope, shift = calibrate(pz, uz, prior)
    return Model(values["w"] * np.float32(slope), slope * float(values["b"][0]) + shift)


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 8) -> tuple[float, float]:
    """Slope and shift that make scores probabilities: positives with the weight of the prior against
    unlabelled rows, each weighted by the present probability that it is negative."""
    slope, shift = 1.0, 0.0
    z = np.concatenate((positive, unlabelled))
    label = np.concatenate((np.ones(len(positive)), np.zeros(len(unlabelled))))
    for _ in range(rounds):
        clean = 1 - ft.sigmoid(slope * unlabelled + shift)
        weight = np.concatenate((np.full(len(positive), prior * len(unlabelled) / len(positive)), clean * (1 - prior) * len(unlabelled) / max(clean.sum(), 1e-9)))
        slope, shift = ft.platt(z, label, weight)
    return slope, shift


def fit_toxicity(docs: DataFrame, labels: DataFrame, unlabelled: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``TOXIC_ROWS`` rows labelled 1 and ``PLAIN_ROWS`` rows of ``unlabelled``, whatever these are.

    The class prior is the share of label 1 among all of ``labels``. Both samples are the first rows in the
    order of a hash of their ids; their features are made in tasks and only these come to the driver."""
    counts = label_counts(labels, target)
    prior = min(0.9, max(0.005, counts[1] / max(1, counts[0] + counts[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("label"), list_column([text_features(t) for t in byte_column(batch, "text")], pa.int32())], ["label", "slots"])

    some = unlabelled.select(F.col(id_col).alias("id"), F.lit(0).alias("label")).orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(PLAIN_ROWS)
    rows = {1: [], 0: []}
    for sample, bound in ((sample_labels(labels, target, {1: TOXIC_ROWS}, id_col), TOXIC_ROWS), (some, PLAIN_ROWS)):
        found = with_texts(sample, docs, bound, id_col, text_col).mapInArrow(run, "label int, slots array<int>").toArrow()
        for batch in found.to_batches():
            for label, slots in zip(batch.column("label").to_pylist(), batch.column("slots")):
                rows[label].append(np.asarray(slots.values, np.int64))
    return fit_pu(rows[1], rows[0], prior)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` of every row, from its whole text alone. A null or blank text has the score of no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array([model.score(t) for t in byte_column(batch, "text")], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
