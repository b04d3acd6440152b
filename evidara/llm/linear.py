"""FTRL-proximal logistic regression over hashed features, learnt from a bounded sample.

Features are hashed by all tasks and written. One task then goes over them example by example, as FTRL is defined: at most max_rows
examples of at most 2**bits features, whatever the corpus. Only weights other than zero come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import lean, materialise, small, text_bytes

#: text -> (distinct feature indices, their values)
Featurise = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Ftrl:
    """Settings of the learner; bits bounds the model to 2**bits weights."""

    bits: int = 20
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 3
    max_rows: int = 20_000

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, z: np.ndarray, n: np.ndarray, idx: np.ndarray, x: np.ndarray, y: float) -> None:
        """One example: per-coordinate rates come from the squared gradients gathered in n."""
        zi, ni = z[idx], n[idx]
        w = self.weights(zi, ni)
        g = (sigmoid(float(w @ x)) - y) * x
        grown = ni + g * g
        z[idx] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / self.alpha * w
        n[idx] = grown


def sigmoid(s: float | np.ndarray) -> float | np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(s, -35.0, 35.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """text (bytes) and y of labelled documents: one row for each text, about max_rows of them at most.

    Ids are drawn by hash, so that the draw is the same on every run and every cluster. Where copies of a text carry
    different labels, the mean label stands.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    # labels of documents that are not here (or may not be learnt from) do not count
    there = docs.select("doc_id").join(marked.select("doc_id"), "doc_id", "left_semi").count()
    share = min(1.0, max_rows / max(1, there))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    return text_bytes(docs.where(drawn), F.col("doc_id")).join(marked.where(drawn), "doc_id").groupBy("text").agg(F.avg("y").alias("y"))


def hashed(sample: DataFrame, featurise: Featurise) -> DataFrame:
    """y of each example with its feature indices and values, in an order that the texts alone fix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [featurise(t) for t in batch["text"].to_pylist()]
            idx = pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary())
            # values that are all one are left out
            x = pa.array([b"" if (v == 1).all() else v.astype(np.float32).tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["place"], batch["y"], idx, x], ["place", "y", "idx", "x"])

    return sample.select(F.xxhash64("text").alias("place"), "y", "text").mapInArrow(lean(run), "place long, y double, idx binary, x binary")


def learn(examples: list[tuple[float, np.ndarray, np.ndarray]], model: Ftrl) -> np.ndarray:
    """Weights (2**bits) after some epochs over the examples, in a new but fixed order each time."""
    z, n = np.zeros(1 << model.bits), np.zeros(1 << model.bits)
    order = np.random.default_rng(len(examples))
    for _ in range(model.epochs):
        for i in order.permutation(len(examples)):
            y, idx, x = examples[i]
            model.update(z, n, idx, x if len(x) else np.ones(len(idx)), y)
    return model.weights(z, n)


def train(sample: DataFrame, featurise: Featurise, model: Ftrl) -> np.ndarray:
    """Weights (2**bits) learnt from a sample that the caller has bounded; all zero if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            # views of the batch's own memory, which is held once
            for y, idx, x in zip(batch["y"].to_pylist(), batch["idx"], batch["x"], strict=True):
                examples.append((y, np.frombuffer(idx.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float32)))
        w = learn(examples, model)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at].astype(np.float32))], ["at", "w"])

    rows = materialise(hashed(sample, featurise), "training")
    found = rows.repartition(1).sortWithinPartitions("place", "y").mapInArrow(lean(run), "at long, w float").toArrow()
    weights = np.zeros(1 << model.bits, np.float32)
    weights[found["at"].to_numpy()] = found["w"].to_numpy()
    return weights
