"""Quality rules: a calibrated hashed word and character n-gram classifier behind exact base rules.

The classifier is a logistic regression over the shares of hashed words, word pairs and character runs of a text, trained on
labelled quality rows and calibrated (Platt) on labelled rows that it has not seen. Texts are scored in Arrow batches against
fixed thresholds.

Rules for odd input: a null text has no words and fails the base rules; repeated rows are judged each on its own; where no row
is labelled the classifier keeps everything; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import SPACE, U64, lean, mix, row_of, small, spread, text_bytes
from evidara.llm.linear import Ftrl, labelled_sample, sigmoid, train

MODEL = Ftrl(bits=18, alpha=0.5, beta=1.0, l1=0.0, l2=0.0, epochs=4, max_rows=12_000)
#: A text below this calibrated chance of being good is dropped.
LEAST_GOOD = 0.5
LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8
#: Fixed symbols of the base count.
SYMBOLS = "#*$%&|<>"
#: Lengths of character runs (in bytes), and the weight of a family's shares as features.
RUNS = (1, 2, 3)
SCALE = 20.0


def families(text: bytes, bits: int) -> list[np.ndarray]:
    """Indices of words, word pairs and character runs, with repeats, a family each; index 0 is the bias."""
    words = text.split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    c = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = [h * U64(0x9E3779B97F4A7C15), h[:-1] * U64(0xC2B2AE3D27D4EB4F) + mix(h[1:])]
    for n in RUNS:
        run = np.full(max(0, len(c) - n + 1), n, np.uint64)
        for i in range(n):
            run = (run << U64(8)) | c[i : i + len(run)]
        out.append(run)
    return [(mix(x) % U64((1 << bits) - 1)).astype(np.int64) + 1 for x in out]


def featurise(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = [f for f in families(text, MODEL.bits) if len(f)]
    if not found:
        return np.zeros(1, np.int64), np.ones(1)
    idx = np.concatenate(found)
    share = np.concatenate([np.full(len(f), SCALE / len(f)) for f in found])
    distinct, at = np.unique(idx, return_inverse=True)
    return np.concatenate([np.zeros(1, np.int64), distinct]), np.concatenate([np.ones(1), np.bincount(at, share)])


def margin(text: bytes, weights: np.ndarray) -> float:
    """The same as the features' weighted sum: each family adds the mean of its weights."""
    return float(weights[0]) + SCALE * sum(float(weights[f].mean()) for f in families(text, MODEL.bits) if len(f))


def fit(docs: DataFrame, labels: DataFrame, model: Ftrl = MODEL) -> tuple[np.ndarray, float, float]:
    """Weights, and slope and shift of the calibration: chance of good = sigmoid(slope * margin + shift)."""
    sample = labelled_sample(docs, labels, "quality", model.max_rows)
    aside = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    weights = train(sample.where(~aside), featurise, model)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([pa.array([margin(t, sent.value) for t in batch["text"].to_pylist()], pa.float64()), batch["y"]], ["m", "y"])

    # at most model.max_rows pairs of numbers
    seen = sample.where(aside).mapInArrow(lean(run), "m double, y double").toPandas()
    return weights, *platt(seen.m.to_numpy(), seen.y.to_numpy())


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's softened targets; (1, 0) where there is too little to learn from."""
    good = float(y.sum())
    if len(y) < 20 or good < 1 or len(y) - good < 1:
        return 1.0, 0.0
    t = np.where(y >= 0.5, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    x = np.stack([m, np.ones_like(m)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - t) + 1e-6 * (w - [1.0, 0.0]))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if np.isfinite(w).all() and w[0] > 0 else (1.0, 0.0)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that are found twice or more, the first one's included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = mix(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    w = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        w = w * U64(0x9E3779B97F4A7C15) + h[i : i + n]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(found), 1)
    np.add.at(cover, np.flatnonzero(found) + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def judge(docs: DataFrame, model: tuple[np.ndarray, float, float], *keep: str) -> DataFrame:
    """The kept columns as a struct (row), the base counts, base_failed, good (the calibrated chance) and kept."""
    weights, slope, shift = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    rows = text_bytes(docs, row_of(docs, keep).alias("row"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = rows.select("row", *(F.lit(0).cast("long").alias(c) for c in names), F.lit(0.0).alias("good")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for text in batch["text"].to_pylist():
                words = text.split()
                out.append((len(words), *base_counts(text.decode("utf-8", "replace"), words), float(sigmoid(slope * margin(text, sent.value) + shift)) if words else 0.0))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.float64())], ["row", *names, "good"])

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.mapInArrow(lean(run), schema).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("good") >= LEAST_GOOD))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, good and kept of each document."""
    docs = spread(docs)
    return judge(docs, fit(docs, labels), "doc_id").select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    docs = spread(docs)
    return judge(docs, fit(docs, labels), *docs.columns).where("kept").select("row.*")
