"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Rules for odd input: a null or empty text has only the bias feature and gets the base rate; a very long text has at most
2**bits features and is scored whole; a null id counts as the empty text when it is hashed; repeated rows are scored each on its
own and are one example; copies with unlike labels are one example with the mean label; without any labelled row every score is 0.5; an
empty table gives an empty result. Other columns, whatever their names, are ignored by detect and kept by keep_clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import U64, lean, mix, remainder_of_id, row_of, small, spread, text_bytes
from evidara.llm.linear import Ftrl, labelled_sample, sigmoid, train

MODEL = Ftrl(bits=20, alpha=1.0, beta=1.0, l1=8.0, l2=0.0, epochs=4)
#: The label is predicted from this score on.
THRESHOLD = 0.3
#: ASCII other than letters and digits parts words.
PARTS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: A multiplier for each kind of feature: one word, two in a row, two with one and with two words between.
KINDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def feature_hashes(text: bytes, bits: int) -> np.ndarray:
    """Indices of every word, bigram and skip-gram, with repeats; index 0 is the bias alone."""
    words = text.decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(PARTS).split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    parts = [h * U64(KINDS[0])]
    for gap in (1, 2, 3):
        parts.append(h[:-gap] * U64(KINDS[gap]) + mix(h[gap:] + U64(gap)))
    return (mix(np.concatenate(parts)) % U64((1 << bits) - 1)).astype(np.int64) + 1


def featurise(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    idx = np.concatenate([np.zeros(1, np.int64), np.unique(feature_hashes(text, MODEL.bits))])
    return idx, np.ones(len(idx))


def fit(docs: DataFrame, labels: DataFrame, model: Ftrl = MODEL) -> np.ndarray:
    """Weights from labelled rows of docs; most are zero."""
    return train(labelled_sample(docs, labels, "toxic", model.max_rows), featurise, model)


def score(docs: DataFrame, weights: np.ndarray, *keep: str) -> DataFrame:
    """The kept columns as a struct (row) and toxicity_score of each document.

    What is broadcast is at most 2**bits weights, whatever the corpus.
    """
    sparse = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((len(weights), sparse, weights[sparse]))
    rows = text_bytes(docs, row_of(docs, keep).alias("row"))
    schema = rows.select("row", F.lit(0.0).alias("toxicity_score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, at, w = sent.value
        dense = np.zeros(size, np.float32)
        dense[at] = w
        bits = size.bit_length() - 1
        for batch in small(batches):
            out = []
            for text in batch["text"].to_pylist():
                h = feature_hashes(text, bits)
                hit = np.unique(h[dense[h] != 0])
                out.append(float(sigmoid(float(dense[0]) + float(dense[hit].sum()))))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.float64())], ["row", "toxicity_score"])

    return rows.mapInArrow(lean(run), schema)


def detect(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; rows held out are never learnt from."""
    docs = spread(docs)
    weights = fit(docs.where(remainder_of_id(F.col("doc_id"), folds) != held), labels)
    out = score(docs, weights, "doc_id").select("row.doc_id", F.col("toxicity_score").alias("score"))
    return out.select("doc_id", (remainder_of_id(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    docs = spread(docs)
    return score(docs, fit(docs, labels), *docs.columns).where(F.col("toxicity_score") < THRESHOLD).select("row.*")
