"""Document fingerprints by closed syncmers.

A k-mer of code points is an anchor if the least hash among its inner s-mers lies at its first or last place. Whether a k-mer is an
anchor depends on itself alone, so equal passages have equal anchors wherever they stand. Anchors (hash and position) serve
positional matching; the SKETCH least anchor hashes make the fingerprint, and two fingerprints' likeness estimates the
Jaccard similarity of the anchor sets. Its standard error is sqrt(J(1-J)/SKETCH), at most 0.052, however long the texts are; it is
exact for texts with no more anchors than that.

Rules for odd input: a null text is empty; a text shorter than k has its whole self as its only anchor, an empty one none; two
empty fingerprints are alike (1.0), an empty and another are not (0.0); ids may be of any type that has an order; ties of ids are
broken by the text, and a null id comes last in descending order; repeated rows follow each other; very long texts are read whole; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.common import U64, mix, small, spread

K, S = 12, 6
SKETCH = 96
#: Characters in a range of neighbouring documents, on average, while there are no more ranges than MAX_RANGES.
RUN_CHARS = 1_000_000
MAX_RANGES = 100_000
#: Characters of a text that order rows of one id across ranges, and rows drawn for each range.
HEAD, DRAWN = 32, 4


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the closed syncmers of a text, in order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < K:
        if not len(c):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.full(1, len(c), np.uint64)
        for x in c:
            h = mix(h * U64(31) + x)
        return h, np.zeros(1, np.int64)
    inner = window_hash(c, S)
    places = K - S + 1
    least = inner[: len(inner) - places + 1].copy()
    for i in range(1, places):
        np.minimum(least, inner[i : len(inner) - places + 1 + i], out=least)
    closed = np.flatnonzero((inner[: len(least)] == least) | (inner[places - 1 :] == least))
    # a k-mer's hash from its first and last inner hashes, which together cover it
    return mix(inner[closed] * U64(0xC2B2AE3D27D4EB4F) + inner[closed + places - 1]), closed


def window_hash(c: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n code points."""
    out = np.zeros(len(c) - n + 1, np.uint64)
    for i in range(n):
        out = out * U64(0x100000001B3) + c[i : i + len(out)]
    return mix(out)


def sketch(text: str) -> np.ndarray:
    """The least SKETCH distinct anchor hashes (upper 32 bits), sorted."""
    h = np.unique((anchors(text)[0] >> U64(32)).astype(np.uint32))
    return h[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the sets that two sketches stand for."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SKETCH]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, hash and position of every anchor, for positional matching."""
    rows = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for i, text in enumerate(batch["text"].to_pylist()):
                h, at = anchors(text)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(np.full(len(h), i))), pa.array(h.view(np.int64)), pa.array(at)], ["doc_id", "hash", "position"])

    return rows.mapInArrow(run, f"doc_id {kind}, hash long, position long")


def range_edges(rows: DataFrame, ranges: int, count: int) -> list[tuple]:
    """Rows that cut the table into about so many ranges, as (has an id, id, head of the text), ascending; drawn by hash."""
    every = max(1, count // (ranges * DRAWN))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("doc_id", F.substring("text", 1, HEAD).alias("head")).distinct().collect()
    keys = sorted((r.doc_id is not None, r.doc_id, r.head) for r in drawn)
    step = max(1, len(keys) // ranges)
    return keys[step::step]


def with_next(docs: DataFrame) -> DataFrame:
    """Every row with the text of the next document, in descending order of doc_id; after the last comes the first.

    Rows are cut into ranges at sampled rows, by id and the text's first characters, so that neither repeated nor missing ids make
    a range large. A window orders each range; the first row of a range follows the last of the range before. What the driver holds is
    a few short keys for each of MAX_RANGES ranges at most.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("rows")).first()
    ranges = min(MAX_RANGES, max(1, (size.chars or 0) // RUN_CHARS))
    edges = range_edges(rows, ranges, size.rows) if ranges > 1 else []
    some_id = next((e[1] for e in edges if e[0]), None)

    @F.pandas_udf("int")
    def place(there: pd.Series, ids: pd.Series, heads: pd.Series) -> pd.Series:
        found = [bisect_right(edges, (t, i if t else None, h)) for t, i, h in zip(there, ids, heads, strict=True)]
        return pd.Series([len(edges) - x for x in found], dtype="int32")

    # a null would turn whole numbers into floating ones on their way to Python
    filled_id = F.col("doc_id") if some_id is None else F.coalesce("doc_id", F.lit(some_id).cast(docs.schema["doc_id"].dataType))
    ranged = rows.withColumn("run", place(F.col("doc_id").isNotNull(), filled_id, F.substring("text", 1, HEAD)) if edges else F.lit(0))
    w = Window.partitionBy("run").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    inside = ranged.withColumn("next", F.lead("text").over(w))
    known = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))
    top = ranged.groupBy("run").agg(F.max(known).alias("top"))
    first = ranged.join(F.broadcast(top), "run").where(known.eqNullSafe(F.col("top"))).groupBy("run").agg(F.max("text").alias("first"))
    # every range holds the edge that begins it; only the last may be empty
    filled = len(edges) + (0 if edges and ranged.where(F.col("run") == len(edges)).isEmpty() else 1)
    following = first.select(F.pmod(F.col("run") - 1, F.lit(filled)).alias("run"), "first")
    return inside.join(following, "run").select("doc_id", "text", F.coalesce("next", "first").alias("next"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of each text and of its edited text, and their likenesses."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(spread(docs)).select("doc_id", "text", "next", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)).alias("edited"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_text, kept = None, None
        for batch in small(batches):
            out = [[] for _ in names[2:]]
            for text, following, edited in zip(*(batch[c].to_pylist() for c in ("text", "next", "edited")), strict=True):
                # rows come in order, so what follows one document is mostly the next row's own text
                own = kept if text == kept_text else sketch(text)
                kept_text, kept = following, own if following == text else sketch(following)
                other = sketch(edited)
                for x, v in zip(out, (sha256(edited.encode()).hexdigest(), own.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(own, other), likeness(own, kept)), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_chars"], *(pa.array(x, t) for x, t in zip(out, (pa.string(),) * 3 + (pa.float64(),) * 2, strict=True))], names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
