"""Embedding whitening by a tiled covariance.

Every entry c becomes the whole number floor(64 c) + 1000000, so sums are exact. Pairs of dimensions are cut into tiles: rows come in
row-blocks, each row-block in column blocks of TILE dimensions, shuffled by row-block; where two column blocks of one row-block
meet they are centred and multiplied, products are summed per tile, and the driver puts the tiles together. What it holds is a
matrix of the vectors' width squared, however many rows there are. Components are the eigenvectors of that matrix by falling
eigenvalue; a row's whitened values are its projections over the root of the eigenvalue. The covariance of the whitened
values is measured by the same tiles, which gives identity_error.

Rules for odd input: rows whose vector is null, empty or holds null, NaN or infinite entries go; so do vectors of another
length than most have (a tie goes to the longer); entries are held within 2^40 / 64 either way; components whose eigenvalue is no
more than RANK of the largest (constant or dependent dimensions) are left out, so equal vectors alone give no rows; a deviation beyond
a long is null; repeated rows count and are returned each; a null id stays; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import small, spread

SCALE, SHIFT = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 32
#: Dimensions of a column block and rows of a row-block.
TILE, BLOCK_ROWS = 16, 4096
#: Products that a task holds, as tiles, before it hands them on.
HELD_TILES = 1024
LARGEST = float(1 << 40)
RANK = 1e-11

Matrix = Callable[[pa.RecordBatch], np.ndarray]


def usable(rows: DataFrame, id_name: str = "vec_id", name: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that can be fitted."""
    v = F.col(name)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(id_name).alias("vec_id"), v.cast("array<double>").alias("vector"))


def whole_numbers(batch: pa.RecordBatch) -> np.ndarray:
    """floor(64 c) + 1000000 of a batch's vectors, one row each."""
    flat = batch["vector"].flatten().to_numpy(zero_copy_only=False)
    x = np.floor(np.clip(flat * SCALE, -LARGEST, LARGEST)).astype(np.int64) + SHIFT
    return x.reshape(batch.num_rows, -1)


def column_sums(rows: DataFrame, matrix: Matrix, kind: str) -> list:
    """The sum of each column of the matrices that batches give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = matrix(batch).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["dim", "s"])

    found = rows.mapInArrow(run, f"dim int, s {kind}").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)") if kind == "long" else F.col("s")).alias("s"))
    return [r.s for r in sorted(found.collect(), key=lambda r: r.dim)]


def covariance(rows: DataFrame, matrix: Matrix, centre: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of the columns of the matrices that batches give, each column less its centre before it is multiplied."""
    width = len(centre)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in small([batch], BLOCK_ROWS):
                z = matrix(part)
                if z.dtype == np.int64 and np.abs(z).max(initial=0) < 1 << 31:
                    z = z.astype(np.int32)
                cols = [np.ascontiguousarray(z[:, a : a + TILE].T).tobytes() for a in range(0, width, TILE)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(cols)), pa.array(np.arange(len(cols), dtype=np.int32)), pa.array([z.dtype.str] * len(cols)), pa.array(cols, pa.binary())], ["block", "col", "kind", "data"])
                block += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            if held:
                at = np.array(list(held), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array([m.ravel().tolist() for m in held.values()])], ["i", "j", "cells"])
                held.clear()

        def centred(kind: str, data: bytes, col: int) -> np.ndarray:
            mid = centre[col * TILE : (col + 1) * TILE]
            return np.frombuffer(data, kind).reshape(len(mid), -1) - mid[:, None]

        for batch in batches:
            for row in batch.to_pylist():
                i, j = row["i"], row["j"]
                product = centred(row["kind"], row["left"], i) @ centred(row["kind"], row["right"], j).T
                held[i, j] = held[i, j] + product if (i, j) in held else product
                if len(held) > HELD_TILES:
                    yield from hand_on()
        yield from hand_on()

    blocks = rows.mapInArrow(cut, "block long, col int, kind string, data binary")
    left, right = blocks.select("block", "kind", F.col("col").alias("i"), F.col("data").alias("left")), blocks.select("block", F.col("col").alias("j"), F.col("data").alias("right"))
    pairs = left.join(right, "block").where(F.col("i") <= F.col("j"))
    sums = pairs.select("i", "j", "kind", "left", "right").mapInArrow(multiply, "i int, j int, cells array<double>").select("i", "j", F.posexplode("cells").alias("cell", "s")).groupBy("i", "j", "cell").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width))
    got = sums.toPandas()
    per = np.minimum(TILE, width - got["j"].to_numpy() * TILE)
    a, b = got["i"].to_numpy() * TILE + got["cell"].to_numpy() // per, got["j"].to_numpy() * TILE + got["cell"].to_numpy() % per
    out[a, b] = out[b, a] = got["s"].to_numpy() / n
    return out


def exact_deviation(y: np.ndarray, rest: list[int], n: int) -> list[int | None]:
    """Sum over dimensions of (n y - rest)^2 for each row, in whole numbers; null beyond a long."""
    most = int(np.abs(y).max(initial=0))
    wide = max(most * most, most * max(rest, default=0)) * y.shape[1] >= 1 << 62
    y = y.astype(object) if wide else y
    squares, cross, constant = (y * y).sum(1).tolist(), (y * np.array(rest, object if wide else np.int64)).sum(1).tolist(), sum(r * r for r in rest)
    found = (n * n * a - 2 * n * b + constant for a, b in zip(squares, cross, strict=True))
    return [d if d < 1 << 63 else None for d in found]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    spark = rows.sparkSession
    fit = spread(usable(rows))
    kind = fit.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = fit.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if not lengths:
        return spark.createDataFrame([], schema)
    width, n = lengths.width, lengths.n
    fit = fit.where(F.size("vector") == width)
    total = [int(s) for s in column_sums(fit, whole_numbers, "long")]
    floor, rest = np.array([s // n for s in total]), [s % n for s in total]
    # whole numbers less the floor of their mean are small, so nothing is lost when the rest of the mean goes too
    over = np.array([r / n for r in rest])

    def near_mean(batch: pa.RecordBatch) -> np.ndarray:
        return whole_numbers(batch) - floor

    v = covariance(fit, near_mean, over, n)
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1], vectors[:, ::-1]
    kept = int((e[:components] > max(e[0], 0) * RANK).sum()) if e[0] > 0 else 0
    if not kept:
        return spark.createDataFrame([], schema)
    to_white = vectors[:, :kept] / np.sqrt(e[:kept])
    explained = e[:kept] / np.trace(v)

    def white(batch: pa.RecordBatch) -> np.ndarray:
        return (near_mean(batch) - over) @ to_white

    means = np.array(column_sums(fit, white, "double")) / n
    error = float(np.abs(covariance(fit, white, means, n) - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, BLOCK_ROWS):
            k = batch.num_rows
            at = pa.array(np.repeat(np.arange(k), kept))
            deviation = pa.array(exact_deviation(near_mean(batch), rest, n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(at), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), k)), pa.array(np.full(k * kept, n)), deviation.take(at), pa.array(white(batch).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * kept, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return fit.mapInArrow(run, schema)
