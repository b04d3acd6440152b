"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Pieces of equal length are interchangeable, so the plan needs only how many pieces there are of each length (at most as many
numbers as a sequence has tokens). The driver packs those counts by best-fit decreasing: the longest first, each into the
tightest open sequence, which the segment tree finds in logarithmic time. Spark numbers the pieces of each length and looks up
their places.

Rules for odd input: a null text is empty and still gets its end id; repeated rows are packed each on its own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.llm.bpe import encoder
from evidara.llm.common import materialise, small, spread

CAPACITY = 2048
END_ID = 0
#: Rows that are encoded together: few, as packing follows stages that leave little of an executor's memory.
TOGETHER = 300
#: Pieces in a bucket within which ranks are counted, on average.
BUCKET_ROWS = 5_000


class OpenSequences:
    """A segment tree over capacities 0..size: which of them have open sequences."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << (size + 1).bit_length()
        self.some = [False] * (2 * self.leaves)

    def put(self, capacity: int, there: bool) -> None:
        i = capacity + self.leaves
        self.some[i] = there
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least this that has an open sequence."""
        i = least + self.leaves
        if self.some[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.some[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(first item, items per sequence, first sequence, first offset, length) of runs of items.

    Items are numbered from the longest to the shortest. Sequences filled alike are kept together as (first, number).
    """
    tree = OpenSequences(capacity)
    ready: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]
    runs, item, opened = [], 0, 0

    def leave(capacity_left: int, first: int, number: int) -> None:
        if capacity_left and number:
            ready[capacity_left].append((first, number))
            tree.put(capacity_left, True)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # open as many as the rest of this length fills
                room = capacity
                first, number = opened, -(-left // (capacity // length))
                opened += number
            else:
                first, number = ready[room].popleft()
                tree.put(room, bool(ready[room]))
            per = room // length
            full = min(number, left // per)
            if full:
                runs.append((item, per, first, capacity - room, length))
                item, left = item + full * per, left - full * per
                leave(room - per * length, first, full)
            first, number = first + full, number - full
            if left and number:  # fewer than one sequence takes
                runs.append((item, left, first, capacity - room, length))
                leave(room - left * length, first, 1)
                item, left, first, number = item + left, 0, first + 1, number - 1
            if number:
                ready[room].appendleft((first, number))
                tree.put(room, True)
    return runs


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    docs = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = int(END_ID).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in small(batches, TOGETHER):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(enc.encode_batch(batch["text"])):
                data = ids + end
                for p, b in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[b : b + 4 * capacity]
                    at.append(i)
                    piece.append(p)
                    start.append(b // 4)
                    length.append(len(part) // 4)
                    crc.append(crc32(part))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    spark = docs.sparkSession
    found = materialise(pieces(docs, path, capacity), "pieces")
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    runs = plan(counts, capacity)
    sent = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5).T.copy())
    firsts, at = {}, 0
    for length in sorted(counts, reverse=True):
        firsts[length], at = at, at + counts[length]

    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = spark.createDataFrame(list(firsts.items()) or [(0, 0)], "length long, first long")
    offsets = sizes.withColumn("before", before).join(F.broadcast(first), "length").select("length", "bucket", (F.col("first") + F.col("before")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    numbered = dealt.withColumn("rank", rank).join(offsets, ["bucket", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("item"))
    kind = found.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, per, seq, offset, length = sent.value
        for batch in batches:
            x = batch["item"].to_numpy()
            run = np.searchsorted(item, x, side="right") - 1
            k = x - item[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq[run] + k // per[run]), pa.array(offset[run] + k % per[run] * length[run])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
