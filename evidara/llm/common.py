"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch that are turned into Python objects at once.
BATCH_ROWS = 500

#: Spark's limit of a batch that goes to Python, and ours.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

U64 = np.uint64
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, spread over the cores if it has fewer partitions than there are cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of very few partitions over the cores; larger tables stay as they are.

    Where the session has no limit of its own, rows go to Python in batches of a few megabytes, as a batch of whole texts is held several
    times over, on both sides.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, f"{64 << 20}b") in (str(64 << 20), f"{64 << 20}b"):
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, as whole texts take several times their size as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Give back to the system what a task's batches held: Python workers live on, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: What modules hold in a Python worker between tasks and can do without.
DROP: list[Callable[[], None]] = []


def drop_held() -> None:
    for drop in DROP:
        drop()


def lean(run: Batches) -> Batches:
    """A task that begins without what others have left in its worker, and leaves nothing itself."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def by_size(batches: Iterable[pa.RecordBatch], most: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many bytes of a binary column, or of one row."""
    for batch in batches:
        if batch.num_rows:
            offsets = np.frombuffer(batch[name].buffers()[1], np.int32)[batch[name].offset :][: batch.num_rows + 1]
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
                yield batch.slice(at, stop - at)
                at = stop
    release()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A folder of our own stands in only where all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="evidara-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:") == shared_dir(spark).removeprefix("file://").removeprefix("file:"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_of(df: DataFrame, names: list[str] | tuple[str, ...]) -> Column:
    """A struct of the named columns; a name may hold dots or clash with those made here."""
    return F.struct(*(df[f"`{n.replace('`', '``')}`"] for n in names))


def remainder_of_id(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def text_bytes(df: DataFrame, *keep: Column) -> DataFrame:
    """The named columns and the text as UTF-8 bytes, null as empty."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


class BitMap:
    """A bit map of 64-bit names: says no only of names that are not in it. The number of bits is a power of two."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @classmethod
    def of(cls, names: DataFrame, size: int) -> BitMap:
        at = [F.pmod("name", F.lit(size)), F.pmod(F.shiftrightunsigned("name", 32), F.lit(size))]
        place = names.select(F.explode(F.array(*at)).alias("place")).select((F.col("place") + 1).alias("place"))
        rows = place.groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits")).toArrow()
        bits = np.zeros((size // 32768, 4096), np.uint8)
        for bucket, some in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
            bits[bucket - 1] = np.frombuffer(some, np.uint8)
        return cls(bits.ravel())

    def may_hold(self, names: np.ndarray) -> np.ndarray:
        out, last = np.ones(len(names), bool), U64(8 * len(self.bits) - 1)
        for at in (names & last, names >> U64(32) & last):
            out &= self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1 == 1
        return out
