"""Chunking, deduplication, conversations and document trees."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions import text as T


def chunks(docs: DataFrame, size: int = 900, overlap: int = 0) -> DataFrame:
    """Fixed windows of each document with stable ids."""
    each = docs.select("doc_id", F.posexplode(T.windows(F.coalesce("text", F.lit("")), size, overlap)).alias("chunk", "text"))
    return each.select("doc_id", "chunk", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk").cast("string"), F.col("text")), 256).alias("chunk_id"), F.length("text").cast("long").alias("n_chars"), "text")


def deduplicate(df: DataFrame, order: list[Column], least: int = 40) -> DataFrame:
    """The first row of each normal content of at least so many characters."""
    keyed = df.withColumn("_k", T.content_hash("text")).where(F.length(T.normal("text")) >= least)
    w = Window.partitionBy("_k").orderBy(*order)
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_k")


def by_authority(df: DataFrame) -> DataFrame:
    """Of equal content of a company the public row stays, then the least id."""
    w = Window.partitionBy("source", T.content_hash("text")).orderBy(F.when(F.col("tenant_id") == 0, 2).otherwise(1).desc(), "doc_id")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def private_without_public(df: DataFrame) -> DataFrame:
    """Private rows whose content the public corpus of the same company does not have."""
    keyed = df.withColumn("_k", T.content_hash("text"))
    public = keyed.where("tenant_id = 0").select("source", "_k").distinct()
    return keyed.where("tenant_id <> 0").join(public, ["source", "_k"], "left_anti").drop("_k")


def registry(docs: DataFrame) -> DataFrame:
    """One row for each tenant and content: the least id stands for all."""
    return docs.groupBy("tenant_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows replace old's of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(df: DataFrame, where: Column) -> DataFrame:
    """What is left when the rows that match are taken out; a condition that cannot be decided keeps its row."""
    return df.where(~F.coalesce(where, F.lit(False)))


def same_rows(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with repeats: empty for equal tables."""
    return expected.exceptAll(stored).withColumn("side", F.lit("missing")).unionByName(stored.exceptAll(expected).withColumn("side", F.lit("extra")))


def chat_text(messages: DataFrame) -> DataFrame:
    """Each conversation as one training text: a mark and the content of each turn, then the end mark."""
    g = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    turn = F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), F.coalesce(x["text"], F.lit(""))))
    return g.select("conv_id", F.concat(F.array_join(turn, "\n"), F.lit("\n<|end|>")).alias("text"))


def chat_shape(messages: DataFrame) -> DataFrame:
    """Whether each conversation is well formed: a system turn only first, then user and assistant in turn, assistant last."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.select("conv_id", "turn", "role", F.row_number().over(w).alias("at"), F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))
    first = F.coalesce("before", F.lit("system")) == "system"
    fine = F.when(F.col("role") == "system", F.col("at") == 1).when(F.col("role") == "user", first | (F.col("before") == "assistant")).when(F.col("role") == "assistant", F.col("before") == "user").otherwise(False)
    return m.groupBy("conv_id").agg(F.every(F.coalesce(fine & (F.col("after").isNotNull() | (F.col("role") == "assistant")), F.lit(False))).alias("valid"), F.count("*").alias("turns"))


def islands(rows: DataFrame, partition: list[str], order: list[Column], label: str) -> DataFrame:
    """Runs of neighbours with one label: its first place, its last and its size."""
    w = Window.partitionBy(*partition).orderBy(*order)
    begun = rows.withColumn("_at", F.row_number().over(w)).withColumn("_new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    run = begun.withColumn("island", F.sum("_new").over(w))
    return run.groupBy(*partition, "island", label).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("size"))


def written(df: DataFrame) -> DataFrame:
    """The rows computed once and written to the shared folder: what follows does not compute them again, knows their size, and lost executors do no harm."""
    return tabled(df, "written")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores dealt over the cores; larger ones stay as they are. For work that costs far more than to move rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own stands in only where all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="evidara-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def tabled(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows written as a table in the shared folder and read again, for what several parts of a plan read."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def descend(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes under the roots with their depth and path, level by level until a level is empty; a node on its own path ends the descent.

    nodes: node_id, parent_id. roots: node_id.
    """
    level = written(roots.select("node_id", F.lit(0).alias("depth"), F.array("node_id").alias("path")))
    found = level
    while not level.isEmpty():
        up = level.select(F.col("node_id").alias("parent_id"), "depth", "path")
        below = nodes.join(up, "parent_id").where(~F.array_contains("path", F.col("node_id")))
        level = written(below.select("node_id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("node_id")).alias("path")))
        found = found.unionByName(level)
    return found.select("node_id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that more than one row has, and how many; rows without an id count as one group."""
    return rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key and the name of every check that a row fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return rows.select(key, F.explode(failed).alias("violation"))


def vector_audit(vectors: DataFrame) -> DataFrame:
    """What an index needs of its vectors: one size, finite and not all zero, ids once."""
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.agg(
        F.count("*").alias("vectors"),
        F.count_distinct(F.size("embedding")).alias("sizes"),
        F.count_if(~finite).alias("not_finite"),
        F.count_if(F.forall("embedding", lambda x: x == 0)).alias("zero"),
        (F.count("*") - F.count_distinct("vec_id")).alias("repeated_ids"),
    )
