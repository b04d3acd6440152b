"""Tables that change: versions under a manifest, written once, read whole.

A table is a folder with parts (Parquet, one folder for each partition value that a commit rewrote) and manifests, one small JSON file for each version.
A commit writes its parts first and then creates the next manifest, which must not be there yet: that is the one step that makes it
visible. So a run that is killed leaves the old version (its parts are never read), two writers cannot both make one version, and a commit
with the name of one that is in the manifest does nothing, which makes repeats harmless, also from foreachBatch. All files are reached by
Hadoop's file system of the table's path, which on a cluster must be one that creates files exclusively.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Commits that a manifest remembers; older names could be used again.
REMEMBERED = 10_000
ATTEMPTS = 20
#: Seconds after which a claim without a manifest counts as left by a writer that died.
STALE = 60.0


class Conflict(RuntimeError):
    """Another writer was faster too often."""


class VersionedTable:
    """Rows of one schema, by the values of one partition column (null is a value too)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, partition: str) -> None:
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))

    def version(self) -> int:
        """The number of the last manifest; 0 before the first commit."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/manifests"))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """parts (partition value to folders) and commits of a version."""
        version = self.version() if version is None else version
        if not version:
            return {"parts": {}, "commits": []}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, content: dict) -> bool:
        """Whether this manifest was the first of its version. A claim, created exclusively, says who may move the manifest to its name; the claim
        of a writer that died is taken away after STALE seconds."""
        target, claim = self._path(f"{self.path}/manifests/{version:010d}.json"), self._path(f"{self.path}/manifests/{version:010d}.claim")
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError:
            if self._fs.exists(claim) and not self._fs.exists(target) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > STALE:
                self._fs.delete(claim, False)
            return False
        if self._fs.exists(target):
            return False
        own = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(own, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return bool(self._fs.rename(own, target))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one unless another is named."""
        folders = [p for some in self.manifest(version)["parts"].values() for p in some]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in folders))

    def _values(self, rows: DataFrame) -> dict[str, object]:
        """The partition values of rows, by their name in the manifest."""
        return {json.dumps(r[0], default=str): r[0] for r in rows.select(self.partition).distinct().collect()}

    def _rewrite(self, name: str, touched: Callable[[dict], dict[str, object]], change: Callable[[DataFrame, dict], DataFrame]) -> int:
        """Replace the parts of the touched partition values by what change makes of their rows; the version that holds the commit."""
        for _ in range(ATTEMPTS):
            version = self.version()
            held = self.manifest(version)
            if name in held["commits"]:
                return version
            values = touched(held)
            old = [p for v in values for p in held["parts"].get(v, [])]
            before = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in old)) if old else self.spark.createDataFrame([], self.schema)
            after = change(before, values).select(*(f"`{n}`" for n in self.schema.names))
            folder = f"data/{uuid.uuid4().hex}"
            after.withColumn("_part", F.to_json(F.struct(F.col(self.partition).alias("v")))).write.partitionBy("_part").parquet(f"{self.path}/{folder}")
            made = {r[0]: r[1] for r in self._made(folder)}
            parts = {k: v for k, v in held["parts"].items() if k not in values} | {k: [p] for k, p in made.items()}
            if self._publish(version + 1, {"parts": parts, "commits": [*held["commits"], name][-REMEMBERED:]}):
                return version + 1
            time.sleep(0.1)
        raise Conflict(f"{self.path}: {ATTEMPTS} versions were made by others meanwhile")

    def _made(self, folder: str) -> list[tuple[str, str]]:
        """(partition value, folder) of what a write has made."""
        out = []
        for status in self._fs.listStatus(self._path(f"{self.path}/{folder}")):
            name = status.getPath().getName()
            if name.startswith("_part="):
                value = json.loads(self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name.removeprefix("_part="))).get("v")
                out.append((json.dumps(value, default=str), f"{folder}/{name}"))
        return out

    def upsert(self, rows: DataFrame, key: list[str], commit: str, order: str | None = None) -> int:
        """Add rows; of rows with one key the incoming one stays, of several incoming ones the last by order. A null key is a key."""
        rows = rows.select(*(f"`{n}`" for n in self.schema.names))

        def change(before: DataFrame, _: dict) -> DataFrame:
            both = before.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
            last = Window.partitionBy(*key).orderBy(F.col("_new").desc(), F.col(order or key[0]).desc(), F.xxhash64(*self.schema.names))
            return both.withColumn("_at", F.row_number().over(last)).where("_at = 1")

        return self._rewrite(commit, lambda _: self._values(rows), change)

    def delete(self, condition: str, commit: str) -> int:
        """Remove the rows for which the condition is true (not those for which it is unknown); only partitions that hold some are rewritten."""
        hit = F.coalesce(F.expr(condition), F.lit(False))
        return self._rewrite(commit, lambda held: self._values(self.read().where(hit)) if held["parts"] else {}, lambda before, _: before.where(~hit))

    def drop_partition(self, value: object, commit: str) -> int:
        """Remove a partition value; nothing is read or written but the manifest."""
        return self._rewrite(commit, lambda held: {json.dumps(value, default=str): value}, lambda before, _: before.limit(0))

    def save_batch(self, rows: DataFrame, key: list[str], value: str, commit: str) -> dict[str, int]:
        """All or nothing: rows with new keys are added unless any row conflicts, with one that is there or within the batch.

        How many keys were inserted, unchanged and conflicted; a batch with conflicts leaves the table as it was.
        """
        rows = rows.select(*(f"`{n}`" for n in self.schema.names))
        batch = rows.groupBy(*key).agg(F.count_distinct(value).alias("_values"), F.count_if(F.col(value).isNull()).alias("_nulls"), F.min(value).alias("_value"))
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in key]
        there = self.read().select(*key, F.col(value).alias("_old"), F.lit(True).alias("_there")).alias("t")
        joined = batch.alias("b").join(there, same, "left")
        torn = (F.col("_values") + F.least("_nulls", F.lit(1))) > 1
        outcome = F.when(torn, "conflicted").when(F.col("_there").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.col("_value")), "unchanged").otherwise("conflicted")
        found = {r.outcome: r.n for r in joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n")).collect()}
        counts = {k: found.get(k, 0) for k in ("inserted", "unchanged", "conflicted")}
        if counts["inserted"] and not counts["conflicted"]:
            self.upsert(rows, key, commit)
        return counts

    def sink(self, key: list[str], name: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: each batch is one commit, so a batch that runs again changes nothing."""
        return lambda rows, batch: self.upsert(rows, key, f"{name}/{batch}") and None


def put_artifacts(table: VersionedTable, rows: DataFrame, commit: str) -> int:
    """Content-addressed blobs: tenant, source_sha256 and content. The address is the digest of the content; what is there already is not
    written again, and equal blobs of one tenant and source are one."""
    addressed = rows.where("content IS NOT NULL").select(F.col("tenant_id"), "source_sha256", F.sha2("content", 256).alias("artifact_sha256"), "content")
    return table.upsert(addressed, ["tenant_id", "source_sha256", "artifact_sha256"], commit)


ARTIFACTS = T.StructType([T.StructField("tenant_id", T.LongType()), T.StructField("source_sha256", T.StringType()), T.StructField("artifact_sha256", T.StringType()), T.StructField("content", T.BinaryType())])
