"""Sharding by size-tiered compaction.

A store is a folder: `data/<attempt>/` holds immutable Parquet shards, `manifest/v<n>` one Parquet table per
version with a row per live shard (path under `data/`, bytes, rows, tier, and how many files its attempt wrote).
`append` writes arrivals as small shards. `compact` takes a tier with at least FANOUT runs of similar size and
merges them to runs of the next tier, the last being TARGET_BYTES: whole runs are packed up to that size, one task
writes each pack as one file, and nothing is shuffled.

Every attempt at a version writes to a folder of its own, and a commit names only files of that folder; what a job
that died has left there is in no manifest. A version becomes visible by one rename that fails if the version
exists, so of two writers one commits and readers see a whole version or the one before. A writer that comes too
late tries again on the new version: an append keeps its files, a compaction chooses its runs anew. `vacuum`
deletes shards that no kept version names, except those of attempts at a version that is still open. A store needs
a file system with atomic rename.

DataFrame code only; file names and renames go through Hadoop's file system API. Null values, long texts,
repeated rows and any columns, `_metadata` included, are stored as they are. An empty append commits a version
without new rows; reading a store without shards gives an empty table of the given schema.
"""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandweave.llm.common import drop_path, shared_path

#: Rows of an arriving shard, runs that make a tier ripe, least size of a run of tier 1, size of a full shard.
ARRIVAL_ROWS, FANOUT, BASE_BYTES, TARGET_BYTES = 4096, 8, 8 << 20, 128 << 20

#: Packs merged by one job, which bounds its plan.
WAVE = 64

MANIFEST = "path string, bytes long, rows long, tier int, files int"


class Conflict(Exception):
    """Another writer has committed the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, base: int = BASE_BYTES, target: int = TARGET_BYTES):
        self.spark, self.root, self.fanout, self.base, self.target = spark, root.rstrip("/"), fanout, base, target

    # --- manifest ----------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        p, fs = self._fs(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{v:08d}")

    def commit(self, shards: DataFrame, on: int) -> int:
        """Make shards version on+1; raises Conflict if another writer has made it meanwhile."""
        jvm = self.spark._jvm
        tmp = shared_path(self.spark, "manifest")
        shards.select(*(c.split()[0] for c in MANIFEST.split(", "))).coalesce(1).write.parquet(tmp)
        src, fs = self._fs(tmp)
        dst, _ = self._fs(f"{self.root}/manifest/v{on + 1:08d}")
        fs.mkdirs(dst.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(src, dst, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if self.version() > on:
                raise Conflict(f"version {on + 1} exists") from e
            raise
        return on + 1

    def _attempt(self, on: int) -> str:
        """A folder name that no other attempt has; it begins with the version that it is meant for."""
        return f"{on + 1:08d}-{uuid.uuid4().hex}"

    def _written(self, attempt: str) -> DataFrame:
        """Rows for the manifest of the files that an attempt has written."""
        folder = f"{self.root}/data/{attempt}"
        name = lambda c: F.regexp_extract(c, "[^/]+$", 0).alias("name")  # noqa: E731  the two readers spell folders differently
        sizes = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(name(F.col("path")), F.col("length").alias("bytes"))
        rows = self.spark.read.schema("__sw_none int").parquet(folder).groupBy(name(F.input_file_name())).agg(F.count("*").alias("rows"))
        got = sizes.join(rows, "name", "left").select(F.concat(F.lit(f"{attempt}/"), "name").alias("path"), "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), self._tier(F.col("bytes")).alias("tier"))
        return got.withColumn("files", F.lit(got.count()))

    def _tier(self, size):
        """0 below BASE_BYTES, then one more for each factor FANOUT."""
        return F.when(size < self.base, 0).otherwise(F.floor(F.log(size / self.base) / F.log(F.lit(float(self.fanout)))) + 1).cast("int")

    # --- writing -----------------------------------------------------------------------------------

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Write df once; commit it on whatever version is the last."""
        on = self.version()
        attempt = self._attempt(on)
        df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(f"{self.root}/data/{attempt}")
        while True:
            try:
                return self.commit(self.manifest(on).unionByName(self._written(attempt)), on)
            except Conflict:
                on = self.version()
                old, attempt = attempt, self._attempt(on)  # under the old name vacuum could take it for a dead one
                src, fs = self._fs(f"{self.root}/data/{old}")
                if not fs.rename(src, self._fs(f"{self.root}/data/{attempt}")[0]):
                    raise

    def compact_once(self) -> bool:
        """Merge the lowest ripe tier; False if none is ripe."""
        on = self.version()
        now = self.manifest(on)
        small = now.where(F.col("bytes") < self.target // 2)
        ripe = small.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fanout).orderBy("tier").first()
        if ripe is None:
            return False
        runs = small.where(F.col("tier") == ripe.tier).select("path", "bytes").orderBy("path").collect()  # names and sizes only
        size = min(self.target, self.base * self.fanout ** (ripe.tier + 1))
        packs: list[list[str]] = []
        room = 0
        for r in runs:
            if r.bytes > room:
                packs.append([])
                room = size
            packs[-1].append(r.path)
            room -= r.bytes
        merged = [p for p in packs if len(p) > 1]
        attempt = self._attempt(on)
        gone = self.spark.createDataFrame([(x,) for p in merged for x in p], "path string")
        left = now.join(gone, "path", "left_anti")
        # a run without a partner of its size moves up a tier unchanged
        kept = left.withColumn("tier", F.when((F.col("tier") == ripe.tier) & (F.col("bytes") < self.target // 2), F.col("tier") + 1).otherwise(F.col("tier")))
        if merged:
            schema = self.spark.read.parquet(f"{self.root}/data/{merged[0][0]}").schema
            for k in range(0, len(merged), WAVE):
                parts = [self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{x}" for x in p)).coalesce(1) for p in merged[k : k + WAVE]]
                reduce(DataFrame.unionAll, parts).write.mode("append").option("compression", "zstd").parquet(f"{self.root}/data/{attempt}")
            kept = kept.unionByName(self._written(attempt).withColumn("tier", F.greatest("tier", F.lit(ripe.tier + 1))))
        try:
            self.commit(kept, on)
        except Conflict:
            drop_path(self.spark, f"{self.root}/data/{attempt}")  # its runs may be gone: choose anew
        return True

    def compact(self, keep: int | None = None) -> int:
        """Merge until no tier is ripe; with keep, drop what older versions alone need after each commit."""
        while self.compact_once():
            if keep:
                self.vacuum(keep)
        return self.version()

    def vacuum(self, keep: int = 1) -> None:
        """Delete versions but the last `keep`, and the shards that none of these names."""
        last = self.version()
        named = {r.path for v in range(max(1, last - keep + 1), last + 1) for r in self.manifest(v).select("path").collect()}
        p, fs = self._fs(f"{self.root}/data")
        for folder in fs.listStatus(p) if fs.exists(p) else ():
            attempt = folder.getPath().getName()
            if int(attempt[:8]) > last:
                continue  # of a writer that has yet to commit
            files = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
            dead = [f for f in files if f"{attempt}/{f.getName()}" not in named]
            for f in [folder.getPath()] if len(dead) == len(files) else dead:
                fs.delete(f, True)
        for v in range(last - keep, 0, -1):
            q, _ = self._fs(f"{self.root}/manifest/v{v:08d}")
            if not fs.exists(q):
                break
            drop_path(self.spark, q.toString())

    # --- reading -----------------------------------------------------------------------------------

    def read(self, schema, version: int | None = None) -> DataFrame:
        """Rows of a version. Spark gets the folders of attempts whose files are all live, and single files of others."""
        of = self.manifest(version).groupBy(F.substring_index("path", "/", 1).alias("attempt")).agg(F.count("*").alias("n"), F.max("files").alias("files"), F.collect_list("path").alias("paths"))
        whole = F.when(F.col("n") == F.col("files"), F.array("attempt")).otherwise(F.col("paths"))
        paths = [r.p for r in of.select(F.explode(whole).alias("p")).orderBy("p").collect()]
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)


def shard(docs: DataFrame, root: str | None = None, **sizes) -> DataFrame:
    """doc_id, shard_id, tier, shard_rows, shard_bytes, version: where each document is after compaction."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or shared_path(spark, "shards"), **sizes)
    store.append(docs)
    version = store.compact(keep=1)
    at = store.manifest(version).where("rows > 0").selectExpr("path", "row_number() over (order by path) - 1 as shard_id", "tier", "rows as shard_rows", "bytes as shard_bytes")
    placed = store.read(docs.schema, version).select("doc_id", F.regexp_extract(F.input_file_name(), "[^/]+/[^/]+$", 0).alias("path"))
    return placed.join(at, "path").select("doc_id", F.col("shard_id").cast("long").alias("shard_id"), "tier", "shard_rows", "shard_bytes", F.lit(version).cast("long").alias("version"))
