"""Tables in the shared folder that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file of a staged table of numbers, and of one of texts.
ROWS_PER_FILE, TEXTS_PER_FILE = 1 << 18, 1 << 13
#: Bytes of the batches that Spark hands to a worker, whatever the length of the texts or blocks.
BATCH_BYTES = 8 << 20
# By application: the folder of tests, and what has been staged.
_local: dict[str, str] = {}
_paths: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and the master is local (tests), a folder of this session's own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _local.get(spark.sparkContext.applicationId)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="strandweave-")
            atexit.register(shutil.rmtree, folder, True)
            base = _local[spark.sparkContext.applicationId] = f"file://{folder}"
    return f"{base.rstrip('/')}/strandweave"


def _made(spark: SparkSession) -> list[str]:
    """Paths that this application has staged and not dropped; a stream's batches run in sessions of their own."""
    return _paths.setdefault(spark.sparkContext.applicationId, [])


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path that nothing else uses."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def packed(df: DataFrame, rows: int, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """df, of about so many rows, in no more partitions than it fills with `per_file` rows each: a small table is not
    written as a file for each shuffle partition."""
    return df.coalesce(max(1, -(-rows // per_file)))


def staged(df: DataFrame, tag: str, rows: int | None = None, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; packed, if about how many rows it has is known."""
    path = shared_path(df.sparkSession, tag)
    (df if rows is None else packed(df, rows)).write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made(spark):
        _made(spark).remove(path)


def bounded(spark: SparkSession) -> None:
    """Have Spark cut Arrow batches by bytes too, so that very long texts or blocks don't fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def released(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of what is no longer referred to: else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scope:
    """Staged tables of one computation: `with Scope(spark) as s` drops all but those that s.keep() names."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scope:
        self.before = len(_made(self.spark))
        self.kept: set[str] = set()
        return self

    def keep(self, df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
        """Stage df; it outlives the scope."""
        out = staged(df, tag, rows)
        self.kept.add(_made(self.spark)[-1])
        return out

    def __exit__(self, *failure) -> None:
        for path in _made(self.spark)[self.before :]:
            if path not in self.kept:
                drop_path(self.spark, path)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has staged, indexed graphs included; results that still read it are lost."""
    spark.__dict__.pop("_strandweave_graphs", None)
    for t in spark.catalog.listTables(pattern="strandweave_*"):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    for path in list(_made(spark)):
        drop_path(spark, path)
