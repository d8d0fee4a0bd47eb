"""Tables and files in the folder that driver and executors share (spark.checkpoint.dir).

Lineage is cut by writing a table there and reading it back: the copy is in reliable storage, so a lost
executor costs nothing but the rerun of its tasks.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset (tests, one machine)."""
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    return _own[app]


def _path(spark: SparkSession, uri: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Workspace:
    """A folder of one operator call: cut(df) writes a table there, drop(df) removes one that nothing needs now."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._at: dict[int, str] = {}

    def cut(self, df: DataFrame, *by: str) -> DataFrame:
        """The same rows, read back from shared storage; a filter on columns `by` reads only the folders that it needs."""
        self._n += 1
        at = f"{self.root}/{self._n:03d}"
        (df.write.partitionBy(*by) if by else df.write).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self._at[id(out)] = at
        out._tallyloom_keep = self
        return out

    def together(self, frames: list[DataFrame]) -> DataFrame:
        """The rows of tables of one schema that were cut here, as one read."""
        out = self.spark.read.schema(frames[0].schema).parquet(*[self._at[id(f)] for f in frames])
        out._tallyloom_keep = self
        return out

    def release(self) -> None:
        """Let Spark delete the shuffle files of jobs whose results are cut: it does when the driver's unused objects go."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            at = self._at.pop(id(df), None) if df is not None else None
            if at:
                fs, path = _path(self.spark, at)
                fs.delete(path, True)


def share_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Put a small file in the shared folder and register it with Spark's file cache; workers open SparkFiles.get(name)."""
    uri = f"{shared_dir(spark)}/files/{name}"
    fs, path = _path(spark, uri)
    if not fs.exists(path):
        half = _path(spark, f"{uri}.{uuid.uuid4().hex}")[1]
        out = fs.create(half)
        try:
            for i in range(0, len(data), 1 << 20):
                out.write(bytearray(data[i : i + (1 << 20)]))
        finally:
            out.close()
        if not fs.rename(half, path):
            fs.delete(half, False)
    spark.sparkContext.addFile(uri)
    return name
