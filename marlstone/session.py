"""Session helpers that every part of the library shares."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Where a local session without spark.checkpoint.dir, as in tests, keeps checkpoints.
UNSET = "/tmp/checkpoints"
ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it outside PYTHONPATH."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    if spark.conf.get(BATCH_OPTION, None) == BATCH_DEFAULT:  # a caller's own setting stays
        spark.conf.set(BATCH_OPTION, str(BATCH_BYTES))


#: Tables of texts, whose rows cost far more to work on than to move.
TEXTS = ("documents", "pages", "conversations")
#: Bytes of a table up to which it is dealt out, and of what a task then gets at least.
SMALL_TABLE, LEAST_SHARE = 256 << 20, 256 << 10
#: Bytes of input that a task of many small files or partitions gets, so that it doesn't write as many small files again.
FILE_BYTES = 4 << 20
BATCH_OPTION, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Bytes of an Arrow batch to and from Python workers, which bounds what both sides hold.
BATCH_BYTES = 8 << 20


def size_of(df: DataFrame) -> int:
    """The planner's estimate of a DataFrame's bytes; for a table on disk, those of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def files_for(df: DataFrame) -> int:
    """How many pieces of FILE_BYTES a table has, as many as cores at least; without bound where the size isn't known."""
    return max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size_of(df) // FILE_BYTES), 1 << 30))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; a small one of texts in fewer pieces than half the cores is dealt out to more of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in TEXTS:
        return df
    size = size_of(df)
    pieces = min(spark.sparkContext.defaultParallelism, -(-size // LEAST_SHARE))
    return df.repartition(pieces) if size <= SMALL_TABLE and 2 * df.rdd.getNumPartitions() <= pieces else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, set as the checkpoint folder too."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named or UNSET)
    return named or UNSET


class Folder:
    """A folder on any file system that Spark knows, with the few operations that the driver needs."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.top = self._path(path)
        self._fs = self.top.getFileSystem(spark._jsc.hadoopConfiguration())
        self._charset = spark._jvm.java.nio.charset.StandardCharsets.UTF_8
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    def path(self, name: str) -> str:
        return self._at(name).toString()

    def _at(self, name: str):
        return self._path(self.top, name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.top)) if self._fs.exists(self.top) else []

    def modified(self, name: str) -> float:
        """Seconds since 1970."""
        return self._fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        held = self._fs.open(self._at(name))
        try:
            return self._io.toString(held, self._charset)
        except Py4JJavaError as e:
            if "ChecksumException" in str(e.java_exception):
                raise ValueError(f"{name} doesn't agree with its checksum") from e
            raise
        finally:
            held.close()

    def write(self, name: str, text: str) -> None:
        """Write beside the file and put it in its place, so that no reader sees a part of it."""
        beside = self._at(f".{name}.{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        if not self._fs.rename(beside, self._at(name)):  # some stores don't replace
            self._fs.delete(self._at(name), False)
            self._fs.rename(beside, self._at(name))

    def delete(self, name: str) -> bool:
        return self._fs.delete(self._at(name), True)

    def remove_if_empty(self) -> None:
        if self._fs.exists(self.top) and not self.names():
            self._fs.delete(self.top, False)


#: Removes a query's shuffle files when it ends; otherwise they stay until the driver happens to collect its garbage.
CLEANUP_OPTION = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, files: int | None = None) -> DataFrame:
    """An eager checkpoint in the shared folder, in no more than `files` files if that is given. The shuffle files behind it go, for nothing reads them again."""
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_OPTION, None)
    conf.set(CLEANUP_OPTION, "true")
    try:
        # a DataFrame goes by the option as it is when the DataFrame is made
        return (df.coalesce(max(1, files)) if files is not None else df.select("*")).checkpoint(eager=True)
    finally:
        if before is None:
            conf.unset(CLEANUP_OPTION)
        else:
            conf.set(CLEANUP_OPTION, before)
