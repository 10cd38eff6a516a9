"""Session helpers: shared-folder staging, so that long lineages can be cut safely.

Every iterative operator writes its intermediate state as a Parquet table below the
folder named by ``spark.checkpoint.dir``. A committed table survives the loss of any
executor, carries file-size statistics that Catalyst uses to choose joins, and is
compressed and columnar, which a checkpointed RDD is not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder of its own (tests); on a
    cluster, whose executors would each write to their own disk, that is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="nodeloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Workspace:
    """Names the tables one operator run stages, and removes those no longer needed."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/nodeloom-{tag}-{uuid.uuid4().hex}"
        self._n = 0
        # lazy results read these tables until the session ends, so they go with it
        where = self._path(self.root)
        self._files(where).deleteOnExit(where)

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, where):
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def stage(self, df: DataFrame, *partition_by: str) -> DataFrame:
        return self.stage_counted(df, *partition_by)[0]

    def stage_counted(self, df: DataFrame, *partition_by: str, **counts) -> tuple[DataFrame, dict]:
        """Write ``df`` once; return it read back, and aggregates observed while it was written."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        schema = df.schema
        seen: dict = {}
        if counts:
            watch = Observation()
            df = df.observe(watch, *[c.alias(n) for n, c in counts.items()])
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
        if counts:
            seen = watch.get
        back = self.spark.read.schema(schema).parquet(path)
        back._staged_path = path
        return back, seen

    def drop(self, df: DataFrame) -> None:
        """Delete a staged table that no later plan reads."""
        path = getattr(df, "_staged_path", None)
        if path:
            where = self._path(path)
            self._files(where).delete(where, True)

    def clear(self) -> None:
        """Delete all staged tables, which no later plan reads."""
        where = self._path(self.root)
        self._files(where).delete(where, True)


class Files:
    """Small files of the shared folder, by way of the file system that its address names."""

    def __init__(self, spark: SparkSession):
        self.context = spark.sparkContext
        self.java = spark.sparkContext._jvm

    def _at(self, path: str):
        where = self.java.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.context._jsc.hadoopConfiguration()), where

    def names(self, folder: str) -> list[str]:
        """Names of what lies in a folder; none if there is no such folder."""
        files, where = self._at(folder)
        return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []

    def state(self, path: str) -> tuple:
        """Sizes and times of a table's files, which tell whether it has changed."""
        files, where = self._at(path)
        return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in files.listStatus(where)))

    def read(self, path: str) -> str:
        files, where = self._at(path)
        stream = files.open(where)
        try:
            return self.java.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a new file; an error if it exists, so of two writers one is refused."""
        files, where = self._at(path)
        stream = files.create(where, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        files, where = self._at(path)
        files.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

