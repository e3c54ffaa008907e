"""Small files and folders in whatever file system Spark reads, and the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set and all runs in one process, a folder of this machine."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        at = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(at)
    return at.rstrip("/")


class Folder:
    """A folder reached through Hadoop's file system, as Spark's readers reach it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def is_folder(self, name: str = "") -> bool:
        return self.has(name) and self._fs.getFileStatus(self._path(name)).isDirectory()

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder, in order; nothing if there is none."""
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(name))) if self.has(name) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file whole, or not at all; one of that name is replaced in one step."""
        jvm, beside = self.spark._jvm, f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(self._path(beside), self._path(name), how)

    def move(self, name: str, to: str) -> bool:
        """Move a folder to where nothing is yet; whether that went well."""
        target = self._path(to)
        self._fs.mkdirs(target.getParent())
        return not self._fs.exists(target) and self._fs.rename(self._path(name), target)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
