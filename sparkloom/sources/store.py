"""Small files of a store on any Hadoop file system: read, listed, deleted, and put in place only if nobody was first."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one, as in tests, gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Files:
    """The file system of a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def is_file(self, name: str) -> bool:
        return self.fs.getFileStatus(self.path(name)).isFile()

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if it isn't there."""
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def states(self, name: str) -> list[tuple[str, int, int]]:
        """Name, length and time of change of a file, or of all that a folder holds directly. The time of a subfolder stands
        for what lies in it."""
        return sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in self.fs.listStatus(self.path(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Put a whole file in place unless there is one; says whether it did. The rename that does it is atomic on HDFS; a
        store whose rename isn't needs a commit service in front of it."""
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}-{uuid.uuid4().hex}"
        self.put(draft, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self.conf)
        plain = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.path(draft), self.path(name), plain)
        except Exception:
            if not self.exists(name):
                raise
            self.delete(draft)
            return False
        return True
