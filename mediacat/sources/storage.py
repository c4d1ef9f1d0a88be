"""Small files and folders on whatever file system a path names, through Spark's own clients."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    """The file system below one location."""

    def __init__(self, spark: SparkSession, location: str):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._root = self._jvm.org.apache.hadoop.fs.Path(location)
        self._fs = self._root.getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name) if name else self._root

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, none if it does not exist."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file that others see whole or not at all; False if the name is taken."""
        hidden = self._path(f".{name.replace('/', '-')}-{self._jvm.java.util.UUID.randomUUID()}")
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(hidden), context.makeQualified(target), options)
        except Exception as error:
            self._fs.delete(hidden, False)
            if self._fs.exists(target):
                return False
            raise error
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
