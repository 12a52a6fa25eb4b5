"""Small files and folders through Spark's Hadoop file systems, so that any store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def size(self, path: str) -> int:
        """Bytes of a file or of all files of a folder."""
        fs, target = self._at(path)
        return fs.getContentSummary(target).getLength()

    def delete(self, path: str) -> None:
        fs, target = self._at(path)
        fs.delete(target, True)

    def scheme(self, path: str) -> str:
        return self._at(path)[0].getUri().getScheme()

    def make_for_now(self, path: str) -> None:
        """Make a folder that is deleted with its content when the application ends."""
        fs, target = self._at(path)
        fs.mkdirs(target)
        fs.deleteOnExit(target)

    def names(self, path: str) -> list[str]:
        """Names of what lies in a folder."""
        fs, target = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(target)]

    def read(self, path: str) -> str:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write a whole file beside the old one, then put it in its place."""
        fs, target = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(path + ".new")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(beside, target, options)
