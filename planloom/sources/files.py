"""Small files in folders that all machines share, through Hadoop's file systems: claims that one writer can win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Of what a folder holds, in order; of a folder that isn't there, none."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def read(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Makes the file whole, or not at all: whether this call made it. Of several writers one wins.

    The content is written beside it first, and then moved to the name, which no file may have yet.
    """
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.new")
    out = fs.create(beside, False)
    out.write(bytearray(content.encode()))
    out.close()
    if fs.getUri().getScheme() == "file":  # a hard link is made only where no file has the name
        files, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Paths
        try:
            files.createLink(paths.get(at.toUri()), paths.get(beside.toUri()))
            return True
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        finally:
            fs.delete(beside, False)
    won = not fs.exists(at) and fs.rename(beside, at)  # a rename fails where a file has the name
    if not won:
        fs.delete(beside, False)
    return bool(won)
