"""Small files of tables and streams, on any Hadoop file system."""

import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def escaped(name: str) -> str:
    """A name as one part of a path. Other letters than ASCII stay as they are: Spark takes
    an escaped byte of a partition's name for a letter of its own."""
    return "".join(quote(c, safe="") if c.isascii() else c for c in name)


def _path(spark: SparkSession, path: str):
    java = spark._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark._jsc.hadoopConfiguration()), java


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, sorted; hidden files apart. A folder that is missing is empty."""
    files, java = _path(spark, path)
    if not files.exists(java):
        return []
    return sorted(n for n in (s.getPath().getName() for s in files.listStatus(java)) if n[0] not in "._")


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path, 0 if it is missing."""
    files, java = _path(spark, path)
    return files.getContentSummary(java).getLength() if files.exists(java) else 0


def remove(spark: SparkSession, path: str) -> None:
    files, java = _path(spark, path)
    files.delete(java, True)


def read_text(spark: SparkSession, path: str) -> str:
    files, java = _path(spark, path)
    stream = files.open(java)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file whole or not at all: written aside, and renamed when it is complete.
    False if there is one of that name, which then stays as it is."""
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    aside = jvm.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    stream = files.create(aside, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    context = jvm.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
    try:
        context.rename(aside, target, plain)
    except Py4JJavaError as error:
        files.delete(aside, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True
