"""Shared scratch space, written tables, and documents written out as the input of streams."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_kept: dict[tuple, str | None] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new path below the cluster's checkpoint folder. Only a local session that names
    none gets a folder of this machine."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/receiptlake-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    java = spark._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark._jsc.hadoopConfiguration()), java


def read_back(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed rows under their declared schema. A sink that was handed no row has written
    no file, or no folder."""
    files, java = _path(spark, path)
    if not files.exists(java):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    files, java = _path(spark, path)
    files.delete(java, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """A small table, written to scratch space and read again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_key(spark: SparkSession, sf_dir: str, names) -> tuple:
    """What tells a state of some tables from another, for this application."""
    state = []
    for name in names:
        files, path = _path(spark, f"{sf_dir}/{name}.parquet")
        held = files.getContentSummary(path)
        state.append((files.getFileStatus(path).getModificationTime(), held.getLength(), held.getFileCount()))
    return spark.sparkContext.applicationId, sf_dir, *state


def kept(df: DataFrame, name: str, key: tuple) -> DataFrame | None:
    """A small table, written once per key; None, and nothing left behind, if it is empty."""
    spark, key = df.sparkSession, (name, *key)
    if key not in _kept:
        path = scratch_dir(spark)
        df.write.parquet(path)
        _kept[key] = path
        if spark.read.schema(df.schema).parquet(path).isEmpty():
            discard(spark, path)
            _kept[key] = None
    return _kept[key] and spark.read.schema(df.schema).parquet(_kept[key])


def staged_documents(spark: SparkSession, sf_dir: str) -> str:
    """New directory with all documents as JSON lines. Order key and page travel in front of
    the document, as a topic's key would beside it. Each query that replays them has its own,
    so that what it costs does not hang on those that ran before, and discards them.

    They are compressed as topics are; a file is read by one task, and is as large as the task
    that wrote it."""
    from receiptlake.plans import fixture

    path = f"{scratch_dir(spark)}/documents"
    docs = fixture.documents(spark, sf_dir).rows
    docs = docs.selectExpr("concat_ws('\t', k, page, json) AS value")
    docs.write.option("compression", "lz4").text(path)
    return path
