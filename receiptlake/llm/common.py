"""Reading the tables, shared scratch space, and small helpers of the operators."""

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The columns used of each table.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local session that
    names none gets one of this machine."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.gettempdir() + "/receiptlake-checkpoints"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{_shared_root(spark)}/receiptlake-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a DataFrame as a table in the shared folder and go on from there, so that a
    lost executor costs no more than the step it worked on."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_sent: set[str] = set()


def short_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Get a session ready for the Python of these operators: the package is sent to the
    executors, and Python gets at most ``rows`` rows at a time, since a batch of the usual
    10,000 long texts may not fit beside the others. A lower setting stays."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.applicationId not in _sent:
        context.addPyFile(_zipped())
        _sent.add(context.applicationId)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
    return df


def _zipped() -> str:
    """The package as a file for ``addPyFile``, which the driver serves to the executors."""
    package = Path(__file__).resolve().parent.parent
    path = os.path.realpath(tempfile.mkdtemp(prefix="receiptlake-")) + "/receiptlake.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    return path
