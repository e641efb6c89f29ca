"""Where rows end up: raw Parquet, the clean and error tables, a topic.

A sink is a function ``(batch_df, batch_id)`` for ``foreachBatch``. After a crash a batch
may be handed over a second time, so sinks replace what the same batch wrote before. The
key is (stream_id, batch_id): batch ids start at 0 again with a new checkpoint, so a new
checkpoint needs a new ``stream_id``, or it replaces the rows of the old one.
"""

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from receiptlake.functions.checks import year_month

Sink = Callable[[DataFrame, int], None]
Trigger = Mapping[str, object] | None


def _start(writer, checkpoint: str, trigger: Trigger, name: str | None) -> StreamingQuery:
    writer = writer.outputMode("append").option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    if name:
        writer = writer.queryName(name)
    return writer.start()


def start_raw(
    df: DataFrame,
    path: str,
    checkpoint: str,
    gather: bool = False,
    trigger: Trigger = None,
    name: str | None = None,
) -> StreamingQuery:
    """Append Parquet partitioned by ``year_month``; the file sink's own log makes a
    restart add nothing twice. Rows without a time go to the default partition.

    By default rows are written where they are read: no shuffle, one file per task and
    month. That suits live batches, which hold a month or two. ``gather`` is for
    backfills over many months: ``rebalance`` brings a month together, in as many files
    as its size asks for. Documents can be gathered before they are parsed
    (``jobs.gathered``), which moves less. Files are compressed by zstd, since the text of
    documents that may be landed beside their fields is most of them.
    """
    if gather:
        df = df.hint("rebalance", F.col("year_month"))
    writer = df.writeStream.format("parquet").option("path", path).option("compression", "zstd")
    writer = writer.partitionBy("year_month")
    return _start(writer, checkpoint, trigger, name)


def start_batches(
    df: DataFrame, sink: Sink, checkpoint: str, trigger: Trigger = None, name: str | None = None
) -> StreamingQuery:
    return _start(df.writeStream.foreachBatch(sink), checkpoint, trigger, name)


def start_clean(df: DataFrame, sink: Sink, checkpoint: str, **options) -> StreamingQuery:
    """Hand clean line items to ``sink``, batch by batch."""
    return start_batches(df, sink, checkpoint, **options)


def start_errors(df: DataFrame, sink: Sink, checkpoint: str, **options) -> StreamingQuery:
    """Hand rejected receipts to ``sink``, batch by batch."""
    return start_batches(df, sink, checkpoint, **options)


def await_any(spark: SparkSession, timeout: float | None = None):
    """Block until the first of the running queries stops or fails."""
    if timeout is None:
        return spark.streams.awaitAnyTermination()
    return spark.streams.awaitAnyTermination(timeout)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_clean_layout(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Clean rows in monthly partitions, each file ordered by (date_time, tax_payer_iin,
    upload_time).

    ``rebalance`` brings a month together but lets adaptive execution split a month too
    large for one task and merge small ones. The month leads the sort, because the writer
    would sort again, and lose the order, if the rows were not in month order.
    """
    order = ["date_time", "tax_payer_iin", "upload_time"]
    dated = df.withColumn("month", year_month("date_time")).hint("rebalance", F.col("month"))
    laid_out = dated.sortWithinPartitions("month", *[c for c in order if c in df.columns])
    laid_out.write.mode(mode).partitionBy("month").parquet(path)


def path_sink(
    path: str, stream_id: str, write: Callable[[DataFrame, str], None] = write_parquet
) -> Sink:
    """Every batch owns the directory ``stream_id=.../batch_id=...`` below ``path`` and
    overwrites it. Readers may see a batch half written while it is replayed."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write(batch, f"{path}/stream_id={stream_id}/batch_id={batch_id}")

    return sink


def clickhouse_options(url: str, dbtable: str, **more: str) -> dict[str, str]:
    """JDBC options for the clean table: large inserts, since each becomes a part of the
    table. Create the table by ``tables.clean_table`` first: ``createTableOptions`` is used
    by Spark only if there is none yet, and Spark's own types are not the warehouse's.
    Pass ``numPartitions`` to bound the connections of a batch."""
    # Driver, engine and order of the clean table.
    return {
        "url": url,
        "dbtable": dbtable,
        "driver": "com.clickhouse.jdbc.ClickHouseDriver",
        "batchsize": "100000",
        "isolationLevel": "NONE",
        "createTableOptions": "ENGINE = MergeTree() PARTITION BY toYYYYMM(date_time) "
        "ORDER BY (date_time, tax_payer_iin, upload_time)",
        **more,
    }


def postgres_options(url: str, dbtable: str, **more: str) -> dict[str, str]:
    """JDBC options for the error table; text is accepted by its JSONB column. Create it
    by ``tables.error_table`` first. Pass ``numPartitions`` to bound the connections of a
    batch."""
    glue = "&" if "?" in url else "?"
    return {
        "url": f"{url}{glue}stringtype=unspecified&reWriteBatchedInserts=true",
        "dbtable": dbtable,
        "driver": "org.postgresql.Driver",
        **more,
    }


def delete_batch_sql(dbtable: str) -> str:
    return f"DELETE FROM {dbtable} WHERE stream_id = ? AND batch_id = ?"


def delete_batch(spark: SparkSession, options: Mapping[str, str], stream_id: str, batch_id: int):
    """Remove what an earlier run of the batch left in the table, in one statement."""
    java = spark._jvm.java
    properties = java.util.Properties()
    for key in ("user", "password"):
        if key in options:
            properties.setProperty(key, options[key])
    loader = java.lang.Thread.currentThread().getContextClassLoader()
    driver = java.lang.Class.forName(options["driver"], True, loader).newInstance()
    connection = driver.connect(options["url"], properties)
    try:
        statement = connection.prepareStatement(delete_batch_sql(options["dbtable"]))
        statement.setString(1, stream_id)
        statement.setLong(2, batch_id)
        statement.executeUpdate()
    finally:
        connection.close()


def insert_rows(df: DataFrame, options: Mapping[str, str]) -> None:
    df.write.mode("append").format("jdbc").options(**options).save()


def jdbc_sink(
    options: Mapping[str, str],
    stream_id: str | None = None,
    delete: Callable = delete_batch,
    insert: Callable = insert_rows,
) -> Sink:
    """Append batches to a table by JDBC.

    Without ``stream_id`` this is a plain append, and a replayed batch is in the table
    twice. With it, rows carry the columns stream_id and batch_id, and the sink deletes
    what an earlier run of the batch may have left before it inserts; readers may look in
    between. Only a batch that does not follow the one just written can have been run
    before: the first after a start, or one that is handed over again after a failure. So
    the table is searched once per start, not once per batch.
    """
    written: int | None = None

    def append(batch: DataFrame, batch_id: int) -> None:
        insert(batch, options)

    def replace(batch: DataFrame, batch_id: int) -> None:
        nonlocal written
        follows, written = written is not None and batch_id == written + 1, None
        if not follows:
            delete(batch.sparkSession, options, stream_id, batch_id)
        keyed = batch.withColumn("stream_id", F.lit(stream_id)).withColumn(
            "batch_id", F.lit(batch_id).cast("bigint")
        )
        insert(keyed, options)
        written = batch_id

    return append if stream_id is None else replace


def to_kafka_value(df: DataFrame) -> DataFrame:
    """Whole rows as UTF-8 JSON in ``value``; no key, so records spread evenly."""
    return df.select(F.to_json(F.struct("*")).cast("binary").alias("value"))


def topic_sink_options(servers: str, topic: str) -> dict[str, str]:
    # Acknowledgement by all replicas, five retries, 50 ms of batching.
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.acks": "all",
        "kafka.retries": "5",
        "kafka.linger.ms": "50",
    }


def start_topic(
    df: DataFrame,
    servers: str,
    topic: str,
    checkpoint: str,
    trigger: Trigger = None,
    name: str | None = None,
) -> StreamingQuery:
    options = topic_sink_options(servers, topic)
    writer = to_kafka_value(df).writeStream.format("kafka").options(**options)
    return _start(writer, checkpoint, trigger, name)


def s3a_options(endpoint: str) -> dict[str, str]:
    """Session settings for an S3-compatible store with path-style access. Credentials
    belong in the Spark configuration or the environment's provider chain."""
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.path.style.access": "true",
        "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }
