"""Envelopes: records of a Kafka topic, or the same records replayed from files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_options(
    servers: str,
    topic: str,
    starting: str = "latest",
    min_partitions: int | None = None,
    max_offsets_per_trigger: int | None = None,
) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
    }
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def read_topic(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", **limits
) -> DataFrame:
    """Subscribe to one topic. ``min_partitions`` gives a batch more tasks than the
    topic has partitions, ``max_offsets_per_trigger`` bounds a batch after downtime."""
    options = topic_options(servers, topic, starting, **limits)
    return spark.readStream.format("kafka").options(**options).load()


def read_lines(
    spark: SparkSession,
    path: str,
    files_per_trigger: int | None = None,
    bytes_per_trigger: int | str | None = None,
) -> DataFrame:
    """Replay landed JSON lines as a stream with the topic's ``value`` column. A batch is
    bounded by files or by bytes."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.load(path)


def decode_value(df: DataFrame, keep_source: bool = False) -> DataFrame:
    """Bytes (or text) in ``value`` to the string column ``json``. ``keep_source``
    keeps the other columns, such as key, topic, partition, offset, timestamp."""
    json = F.col("value").cast("string").alias("json")
    if not keep_source:
        return df.select(json)
    return df.select(*[c for c in df.columns if c != "value"], json)
