"""Sinks and streaming jobs."""

from receiptlake.streaming.control import GivenUp, Supervisor  # noqa: F401
from receiptlake.streaming.jobs import (  # noqa: F401
    raw_table,
    run_clean_and_errors,
    run_clean_items,
    run_error_feed,
    run_raw_landing,
)
from receiptlake.streaming.metrics import RoutingLog, routing_counts  # noqa: F401
from receiptlake.streaming.published import (  # noqa: F401
    PublishedTable,
    clean_table,
    error_table,
)
from receiptlake.streaming.sinks import (  # noqa: F401
    await_any,
    jdbc_sink,
    path_sink,
    s3a_options,
    start_clean,
    start_errors,
    start_raw,
    start_topic,
    to_kafka_value,
    write_clean_layout,
    write_parquet,
)
