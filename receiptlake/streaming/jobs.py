"""The jobs a user runs, from documents (column ``json``) to started queries."""

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from receiptlake.operators.clean import clean_items, clean_items_of
from receiptlake.operators.enrich import with_checks, with_ingest_time, with_year_month
from receiptlake.operators.errors import error_feed, errors_of
from receiptlake.sources.receipts import parse_receipts, with_event_time
from receiptlake.streaming.metrics import observed
from receiptlake.streaming.sinks import Sink, start_batches, start_clean, start_errors, start_raw

BATCH_TIME = "__batch_time"
MONTH = "__month"


def raw_table(docs: DataFrame, keep_source: bool = False) -> DataFrame:
    """Parsed receipts with DateTime_ts, year_month and ingest_time. ``keep_source``
    also lands the document's text and the other columns of ``docs``."""
    parsed = parse_receipts(docs, keep_source)
    return with_ingest_time(with_year_month(with_event_time(parsed)))


def gathered(docs: DataFrame) -> DataFrame:
    """Documents with those of a month brought together, in as many tasks as its size asks
    for. They are shuffled before the parse, which would add all fields to their text; the
    month takes a narrow parse of its own."""
    dated = with_year_month(with_event_time(parse_receipts(docs, True, ["DateTime"])))
    months = dated.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("year_month").alias(MONTH))
    return months.hint("rebalance", F.col(MONTH)).drop(MONTH)


def run_raw_landing(
    docs: DataFrame,
    path: str,
    checkpoint: str,
    keep_source: bool = False,
    gather: bool = False,
    **options,
) -> StreamingQuery:
    """``gather`` is for backfills over many months: see ``start_raw``."""
    if gather:
        docs = gathered(docs if keep_source else docs.select("json"))
    return start_raw(raw_table(docs, keep_source), path, checkpoint, **options)


def run_clean_items(docs: DataFrame, sink: Sink, checkpoint: str, **options) -> StreamingQuery:
    return start_clean(clean_items(docs), sink, checkpoint, **options)


def run_error_feed(
    docs: DataFrame,
    sink: Sink,
    checkpoint: str,
    mode: str = "reference",
    on_null: str = "drop",
    keep_source: bool = False,
    **options,
) -> StreamingQuery:
    return start_errors(error_feed(docs, mode, on_null, keep_source), sink, checkpoint, **options)


def run_clean_and_errors(
    docs: DataFrame,
    clean_sink: Sink,
    error_sink: Sink,
    checkpoint: str,
    mode: str = "reference",
    on_null: str = "drop",
    keep_source: bool = False,
    carry: Sequence[str] | None = None,
    count: Column | None = None,
    **options,
) -> StreamingQuery:
    """Both tables from one read and one parse of the source: the checked batch is kept
    (spilling to disk) while the two sinks take their share.

    Both tables get the batch's time, which the stream writes to its log before the batch
    runs, so a batch that runs again has the times it had before. The numbers of clean and
    rejected receipts, and of those that go to neither table, are observed on the way
    (``metrics``); ``count`` tells which rows count as a receipt (default: all).

    ``carry`` names columns of ``docs`` that go along into both tables (default: all but
    the document); ``keep_source`` puts all columns of ``docs`` into the error table.
    """
    if carry is None:
        carry = [c for c in docs.columns if c != "json"]
    source = docs.columns if keep_source else list(carry)
    needed = dict.fromkeys(["json", *source])
    parsed = parse_receipts(docs.select(*needed), keep_source=True)
    checked = with_checks(with_event_time(parsed if keep_source else parsed.drop("json")))
    # In the plan of the stream, not of the batch: there it is the time of the stream's log.
    checked = observed(checked.withColumn(BATCH_TIME, F.current_timestamp()), on_null, count)

    def both(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            clean_sink(clean_items_of(batch, carry, BATCH_TIME), batch_id)
            error_sink(errors_of(batch, mode, on_null, source, BATCH_TIME), batch_id)
        finally:
            batch.unpersist()

    return start_batches(checked, both, checkpoint, **options)
