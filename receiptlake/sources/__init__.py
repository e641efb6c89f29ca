"""Readers: topic, replayed files, captured event-stream lines, product catalogue."""

from receiptlake.sources.catalogue import read_catalogue  # noqa: F401
from receiptlake.sources.diagnostics import parse_diagnostics  # noqa: F401
from receiptlake.sources.frames import EventStreamSource  # noqa: F401
from receiptlake.sources.receipts import parse_receipts, with_event_time  # noqa: F401
from receiptlake.sources.sse import decode_sse_lines  # noqa: F401
from receiptlake.sources.topic import decode_value, read_lines, read_topic  # noqa: F401
