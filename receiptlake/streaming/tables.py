"""Statements that create the tables behind the JDBC sinks.

Both tables have the columns stream_id and batch_id that a replay-safe sink writes, and an
index on them, so that the delete at a start does not read the whole table.
"""

from receiptlake.schema import CLEAN

# The warehouse's type of each type of the clean table.
WAREHOUSE_TYPES = {
    "timestamp": "DateTime",
    "string": "String",
    "bigint": "UInt64",
    "decimal(18,2)": "Decimal64(2)",
}


def clean_table(name: str) -> str:
    """The line-item table of the column store, monthly, in the order it is read."""
    columns = [f"{f.name} {WAREHOUSE_TYPES[f.dataType.simpleString()]}" for f in CLEAN]
    columns += ["stream_id String", "batch_id UInt64"]
    columns += ["INDEX by_batch (stream_id, batch_id) TYPE set(0) GRANULARITY 1"]
    return (
        f"CREATE TABLE IF NOT EXISTS {name} (\n    " + ",\n    ".join(columns) + "\n)\n"
        "ENGINE = MergeTree()\nPARTITION BY toYYYYMM(date_time)\n"
        "ORDER BY (date_time, tax_payer_iin, upload_time)"
    )


def error_table(name: str) -> list[str]:
    """The table of rejected receipts, and its index."""
    columns = [
        "ts TIMESTAMP DEFAULT now()",
        "reason TEXT NOT NULL",
        "payload JSONB NOT NULL",
        "stream_id TEXT",
        "batch_id BIGINT",
    ]
    index = name.replace(".", "_") + "_by_batch"
    return [
        f"CREATE TABLE IF NOT EXISTS {name} (\n    " + ",\n    ".join(columns) + "\n)",
        f"CREATE INDEX IF NOT EXISTS {index} ON {name} (stream_id, batch_id)",
    ]
