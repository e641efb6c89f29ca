"""JSON text to receipt columns."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from receiptlake.functions.checks import event_time
from receiptlake.schema import RECEIPT


def parse_receipts(
    df: DataFrame,
    keep_source: bool = False,
    fields: Sequence[str] | None = None,
    schema: T.StructType = RECEIPT,
) -> DataFrame:
    """One row per document with the receipt's fields as columns.

    Text that is no JSON object gives a row of NULLs, a value of the wrong type a NULL
    in its field only. ``inline`` keeps the parse in one plan node: projecting the
    parsed struct's fields instead lets the optimizer copy the whole parse into every
    later filter and projection. ``fields`` narrows the parse, since columns are not
    pruned through a generator. ``keep_source`` keeps all columns of ``df``.
    """
    if fields is not None:
        schema = T.StructType([f for f in schema.fields if f.name in set(fields)])
    source = df.columns if keep_source else []
    if clash := set(source) & set(schema.names):
        raise ValueError(f"rename input columns called like receipt fields: {sorted(clash)}")
    parsed = F.from_json("json", schema)
    return df.select(*[F.col(f"`{c}`") for c in source], F.inline(F.array(parsed)))


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("DateTime_ts", event_time("DateTime"))
