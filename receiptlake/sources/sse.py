"""Captured server-sent-event lines to JSON documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\f"


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def decode_sse_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Replace the text in ``column`` by the column ``json``, keeping only lines that
    hold a ``{...}`` document, framed with ``data:`` or bare."""
    line = F.col(column)
    payload = F.when(line.startswith("data:"), _strip(F.substr(line, F.lit(6)))).otherwise(line)
    others = [c for c in df.columns if c != column]
    shape = _strip(F.col("json"))
    return df.select(*others, payload.alias("json")).filter(
        shape.startswith("{") & shape.endswith("}")
    )
