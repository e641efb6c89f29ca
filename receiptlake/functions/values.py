"""Typing and tidying of values on their way into the clean table."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from receiptlake.functions.checks import _col

MONEY = "decimal(18,2)"

# Marks deleted wherever they stand, and spaces deleted at the end.
MARKS = r"!!!|\*\*\*|\?\?| +$"


def strip_marks(c) -> Column:
    """Delete ``!!!``, ``***``, ``??`` anywhere and trailing spaces, in one pass."""
    return F.regexp_replace(_col(c), MARKS, "")


def or_unknown(c) -> Column:
    return F.coalesce(_col(c), F.lit("unknown"))


def money(c) -> Column:
    """decimal(18,2), rounded half up; NULL for bad text and on overflow."""
    return _col(c).try_cast(MONEY)


def whole(c) -> Column:
    """bigint; a decimal fraction in the text is cut off, other bad text is NULL."""
    text = _col(c).cast("string")
    return F.regexp_replace(text, r"(\d*)\.\d*(\s*)$", "0$1").try_cast("bigint")
