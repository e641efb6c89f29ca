"""Validation predicates and normalisations of receipt fields.

Dirty values never raise: under ANSI mode every parse and cast is a ``try_`` one.
NULL inputs keep three-valued logic, so a check may answer NULL.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted time patterns, in order of precedence, and the placeholders
# that stand for "no address" and "unreadable code".
TIME_PATTERNS = ["yyyy-MM-dd, HH:mm:ss", "dd.MM.yy HH:mm", "dd/MM/yyyy HH:mm:ss"]
NO_ADDRESS = "unknown"
BROKEN_QR = "битый_qr_code"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_separator(c: Column, comma: Column, dot: Column, slash: Column) -> Column:
    """Choose among parses of the three layouts. A text can only fit the layout whose
    separator it holds, so this equals trying one after the other, at one parse for each
    time it is evaluated: the flagship filters by the time and projects it, so a row that is
    clean is parsed twice."""
    return F.when(c.contains(","), comma).when(c.contains("."), dot).otherwise(slash)


def event_time(c) -> Column:
    """Timestamp (session time zone) by the first pattern that fits, else NULL."""
    c = _col(c)
    return by_separator(c, *[F.try_to_timestamp(c, F.lit(p)) for p in TIME_PATTERNS])


def year_month(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def iin_valid(c) -> Column:
    """Twelve ASCII digits; NULL stays NULL."""
    return _col(c).rlike(r"^\d{12}$")


def _given(c: Column, placeholder: str) -> Column:
    return c.isNotNull() & ~c.isin("", placeholder)


def address_correct(c) -> Column:
    c = _col(c)
    return F.when(_given(c, NO_ADDRESS), c)


def city(c) -> Column:
    """Text before the first comma, untrimmed; '' for an unusable address."""
    c = _col(c)
    return F.when(_given(c, NO_ADDRESS), F.substring_index(c, ",", 1)).otherwise("")


def main_vat_rate(items, rate) -> Column:
    """The receipt's rate if it has items, else ''."""
    return F.when(F.size(_col(items)) > 0, _col(rate)).otherwise("")


def vat_valid(c) -> Column:
    """First run of digits as ``<n>%``; NULL without one or beyond the int range."""
    n = F.regexp_extract(_col(c), r"\d+", 0).try_cast("int")
    return F.concat(n.cast("string"), F.lit("%"))


def qr_code_valid(c) -> Column:
    c = _col(c)
    return F.when(_given(c, BROKEN_QR), c)


# Cheap rules first: the conjunction stops at the first FALSE, in any order alike.
_RULES = {
    "total": lambda: F.col("TotalSum") > 0,
    "address": lambda: F.col("address_correct").isNotNull(),
    "qr": lambda: F.col("qr_code_valid").isNotNull(),
    "iin": lambda: F.col("iin_valid"),
    "vat": lambda: F.col("vat_valid").isNotNull(),
    "datetime": lambda: F.col("event_time").isNotNull(),
}
ALL_RULES = tuple(_RULES)
# The rule set that goes with per-item VAT: address and QR code are not looked at.
ITEM_VAT_RULES = ("total", "iin", "vat", "datetime")


def is_clean(rules=ALL_RULES) -> Column:
    """All rules hold. NULL when none fails but the IIN or the total is unknown."""
    return reduce(Column.__and__, [_RULES[r]() for r in rules])
