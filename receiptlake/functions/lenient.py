"""The looser variants of the checks, with the rules of Python's own string and
date parsing, as native expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from receiptlake.functions.checks import NO_ADDRESS, _col, _given, by_separator

# The three layouts with one-digit parts allowed.
YEAR_FIRST = "yyyy-M-d, H:m:s"
SHORT_YEAR = "d.M.yy H:m"
DAY_FIRST = "d/M/yyyy H:m:s"


def py_event_time(c) -> Column:
    """As ``event_time``, with one-digit parts; two-digit years 69-99 are 19xx."""
    text = F.regexp_replace(_col(c), r"(?U)\s+", " ")
    year_first, short, day_first = [
        F.try_to_timestamp(text, F.lit(p)) for p in (YEAR_FIRST, SHORT_YEAR, DAY_FIRST)
    ]
    a_century = F.expr("INTERVAL '100' YEAR")
    short = F.when(F.year(short) >= 2069, short - a_century).otherwise(short)
    return by_separator(text, year_first, short, day_first)


def py_iin_valid(c) -> Column:
    """Twelve digits of any script; NULL is FALSE."""
    return F.coalesce(_col(c).rlike(r"(?U)^\d{12}\n?\z"), F.lit(False))


def py_city(c) -> Column:
    """Text before the first comma, trimmed of any white space; '' if unusable."""
    c = _col(c)
    head = F.regexp_replace(F.substring_index(c, ",", 1), r"(?U)^\s+|\s+$", "")
    return F.when(_given(c, NO_ADDRESS), head).otherwise("")


def py_address(c) -> Column:
    """The address, or '' (never NULL) if unusable."""
    c = _col(c)
    return F.when(_given(c, NO_ADDRESS), c).otherwise("")


def py_vat(c) -> Column:
    """First run of digits (any script) and ``%``; leading zeros stay, no int limit."""
    digits = F.regexp_extract(_col(c), r"(?U)\d+", 0)
    return F.when(digits != "", F.concat(digits, F.lit("%")))


def item_vat(items) -> Column:
    """VAT rate of the first item, '' for a receipt without items."""
    items = _col(items)
    return F.when(F.size(items) > 0, F.get(items, F.lit(0))["VAT"]["Rate"]).otherwise("")
