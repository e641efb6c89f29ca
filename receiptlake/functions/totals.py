"""Recomputed amounts: line total, receipt total, VAT and the OFD's site."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from receiptlake.functions.checks import _col
from receiptlake.functions.values import money

# The VAT share of a 12 % rate, the operator names and sites.
VAT_SHARE = "0.12"
OFD_SITES = {"АО Казахтелеком": "https://ofd.telecom.kz"}
OTHER_OFD_SITE = "https://ofd.ttc.kz"


def line_total(unit_price, quantity) -> Column:
    """round(unit price x quantity, 2), half up."""
    price = _col(unit_price).try_cast("decimal(24,6)")
    return F.round(F.try_multiply(price, _col(quantity)), 2).try_cast("decimal(18,2)")


def receipt_total(items) -> Column:
    """Sum of the line totals: 0 for an empty list, NULL for a missing one or if a
    line has no total."""
    return F.aggregate(
        _col(items),
        F.lit(0).cast("decimal(38,2)"),
        lambda total, item: F.try_add(
            total, line_total(item["UnitPrice"], item["Quantity"])
        ).cast("decimal(38,2)"),
        money,
    )


def vat_sum(total, rate) -> Column:
    """12 % of the total if the rate starts with 12, else 0."""
    share = F.lit(VAT_SHARE).cast("decimal(2,2)")
    vat = F.round(money(total) * share, 2)
    return money(F.when(_col(rate).startswith("12"), vat).otherwise(F.lit(0)))


def ofd_site(name) -> Column:
    site = F.lit(OTHER_OFD_SITE)
    for operator, url in OFD_SITES.items():
        site = F.when(_col(name) == operator, url).otherwise(site)
    return site
