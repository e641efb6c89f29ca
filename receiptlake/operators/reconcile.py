"""Recomputed totals of parsed receipts, and how far the stated ones are off."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake import functions as R


def line_totals(df: DataFrame) -> DataFrame:
    """Add ``lines``: per item the recomputed total and stated minus recomputed."""

    def line(item):
        total = R.line_total(item["UnitPrice"], item["Quantity"])
        return F.struct(
            total.alias("line_total"),
            R.money(F.try_subtract(R.money(item["Total"]), total)).alias("line_diff"),
        )

    return df.withColumn("lines", F.transform("Items", line))


def receipt_totals(df: DataFrame) -> DataFrame:
    """Add the sum of the recomputed line totals and stated minus recomputed."""
    return df.withColumn("receipt_total", R.receipt_total("Items")).withColumn(
        "receipt_diff", R.money(F.try_subtract(R.money("TotalSum"), F.col("receipt_total")))
    )


def vat_totals(df: DataFrame) -> DataFrame:
    """Add the VAT due on the stated total and stated minus due."""
    return df.withColumn("vat_due", R.vat_sum("TotalSum", "VatRate")).withColumn(
        "vat_diff", R.money(F.try_subtract(R.money("VatSum"), F.col("vat_due")))
    )


def ofd_sites(df: DataFrame) -> DataFrame:
    """Add the site that belongs to the operator's name, and whether it is stated."""
    return df.withColumn("ofd_site", R.ofd_site("OFD.Name")).withColumn(
        "ofd_site_ok", F.col("OFD.Site") == F.col("ofd_site")
    )


def receipt_reconcile(df: DataFrame) -> DataFrame:
    """All four on parsed receipts."""
    return ofd_sites(vat_totals(receipt_totals(line_totals(df))))
