"""Check columns and clock columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake import functions as R


def with_year_month(df: DataFrame) -> DataFrame:
    return df.withColumn("year_month", R.year_month("DateTime_ts"))


def with_ingest_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ingest_time", F.current_timestamp())


def with_checks(df: DataFrame) -> DataFrame:
    """Add the check columns to parsed receipts that have ``DateTime_ts``."""
    checks = {
        "event_time": F.col("DateTime_ts"),
        "iin_valid": R.iin_valid("TaxPayerIIN"),
        "address_correct": R.address_correct("Address"),
        "main_vat_rate": R.main_vat_rate("Items", "VatRate"),
        "qr_code_valid": R.qr_code_valid("QRCode"),
    }
    df = df.withColumns(checks).withColumn("vat_valid", R.vat_valid("main_vat_rate"))
    return df.withColumn("is_clean", R.is_clean())


def with_item_vat_checks(df: DataFrame) -> DataFrame:
    """The lenient checks, on receipts whose items carry the VAT. NULL text makes the
    IIN check FALSE and the address '', so only the total can leave the flag NULL."""
    checks = {
        "event_time": R.py_event_time("DateTime"),
        "iin_valid": R.py_iin_valid("TaxPayerIIN"),
        "address_correct": R.py_address("Address"),
        "main_vat_rate": R.item_vat("Items"),
    }
    df = df.withColumns(checks).withColumn("vat_valid", R.py_vat("main_vat_rate"))
    return df.withColumn("is_clean", R.is_clean(R.ITEM_VAT_RULES))
