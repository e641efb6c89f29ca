"""Clean receipts to typed line items."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake import functions as R
from receiptlake.operators.enrich import with_checks
from receiptlake.schema import CLEAN, FACTORY_NUMBER, FISCAL_SIGN, REGISTRATION_NUMBER
from receiptlake.sources.receipts import parse_receipts, with_event_time

# Receipt column and its name in the clean projection.
CLEAN_NAMES = {
    "event_time": "event_time",
    "CompanyName": "company_name",
    "TaxPayerIIN": "tax_payer_iin",
    FACTORY_NUMBER: "kkt_factor_number",
    REGISTRATION_NUMBER: "kkt_registration_number",
    "ReceiptNumber": "receipt_number",
    "DateTime": "date_time",
    "Items": "items",
    "TotalSum": "total_sum",
    "VatRate": "vat_rate",
    "VatSum": "vat_sum",
    "Payment": "payment",
    FISCAL_SIGN: "fiscal_sign",
    "OFD": "ofd",
    "address_correct": "address",
    "QRCode": "qrcode",
}


def clean(df: DataFrame) -> DataFrame:
    """Checked receipts that passed; FALSE and NULL flags are left out."""
    return df.filter("is_clean")


def select_clean(df: DataFrame, keep=()) -> DataFrame:
    """The 16 columns the clean table is made from. ``keep`` names columns to carry
    along unchanged."""
    return df.select(*keep, *[F.col(f"`{c}`").alias(n) for c, n in CLEAN_NAMES.items()])


def with_upload_time(df: DataFrame) -> DataFrame:
    return df.withColumn("upload_time", F.current_timestamp())


def explode_items(df: DataFrame) -> DataFrame:
    """One row per line item, in column ``item``; a receipt without items gives none."""
    others = [c for c in df.columns if c != "items"]
    return df.select(*others, F.explode("items").alias("item"))


def type_receipts(df: DataFrame) -> DataFrame:
    """Receipt columns of the clean projection to their types, before the explode
    repeats them for every item."""
    return df.withColumns(
        {
            "kkt_registration_number": R.whole("kkt_registration_number"),
            "fiscal_sign": R.whole("fiscal_sign"),
            "total_sum": R.money("total_sum"),
            "vat_sum": R.money("vat_sum"),
            "ofd_name": R.or_unknown("ofd.Name"),
            "ofd_site": R.or_unknown("ofd.Site"),
        }
    )


def type_items(df: DataFrame, keep=()) -> DataFrame:
    """Exploded rows, typed by ``type_receipts`` before, to the clean table's columns."""
    columns = {
        "date_time": F.col("event_time"),
        "category": F.col("item.Category"),
        "product_name": R.strip_marks("item.Name"),
        "unit_price": R.money("item.UnitPrice"),
        "quantity": F.col("item.Quantity").cast("bigint"),
        "total_amount_by_position": R.money("item.Total"),
        "qr_code": F.col("qrcode"),
    }
    return df.select(*keep, *[columns.get(c, F.col(c)).alias(c) for c in CLEAN.names])


def clean_items(docs: DataFrame) -> DataFrame:
    """Documents (column ``json``) to clean line items. Other columns of ``docs`` are
    carried along in front. Batch or streaming; no shuffle, one parse."""
    keep = [c for c in docs.columns if c != "json"]
    checked = with_checks(with_event_time(parse_receipts(docs, keep_source=True)))
    return clean_items_of(checked, keep)


def clean_items_of(checked: DataFrame, keep=(), at: str | None = None) -> DataFrame:
    """``at`` names a column that has the time of upload; without it that is now."""
    if at is None:
        receipts = with_upload_time(select_clean(clean(checked), keep))
    else:
        receipts = select_clean(clean(checked), [*keep, at]).withColumnRenamed(at, "upload_time")
    return type_items(explode_items(type_receipts(receipts)), keep)
