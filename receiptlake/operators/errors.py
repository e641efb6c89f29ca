"""Rejected receipts with their reasons and content."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receiptlake.operators.enrich import with_checks
from receiptlake.schema import PAYLOAD_COLUMNS
from receiptlake.sources.receipts import parse_receipts, with_event_time


def errors(df: DataFrame, on_null: str = "drop") -> DataFrame:
    """Checked receipts that failed. A flag of NULL passes neither this filter nor that
    of the clean rows, unless ``on_null="error"`` counts it as failed."""
    if on_null == "drop":
        return df.filter(~F.col("is_clean"))
    if on_null == "error":
        return df.filter(~F.coalesce("is_clean", F.lit(False)))
    raise ValueError(f"on_null is 'drop' or 'error', not {on_null!r}")


def reason(mode: str = "reference") -> Column:
    """Reason codes joined by ``"; "``, '' without any.

    ``"reference"`` reports ``bad_vat`` for receipts whose VAT *is* valid, has no code
    for address and QR code, and no code for an unknown IIN or total. ``"complete"``
    names every check that does not hold.
    """
    # The codes, in order.
    vat_known = F.col("vat_valid").isNotNull()
    if mode == "reference":
        failing = {
            "bad_datetime": F.col("event_time").isNull(),
            "bad_iin": ~F.col("iin_valid"),
            "bad_vat": vat_known,
            "total <= 0": F.col("TotalSum") <= 0,
        }
    elif mode == "complete":
        failing = {
            "bad_datetime": F.col("event_time").isNull(),
            "bad_iin": ~F.coalesce("iin_valid", F.lit(False)),
            "bad_address": F.col("address_correct").isNull(),
            "bad_vat": ~vat_known,
            "bad_qr": F.col("qr_code_valid").isNull(),
            "total <= 0": ~F.coalesce(F.col("TotalSum") > 0, F.lit(False)),
        }
    else:
        raise ValueError(f"mode is 'reference' or 'complete', not {mode!r}")
    return F.concat_ws("; ", *[F.when(bad, code) for code, bad in failing.items()])


def payload(columns=PAYLOAD_COLUMNS, variant: bool = False) -> Column:
    """The named columns as JSON text (or as a VARIANT); NULL fields are left out."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    return F.parse_json(text) if variant else text


def errors_of(
    checked: DataFrame, mode: str = "reference", on_null: str = "drop", keep=(), at: str | None = None
) -> DataFrame:
    """``at`` names a column that has the time of the error row; without it that is now."""
    return errors(checked, on_null).select(
        *keep,
        (F.current_timestamp() if at is None else F.col(at)).alias("ts"),
        reason(mode).alias("reason"),
        payload().alias("payload"),
    )


def error_feed(
    docs: DataFrame, mode: str = "reference", on_null: str = "drop", keep_source: bool = False
) -> DataFrame:
    """Documents (column ``json``) to rows (ts, reason, payload). A malformed document
    has the payload ``{}``; ``keep_source`` also carries its text in ``json``. Other
    columns of ``docs`` are carried along in front."""
    checked = with_checks(with_event_time(parse_receipts(docs, keep_source=True)))
    keep = [c for c in docs.columns if keep_source or c != "json"]
    return errors_of(checked, mode, on_null, keep)
