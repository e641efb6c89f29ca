"""DataFrame operators on parsed receipts. All are narrow: none shuffles."""

from receiptlake.operators.clean import (  # noqa: F401
    clean,
    clean_items,
    explode_items,
    select_clean,
    type_items,
    type_receipts,
    with_upload_time,
)
from receiptlake.operators.enrich import (  # noqa: F401
    with_checks,
    with_ingest_time,
    with_item_vat_checks,
    with_year_month,
)
from receiptlake.operators.errors import error_feed, errors, payload, reason  # noqa: F401
from receiptlake.operators.reconcile import (  # noqa: F401
    line_totals,
    ofd_sites,
    receipt_reconcile,
    receipt_totals,
    vat_totals,
)
