"""Column functions. Each takes a column (or its name) and returns a column."""

from receiptlake.functions.checks import (  # noqa: F401
    ALL_RULES,
    ITEM_VAT_RULES,
    address_correct,
    city,
    event_time,
    iin_valid,
    is_clean,
    main_vat_rate,
    qr_code_valid,
    vat_valid,
    year_month,
)
from receiptlake.functions.lenient import (  # noqa: F401
    item_vat,
    py_address,
    py_city,
    py_event_time,
    py_iin_valid,
    py_vat,
)
from receiptlake.functions.totals import (  # noqa: F401
    line_total,
    ofd_site,
    receipt_total,
    vat_sum,
)
from receiptlake.functions.values import money, or_unknown, strip_marks, whole  # noqa: F401
