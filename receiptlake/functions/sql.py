"""The checks and the two jobs as SQL functions.

``register`` creates temporary functions for ``spark.sql``. Scalar ones are written as SQL
expressions, table functions as queries over a view of documents, so the optimizer puts
their bodies in the place of the calls: nothing is interpreted row by row, filters reach the
scan, and a document is parsed once, as in the DataFrame form.

    documents.createOrReplaceTempView("documents")          # column json, and others
    register(spark, "documents")
    spark.sql("SELECT category, sum(total_sum) FROM receipt_clean_items() GROUP BY category")
    spark.sql("SELECT * FROM receipt_errors_complete() WHERE reason LIKE '%bad_qr%'")
    spark.sql("SELECT receipt_event_time('02.01.25 10:00')")

Table functions take no table, and a call of one per document (LATERAL) would join the
documents with themselves; so these are over the view, and carry its other columns in front.
"""

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from receiptlake.functions import checks, lenient, totals, values
from receiptlake.schema import (
    CLEAN,
    ERROR,
    FACTORY_NUMBER,
    FISCAL_SIGN,
    PAYLOAD_COLUMNS,
    RECEIPT,
    RECEIPT_WITH_ITEM_VAT,
    REGISTRATION_NUMBER,
)

PREFIX = "receipt_"


def _time(c: str, patterns) -> str:
    """By the separator that the text holds."""
    comma, dot, slash = (f"try_to_timestamp({c}, '{p}')" for p in patterns)
    return f"CASE WHEN contains({c}, ',') THEN {comma} WHEN contains({c}, '.') THEN {dot} ELSE {slash} END"


_GIVEN = f"address IS NOT NULL AND address NOT IN ('', '{checks.NO_ADDRESS}')"
_MONEY = values.MONEY
_LENIENT = (lenient.YEAR_FIRST, lenient.SHORT_YEAR, lenient.DAY_FIRST)
_ITEMS = RECEIPT["Items"].dataType.simpleString()
_ITEMS_WITH_VAT = RECEIPT_WITH_ITEM_VAT["Items"].dataType.simpleString()

# Name: parameters, type, body. A later one may call those before it.
SCALARS = {
    "event_time": ("c STRING", "TIMESTAMP", _time("c", checks.TIME_PATTERNS)),
    "year_month": ("ts TIMESTAMP", "STRING", "date_format(ts, 'yyyy-MM')"),
    "iin_valid": ("iin STRING", "BOOLEAN", r"iin RLIKE r'^\d{12}$'"),
    "address_correct": ("address STRING", "STRING", f"CASE WHEN {_GIVEN} THEN address END"),
    "city": ("address STRING", "STRING", f"CASE WHEN {_GIVEN} THEN substring_index(address, ',', 1) ELSE '' END"),
    "main_vat_rate": ("items BIGINT, rate STRING", "STRING", "CASE WHEN items > 0 THEN rate ELSE '' END"),
    "vat_valid": (
        "rate STRING",
        "STRING",
        r"concat(CAST(try_cast(regexp_extract(rate, r'\d+', 0) AS INT) AS STRING), '%')",
    ),
    "qr_code_valid": (
        "code STRING",
        "STRING",
        f"CASE WHEN code IS NOT NULL AND code NOT IN ('', '{checks.BROKEN_QR}') THEN code END",
    ),
    "strip_marks": ("name STRING", "STRING", f"regexp_replace(name, r'{values.MARKS}', '')"),
    "or_unknown": ("c STRING", "STRING", "coalesce(c, 'unknown')"),
    "money": ("c STRING", _MONEY, f"try_cast(c AS {_MONEY})"),
    "amount": ("c DOUBLE", _MONEY, f"try_cast(c AS {_MONEY})"),
    "whole": ("c STRING", "BIGINT", r"try_cast(regexp_replace(c, r'(\d*)\.\d*(\s*)$', '0$1') AS BIGINT)"),
    "line_total": (
        "price DOUBLE, quantity INT",
        _MONEY,
        f"try_cast(round(try_multiply(try_cast(price AS decimal(24,6)), quantity), 2) AS {_MONEY})",
    ),
    "vat_sum": (
        "total DOUBLE, rate STRING",
        _MONEY,
        f"try_cast(CASE WHEN startswith(rate, '12') THEN round(try_cast(total AS {_MONEY}) * {totals.VAT_SHARE}BD, 2) "
        f"ELSE 0 END AS {_MONEY})",
    ),
    "ofd_site": (
        "name STRING",
        "STRING",
        "CASE " + " ".join(f"WHEN name = '{n}' THEN '{s}'" for n, s in totals.OFD_SITES.items())
        + f" ELSE '{totals.OTHER_OFD_SITE}' END",
    ),
    "py_century": (
        "ts TIMESTAMP",
        "TIMESTAMP",
        "CASE WHEN year(ts) >= 2069 THEN ts - INTERVAL '100' YEAR ELSE ts END",
    ),
    "py_time_of": (
        "c STRING",
        "TIMESTAMP",
        _time("c", _LENIENT).replace(
            f"try_to_timestamp(c, '{lenient.SHORT_YEAR}')",
            f"{PREFIX}py_century(try_to_timestamp(c, '{lenient.SHORT_YEAR}'))",
        ),
    ),
    "py_event_time": ("c STRING", "TIMESTAMP", rf"{PREFIX}py_time_of(regexp_replace(c, r'(?U)\s+', ' '))"),
    "py_iin": ("iin STRING", "BOOLEAN", r"coalesce(iin RLIKE r'(?U)^\d{12}\n?\z', false)"),
    "py_city": (
        "address STRING",
        "STRING",
        rf"CASE WHEN {_GIVEN} THEN regexp_replace(substring_index(address, ',', 1), r'(?U)^\s+|\s+$', '') ELSE '' END",
    ),
    "py_address": ("address STRING", "STRING", f"CASE WHEN {_GIVEN} THEN address ELSE '' END"),
    "py_vat": (
        "rate STRING",
        "STRING",
        r"CASE WHEN regexp_extract(rate, r'(?U)\d+', 0) <> '' THEN concat(regexp_extract(rate, r'(?U)\d+', 0), '%') END",
    ),
    "item_vat": (f"items {_ITEMS_WITH_VAT}", "STRING", "CASE WHEN size(items) > 0 THEN get(items, 0).VAT.Rate ELSE '' END"),
    "total": (
        f"items {_ITEMS}",
        _MONEY,
        "aggregate(items, CAST(0 AS decimal(38,2)), (sum, item) -> CAST(try_add(sum, "
        "try_cast(round(try_multiply(try_cast(item.UnitPrice AS decimal(24,6)), item.Quantity), 2) "
        f"AS {_MONEY})) AS decimal(38,2)), sum -> try_cast(sum AS {_MONEY}))",
    ),
}

_KNOWN = "event_time IS NOT NULL"
_REASONS = {
    # As the error table has them: valid VAT is called bad, and what is unknown has no code.
    "reference": {
        "bad_datetime": "event_time IS NULL",
        "bad_iin": "NOT iin_valid",
        "bad_vat": "vat_valid IS NOT NULL",
        "total <= 0": "TotalSum <= 0",
    },
    "complete": {
        "bad_datetime": "event_time IS NULL",
        "bad_iin": "NOT coalesce(iin_valid, false)",
        "bad_address": "address_correct IS NULL",
        "bad_vat": "vat_valid IS NULL",
        "bad_qr": "qr_code_valid IS NULL",
        "total <= 0": "NOT coalesce(TotalSum > 0, false)",
    },
}


def _q(name: str) -> str:
    return f"`{name}`"


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{_q(f.name)} {f.dataType.simpleString()}" for f in schema)


def _reason(mode: str) -> str:
    codes = ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in _REASONS[mode].items())
    return f"concat_ws('; ', {codes})"


def _checked(view: str, carried: list[str]) -> str:
    """Parsed receipts with their checks and the flag."""
    p = PREFIX
    parsed = f"SELECT {''.join(f'{_q(c)}, ' for c in carried)}inline(array(from_json(json, '{_ddl(RECEIPT)}'))) FROM {view}"
    checked = (
        f"SELECT *, {p}event_time(DateTime) AS event_time, {p}iin_valid(TaxPayerIIN) AS iin_valid, "
        f"{p}address_correct(Address) AS address_correct, {p}qr_code_valid(QRCode) AS qr_code_valid, "
        f"{p}vat_valid({p}main_vat_rate(size(Items), VatRate)) AS vat_valid FROM ({parsed})"
    )
    return (
        "SELECT *, TotalSum > 0 AND address_correct IS NOT NULL AND qr_code_valid IS NOT NULL AND iin_valid "
        f"AND vat_valid IS NOT NULL AND {_KNOWN} AS is_clean FROM ({checked})"
    )


def _clean_items(view: str, carried: list[str]) -> str:
    p = PREFIX
    receipt = {
        "company_name": "CompanyName",
        "tax_payer_iin": "TaxPayerIIN",
        "kkt_factor_number": _q(FACTORY_NUMBER),
        "kkt_registration_number": f"{p}whole({_q(REGISTRATION_NUMBER)})",
        "receipt_number": "ReceiptNumber",
        "date_time": "event_time",
        "total_sum": f"{p}amount(TotalSum)",
        "vat_rate": "VatRate",
        "vat_sum": f"{p}money(VatSum)",
        "payment": "Payment",
        "fiscal_sign": f"{p}whole({_q(FISCAL_SIGN)})",
        "ofd_name": f"{p}or_unknown(OFD.Name)",
        "ofd_site": f"{p}or_unknown(OFD.Site)",
        "address": "address_correct",
        "qr_code": "QRCode",
    }
    item = {
        "upload_time": "current_timestamp()",
        "category": "item.Category",
        "product_name": f"{p}strip_marks(item.Name)",
        "unit_price": f"{p}amount(item.UnitPrice)",
        "quantity": "CAST(item.Quantity AS BIGINT)",
        "total_amount_by_position": f"{p}amount(item.Total)",
    }
    keep = "".join(f"{_q(c)}, " for c in carried)
    typed = ", ".join(f"{v} AS {n}" for n, v in receipt.items())
    receipts = f"SELECT {keep}{typed}, explode(Items) AS item FROM ({_checked(view, carried)}) WHERE is_clean"
    return f"SELECT {keep}{', '.join(f'{item.get(c, c)} AS {c}' for c in CLEAN.names)} FROM ({receipts})"


def _errors(view: str, carried: list[str], mode: str, rejected: str) -> str:
    payload = ", ".join(_q(c) for c in PAYLOAD_COLUMNS[:-1])
    return (
        f"SELECT {''.join(f'{_q(c)}, ' for c in carried)}current_timestamp() AS ts, {_reason(mode)} AS reason, "
        f"to_json(struct({payload}, event_time AS {PAYLOAD_COLUMNS[-1]})) AS payload "
        f"FROM ({_checked(view, carried)}) WHERE {rejected}"
    )


def register(spark: SparkSession, view: str | None = None) -> list[str]:
    """Create the functions, replacing those of an earlier call; their names. Table functions
    only with a ``view`` of documents: ``receipt_checked``, ``receipt_clean_items``,
    ``receipt_errors`` and, with every failing check named and unknown flags taken as
    failing, ``receipt_errors_complete``."""
    made = []
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}({parameters}) RETURNS {kind} RETURN {body}")
        made.append(PREFIX + name)
    if view is None:
        return made
    source = spark.table(view).schema
    carried = [f for f in source if f.name != "json"]
    names = [f.name for f in carried]
    checked = T.StructType(
        [
            *carried,
            *RECEIPT,
            T.StructField("event_time", T.TimestampType()),
            T.StructField("iin_valid", T.BooleanType()),
            *[T.StructField(c, T.StringType()) for c in ("address_correct", "qr_code_valid", "vat_valid")],
            T.StructField("is_clean", T.BooleanType()),
        ]
    )
    tables = {
        "checked": (checked, _checked(view, names)),
        "clean_items": (T.StructType([*carried, *CLEAN]), _clean_items(view, names)),
        "errors": (T.StructType([*carried, *ERROR]), _errors(view, names, "reference", "NOT is_clean")),
        "errors_complete": (
            T.StructType([*carried, *ERROR]),
            _errors(view, names, "complete", "NOT coalesce(is_clean, false)"),
        ),
    }
    for name, (schema, body) in tables.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}() RETURNS TABLE({_ddl(schema)}) RETURN {body}")
        made.append(PREFIX + name)
    return made
