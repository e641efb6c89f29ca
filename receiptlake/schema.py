"""The three contracts: receipts as they arrive, clean line items, rejected receipts."""

from pyspark.sql import types as T

_TEXT = T.StringType()
_TIME = T.TimestampType()
_LONG = T.LongType()
_DOUBLE = T.DoubleType()
_MONEY = T.DecimalType(18, 2)


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, type_) for name, type_ in fields.items()])


# Document fields whose names are long.
FACTORY_NUMBER = "KKTFactorNumber (ЗНМ)"
REGISTRATION_NUMBER = "KKTRegistrationNumber (РНМ)"
FISCAL_SIGN = "FiscalSign (ФП)"

# Names and types of the document fields, in order.
_ITEM_FIELDS = {
    "Category": _TEXT,
    "Name": _TEXT,
    "UnitPrice": _DOUBLE,
    "Quantity": T.IntegerType(),
    "Total": _DOUBLE,
}
_ITEM_VAT_FIELDS = {"Rate": _TEXT, "Sum": _DOUBLE}
_RECEIPT_FIELDS = {
    "CompanyName": _TEXT,
    "TaxPayerIIN": _TEXT,
    FACTORY_NUMBER: _TEXT,
    REGISTRATION_NUMBER: _TEXT,
    "ReceiptNumber": _LONG,
    "DateTime": _TEXT,
    "Items": T.ArrayType(_struct(_ITEM_FIELDS)),
    "TotalSum": _DOUBLE,
    "VatRate": _TEXT,
    "VatSum": _TEXT,
    "Payment": _TEXT,
    FISCAL_SIGN: _TEXT,
    "OFD": _struct({"Name": _TEXT, "Site": _TEXT}),
    "Address": _TEXT,
    "QRCode": _TEXT,
}

# Names and types of the clean line-item table, in order.
_CLEAN_FIELDS = {
    "upload_time": _TIME,
    "company_name": _TEXT,
    "tax_payer_iin": _TEXT,
    "kkt_factor_number": _TEXT,
    "kkt_registration_number": _LONG,
    "receipt_number": _LONG,
    "date_time": _TIME,
    "category": _TEXT,
    "product_name": _TEXT,
    "unit_price": _MONEY,
    "quantity": _LONG,
    "total_amount_by_position": _MONEY,
    "total_sum": _MONEY,
    "vat_rate": _TEXT,
    "vat_sum": _MONEY,
    "payment": _TEXT,
    "fiscal_sign": _LONG,
    "ofd_name": _TEXT,
    "ofd_site": _TEXT,
    "address": _TEXT,
    "qr_code": _TEXT,
}

RECEIPT = _struct(_RECEIPT_FIELDS)
CLEAN = _struct(_CLEAN_FIELDS)
ERROR = _struct({"ts": _TIME, "reason": _TEXT, "payload": _TEXT})

# The older document shape: every item carries its own VAT.
_OLD_ITEM = _struct({**_ITEM_FIELDS, "VAT": _struct(_ITEM_VAT_FIELDS)})
RECEIPT_WITH_ITEM_VAT = _struct({**_RECEIPT_FIELDS, "Items": T.ArrayType(_OLD_ITEM)})

# What an error payload holds: the parsed document and its event time.
PAYLOAD_COLUMNS = RECEIPT.names + ["DateTime_ts"]
