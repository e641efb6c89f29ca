import json

from receiptlake.schema import FACTORY_NUMBER, FISCAL_SIGN, REGISTRATION_NUMBER

GOOD = {
    "CompanyName": "ТОО Ромашка",
    "TaxPayerIIN": "123456789012",
    FACTORY_NUMBER: "A000000001",
    REGISTRATION_NUMBER: 12345678901,
    "ReceiptNumber": 7,
    "DateTime": "2025-01-02, 03:04:05",
    "Items": [
        {"Category": "c", "Name": "Хлеб!!!", "UnitPrice": 10.5, "Quantity": 2, "Total": 21.0},
        {"Category": "c", "Name": "Сыр", "UnitPrice": 3.0, "Quantity": 1, "Total": 3.0},
    ],
    "TotalSum": 24.0,
    "VatRate": "12%",
    "VatSum": 2.88,
    "Payment": "Cash",
    FISCAL_SIGN: 9876543210,
    "OFD": {"Name": "АО Казахтелеком", "Site": "https://ofd.telecom.kz"},
    "Address": "Алматы, Абая 1",
    "QRCode": "abcdefghijklmnopqrstuvwx",
}


def receipt(**changes) -> str:
    """A clean receipt with some fields changed; ``None`` leaves a field out."""
    fields = {**GOOD, **changes}
    return json.dumps({k: v for k, v in fields.items() if v is not None}, ensure_ascii=False)


def documents(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "json string")


def apply(spark, function, values, type_="string"):
    """The results of a column function on Python values, in order."""
    rows = [(n, v) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"n int, v {type_}").select("n", function("v").alias("out"))
    return [r.out for r in sorted(df.collect())]


def multiset(df):
    columns = sorted(df.columns)
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
