import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import documents, receipt
from receiptlake import operators as O
from receiptlake.schema import CLEAN, ERROR, PAYLOAD_COLUMNS, RECEIPT_WITH_ITEM_VAT
from receiptlake.sources import parse_receipts, with_event_time


def checked_docs(docs):
    return O.with_checks(with_event_time(parse_receipts(docs)))


def checked(spark, *texts):
    return checked_docs(documents(spark, *texts))


def names_and_types(schema):
    return [(f.name, f.dataType) for f in schema]


def test_clean_contract(spark):
    items = O.clean_items(documents(spark, receipt()))
    assert names_and_types(items.schema) == names_and_types(CLEAN)
    assert len(CLEAN) == 21
    feed = O.error_feed(documents(spark, receipt()))
    assert names_and_types(feed.schema) == names_and_types(ERROR)


def test_clean_values(spark):
    first, second = O.clean_items(documents(spark, receipt())).orderBy("unit_price").collect()[::-1]
    assert first.product_name == "Хлеб" and second.product_name == "Сыр"
    assert first.date_time == datetime(2025, 1, 2, 3, 4, 5)
    assert first.unit_price == Decimal("10.50") and first.quantity == 2
    assert (first.kkt_registration_number, first.fiscal_sign) == (12345678901, 9876543210)
    assert first.vat_rate == "12%" and first.vat_sum == Decimal("2.88")
    assert first.upload_time is not None


def test_steps_equal_the_job(spark):
    docs = documents(spark, receipt(), receipt(OFD=None, VatSum="x"))
    receipts = O.with_upload_time(O.select_clean(O.clean(checked_docs(docs))))
    steps = O.type_items(O.explode_items(O.type_receipts(receipts)))
    job = O.clean_items(docs)
    assert steps.columns == job.columns
    assert steps.drop("upload_time").exceptAll(job.drop("upload_time")).count() == 0


def test_raw_rate_and_defaults(spark):
    [a, _] = O.clean_items(documents(spark, receipt(VatRate="НДС 012", OFD=None))).collect()
    assert (a.vat_rate, a.ofd_name, a.ofd_site) == ("НДС 012", "unknown", "unknown")


@pytest.mark.parametrize(
    "changes, flag",
    [
        ({}, True),
        ({"TaxPayerIIN": None}, None),
        ({"TotalSum": None}, None),
        ({"TaxPayerIIN": None, "Address": "unknown"}, False),
        ({"DateTime": "x"}, False),
        ({"TotalSum": 0}, False),
        ({"VatRate": ""}, False),
        ({"VatRate": None}, False),
        ({"Items": []}, False),
        ({"Items": None}, False),
        ({"QRCode": "битый_qr_code"}, False),
        ({"Address": ""}, False),
    ],
)
def test_clean_flag(spark, changes, flag):
    assert [r.is_clean for r in checked(spark, receipt(**changes)).collect()] == [flag]


REASONS = [
    ({"Address": ""}, "bad_vat", "bad_address"),
    ({"VatRate": ""}, "", "bad_vat"),
    ({"DateTime": "x", "VatRate": ""}, "bad_datetime", "bad_datetime; bad_vat"),
    ({"TaxPayerIIN": "1", "QRCode": ""}, "bad_iin; bad_vat", "bad_iin; bad_qr"),
    ({"TotalSum": -1}, "bad_vat; total <= 0", "total <= 0"),
    ({"TotalSum": None}, None, "total <= 0"),
    ({"TaxPayerIIN": None}, None, "bad_iin"),
]


@pytest.mark.parametrize("changes, reference, complete", REASONS)
def test_reasons(spark, changes, reference, complete):
    docs = documents(spark, receipt(**changes))
    got = [r.reason for r in O.error_feed(docs).collect()]
    assert got == ([] if reference is None else [reference])
    got = [r.reason for r in O.error_feed(docs, mode="complete", on_null="error").collect()]
    assert got == [complete]


def test_malformed_document(spark):
    docs = documents(spark, "{oops")
    [row] = O.error_feed(docs, keep_source=True).collect()
    assert (row.json, row.reason, row.payload) == ("{oops", "bad_datetime", "{}")
    [row] = O.error_feed(docs, mode="complete").collect()
    assert row.reason.count(";") == 5


def test_unknown_modes():
    with pytest.raises(ValueError):
        O.reason("other")
    with pytest.raises(ValueError):
        O.errors(None, "other")


def test_payload(spark):
    [row] = O.error_feed(documents(spark, receipt(Address="", OFD=None))).collect()
    payload = json.loads(row.payload)
    assert list(payload) == [c for c in PAYLOAD_COLUMNS if c != "OFD"]
    assert payload["DateTime_ts"] == "2025-01-02T03:04:05.000Z"
    assert payload["Items"][0]["Name"] == "Хлеб!!!"


def test_payload_as_variant(spark):
    df = checked(spark, receipt(Address="")).select(O.payload(variant=True).alias("p"))
    assert dict(df.dtypes)["p"] == "variant"
    names = df.selectExpr("variant_get(p, '$.Items[1].Name', 'string')").collect()
    assert [tuple(r) for r in names] == [("Сыр",)]


def test_every_receipt_goes_to_one_place(spark):
    texts = [receipt(**c) for c, _, _ in REASONS] + [receipt(), "x"]
    df = checked(spark, *texts)
    clean, errors = O.clean(df).count(), O.errors(df).count()
    in_neither = df.filter("is_clean IS NULL").count()
    assert clean + errors + in_neither == len(texts) and in_neither == 2
    assert clean + O.errors(df, on_null="error").count() == len(texts)


def test_item_vat_checks(spark):
    def run(**changes):
        items = [{"Name": "n", "VAT": {"Rate": changes.pop("rate", "012%"), "Sum": 1.0}}]
        docs = documents(spark, receipt(Items=items, **changes))
        df = parse_receipts(docs, schema=RECEIPT_WITH_ITEM_VAT)
        [row] = O.with_item_vat_checks(df).collect()
        return row.is_clean, row.vat_valid

    assert run() == (True, "012%")
    assert run(QRCode="", Address="unknown", DateTime="2.1.25 3:4") == (True, "012%")
    assert run(TaxPayerIIN=None) == (False, "012%")
    assert run(TotalSum=None) == (None, "012%")
    assert run(rate="") == (False, None)


def test_reconcile(spark):
    items = [
        {"Name": "a", "UnitPrice": 10.5, "Quantity": 2, "Total": 20.0},
        {"Name": "b", "UnitPrice": 3.0, "Quantity": 1, "Total": 3.0},
    ]
    ofd = {"Name": "АО Транстелеком", "Site": "https://ofd.telecom.kz"}
    docs = documents(spark, receipt(Items=items, TotalSum=23.0, VatSum=2.76, OFD=ofd))
    [row] = O.receipt_reconcile(parse_receipts(docs)).collect()
    assert [tuple(x) for x in row.lines] == [
        (Decimal("21.00"), Decimal("-1.00")),
        (Decimal("3.00"), Decimal("0.00")),
    ]
    assert (row.receipt_total, row.receipt_diff) == (Decimal("24.00"), Decimal("-1.00"))
    assert (row.vat_due, row.vat_diff) == (Decimal("2.76"), Decimal("0.00"))
    assert (row.ofd_site, row.ofd_site_ok) == ("https://ofd.ttc.kz", False)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_parses_once_and_never_shuffles(spark, tmp_path):
    path = str(tmp_path / "docs")
    documents(spark, receipt(), "x").write.text(path)
    docs = spark.read.text(path).select(F.col("value").alias("json"))
    for df in (O.clean_items(docs), O.error_feed(docs)):
        plan = plan_of(df)
        assert plan.count("from_json") == 1
        assert "Exchange" not in plan and "Python" not in plan


def test_clean_filter_runs_before_the_explode(spark):
    plan = plan_of(O.clean_items(documents(spark, receipt()).withColumn("json", F.upper("json"))))
    lines = [x for x in plan.splitlines() if "Filter" in x or "Generate" in x]
    assert ["explode" in lines[0], "Filter" in lines[1], "inline" in lines[2]] == [True] * 3
