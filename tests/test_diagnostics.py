"""What the typed parse loses, against documents whose faults are known; SQL functions."""

import pytest
from pyspark.sql import functions as F

from helpers import GOOD, apply, documents, multiset, receipt
from receiptlake import functions as R
from receiptlake import operators as O
from receiptlake.functions.sql import register
from receiptlake.schema import FISCAL_SIGN, RECEIPT_WITH_ITEM_VAT
from receiptlake.sources import parse_diagnostics, parse_receipts


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, json string")
    rows = parse_diagnostics(df).collect()
    return sorted((r.n, r.field, r.pos, r.declared, r.found) for r in rows)


ITEM = GOOD["Items"][0]


def test_values_of_other_types(spark):
    assert found(spark, receipt(), receipt(TaxPayerIIN=None, Items=[])) == []
    assert found(spark, receipt(ReceiptNumber="7", TotalSum="x", OFD=["a"])) == [
        (0, "OFD", None, "struct<Name:string,Site:string>", "ARRAY<STRING>"),
        (0, "ReceiptNumber", None, "bigint", "STRING"),
        (0, "TotalSum", None, "double", "STRING"),
    ]
    assert found(spark, receipt(ReceiptNumber=1.5)) == [(0, "ReceiptNumber", None, "bigint", "DECIMAL(2,1)")]
    (one,) = found(spark, receipt(Items={"Name": "x"}))
    assert one[1:3] == ("Items", None) and one[4] == "OBJECT<Name: STRING>"


def test_numbers_taken_as_text_are_not_lost(spark):
    assert found(spark, receipt(VatSum=2.5, **{FISCAL_SIGN: 1}, Payment=True)) == []


def test_values_inside(spark):
    items = [ITEM, {**ITEM, "Quantity": 1.5, "UnitPrice": "a"}, {**ITEM, "Quantity": None}, {**ITEM, "Total": [1]}]
    assert found(spark, receipt(Items=items)) == [
        (0, "Items[].Quantity", 1, "int", "DECIMAL(2,1)"),
        (0, "Items[].Total", 3, "double", "ARRAY<BIGINT>"),
        (0, "Items[].UnitPrice", 1, "double", "STRING"),
    ]
    rows = found(spark, receipt(Items=[ITEM, 7, None]))
    assert [(r[1], r[2], r[4]) for r in rows] in ([("Items[]", 1, "BIGINT")], [("Items", None, "ARRAY<VARIANT>")])


def test_fields_that_are_not_declared(spark):
    rows = found(spark, receipt(taxpayeriin="1", Extra={"a": 1}), receipt(Extra=None))
    assert rows == [
        (0, "Extra", None, None, "OBJECT<a: BIGINT>"),
        (0, "taxpayeriin", None, None, "STRING"),
    ]


def test_text_that_is_no_document(spark):
    rows = found(spark, None, "", "{bad", "[1]", "7", '"text"', "null", "{}", receipt()[:20])
    assert [(r[0], r[1], r[4]) for r in rows] == [
        (0, "$", "missing"),
        (1, "$", "malformed"),
        (2, "$", "malformed"),
        (3, "$", "ARRAY<BIGINT>"),
        (4, "$", "BIGINT"),
        (5, "$", "STRING"),
        (6, "$", "VOID"),
        (8, "$", "malformed"),
    ]


def test_both_parses_happen_once(spark):
    docs = documents(spark, receipt()).withColumn("k", F.rand()).select("k", "json")
    plan = parse_diagnostics(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert plan.lower().count("parse_json") + plan.count("parseJson") == 1
    with pytest.raises(ValueError):
        parse_diagnostics(docs.withColumnRenamed("k", "found"))


def test_all_other_columns_are_kept(spark):
    df = spark.createDataFrame([(1, "a", "{bad")], "`a b` int, missing2 string, json string")
    assert parse_diagnostics(df).columns == ["a b", "missing2", "field", "pos", "declared", "found"]


# SQL functions.

TEXTS = [
    None, "", " ", "unknown", "Алматы, Абая 1", "\tАлматы , x", "12%", "012%", "12.5%", "99999999999%", "0%", "VAT ٥",
    "2025-01-02, 03:04:05", "02.01.25 10:00", "2.1.70 1:2", "02/01/2025 03:04:05", "2/1/2025 3:4:5", "not a date",
    "123456789012", "12345678901", "123456789012\n", "١٢٣٤٥٦٧٨٩٠١٢", "битый_qr_code", "a!!!b", "x***??  ", "12.5", "x1",
    "АО Казахтелеком", "-7", "1.005", "1e3",
]
TWINS = {
    "event_time": R.event_time, "iin_valid": R.iin_valid, "address_correct": R.address_correct, "city": R.city,
    "vat_valid": R.vat_valid, "qr_code_valid": R.qr_code_valid, "strip_marks": R.strip_marks, "money": R.money,
    "or_unknown": R.or_unknown, "whole": R.whole, "ofd_site": R.ofd_site, "py_event_time": R.py_event_time,
    "py_iin": R.py_iin_valid, "py_city": R.py_city, "py_address": R.py_address, "py_vat": R.py_vat,
}


@pytest.mark.parametrize("name", list(TWINS))
def test_scalar_functions_equal_their_twins(spark, name):
    register(spark)
    rows = [(n, t) for n, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "n int, v string").createOrReplaceTempView("texts")
    got = [r.out for r in spark.sql(f"SELECT receipt_{name}(v) AS out FROM texts ORDER BY n").collect()]
    assert got == apply(spark, TWINS[name], TEXTS)


def test_functions_of_several_values(spark):
    register(spark)
    df = parse_receipts(documents(spark, receipt(), receipt(Items=None), receipt(TotalSum=0.125, VatRate="0%")))
    df.createOrReplaceTempView("parsed")
    got = spark.sql(
        "SELECT receipt_vat_sum(TotalSum, VatRate), receipt_total(Items), receipt_main_vat_rate(size(Items), VatRate), "
        "receipt_line_total(Items[0].UnitPrice, Items[0].Quantity), receipt_amount(TotalSum) FROM parsed"
    )
    twin = df.select(
        R.vat_sum("TotalSum", "VatRate"),
        R.receipt_total("Items"),
        R.main_vat_rate("Items", "VatRate"),
        R.line_total(F.col("Items")[0]["UnitPrice"], F.col("Items")[0]["Quantity"]),
        R.money("TotalSum"),
    )
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, twin.collect())))
    old = documents(spark, receipt(Items=[{**ITEM, "VAT": {"Rate": "5%"}}]), receipt(Items=[]))
    parse_receipts(old, schema=RECEIPT_WITH_ITEM_VAT).createOrReplaceTempView("older")
    assert sorted(r[0] for r in spark.sql("SELECT receipt_item_vat(Items) FROM older").collect()) == ["", "5%"]


def test_table_functions(spark):
    texts = [receipt(), receipt(Address=""), receipt(TotalSum=None), "{bad", receipt(VatRate="x", DateTime="y")]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "`a b` int, json string")
    docs.createOrReplaceTempView("some_documents")
    assert "receipt_clean_items" in register(spark, "some_documents")
    items = spark.sql("SELECT * FROM receipt_clean_items()")
    assert items.schema == O.clean_items(docs).schema
    assert multiset(items.drop("upload_time")) == multiset(O.clean_items(docs).drop("upload_time"))
    for name, options in (("errors", {}), ("errors_complete", {"mode": "complete", "on_null": "error"})):
        got, want = spark.sql(f"SELECT * FROM receipt_{name}()"), O.error_feed(docs, **options)
        assert got.columns == want.columns and multiset(got.drop("ts")) == multiset(want.drop("ts")) != []


def test_table_functions_are_inlined(spark, tmp_path):
    """One scan, one parse, no shuffle, no Python; a filter of the caller reaches the scan."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, receipt())], "k int, json string").write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("stored_documents")
    register(spark, "stored_documents")
    df = spark.sql("SELECT category, total_sum FROM receipt_clean_items() WHERE k = 1 AND receipt_year_month(date_time) = '2025-01'")
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1 and "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,1)]" in plan
