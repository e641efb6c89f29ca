import json

import pytest

from helpers import GOOD, documents, receipt
from receiptlake.schema import RECEIPT, REGISTRATION_NUMBER
from receiptlake.sources import (
    decode_sse_lines,
    decode_value,
    parse_receipts,
    read_catalogue,
    read_topic,
)
from receiptlake.sources.topic import topic_options


def parse_one(spark, text, **options):
    [row] = parse_receipts(documents(spark, text), **options).collect()
    return row


def test_parse_good(spark):
    row = parse_one(spark, receipt())
    assert row.CompanyName == "ТОО Ромашка"
    assert row[REGISTRATION_NUMBER] == "12345678901"
    assert [i.Name for i in row.Items] == ["Хлеб!!!", "Сыр"]
    assert row.OFD.Site == "https://ofd.telecom.kz"
    assert parse_receipts(documents(spark, receipt())).schema == RECEIPT


@pytest.mark.parametrize("text", ["", None, "[]", "x", '{"CompanyName":"a'])
def test_malformed_is_a_row_of_nulls(spark, text):
    assert all(v is None for v in parse_one(spark, text))


def test_wrong_types_null_their_field_only(spark):
    row = parse_one(spark, receipt(ReceiptNumber="abc", TotalSum="x", Items={"a": 1}))
    assert (row.ReceiptNumber, row.TotalSum, row.Items) == (None, None, None)
    assert row.Payment == "Cash"
    bad_item = [{"Name": "n", "Quantity": 1.5, "UnitPrice": 2.0}]
    [item] = parse_one(spark, receipt(Items=bad_item)).Items
    assert (item.Name, item.Quantity, item.UnitPrice) == ("n", None, 2.0)


def test_names_are_case_sensitive_and_trailing_objects_ignored(spark):
    assert parse_one(spark, '{"taxpayeriin": "1"}').TaxPayerIIN is None
    assert parse_one(spark, '{"Payment": "QR"}{"Payment": "Cash"}').Payment == "QR"


def test_large_number_text(spark):
    assert parse_one(spark, receipt(VatSum=12345678.90)).VatSum == "1.23456789E7"


def test_keep_source_and_fields(spark):
    docs = spark.createDataFrame([(5, receipt()), (6, "x")], "offset int, json string")
    rows = parse_receipts(docs, keep_source=True, fields=["Payment"]).collect()
    assert [(r.offset, r.json, r.Payment) for r in rows] == [(5, receipt(), "Cash"), (6, "x", None)]


def test_decode_value(spark):
    df = spark.createDataFrame(
        [(bytearray("{\"a\":\"ЗНМ\"}".encode()), 3)], "value binary, offset long"
    )
    assert [tuple(r) for r in decode_value(df).collect()] == [('{"a":"ЗНМ"}',)]
    assert [tuple(r) for r in decode_value(df, keep_source=True).collect()] == [(3, '{"a":"ЗНМ"}')]


def test_topic_options(spark):
    assert topic_options("h:9092", "t") == {
        "kafka.bootstrap.servers": "h:9092",
        "subscribe": "t",
        "startingOffsets": "latest",
    }
    more = topic_options("h:9092", "t", "earliest", min_partitions=64, max_offsets_per_trigger=1000)
    assert more["minPartitions"] == "64" and more["maxOffsetsPerTrigger"] == "1000"
    with pytest.raises(Exception, match="kafka"):  # the connector is not installed here
        read_topic(spark, "h:9092", "t")


def test_sse_lines(spark):
    lines = {
        'data: {"a":1}': '{"a":1}',
        'data:{"a":1}\t': '{"a":1}',
        '{"a":1}': '{"a":1}',
        '  {"a":1} ': '  {"a":1} ',
        "data: {broken}": "{broken}",
        'Data: {"a":1}': None,
        ' data: {"a":1}': None,
        "data: [1]": None,
        'data: {"a":1': None,
        "{": None,
        ": ping": None,
        "data:": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in lines], "value string")
    got = [r.json for r in decode_sse_lines(df).collect()]
    assert got == [v for v in lines.values() if v is not None]
    assert all(v is None for v in parse_one(spark, "{broken}"))


def test_catalogue(spark):
    text = json.dumps({"products": {"Хлеб": ["a", "b"], "Сыр": ["c"], "нет": []}}, ensure_ascii=False)
    rows = read_catalogue(documents(spark, text, "x")).collect()
    assert sorted(map(tuple, rows)) == [("Сыр", 0, "c"), ("Хлеб", 0, "a"), ("Хлеб", 1, "b")]


def test_fixture_record_is_clean_json():
    assert json.loads(receipt()) == GOOD


def test_columns_called_like_fields_are_refused(spark):
    df = spark.createDataFrame([("{}", 1)], "json string, OFD int")
    with pytest.raises(ValueError, match="OFD"):
        parse_receipts(df, keep_source=True)
    assert parse_receipts(df).count() == 1
