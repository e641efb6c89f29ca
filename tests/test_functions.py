from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import apply
from receiptlake import functions as R

D = Decimal


def test_event_time(spark):
    cases = {
        "2025-01-02, 03:04:05": datetime(2025, 1, 2, 3, 4, 5),
        "02.01.25 03:04": datetime(2025, 1, 2, 3, 4),
        "02/01/2025 03:04:05": datetime(2025, 1, 2, 3, 4, 5),
        "01.01.69 00:00": datetime(2069, 1, 1),
        "01.01.99 00:00": datetime(2099, 1, 1),
        "2025-1-2, 3:4:5": None,
        "2.1.25 03:04": None,
        "2025-02-30, 00:00:00": None,
        "2025-01-02 03:04:05": None,
        "2025-01-02, 03:04:05 ": None,
        "02.01.2025 03:04": None,
        "02/01/2025, 03:04:05": None,
        "02.01/2025 03:04": None,
        "not a date": None,
        "": None,
        None: None,
    }
    assert apply(spark, R.event_time, cases) == list(cases.values())


def test_event_time_equals_trying_each_pattern(spark):
    texts = [
        f"{a}{s}{b}{s}{c}{t}{d}:{e}{f}"
        for a, b, c in [("2025", "01", "02"), ("02", "01", "25"), ("02", "01", "2025"), ("+12025", "01", "02")]
        for s in "-./"
        for t in (" ", ", ", ",")
        for d, e, f in [("03", "04", ":05"), ("03", "04", ""), ("3", "4", ":5")]
    ]

    def one_by_one(c):
        from receiptlake.functions.checks import TIME_PATTERNS

        return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit(p)) for p in TIME_PATTERNS])

    as_text = lambda f: (lambda c: f(c).cast("string"))
    expected = apply(spark, as_text(one_by_one), texts)
    assert apply(spark, as_text(R.event_time), texts) == expected
    assert sum(x is not None for x in expected) >= 3


def test_year_month(spark):
    cases = {datetime(2025, 3, 4): "2025-03", None: None}
    assert apply(spark, R.year_month, cases, "timestamp") == list(cases.values())


def test_iin_valid(spark):
    cases = {
        "123456789012": True,
        "12345678901": False,
        "123456789012x": False,
        "123456789012\n": True,
        "١٢٣٤٥٦٧٨٩٠١٢": False,
        "": False,
        None: None,
    }
    assert apply(spark, R.iin_valid, cases) == list(cases.values())


def test_address_and_city(spark):
    cases = {
        "Алматы, Абая 1": ("Алматы, Абая 1", "Алматы"),
        "Астана": ("Астана", "Астана"),
        " unknown": (" unknown", " unknown"),
        " Шымкент , 1": (" Шымкент , 1", " Шымкент "),
        ",x": (",x", ""),
        "unknown": (None, ""),
        "": (None, ""),
        None: (None, ""),
    }
    assert apply(spark, R.address_correct, cases) == [a for a, _ in cases.values()]
    assert apply(spark, R.city, cases) == [c for _, c in cases.values()]


def test_main_vat_rate(spark):
    df = spark.createDataFrame(
        [(1, ["x"], "12%"), (2, [], "12%"), (3, None, "12%"), (4, ["x"], None)],
        "n int, items array<string>, rate string",
    ).select("n", R.main_vat_rate("items", "rate").alias("out"))
    assert [r.out for r in sorted(df.collect())] == ["12%", "", "", None]


def test_vat_valid(spark):
    cases = {
        "12%": "12%",
        "0%": "0%",
        "НДС 012": "12%",
        "12.5%": "12%",
        "VAT 5": "5%",
        "": None,
        "none": None,
        "99999999999": None,
        None: None,
    }
    assert apply(spark, R.vat_valid, cases) == list(cases.values())


def test_qr_code_valid(spark):
    cases = {"abc": "abc", "": None, "битый_qr_code": None, " ": " ", None: None}
    assert apply(spark, R.qr_code_valid, cases) == list(cases.values())


def test_strip_marks(spark):
    cases = {
        "a!!!b": "ab",
        "x!!!!": "x!",
        "a***b???": "ab?",
        "x!!!  ": "x",
        "  x ": "  x",
        "a b": "a b",
        "x !!!": "x ",
        None: None,
    }
    assert apply(spark, R.strip_marks, cases) == list(cases.values())


def test_whole_equals_the_lenient_cast(spark):
    texts = ["12", "12.5", "-12.5", "12.", ".5", ".", "+7.0", " 8.2 ", "1.2.3", "a.5", "1E5",
             "1.5E5", "", "x", None, "9223372036854775807", "9223372036854775808", "007"]
    got = apply(spark, R.whole, texts)
    other = spark.newSession()
    other.conf.set("spark.sql.ansi.enabled", "false")
    expected = apply(other, lambda c: F.col(c).cast("bigint"), texts)
    assert got == expected


def test_money(spark):
    assert apply(spark, R.money, [1.005, 1e30, float("nan"), None, -2.344], "double") == [
        D("1.01"), None, None, None, D("-2.34")]
    assert apply(spark, R.money, ["1.23456789E7", "2.88", "x", "", None]) == [
        D("12345678.90"), D("2.88"), None, None, None]


def test_or_unknown(spark):
    assert apply(spark, R.or_unknown, ["a", "", None]) == ["a", "", "unknown"]


def test_line_and_receipt_totals(spark):
    item = "array<struct<UnitPrice double, Quantity int>>"
    cases = [
        ([(10.5, 2), (3.0, 1)], D("24.00")),
        ([(0.335, 1)], D("0.34")),
        ([], D("0.00")),
        (None, None),
        ([(None, 1), (1.0, 1)], None),
        ([(1e30, 1)], None),
    ]
    assert apply(spark, R.receipt_total, [c for c, _ in cases], item) == [t for _, t in cases]


def test_vat_sum_and_site(spark):
    df = spark.createDataFrame(
        [(1, 24.0, "12%"), (2, 24.0, "0%"), (3, 24.0, None), (4, None, "12%"), (5, 0.04, "12")],
        "n int, total double, rate string",
    ).select("n", R.vat_sum("total", "rate").alias("out"))
    assert [r.out for r in sorted(df.collect())] == [
        D("2.88"), D("0.00"), D("0.00"), None, D("0.00")]
    assert apply(spark, R.ofd_site, ["АО Казахтелеком", "АО Транстелеком", "x", None]) == [
        "https://ofd.telecom.kz"] + ["https://ofd.ttc.kz"] * 3


# The lenient variants: what Python's own parsing makes of each text.


def test_py_event_time(spark):
    cases = {
        "2025-01-02, 03:04:05": datetime(2025, 1, 2, 3, 4, 5),
        "2025-1-2, 3:4:5": datetime(2025, 1, 2, 3, 4, 5),
        "2025-01-02,  03:04:05": datetime(2025, 1, 2, 3, 4, 5),
        "2.1.25 3:4": datetime(2025, 1, 2, 3, 4),
        "02.01.68 00:00": datetime(2068, 1, 2),
        "02.01.69 00:00": datetime(1969, 1, 2),
        "29.02.72 10:00": datetime(1972, 2, 29, 10),
        "31.12.99 23:59": datetime(1999, 12, 31, 23, 59),
        "2/1/2025 3:4:5": datetime(2025, 1, 2, 3, 4, 5),
        "31/02/2025 00:00:00": None,
        "2025-01-02, 24:00:00": None,
        "x": None,
        "": None,
        None: None,
        "25.01.02 3:4 ": None,
    }
    assert apply(spark, R.py_event_time, cases) == list(cases.values())


def test_py_iin(spark):
    texts = ["123456789012", "12345678901", "123456789012\n", "123456789012\r", "١٢٣٤٥٦٧٨٩٠١٢", "", None]
    assert apply(spark, R.py_iin_valid, texts) == [True, False, True, False, True, False, False]


def test_py_address_and_city(spark):
    cases = {
        " Шымкент , 1": (" Шымкент , 1", "Шымкент"),
        " Актау\t, 1": (" Актау\t, 1", "Актау"),
        "unknown": ("", ""),
        "": ("", ""),
        None: ("", ""),
    }
    assert apply(spark, R.py_address, cases) == [a for a, _ in cases.values()]
    assert apply(spark, R.py_city, cases) == [c for _, c in cases.values()]


def test_py_vat(spark):
    cases = {"12%": "12%", "012%": "012%", "99999999999": "99999999999%", "": None, None: None}
    assert apply(spark, R.py_vat, cases) == list(cases.values())


def test_item_vat(spark):
    item = "array<struct<VAT struct<Rate string, Sum double>>>"
    values = [[(("12%", 1.0),), (("0%", 0.0),)], [], None, [(None,)]]
    assert apply(spark, R.item_vat, values, item) == ["12%", "", "", None]


@pytest.mark.parametrize("value", [None, "", "x", "1.5", "99999999999999999999"])
def test_dirty_values_never_raise(spark, value):
    functions = [R.event_time, R.iin_valid, R.address_correct, R.city, R.vat_valid,
                 R.qr_code_valid, R.strip_marks, R.money, R.whole, R.py_event_time, R.py_iin_valid,
                 R.py_city, R.py_address, R.py_vat, R.ofd_site, R.or_unknown]
    df = spark.createDataFrame([(value,)], "v string")
    df.select(*[f("v").alias(f"c{n}") for n, f in enumerate(functions)]).collect()
