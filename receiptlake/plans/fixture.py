"""Receipt documents derived from the order tables (rules in FIXTURES.md).

One document per order, with its lines as items. An order with more than ``PAGE_LINES``
lines is issued as several documents with the same head, so that no document, row or
task has to hold an unbounded number of lines. Page 0 holds the order's first line. What
is asked of a receipt's head can be asked of page 0; what concerns its items is made for
every page and put together again (``per_receipt``).
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from receiptlake.plans.staging import kept, tables_key
from receiptlake.schema import FACTORY_NUMBER, FISCAL_SIGN, RECEIPT, REGISTRATION_NUMBER

PAGE_LINES = 500_000

ALL_FIELDS = tuple(RECEIPT.names)

# The columns used of each table.
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, "
    "o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, "
    "p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
}

# The rule of each field, k being the order key.
_TS = "o_orderdate + INTERVAL '30' YEAR + make_dt_interval(0, 0, 0, k * 7 % 86400)"
HEAD = {
    "CompanyName": "c_name",
    "TaxPayerIIN": "CASE WHEN k % 53 = 0 THEN NULL "
    "WHEN k % 59 = 1 THEN translate(lpad(string(o_custkey), 12, '0'), '0123456789', '٠١٢٣٤٥٦٧٨٩') "
    "WHEN k % 5 = 1 THEN lpad(string(o_custkey), 11, '0') "
    "WHEN k % 5 = 2 THEN lpad(string(o_custkey), 12, '0') || 'x' "
    "ELSE lpad(string(o_custkey), 12, '0') END",
    FACTORY_NUMBER: "char(k % 26 + 65) || lpad(string(k), 9, '0')",
    REGISTRATION_NUMBER: "CASE WHEN k % 71 = 0 THEN '12.5' WHEN k % 67 = 0 THEN 'x12' "
    "WHEN k % 73 = 0 THEN '99999999999999999999' ELSE string(k * 104729 % 1000000000000) END",
    "ReceiptNumber": "k % 999999 + 1",
    "DateTime": "CASE WHEN k % 59 = 0 THEN NULL WHEN k % 47 = 0 THEN 'not a date' "
    f"WHEN k % 37 = 0 THEN date_format({_TS}, 'd/M/yyyy H:m:s') "
    f"WHEN k % 53 = 1 THEN date_format({_TS} - INTERVAL '55' YEAR, 'dd.MM.yy HH:mm') "
    f"WHEN k % 3 = 0 THEN date_format({_TS}, 'yyyy-MM-dd, HH:mm:ss') "
    f"WHEN k % 3 = 1 THEN date_format({_TS}, 'dd.MM.yy HH:mm') "
    f"ELSE date_format({_TS}, 'dd/MM/yyyy HH:mm:ss') END",
    "TotalSum": "CASE WHEN k % 61 = 0 THEN NULL WHEN k % 29 = 0 THEN 0D "
    "WHEN k % 31 = 0 THEN -o_totalprice ELSE o_totalprice END",
    "VatRate": "CASE WHEN k % 44 = 4 THEN '012%' WHEN k % 44 = 8 THEN '12.5%' "
    "WHEN k % 44 = 12 THEN '99999999999%' WHEN k % 4 = 0 THEN '12%' WHEN k % 4 = 1 THEN '0%' "
    "WHEN k % 4 = 2 THEN '' ELSE 'VAT 5' END",
    "VatSum": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.12BD AS DECIMAL(18,2))",
    "Payment": "CASE k % 3 WHEN 0 THEN 'Cash' WHEN 1 THEN 'Card' ELSE 'QR' END",
    FISCAL_SIGN: "k * 15485863 % 10000000000",
    "OFD": "CASE WHEN k % 41 = 0 THEN NULL "
    "WHEN k % 2 = 0 THEN struct('АО Казахтелеком' AS Name, 'https://ofd.telecom.kz' AS Site) "
    "ELSE struct('АО Транстелеком' AS Name, 'https://ofd.ttc.kz' AS Site) END",
    "Address": "CASE WHEN k % 6 = 1 THEN 'unknown' WHEN k % 6 = 2 THEN '' "
    "WHEN k % 6 = 3 THEN ' ' || n_name || '\\t, ' || c_mktsegment "
    "ELSE n_name || ', ' || c_mktsegment END",
    "QRCode": "CASE WHEN k % 7 = 1 THEN '' WHEN k % 7 = 2 THEN 'битый_qr_code' "
    "ELSE 'QR' || lpad(string(k), 22, '0') END",
}
# What is done to the text of some documents. A number in quotes is of the
# wrong type; the last rule cuts a document off.
DAMAGE = (
    ("k % 79 = 0", """regexp_replace(text, '("ReceiptNumber":)([0-9]+)', '$1"$2"')"""),
    ("k % 83 = 0", """regexp_replace(text, '("TotalSum":)([-0-9.E]+)', '$1"$2"')"""),
    ("k % 101 = 0", """regexp_replace(text, '("VatSum":)([0-9.]+)', '$1"n/a"')"""),
    ("k % 43 = 0", "substring(text, 1, 20)"),
)

_LINE = "l_linenumber, l_partkey, l_suppkey"
_NAME = (
    "CASE (l_partkey + l_linenumber) % 8 WHEN 0 THEN p_name || '!!!' WHEN 1 THEN p_name || '***' "
    "WHEN 2 THEN p_name || '??' WHEN 3 THEN p_name || ' ' "
    "WHEN 4 THEN substring(p_name, 1, 3) || '!!!' || substring(p_name, 4) "
    "WHEN 5 THEN '??' || p_name || ' *** ' ELSE p_name END"
)
_ITEM = (
    f"p_type AS Category, {_NAME} AS Name, p_retailprice AS UnitPrice, "
    "int(l_quantity) AS Quantity, l_extendedprice AS Total"
)
_ITEM_VAT = (
    "struct(CASE (l_partkey + l_linenumber) % 4 WHEN 0 THEN '012%' WHEN 1 THEN '0%' "
    "WHEN 2 THEN '' ELSE 'VAT' END AS Rate, "
    "CASE (l_partkey + l_linenumber) % 4 WHEN 0 "
    "THEN round(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.12BD, 2) ELSE 0 END AS Sum) AS VAT"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


# Lines of a long order are dealt to ``pages`` slots by hash. Pages are numbered from
# the slot the first line falls in, so that page 0 is the one with the first line.
_SLOT = "pmod(xxhash64({line}), pages)"
_PAGE = "int(coalesce(pmod({slot} - first_slot, pages), 0))"


def long_orders(lineitem: DataFrame, sf_dir: str, page_lines: int) -> DataFrame | None:
    """Orders that need several pages, and the slot their first line falls in: one pass
    over the lines, combined before the shuffle, for each state of the table. The result is
    written out, so its size is known to the optimizer, which broadcasts it or not. None if
    there is no such order."""
    first = _SLOT.format(line="first.l_linenumber, first.l_partkey, first.l_suppkey")
    counts = (
        lineitem.groupBy(F.col("l_orderkey").alias("long_key"))
        .agg(F.count("*").alias("lines"), F.expr(f"min(struct({_LINE})) AS first"))
        .filter(f"lines > {page_lines}")
        .selectExpr("long_key", f"int(ceil(lines / {page_lines})) AS pages", "first")
        .selectExpr("long_key", "pages", f"{first} AS first_slot")
    )
    key = tables_key(lineitem.sparkSession, sf_dir, ["lineitem"])
    return kept(counts, "long-orders", (page_lines, *key))


def paged_items(lineitem: DataFrame, part: DataFrame, long: DataFrame | None, vat: bool) -> DataFrame:
    """Columns l_orderkey, l_page and the page's items in line order. The rows are
    shuffled as they are: collecting before the shuffle would combine nothing. They are
    shuffled once: without pages the optimizer drops ``l_page``, a constant, from the keys of
    the grouping and the join, and rows dealt by it as well would have to be dealt again."""
    item = f"struct({_LINE}, {_ITEM}, {_ITEM_VAT})" if vat else f"struct({_LINE}, {_ITEM})"
    names = "l -> struct(l.Category, l.Name, l.UnitPrice, l.Quantity, l.Total"
    names += ", l.VAT)" if vat else ")"
    if long is None:
        lines, dealt = lineitem.withColumn("l_page", F.lit(0)), ["l_orderkey"]
    else:
        dealt = ["l_orderkey", "l_page"]
        page = _PAGE.format(slot=_SLOT.format(line=_LINE))
        lines = lineitem.join(long, F.expr("l_orderkey = long_key"), "left")
        lines = lines.selectExpr("*", f"{page} AS l_page")
    return (
        lines.join(part, F.expr("l_partkey = p_partkey"), "left")
        .selectExpr("l_orderkey", "l_page", f"{item} AS item")
        .repartition(*dealt)
        .groupBy("l_orderkey", "l_page")
        .agg(F.expr(f"transform(sort_array(collect_list(item)), {names}) AS Items"))
    )


@dataclass
class Documents:
    """Columns ``k`` (order key), ``page`` and ``json``; ``paged``: some order has pages."""

    rows: DataFrame
    paged: bool


def documents(
    spark: SparkSession, sf_dir: str, item_vat: bool = False, page_lines: int | None = None
) -> Documents:
    """Whole documents, from whole tables."""
    docs = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    lineitem = table(spark, sf_dir, "lineitem")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    docs = docs.join(customer, F.expr("o_custkey = c_custkey"), "left")
    docs = docs.join(nation, F.expr("c_nationkey = n_nationkey"), "left")
    long = long_orders(lineitem, sf_dir, page_lines or PAGE_LINES)
    paged = long is not None
    items = paged_items(lineitem, table(spark, sf_dir, "part"), long, item_vat)
    if paged:
        docs = (
            docs.join(long, F.expr("k = long_key"), "left")
            .selectExpr("*", "explode(sequence(0, coalesce(pages, 1) - 1)) AS slot")
            .selectExpr("*", f"{_PAGE.format(slot='slot')} AS page")
        )
    else:
        docs = docs.withColumn("page", F.lit(0))
    docs = docs.join(items, F.expr("k = l_orderkey AND page = l_page"), "left")
    if paged:  # a slot that no line fell into makes no page
        docs = docs.filter("page = 0 OR Items IS NOT NULL")
    rules = {**HEAD, "Items": "Items"}
    values = ", ".join(f"{rules[n]} AS `{n}`" for n in ALL_FIELDS)
    docs = docs.selectExpr("k", "page", f"to_json(struct({values})) AS text")
    for some, damaged in DAMAGE:
        docs = docs.withColumn("text", F.expr(f"CASE WHEN {some} THEN {damaged} ELSE text END"))
    return Documents(docs.withColumnRenamed("text", "json"), paged)


def total_of_pages(value: Column, name: str) -> Column:
    """A total over pages: unknown if it is unknown on one of them."""
    return F.when(F.count(value) == F.count("*"), F.sum(value)).alias(name)


def per_receipt(pages: DataFrame, paged: bool, heads, **totals) -> DataFrame:
    """One row per receipt of rows per page: columns k, ``heads`` as page 0 has them, and
    ``totals``: name to an aggregate over the pages. Without pages there is nothing to put
    together, and the columns called like the totals are those of the only page."""
    if not paged:
        return pages.select("k", *heads, *totals)
    head = F.min_by(F.struct(*[F.col(f"`{h}`") for h in heads]), "page").alias("head")
    merged = pages.groupBy("k").agg(head, *[t.alias(n) for n, t in totals.items()])
    return merged.select("k", "head.*", *totals)
