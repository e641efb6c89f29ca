"""The registered queries: each operator over documents derived from the test tables.

Every query takes (spark, sf_dir) and returns a DataFrame with the order key ``k``. It works
on whole documents and on all their pages; only the parse is narrowed to the fields asked
for. Times are zone-free, and of clock columns it is told whether they are set.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from receiptlake import functions as R
from receiptlake import operators as O
from receiptlake import streaming as S
from receiptlake.functions.sql import register
from receiptlake.plans import fixture
from receiptlake.plans.fixture import ALL_FIELDS, per_receipt, table, total_of_pages
from receiptlake.plans.staging import discard, read_back, scratch_dir, staged_documents, written
from receiptlake.schema import (
    FACTORY_NUMBER,
    FISCAL_SIGN,
    RECEIPT,
    RECEIPT_WITH_ITEM_VAT,
    REGISTRATION_NUMBER,
)
from receiptlake.sources import (
    EventStreamSource,
    decode_sse_lines,
    decode_value,
    parse_diagnostics,
    parse_receipts,
    read_catalogue,
    read_lines,
    with_event_time,
)
from receiptlake.streaming import files

# Ranges of a captured file's text that a task reads.
FRAME_BYTES = 8 << 20

Query = Callable[[SparkSession, str], DataFrame]

CHECKED_FIELDS = [
    "TaxPayerIIN", "DateTime", "Items", "TotalSum", "VatRate", "Address", "QRCode"
]


def ntz(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def parsed_pages(spark: SparkSession, sf_dir: str, *fields: str) -> tuple[DataFrame, bool]:
    """One row per page: ``k``, ``page`` and the fields; and whether there are pages."""
    docs = fixture.documents(spark, sf_dir)
    rows = parse_receipts(docs.rows, keep_source=True, fields=fields).drop("json")
    return rows, docs.paged


def parsed(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """One row per receipt: ``k`` and the fields, items as far as page 0 has them, which
    tells whether there are any and what the first is."""
    return parsed_pages(spark, sf_dir, *fields)[0].filter("page = 0").drop("page")


def checked(spark: SparkSession, sf_dir: str, fields=CHECKED_FIELDS) -> DataFrame:
    return O.with_checks(with_event_time(parsed(spark, sf_dir, *fields)))


def field_query(field: str, name: str, check: Callable[[str], Column]) -> Query:
    def query(spark, sf_dir):
        return parsed(spark, sf_dir, field).select("k", check(field).alias(name))

    return query


HEADS = {
    "company_name": "CompanyName",
    "iin": "TaxPayerIIN",
    "factory_number": FACTORY_NUMBER,
    "registration_number": REGISTRATION_NUMBER,
    "receipt_number": "ReceiptNumber",
    "date_text": "DateTime",
    "total_sum": "TotalSum",
    "vat_rate": "VatRate",
    "vat_sum": "VatSum",
    "payment": "Payment",
    "fiscal_sign": FISCAL_SIGN,
    "ofd_name": "OFD.Name",
    "ofd_site": "OFD.Site",
    "address": "Address",
    "qr_code": "QRCode",
}
MONEY_HEADS = ("total_sum", "vat_sum")


def whole_receipts(pages: DataFrame, paged: bool, *more: str) -> DataFrame:
    """Every field of parsed pages, one row per receipt: the head, columns ``more``, number
    of items and sum of their totals over all pages."""
    sums = F.aggregate(
        F.transform("Items", lambda i: R.money(i["Total"])),
        F.lit(0).cast("decimal(38,2)"),
        lambda total, amount: F.try_add(total, amount).cast("decimal(38,2)"),
        R.money,
    )

    def named(name: str, path: str) -> Column:
        c = F.col(path if path.startswith("OFD.") else f"`{path}`")
        return (R.money(c) if name in MONEY_HEADS else c).alias(name)

    rows = pages.select(
        "k",
        "page",
        *[named(n, c) for n, c in HEADS.items()],
        *more,
        F.coalesce(F.array_size("Items"), F.lit(0)).cast("bigint").alias("item_count"),
        sums.alias("item_sum"),
    )
    count, total = F.sum("item_count"), R.money(total_of_pages(F.col("item_sum"), "item_sum"))
    return per_receipt(rows, paged, [*HEADS, *more], item_count=count, item_sum=total)


def decode_receipts(spark, sf_dir):
    docs = fixture.documents(spark, sf_dir)
    records = docs.rows.select("k", "page", F.col("json").cast("binary").alias("value"))
    decoded = decode_value(records, keep_source=True)
    return whole_receipts(parse_receipts(decoded, keep_source=True), docs.paged)


def sse_decode(spark, sf_dir):
    json = F.col("json")
    frames = F.array(
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("data: "), json)).otherwise(json),
        F.lit(": ping"),
        F.lit(""),
        F.lit("data: "),
        F.lit("retry: 3000"),
    )
    docs = fixture.documents(spark, sf_dir)
    lines = docs.rows.select("k", "page", F.explode(frames).alias("value"))
    return whole_receipts(parse_receipts(decode_sse_lines(lines), keep_source=True), docs.paged)


def sse_frames(spark, sf_dir):
    """Documents as events of one or three ``data:`` lines, captured in compressed files, read
    by ranges far smaller than a file as a stream that is started twice."""
    base = scratch_dir(spark)
    docs = fixture.documents(spark, sf_dir).rows
    inner = F.expr("substring(json, 2, length(json) - 2)")
    broken = ~F.col("json").endswith("}")
    folded = F.concat(F.lit("data: {\ndata: "), inner, F.lit("\r\ndata: }"))
    frame = F.when(broken | (F.col("k") % 3 == 0), F.concat(F.lit("data: "), "json"))
    frame = frame.when(F.col("k") % 3 == 1, folded).otherwise(F.col("json"))
    event = F.concat(
        F.lit("id: "), "k", F.lit("/"), "page", F.lit("\n"), frame, F.lit("\n\n: ping\n\ndata: {broken\n")
    )
    docs.select(event.alias("value")).write.option("compression", "snappy").text(f"{base}/captures")
    spark.dataSource.register(EventStreamSource)
    stream = spark.readStream.format("event_stream").option("path", f"{base}/captures")
    stream = stream.option("bytes_per_partition", FRAME_BYTES).load()
    key = F.split("id", "/")
    events = decode_sse_lines(stream).select(
        key[0].cast("bigint").alias("k"), key[1].cast("int").alias("page"), "json"
    )
    for _ in range(2):
        writer = events.writeStream.format("parquet").option("path", f"{base}/events")
        writer = writer.option("compression", "zstd")
        query = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(**NOW).start()
        query.awaitTermination()
    discard(spark, f"{base}/checkpoint")
    discard(spark, f"{base}/captures")
    landed = read_back(spark, f"{base}/events", events.schema)
    return whole_receipts(parse_receipts(landed, keep_source=True).drop("json"), _paged(landed))


def parse_types(spark, sf_dir):
    """Values of the receipts' heads that the typed parse loses, with the type they have."""
    docs = fixture.documents(spark, sf_dir).rows.filter("page = 0").select("k", "json")
    return parse_diagnostics(docs).select("k", "field", "declared", F.col("found").alias("found_type"))


def _sql(spark: SparkSession, docs: DataFrame, query: str) -> DataFrame:
    """A query with the SQL functions over documents."""
    view = f"documents_{uuid.uuid4().hex}"
    docs.createOrReplaceTempView(view)
    try:
        register(spark, view)
        return spark.sql(query)
    finally:
        spark.catalog.dropTempView(view)


def sql_clean_items(spark, sf_dir):
    docs = fixture.documents(spark, sf_dir).rows.select("k", "json")
    return _without_clock(_sql(spark, docs, "SELECT * FROM receipt_clean_items()"))


def sql_errors(spark, sf_dir):
    """Reasons of both modes; the complete one has receipts that the other leaves out."""
    docs = fixture.documents(spark, sf_dir).rows.filter("page = 0").select("k", "json")
    return _sql(
        spark,
        docs,
        "SELECT k, 'reference' AS mode, reason FROM receipt_errors() "
        "UNION ALL SELECT k, 'complete', reason FROM receipt_errors_complete()",
    )


def sql_checks(spark, sf_dir):
    """The scalar functions, lenient ones included, on the fields of the receipts."""
    docs = fixture.documents(spark, sf_dir).rows.filter("page = 0").select("k", "json")
    checks = {
        "event_time": "CAST(event_time AS TIMESTAMP_NTZ)",
        "year_month": "receipt_year_month(receipt_event_time(DateTime))",
        "iin_valid": "receipt_iin_valid(TaxPayerIIN)",
        "address": "receipt_address_correct(Address)",
        "city": "receipt_city(Address)",
        "vat_valid": "receipt_vat_valid(receipt_main_vat_rate(size(Items), VatRate))",
        "qr_code": "receipt_qr_code_valid(QRCode)",
        "vat_due": "receipt_vat_sum(TotalSum, VatRate)",
        "ofd_site": "receipt_ofd_site(OFD.Name)",
        "py_event_time": "CAST(receipt_py_event_time(DateTime) AS TIMESTAMP_NTZ)",
        "py_iin": "receipt_py_iin(TaxPayerIIN)",
        "py_city": "receipt_py_city(Address)",
        "py_address": "receipt_py_address(Address)",
        "py_vat": "receipt_py_vat(VatRate)",
    }
    columns = ", ".join(f"{c} AS {n}" for n, c in checks.items())
    return _sql(spark, docs, f"SELECT k, {columns} FROM receipt_checked()")


def catalogue_flatten(spark, sf_dir):
    """A document of two categories per part: its type and its brand."""
    kind, brand = F.coalesce("p_type", F.lit("")), F.coalesce("p_brand", F.lit(""))
    categories = F.array(kind, F.concat(F.lit("brand "), brand))
    products = F.map_from_arrays(
        categories, F.array(F.array("p_name", "p_brand"), F.array(F.col("p_name")))
    )
    docs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"), F.to_json(F.struct(products.alias("products"))).alias("json")
    )
    return read_catalogue(docs)


def event_time(spark, sf_dir):
    df = with_event_time(parsed(spark, sf_dir, "DateTime"))
    return df.select("k", ntz("DateTime_ts").alias("event_time"))


def year_month(spark, sf_dir):
    df = O.with_year_month(with_event_time(parsed(spark, sf_dir, "DateTime")))
    return df.select("k", "year_month")


def clock_columns(spark, sf_dir):
    """Whether the clock columns are set, and alike within the run."""
    pages, paged = parsed_pages(spark, sf_dir, "TotalSum")
    rows = O.with_upload_time(O.with_ingest_time(pages))
    rows = rows.withColumn("alike", F.col("ingest_time") == F.col("upload_time"))
    flag = F.coalesce("alike", F.lit(False)).alias("clock_set")
    return per_receipt(rows.select("k", "page", flag), paged, [], clock_set=F.every("clock_set"))


def main_vat_rate(spark, sf_dir):
    df = parsed(spark, sf_dir, "Items", "VatRate")
    return df.select("k", R.main_vat_rate("Items", "VatRate").alias("main_vat_rate"))


def vat_normalize(spark, sf_dir):
    df = main_vat_rate(spark, sf_dir)
    return df.select("k", R.vat_valid("main_vat_rate").alias("vat_valid"))


def clean_flag(spark, sf_dir):
    return checked(spark, sf_dir).select("k", "is_clean")


def clean_receipts(spark, sf_dir):
    df = O.clean(checked(spark, sf_dir, ALL_FIELDS))
    df = O.select_clean(df, keep=["k"]).drop("items", "ofd")
    return df.withColumns(
        {
            "event_time": ntz("event_time"),
            "total_sum": R.money("total_sum"),
            "vat_sum": R.money("vat_sum"),
        }
    )


def _without_clock(items: DataFrame) -> DataFrame:
    return items.drop("upload_time").withColumn("date_time", ntz("date_time"))


def clean_items(spark, sf_dir):
    docs = fixture.documents(spark, sf_dir).rows.select("k", "json")
    return _without_clock(O.clean_items(docs))


def error_reasons(spark, sf_dir):
    rejected = O.errors(checked(spark, sf_dir))
    return rejected.select("k", O.reason().alias("reason"))


def error_reasons_complete(spark, sf_dir):
    rejected = O.errors(checked(spark, sf_dir), on_null="error")
    return rejected.select("k", O.reason("complete").alias("reason"))


def payloads(feed: DataFrame, paged: bool, *more: str) -> DataFrame:
    """Error rows (k, page, ts, reason, payload) with the payload read back from its JSON,
    one row per receipt."""
    shape = T.StructType([*RECEIPT.fields, T.StructField("DateTime_ts", T.StringType())])
    feed = feed.withColumn("stamped", F.col("ts").isNotNull())
    pages = feed.select("k", "page", *more, "stamped", F.inline(F.array(F.from_json("payload", shape))))
    pages = pages.withColumn("event_time", ntz(F.col("DateTime_ts").try_cast("timestamp")))
    return whole_receipts(pages, paged, *more, "stamped", "event_time")


def error_payload(spark, sf_dir):
    docs = fixture.documents(spark, sf_dir)
    return payloads(O.error_feed(docs.rows), docs.paged)


def strip_marks(spark, sf_dir):
    pages, _ = parsed_pages(spark, sf_dir, "Items")
    names = pages.select("k", F.explode("Items.Name").alias("name"))
    return names.select("k", "name", R.strip_marks("name").alias("product_name"))


def ofd_defaults(spark, sf_dir):
    return parsed(spark, sf_dir, "OFD").select(
        "k",
        R.or_unknown("OFD.Name").alias("ofd_name"),
        R.or_unknown("OFD.Site").alias("ofd_site"),
    )


def numeric_typing(spark, sf_dir):
    fields = [REGISTRATION_NUMBER, "ReceiptNumber", "Items", "TotalSum", "VatSum", FISCAL_SIGN]
    typed = parsed_pages(spark, sf_dir, *fields)[0].select(
        "k",
        R.whole(REGISTRATION_NUMBER).alias("registration_number"),
        F.col("ReceiptNumber").alias("receipt_number"),
        R.money("TotalSum").alias("total_sum"),
        R.money("VatSum").alias("vat_sum"),
        R.whole(FISCAL_SIGN).alias("fiscal_sign"),
        F.col("Items").alias("items"),
    )
    return O.explode_items(typed).select(
        "*",
        R.money("item.UnitPrice").alias("unit_price"),
        F.col("item.Quantity").cast("bigint").alias("quantity"),
        R.money("item.Total").alias("total_amount_by_position"),
    ).drop("item")


def line_totals(spark, sf_dir):
    lines = O.line_totals(parsed_pages(spark, sf_dir, "Items")[0])
    lines = lines.select("k", F.explode(F.arrays_zip("Items", "lines")).alias("l"))
    return lines.select(
        "k",
        F.col("l.Items.Name").alias("name"),
        F.col("l.Items.Quantity").alias("quantity"),
        F.col("l.lines.line_total").alias("line_total"),
        F.col("l.lines.line_diff").alias("line_diff"),
    )


def receipt_totals(spark, sf_dir):
    pages, paged = parsed_pages(spark, sf_dir, "Items", "TotalSum")
    rows = O.receipt_totals(pages).withColumn("stated", R.money("TotalSum"))
    total = R.money(total_of_pages(F.col("receipt_total"), "receipt_total"))
    totals = per_receipt(rows, paged, ["stated"], receipt_total=total)
    diff = R.money(F.try_subtract("stated", "receipt_total"))
    return totals.select("k", "receipt_total", diff.alias("receipt_diff"))


def vat_sum(spark, sf_dir):
    df = O.vat_totals(parsed(spark, sf_dir, "TotalSum", "VatRate", "VatSum"))
    return df.select("k", "vat_due", "vat_diff")


def ofd_site(spark, sf_dir):
    return O.ofd_sites(parsed(spark, sf_dir, "OFD")).select("k", "ofd_site", "ofd_site_ok")


def receipt_reconcile(spark, sf_dir):
    """All differences; that of the lines as their sum."""
    pages, paged = parsed_pages(spark, sf_dir, "Items", "TotalSum", "VatRate", "VatSum", "OFD")
    off = F.aggregate(
        F.transform("lines", lambda line: line["line_diff"]),
        F.lit(0).cast("decimal(38,2)"),
        lambda total, diff: F.try_add(total, diff).cast("decimal(38,2)"),
        R.money,
    )
    rows = O.receipt_reconcile(pages).withColumns(
        {
            "stated": R.money("TotalSum"),
            "line_count": F.coalesce(F.array_size("lines"), F.lit(0)).cast("bigint"),
            "line_diff": off,
        }
    )
    done = per_receipt(
        rows,
        paged,
        ["stated", "vat_due", "vat_diff", "ofd_site", "ofd_site_ok"],
        line_count=F.sum("line_count"),
        line_diff=R.money(total_of_pages(F.col("line_diff"), "line_diff")),
        receipt_total=R.money(total_of_pages(F.col("receipt_total"), "receipt_total")),
    )
    diff = R.money(F.try_subtract("stated", "receipt_total"))
    return done.withColumn("receipt_diff", diff).drop("stated")


# Streams: the staged documents are replayed to the end, the sinks' output is read back.

NOW = {"availableNow": True}
# Bounds a batch, and with it what the sinks have to keep while they share it: 4 GB of text,
# of which a quarter is left when it is compressed.
BYTES_PER_TRIGGER = 1 << 30


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """Columns k, page, json of all staged pages; the topic's key stands in front of each line."""
    lines = decode_value(read_lines(spark, path, bytes_per_trigger=BYTES_PER_TRIGGER))
    parts = F.split("json", "\t", 3)
    return lines.select(
        parts[0].cast("bigint").alias("k"),
        parts[1].cast("int").alias("page"),
        parts[2].alias("json"),
    )


def _finish(spark: SparkSession, query, base: str, path: str) -> None:
    query.awaitTermination()
    discard(spark, f"{base}/checkpoint")
    discard(spark, path)


def _paged(rows: DataFrame) -> bool:
    """Landed pages have to be put together only if there is a second one."""
    return not rows.filter("page > 0").isEmpty()


def raw_landing_stream(spark, sf_dir):
    base, path = scratch_dir(spark), staged_documents(spark, sf_dir)
    docs = _stream(spark, path)
    query = S.run_raw_landing(
        docs, f"{base}/raw", f"{base}/checkpoint", keep_source=True, gather=True, trigger=NOW
    )
    _finish(spark, query, base, path)
    schema = S.raw_table(docs, keep_source=True).schema
    landed = read_back(spark, f"{base}/raw", schema).withColumns(
        {"event_time": ntz("DateTime_ts"), "stamped": F.col("ingest_time").isNotNull()}
    )
    return whole_receipts(landed, _paged(landed), "event_time", "year_month", "stamped")


def clean_items_stream(spark, sf_dir):
    base, path = scratch_dir(spark), staged_documents(spark, sf_dir)
    sink = S.path_sink(f"{base}/clean", "items", S.write_clean_layout)
    docs = _stream(spark, path).drop("page")
    _finish(spark, S.run_clean_items(docs, sink, f"{base}/checkpoint", trigger=NOW), base, path)
    landed = read_back(spark, f"{base}/clean", O.clean_items(docs).schema)
    return _without_clock(landed.drop("stream_id", "batch_id", "month"))


def errors_stream(spark, sf_dir):
    base, path = scratch_dir(spark), staged_documents(spark, sf_dir)
    sink = S.path_sink(f"{base}/errors", "errors")
    docs = _stream(spark, path)
    _finish(spark, S.run_error_feed(docs, sink, f"{base}/checkpoint", trigger=NOW), base, path)
    landed = read_back(spark, f"{base}/errors", O.error_feed(docs).schema)
    return payloads(landed, _paged(landed), "reason")


def _destinations(clean: DataFrame, errors: DataFrame) -> DataFrame:
    """Clean items and rejected receipts, with the amount and number of lines of each."""
    errors = payloads(errors, _paged(errors), "reason")
    columns = ["k", "destination", "reason", "product_name", "amount", "lines"]
    clean = clean.withColumns(
        {
            "destination": F.lit("clean"),
            "reason": F.lit(""),
            "amount": F.col("total_amount_by_position"),
            "lines": F.lit(1).cast("bigint"),
        }
    )
    errors = errors.withColumns(
        {
            "destination": F.lit("error"),
            "product_name": F.lit(None).cast("string"),
            "amount": F.col("item_sum"),
            "lines": F.col("item_count"),
        }
    )
    return clean.select(columns).unionAll(errors.select(columns))


def clean_and_errors_stream(spark, sf_dir):
    base, path = scratch_dir(spark), staged_documents(spark, sf_dir)
    docs = _stream(spark, path)
    query = S.run_clean_and_errors(
        docs,
        S.path_sink(f"{base}/clean", "receipts"),
        S.path_sink(f"{base}/errors", "receipts"),
        f"{base}/checkpoint",
        trigger=NOW,
    )
    _finish(spark, query, base, path)
    clean = read_back(spark, f"{base}/clean", O.clean_items(docs).schema)
    errors = read_back(spark, f"{base}/errors", O.error_feed(docs).schema)
    return _destinations(clean, errors)


CARRIED = "k bigint, page int"


def _published(base: str) -> tuple[S.PublishedTable, S.PublishedTable]:
    return S.clean_table(f"{base}/clean", CARRIED), S.error_table(f"{base}/errors", CARRIED)


def _publish(spark: SparkSession, path: str, base: str, **options) -> None:
    """Both tables, published batch by batch."""
    clean, errors = _published(base)
    query = S.run_clean_and_errors(
        _stream(spark, path),
        clean.sink("receipts"),
        errors.sink("receipts"),
        f"{base}/checkpoint",
        trigger=NOW,
        **options,
    )
    query.awaitTermination()


def _lose_commit(spark: SparkSession, base: str) -> None:
    """As after a crash between the last batch and its commit: it will run again."""
    commits = f"{base}/checkpoint/commits"
    last = max(files.names(spark, commits), key=int)
    discard(spark, f"{commits}/{last}")


def published_stream(spark, sf_dir):
    """Published batches, the last of which has run twice."""
    base, path = scratch_dir(spark), staged_documents(spark, sf_dir)
    _publish(spark, path, base)
    _lose_commit(spark, base)
    _publish(spark, path, base)
    discard(spark, f"{base}/checkpoint")
    discard(spark, path)
    clean, errors = _published(base)
    return _destinations(clean.read(spark), errors.read(spark))


def merged_layout(spark, sf_dir):
    """Batches merged into months, one of them run again and merged again."""
    base, path = scratch_dir(spark), staged_documents(spark, sf_dir)
    clean = _published(base)[0]
    for _ in range(2):
        _publish(spark, path, base)
        clean.merge(spark)
        _lose_commit(spark, base)
    clean.discard(spark)
    discard(spark, f"{base}/checkpoint")
    discard(spark, path)
    discard(spark, f"{base}/errors")
    rows = clean.read(spark).drop("stream_id", "batch_id", "page")
    return _without_clock(rows)


def batch_clocks(spark, sf_dir):
    """Per receipt in a table: whether all rows of its batch have one time, those of the
    other table included, and whether it has the time it had before the batch ran again."""
    base, path = scratch_dir(spark), staged_documents(spark, sf_dir)

    def times() -> DataFrame:
        clean, errors = (t.read(spark) for t in _published(base))
        clean = clean.select("k", "page", "batch_id", F.lit("clean").alias("destination"), F.col("upload_time").alias("at"))
        errors = errors.select("k", "page", "batch_id", F.lit("error").alias("destination"), F.col("ts").alias("at"))
        rows = clean.unionAll(errors)
        span = rows.groupBy("batch_id").agg((F.min("at") == F.max("at")).alias("one_time"))
        rows = rows.groupBy("k", "destination", "batch_id").agg(F.max("at").alias("at"))
        return rows.join(span, "batch_id").drop("batch_id")

    _publish(spark, path, base)
    first = written(times().select("k", "destination", F.col("at").alias("first_at")), "times")
    _lose_commit(spark, base)
    _publish(spark, path, base)
    discard(spark, f"{base}/checkpoint")
    discard(spark, path)
    kept = (F.col("at") == F.col("first_at")).alias("kept_time")
    return times().join(first, ["k", "destination"]).select("k", "destination", "one_time", kept)


def routing_metrics(spark, sf_dir):
    """Receipts on each route, as observed while the batches ran, one of them twice."""
    base, path = scratch_dir(spark), staged_documents(spark, sf_dir)
    log = S.RoutingLog(spark, f"{base}/routes")
    spark.streams.addListener(log)
    try:
        for again in (False, True):
            if again:
                _lose_commit(spark, base)
            clean, errors = _published(base)
            query = S.run_clean_and_errors(
                _stream(spark, path),
                clean.sink("receipts"),
                errors.sink("receipts"),
                f"{base}/checkpoint",
                count=F.col("page") == 0,
                trigger=NOW,
                name="receipts",
            )
            query.awaitTermination()
            log.wait(query)
    finally:
        spark.streams.removeListener(log)
    discard(spark, path)
    counts = S.routing_counts(spark, f"{base}/routes")
    sums = counts.agg(*[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in ("clean", "error", "neither")])
    return sums.unpivot([], ["clean", "error", "neither"], "route", "receipts")


def supervised_stream(spark, sf_dir):
    """Two queries, one of whose sinks fails once, after it has written its rows."""
    base, path = scratch_dir(spark), staged_documents(spark, sf_dir)
    clean, errors = _published(base)
    to_clean, calls = clean.sink("receipts"), []

    def fails_once(batch: DataFrame, batch_id: int) -> None:
        to_clean(batch, batch_id)
        calls.append(batch_id)
        if len(calls) == 1:
            raise OSError("the connection was lost")

    jobs = [
        (
            "clean",
            lambda: S.run_clean_items(_stream(spark, path), fails_once, f"{base}/checkpoint", trigger=NOW),
        ),
        (
            "errors",
            lambda: S.run_error_feed(_stream(spark, path), errors.sink("receipts"), f"{base}/checkpoint-errors", trigger=NOW),
        ),
    ]
    failures = S.Supervisor(spark, jobs, pause=0.1).run()
    if len(failures["clean"]) != 1:
        raise AssertionError(f"one failure was expected: {failures}")
    discard(spark, f"{base}/checkpoint")
    discard(spark, path)
    discard(spark, f"{base}/checkpoint-errors")
    return _destinations(clean.read(spark), errors.read(spark))


def clean_layout(spark, sf_dir):
    path = f"{scratch_dir(spark)}/clean"
    rows = clean_items(spark, sf_dir)
    S.write_clean_layout(rows, path)
    return read_back(spark, path, T.StructType([*rows.schema.fields, T.StructField("month", T.StringType())]))


def kafka_value(spark, sf_dir):
    """Encode parsed receipts for a topic, and read them back from the bytes."""
    docs = fixture.documents(spark, sf_dir)
    records = S.to_kafka_value(parse_receipts(docs.rows, keep_source=True).drop("json"))
    key = T.StructField("k", T.LongType()), T.StructField("page", T.IntegerType())
    shape = T.StructType([*key, *RECEIPT.fields])
    back = F.from_json(F.col("value").cast("string"), shape)
    return whole_receipts(records.select(F.inline(F.array(back))), docs.paged)


def _item_vat_receipts(spark, sf_dir, *fields: str) -> DataFrame:
    docs = fixture.documents(spark, sf_dir, item_vat=True).rows.filter("page = 0")
    return parse_receipts(docs, True, fields, RECEIPT_WITH_ITEM_VAT)


def item_vat(spark, sf_dir):
    df = _item_vat_receipts(spark, sf_dir, "Items")
    return df.select("k", R.item_vat("Items").alias("item_vat"))


def py_clean_flag(spark, sf_dir):
    fields = ["TaxPayerIIN", "DateTime", "Items", "TotalSum", "Address"]
    df = _item_vat_receipts(spark, sf_dir, *fields)
    return O.with_item_vat_checks(df).select("k", "is_clean")


def queries() -> dict[str, Query]:
    return {
        "decode_receipts": decode_receipts,
        "sse_decode": sse_decode,
        "sse_frames": sse_frames,
        "parse_types": parse_types,
        "sql_clean_items": sql_clean_items,
        "sql_errors": sql_errors,
        "sql_checks": sql_checks,
        "catalogue_flatten": catalogue_flatten,
        "event_time": event_time,
        "year_month": year_month,
        "clock_columns": clock_columns,
        "iin_check": field_query("TaxPayerIIN", "iin_valid", R.iin_valid),
        "address_check": field_query("Address", "address_correct", R.address_correct),
        "city": field_query("Address", "city", R.city),
        "main_vat_rate": main_vat_rate,
        "vat_normalize": vat_normalize,
        "qr_check": field_query("QRCode", "qr_code_valid", R.qr_code_valid),
        "clean_flag": clean_flag,
        "clean_receipts": clean_receipts,
        "clean_items": clean_items,
        "error_reasons": error_reasons,
        "error_reasons_complete": error_reasons_complete,
        "error_payload": error_payload,
        "strip_marks": strip_marks,
        "ofd_defaults": ofd_defaults,
        "numeric_typing": numeric_typing,
        "line_totals": line_totals,
        "receipt_totals": receipt_totals,
        "vat_sum": vat_sum,
        "ofd_site": ofd_site,
        "receipt_reconcile": receipt_reconcile,
        "raw_landing_stream": raw_landing_stream,
        "clean_items_stream": clean_items_stream,
        "errors_stream": errors_stream,
        "clean_and_errors_stream": clean_and_errors_stream,
        "published_stream": published_stream,
        "merged_layout": merged_layout,
        "batch_clocks": batch_clocks,
        "routing_metrics": routing_metrics,
        "supervised_stream": supervised_stream,
        "clean_layout": clean_layout,
        "kafka_value": kafka_value,
        "py_event_time": field_query(
            "DateTime", "event_time", lambda c: ntz(R.py_event_time(c))
        ),
        "py_iin": field_query("TaxPayerIIN", "iin_valid", R.py_iin_valid),
        "py_city": field_query("Address", "city", R.py_city),
        "py_address": field_query("Address", "address", R.py_address),
        "py_vat": field_query("VatRate", "vat", R.py_vat),
        "item_vat": item_vat,
        "py_clean_flag": py_clean_flag,
    }
