import json
import os
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

import job
from helpers import documents, multiset, receipt
from receiptlake import operators as O
from receiptlake import streaming as S
from receiptlake.operators.clean import clean_items_of
from receiptlake.plans.staging import scratch_dir
from receiptlake.schema import CLEAN, RECEIPT
from receiptlake.sources import decode_value, read_lines
from receiptlake.streaming import sinks, tables

NOW = {"availableNow": True}


@pytest.fixture
def lines(spark, tmp_path):
    """A directory of JSON lines, and a way to add files to it."""
    path = str(tmp_path / "lines")

    def add(*texts):
        documents(spark, *texts).coalesce(1).write.mode("append").text(path)
        return path

    return add


def stream(spark, path, **options):
    return decode_value(read_lines(spark, path, **options))


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_raw_landing_and_restart(spark, lines, tmp_path):
    raw, checkpoint = str(tmp_path / "raw"), str(tmp_path / "ckpt")

    def land(path):
        run(S.run_raw_landing(stream(spark, path), raw, checkpoint, keep_source=True, trigger=NOW))
        return spark.read.parquet(raw)

    path = lines(receipt(), receipt(DateTime="02.03.25 10:00"), "{bad")
    df = land(path)
    assert df.count() == 3
    assert land(path).count() == 3
    lines(receipt(ReceiptNumber=8))
    df = land(path)
    assert df.count() == 4
    months = counts(df.select(F.col("year_month").cast("string")))
    assert months == {"2025-01": 2, "2025-03": 1, None: 1}
    assert "year_month=__HIVE_DEFAULT_PARTITION__" in os.listdir(raw)
    assert df.filter("year_month IS NULL").first().json == "{bad"
    assert df.filter("ingest_time IS NULL").count() == 0


def counts(df):
    out = {}
    for (value,) in df.collect():
        out[value] = out.get(value, 0) + 1
    return out


def test_raw_table_is_pruned_and_can_be_processed_again(spark, lines, tmp_path):
    path = lines(receipt(), receipt(DateTime="02.03.25 10:00"), receipt(Address=""))
    raw = str(tmp_path / "raw")
    run(S.run_raw_landing(stream(spark, path), raw, str(tmp_path / "c"), trigger=NOW))
    month = spark.read.parquet(raw).filter("year_month = '2025-01'")
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan
    again = clean_items_of(O.with_checks(spark.read.parquet(raw)))
    docs = spark.read.text(path).select(F.col("value").alias("json"))
    first = O.clean_items(docs)
    assert multiset(again.drop("upload_time")) == multiset(first.drop("upload_time"))


def test_gather_moves_documents_before_their_parse(spark, lines, tmp_path):
    docs = stream(spark, lines(receipt(), receipt(DateTime="02.03.25 10:00")))
    query = S.run_raw_landing(docs, str(tmp_path / "raw"), str(tmp_path / "c"), True, gather=True, trigger=NOW)
    query.awaitTermination()
    plan = query._jsq.explainInternal(False).split("Initial Plan")[0].splitlines()
    moved = [i for i, line in enumerate(plan) if "Exchange" in line]
    parsed = [i for i, line in enumerate(plan) if "CompanyName" in line and "Generate" in line]
    assert len(moved) == 1 and parsed and max(parsed) < moved[0]  # the plan's source comes last


def test_gather_merges_small_months_and_splits_large_ones(spark, lines, tmp_path):
    dates = [f"2025-{1 + n % 12:02}-01, 03:04:05" for n in range(240)]
    path = lines(*[receipt(DateTime=d) for d in dates])
    for _ in range(3):
        lines(*[receipt(ReceiptNumber=n) for n in range(300)])
    docs = stream(spark, path)

    def land(name, **options):
        raw = str(tmp_path / name)
        run(S.run_raw_landing(docs, raw, f"{raw}-c", trigger=NOW, **options))
        assert spark.read.parquet(raw).count() == 1140
        return [f for _, _, names in os.walk(raw) for f in names if f.endswith(".parquet")]

    assert len(land("gathered", gather=True)) == 12
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(conf, "5k")
    try:
        land("split", gather=True)
    finally:
        spark.conf.unset(conf)
    january = os.listdir(f"{tmp_path}/split/year_month=2025-01")
    assert len([f for f in january if f.endswith(".parquet")]) > 1


def lose_last_commit(checkpoint):
    commits = f"{checkpoint}/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.unlink(f"{commits}/{name}")


def test_path_sink_survives_replay(spark, lines, tmp_path):
    path = lines(receipt(), receipt(Address=""))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ckpt")
    sink = S.path_sink(out, "a")
    for _ in range(2):
        run(S.run_error_feed(stream(spark, path), sink, checkpoint, trigger=NOW))
        assert spark.read.parquet(out).count() == 1
        lose_last_commit(checkpoint)
    run(S.run_error_feed(stream(spark, path), S.path_sink(out, "b"), str(tmp_path / "c2"), trigger=NOW))
    assert counts(spark.read.parquet(out).select("stream_id")) == {"a": 1, "b": 1}


class Table:
    """Stands in for a database table: keeps what the JDBC sink would have written."""

    def __init__(self):
        self.rows, self.deleted = [], []

    def insert(self, df, options):
        self.columns = df.columns
        self.rows += [r.asDict() for r in df.collect()]

    def delete(self, spark, options, stream_id, batch_id):
        self.deleted.append((options["dbtable"], stream_id, batch_id))
        self.rows = [
            r for r in self.rows if (r["stream_id"], r["batch_id"]) != (stream_id, batch_id)
        ]


def test_jdbc_sink(spark, lines, tmp_path):
    path = lines(receipt())
    options = {"dbtable": "t"}
    for stream_id, after_replay in ((None, 4), ("a", 2)):
        table, checkpoint = Table(), str(tmp_path / f"ckpt-{stream_id}")
        sink = S.jdbc_sink(options, stream_id, table.delete, table.insert)
        run(S.run_clean_items(stream(spark, path), sink, checkpoint, trigger=NOW))
        assert len(table.rows) == 2
        lose_last_commit(checkpoint)
        run(S.run_clean_items(stream(spark, path), sink, checkpoint, trigger=NOW))
        assert len(table.rows) == after_replay
    assert table.deleted == [("t", "a", 0), ("t", "a", 0)]
    assert table.columns[-2:] == ["stream_id", "batch_id"]


def test_jdbc_sink_deletes_once_per_start(spark, lines, tmp_path):
    path = None
    for n in range(3):
        path = lines(receipt(ReceiptNumber=n))
    table, checkpoint = Table(), str(tmp_path / "ckpt")

    def start():
        sink = S.jdbc_sink({"dbtable": "t"}, "a", table.delete, table.insert)
        docs = stream(spark, path, files_per_trigger=1)
        run(S.run_clean_items(docs, sink, checkpoint, trigger=NOW))
        return len(table.rows)

    assert start() == 6 and table.deleted == [("t", "a", 0)]
    lose_last_commit(checkpoint)
    assert start() == 6 and table.deleted == [("t", "a", 0), ("t", "a", 2)]


def test_jdbc_sink_deletes_after_a_failed_insert(spark):
    table, batch = Table(), spark.createDataFrame([(1,), (2,)], "x int")

    def half(df, options):
        table.insert(df.limit(1), options)
        raise RuntimeError("lost")

    calls = iter([table.insert, half, table.insert, table.insert])
    sink = S.jdbc_sink({"dbtable": "t"}, "a", table.delete, lambda df, o: next(calls)(df, o))
    sink(batch, 0)
    with pytest.raises(RuntimeError):
        sink(batch, 1)
    sink(batch, 1)
    sink(batch, 2)
    assert len(table.rows) == 6 and table.deleted == [("t", "a", 0), ("t", "a", 1)]


def test_tables_hold_what_the_sinks_write():
    statement = tables.clean_table("analytics.items")
    for column in CLEAN.names + ["stream_id", "batch_id"]:
        assert f" {column} " in statement
    assert "kkt_registration_number UInt64" in statement and "unit_price Decimal64(2)" in statement
    create, index = tables.error_table("errors")
    assert "payload JSONB NOT NULL" in create and "batch_id BIGINT" in create
    assert index == "CREATE INDEX IF NOT EXISTS errors_by_batch ON errors (stream_id, batch_id)"


def test_jdbc_options():
    clean = sinks.clickhouse_options("jdbc:clickhouse://h:8123/db", "items", user="u")
    assert clean["user"] == "u" and "toYYYYMM(date_time)" in clean["createTableOptions"]
    errors = sinks.postgres_options("jdbc:postgresql://h/db", "errors")
    assert errors["url"].startswith("jdbc:postgresql://h/db?stringtype=unspecified")
    errors = sinks.postgres_options("jdbc:postgresql://h/db?ssl=true", "errors")
    assert "?ssl=true&stringtype=unspecified" in errors["url"]
    assert sinks.delete_batch_sql("t") == "DELETE FROM t WHERE stream_id = ? AND batch_id = ?"


def test_delete_batch_runs_one_statement_and_closes():
    session = MagicMock()
    driver = session._jvm.java.lang.Class.forName.return_value.newInstance.return_value
    connection = driver.connect.return_value
    statement = connection.prepareStatement.return_value
    options = {"driver": "d", "url": "u", "dbtable": "t", "user": "me", "password": "pw"}
    sinks.delete_batch(session, options, "a", 7)
    connection.prepareStatement.assert_called_once_with(sinks.delete_batch_sql("t"))
    statement.setString.assert_called_once_with(1, "a")
    statement.setLong.assert_called_once_with(2, 7)
    statement.executeUpdate.assert_called_once_with()
    statement.executeUpdate.side_effect = RuntimeError("gone")
    with pytest.raises(RuntimeError):
        sinks.delete_batch(session, options, "a", 8)
    assert connection.close.call_count == 2


def test_shared_scan_equals_separate_jobs(spark, lines, tmp_path):
    path = lines(receipt(), receipt(Address=""), receipt(TaxPayerIIN=None), "x")
    out = str(tmp_path / "out")
    clean, errors = S.path_sink(f"{out}/clean", "s"), S.path_sink(f"{out}/errors", "s")
    run(
        S.run_clean_and_errors(
            stream(spark, path), clean, errors, f"{out}/c", mode="complete", on_null="error",
            keep_source=True, trigger=NOW,
        )
    )
    docs = spark.read.text(path).select(F.col("value").alias("json"))
    got = spark.read.parquet(f"{out}/clean").drop("upload_time", "stream_id", "batch_id")
    assert multiset(got) == multiset(O.clean_items(docs).drop("upload_time"))
    got = spark.read.parquet(f"{out}/errors").drop("ts", "stream_id", "batch_id")
    feed = O.error_feed(docs, mode="complete", on_null="error", keep_source=True)
    assert multiset(got) == multiset(feed.drop("ts"))
    assert got.count() == 3


def test_shared_scan_releases_a_failed_batch(spark, lines, tmp_path):
    def broken(batch, batch_id):
        raise RuntimeError("table is gone")

    path = lines(receipt())
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    query = S.run_clean_and_errors(
        stream(spark, path), broken, broken, str(tmp_path / "c"), trigger=NOW
    )
    with pytest.raises(Exception, match="table is gone"):
        query.awaitTermination()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_batch_ids_bound_a_batch(spark, lines, tmp_path):
    path = None
    for n in range(3):
        path = lines(receipt(ReceiptNumber=n))
    out = str(tmp_path / "out")
    docs = stream(spark, path, files_per_trigger=1)
    run(S.run_clean_items(docs, S.path_sink(out, "s"), str(tmp_path / "c"), trigger=NOW))
    assert counts(spark.read.parquet(out).select("batch_id")) == {0: 2, 1: 2, 2: 2}


def test_await_any(spark, lines, tmp_path):
    path = lines(receipt())
    spark.streams.resetTerminated()
    S.run_clean_items(stream(spark, path), S.path_sink(str(tmp_path / "o"), "s"),
                      str(tmp_path / "c"), trigger=NOW)
    assert S.await_any(spark, 60) is True


def test_clean_layout_is_sorted_and_splits_a_hot_month(spark, tmp_path):
    docs = documents(
        spark,
        *[receipt(ReceiptNumber=n, DateTime=f"2025-0{1 + n % 2}-{10 + n * 7 % 18}, 03:04:05") for n in range(300)],
    )
    path = str(tmp_path / "layout")
    S.write_clean_layout(O.clean_items(docs), path)
    months = spark.read.parquet(path)
    assert counts(months.select("month")) == {"2025-01": 300, "2025-02": 300}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                rows = spark.read.parquet(f"{folder}/{name}").select("date_time", "tax_payer_iin")
                keys = [tuple(r) for r in rows.collect()]
                assert keys == sorted(keys)

    # A month far beyond the advisory size is written by several tasks.
    conf = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(conf, "20k")
    try:
        many = spark.range(0, 20000, 1, 8).selectExpr(
            "timestamp'2025-05-05 00:00:00' + make_dt_interval(0, 0, 0, id % 1000) AS date_time",
            "string(id) AS tax_payer_iin",
            "timestamp'2025-06-01 00:00:00' AS upload_time",
        )
        S.write_clean_layout(many, path)
    finally:
        spark.conf.unset(conf)
    files = [f for f in os.listdir(f"{path}/month=2025-05") if f.endswith(".parquet")]
    assert len(files) > 1
    assert spark.read.parquet(path).count() == 20000


def test_kafka_value(spark):
    df = spark.createDataFrame([(1, "ЗНМ", None)], "a int, `b (c)` string, d string")
    [row] = S.to_kafka_value(df).collect()
    assert json.loads(bytes(row.value).decode()) == {"a": 1, "b (c)": "ЗНМ"}
    assert sinks.topic_sink_options("h:9092", "t") == {
        "kafka.bootstrap.servers": "h:9092",
        "topic": "t",
        "kafka.acks": "all",
        "kafka.retries": "5",
        "kafka.linger.ms": "50",
    }


def test_s3a_options():
    options = S.s3a_options("http://store:9000")
    assert options["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000"
    assert not any("key" in k for k in options)


def test_scratch_is_below_the_shared_folder(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_dir(spark).startswith(shared)
    assert scratch_dir(spark) != scratch_dir(spark)


def test_job(spark, lines, tmp_path):
    path, out = lines(receipt(), receipt(Address=""), "x"), str(tmp_path / "out")
    base = ["--lines", path, "--once", "--stream-id", "s", "--keep-source"]

    def finish(name, *more):
        args = job.arguments([*base, "--checkpoints", f"{out}/c-{name}", *more])
        for query in job.start(spark, args):
            run(query)

    finish("all", "--raw-path", f"{out}/raw", "--clean-path", f"{out}/clean",
           "--errors-path", f"{out}/errors")
    assert spark.read.parquet(f"{out}/raw").count() == 3
    clean = spark.read.parquet(f"{out}/clean")
    assert clean.columns[:21] == CLEAN.names and clean.count() == 2
    errors = spark.read.parquet(f"{out}/errors")
    assert errors.columns[:4] == ["json", "ts", "reason", "payload"] and errors.count() == 2
    finish("clean", "--clean-path", f"{out}/clean2")
    assert spark.read.parquet(f"{out}/clean2").count() == 2
    sse = str(tmp_path / "sse")
    documents(spark, f"data: {receipt()}", ": ping", "", receipt()).write.text(sse)
    args = job.arguments(["--sse-lines", sse, *base[2:], "--checkpoints", f"{out}/c-sse",
                          "--raw-path", f"{out}/raw3"])
    for query in job.start(spark, args):
        run(query)
    assert spark.read.parquet(f"{out}/raw3").filter("CompanyName IS NOT NULL").count() == 2
    args = job.arguments([*base, "--checkpoints", "c", "--publish", "t"])
    assert job.published(spark, args).columns[-15:] == RECEIPT.names
    finish("errors", "--errors-path", f"{out}/errors2", "--reasons", "complete")
    assert spark.read.parquet(f"{out}/errors2").count() == 2
    with pytest.raises(SystemExit):
        job.arguments(["--checkpoints", "c"])
    with pytest.raises(SystemExit):
        job.arguments([*base[:3], "--checkpoints", "c", "--clean-path", "x"])
