"""Published batches: what readers see, and the upkeep of the months."""

import os

import pytest
from pyspark.sql import functions as F

from helpers import documents, multiset, receipt
from receiptlake import streaming as S
from receiptlake.operators import clean_items
from receiptlake.streaming import files
from receiptlake.streaming.published import Batch, Merged

ROW = "company_name"


def rows(spark, *names, date="2025-01-02, 03:04:05"):
    """Clean line items, two of each receipt, known by the company's name."""
    return clean_items(documents(spark, *[receipt(CompanyName=n, DateTime=date) for n in names]))


@pytest.fixture
def table(tmp_path):
    return S.clean_table(str(tmp_path / "clean"))


def names_of(df):
    return sorted(r[0] for r in df.select(ROW).distinct().collect())


def months_of(table):
    """(version folder, month) of every folder that holds rows."""
    found = set()
    for path, _, inside in os.walk(f"{table.path}/months"):
        if any(n.endswith(".parquet") for n in inside):
            found.add(tuple(path.split("/")[-2:]))
    return found


def read_folders(df):
    return {os.path.dirname(f) for f in df.inputFiles()}


def test_a_reader_sees_the_old_batch_whole_or_the_new_one(spark, table):
    seen = []

    def looking(batch, path):
        seen.append(names_of(table.read(spark)))  # before the rows are written
        batch.write.parquet(path)
        seen.append(names_of(table.read(spark)))  # written, and not published
        assert table.read(spark).count() in (0, 2, 4)

    sink = table.sink("s", looking)
    sink(rows(spark, "a"), 0)
    sink(rows(spark, "b", "c"), 0)
    assert seen == [[], [], ["a"], ["a"]]
    assert names_of(table.read(spark)) == ["b", "c"] and table.read(spark).count() == 4
    assert table.read(spark).columns == [*rows(spark, "a").columns, "stream_id", "batch_id", "month"]


def test_a_run_that_fails_is_seen_by_nobody(spark, table):
    def fails(batch, path):
        batch.write.parquet(path)
        raise OSError("lost")

    table.sink("s")(rows(spark, "a"), 0)
    for _ in range(2):
        with pytest.raises(OSError):
            table.sink("s", fails)(rows(spark, "x"), 0)
        with pytest.raises(OSError):
            table.sink("s", fails)(rows(spark, "x"), 1)
    assert names_of(table.read(spark)) == ["a"]
    table.merge(spark)
    assert names_of(table.read(spark)) == ["a"]


def test_streams_with_odd_names_and_empty_batches(spark, table):
    odd = "a/b=c %é"
    table.sink(odd)(rows(spark, "a"), 0)
    table.sink("s")(rows(spark, "b"), 0)
    table.sink("s")(rows(spark, "b").filter("false"), 1)
    table.sink("s")(rows(spark, "c"), 7)
    df = table.read(spark)
    want = {(odd, 0): 2, ("s", 0): 2, ("s", 7): 2}
    assert {(r.stream_id, r.batch_id): r["count"] for r in df.groupBy("stream_id", "batch_id").count().collect()} == want
    before = multiset(df)
    assert table.merge(spark) == 1 and multiset(table.read(spark)) == before
    assert table.merge(spark) is None and table.batches(spark) == []


def test_merging_writes_only_months_that_get_rows(spark, table):
    sink = table.sink("s")
    assert table.merge(spark) is None
    sink(rows(spark, "a"), 0)
    sink(rows(spark, "b", date="02.02.25 10:00"), 1)
    before = multiset(table.read(spark))
    assert table.merge(spark) == 1
    assert multiset(table.read(spark)) == before
    first = dict(table.merged(spark).months)
    sink(rows(spark, "c", date="03.02.25 10:00"), 2)
    sink(rows(spark, "d", date="03.03.25 10:00"), 3)
    before = multiset(table.read(spark))
    assert table.merge(spark) == 2
    assert multiset(table.read(spark)) == before
    second = table.merged(spark).months
    assert second["month=2025-01"] == first["month=2025-01"]
    assert second["month=2025-02"] == second["month=2025-03"] != first["month=2025-02"]
    assert names_of(table.read(spark).filter("month = '2025-02'")) == ["b", "c"]


def test_a_month_is_read_from_one_folder(spark, table):
    for n in range(6):
        table.sink("s")(rows(spark, f"n{n}", date=f"02.0{1 + n % 3}.25 10:00"), n)
    table.merge(spark)
    one = table.read(spark, months=["2025-02"])
    assert names_of(one) == ["n1", "n4"] and len(read_folders(one)) == 1
    filtered = table.read(spark).filter("month = '2025-02'")
    assert names_of(filtered) == ["n1", "n4"]
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    # A batch to come is read beside it, narrowed to the month.
    table.sink("s")(rows(spark, "x", "y"), 6)
    table.sink("s")(rows(spark, "z", date="02.02.25 10:00"), 7)
    assert names_of(table.read(spark, months=["2025-02"])) == ["n1", "n4", "z"]
    assert names_of(table.read(spark, months=["2030-01"])) == []


def test_a_hot_month_is_split_by_range_and_small_ones_share_a_task(spark, table):
    hot = [receipt(ReceiptNumber=n, DateTime=f"2025-01-{1 + n % 28:02}, 03:{n % 60:02}:05") for n in range(600)]
    cold = [receipt(ReceiptNumber=n, DateTime=f"05.{2 + n % 6:02}.25 10:00") for n in range(12)]
    table.sink("s")(clean_items(documents(spark, *hot, *cold)), 0)
    size = files.size(spark, f"{table.path}/batches")
    table.merge(spark, file_bytes=size // 6)
    version = table.merged(spark).months["month=2025-01"]
    inside = f"{table.path}/months/{version}"
    parts = [f"{inside}/month=2025-01/{n}" for n in os.listdir(f"{inside}/month=2025-01") if n.endswith(".parquet")]
    assert len(parts) >= 4
    spans = []
    for part in parts:
        times = [r.date_time for r in spark.read.parquet(part).select("date_time").collect()]
        assert times == sorted(times)
        spans.append((times[0], times[-1]))
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # ranges, not shares
    tasks = {n.split("-")[1] for m in os.listdir(inside) if m > "month=2025-01" for n in os.listdir(f"{inside}/{m}") if n.endswith(".parquet")}
    assert len(tasks) <= 2


def test_rows_that_shrink_to_nothing_are_split_by_their_number(spark, table):
    alike = [receipt(ReceiptNumber=n, DateTime=f"2025-01-{1 + n % 28:02}, 03:{n % 60:02}:05") for n in range(600)]
    table.sink("s")(clean_items(documents(spark, *alike)), 0)
    before = multiset(table.read(spark))
    table.merge(spark, file_rows=200)
    inside = f"{table.path}/months/{table.merged(spark).months['month=2025-01']}/month=2025-01"
    parts = [n for n in os.listdir(inside) if n.endswith(".parquet")]
    assert len(parts) >= 5 and multiset(table.read(spark)) == before
    assert max(spark.read.parquet(f"{inside}/{n}").count() for n in parts) < 400


def test_a_batch_that_runs_again_after_a_merge(spark, table):
    sink = table.sink("s")
    sink(rows(spark, "a"), 0)
    sink(rows(spark, "b", date="02.02.25 10:00"), 1)
    table.merge(spark)
    sink(rows(spark, "b2", date="02.03.25 10:00"), 1)
    assert names_of(table.read(spark)) == ["a", "b2"]
    assert names_of(table.read(spark, months=["2025-02"])) == []
    table.merge(spark)
    assert names_of(table.read(spark)) == ["a", "b2"]
    assert set(table.merged(spark).months) == {"month=2025-01", "month=2025-03"}
    # Nothing lives on in files that count.
    assert {m for _, m in months_of(table)} == {"month=2025-01", "month=2025-02", "month=2025-03"}
    table.discard(spark, keep=0)
    assert {m for _, m in months_of(table)} == {"month=2025-01", "month=2025-03"}
    assert names_of(table.read(spark)) == ["a", "b2"]
    sink(rows(spark, "b3"), 1)
    assert names_of(table.read(spark)) == ["a", "b3"]


def test_discarding_keeps_what_readers_may_use(spark, table):
    sink = table.sink("s")
    for n in range(3):
        sink(rows(spark, f"n{n}"), n)
        table.merge(spark)
    old = table.read(spark)
    table.discard(spark, keep=5)
    assert len(months_of(table)) == 3
    sink(rows(spark, "n3"), 3)
    table.merge(spark)
    table.discard(spark, keep=1)
    assert names_of(old) == ["n0", "n1", "n2"]  # planned one merge ago
    assert len(months_of(table)) == 2
    assert [b.batch_id for b in table.batches(spark)] == []
    assert names_of(table.read(spark)) == ["n0", "n1", "n2", "n3"]
    assert len(files.names(spark, f"{table.path}/_batches/s")) == 1


def test_a_merge_that_is_stopped_changes_nothing(spark, table, monkeypatch):
    table.sink("s")(rows(spark, "a"), 0)
    before = multiset(table.read(spark))
    with monkeypatch.context() as patched:
        patched.setattr(files, "write_once", lambda *_: False)
        with pytest.raises(RuntimeError, match="another merge"):
            table.merge(spark)
    assert table.merged(spark).version == 0 and multiset(table.read(spark)) == before
    assert table.merge(spark) == 1 and multiset(table.read(spark)) == before
    table.sink("s")(rows(spark, "b"), 1)
    table.merge(spark)
    table.discard(spark, keep=0)  # also what the stopped merge has left
    assert len(months_of(table)) == 1


def test_rows_without_a_time(spark, tmp_path):
    table = S.error_table(str(tmp_path / "errors"))
    df = spark.createDataFrame([(None, "r", "{}")], table.schema).unionAll(
        spark.sql("SELECT timestamp'2025-01-02 03:04:05', 'r', '{}'")
    )
    table.sink("s")(df, 0)
    table.merge(spark)
    assert {r.month: r.reason for r in table.read(spark).collect()} == {None: "r", "2025-01": "r"}
    assert table.read(spark, months=[None]).count() == 1
    table.sink("s")(df, 1)
    table.merge(spark)
    assert table.read(spark).filter("month IS NULL").count() == 2


def test_a_file_is_created_once(spark, tmp_path):
    path = str(tmp_path / "x" / "name.json")
    assert files.write_once(spark, path, "é") and not files.write_once(spark, path, "other")
    assert files.read_text(spark, path) == "é"
    assert files.names(spark, str(tmp_path / "x")) == ["name.json"]
    assert files.names(spark, str(tmp_path / "none")) == [] and files.size(spark, str(tmp_path / "none")) == 0


def test_runs_of_merged_batches():
    state = Merged()
    for n in (5, 1, 2, 9, 4, 3):
        state.add(Batch("s", n, 2 if n == 4 else 1, ""))
    assert state.runs == {"s": [[1, 5], [9, 9]]}
    assert [state.of("s", n) for n in (0, 1, 4, 6, 9)] == [0, 1, 2, 0, 1] and state.of("t", 1) == 0


def test_published_stream_over_many_batches(spark, tmp_path):
    """Several batches, crash after each, both tables merged: the same as in one batch."""
    source, base = str(tmp_path / "lines"), str(tmp_path)
    texts = [receipt(ReceiptNumber=n, Address="" if n % 3 else "Алматы", DateTime=f"0{1 + n % 9}.0{1 + n % 5}.25 10:00") for n in range(30)]
    for n in range(3):
        documents(spark, *texts[n * 10 : n * 10 + 10]).coalesce(1).write.mode("append").text(source)
    clean, errors = S.clean_table(f"{base}/clean"), S.error_table(f"{base}/errors")
    docs = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(source).withColumnRenamed("value", "json")
    for _ in range(2):
        query = S.run_clean_and_errors(docs, clean.sink("r"), errors.sink("r"), f"{base}/c", trigger={"availableNow": True})
        query.awaitTermination()
        clean.merge(spark)
        os.unlink(f"{base}/c/commits/2")
        if os.path.exists(f"{base}/c/commits/.2.crc"):
            os.unlink(f"{base}/c/commits/.2.crc")
    assert sorted(r.batch_id for r in errors.read(spark).select("batch_id").distinct().collect()) == [0, 1, 2]
    whole = clean_items(documents(spark, *texts)).drop("upload_time")
    assert multiset(clean.read(spark).select(whole.columns)) == multiset(whole)
    assert errors.read(spark).count() == 20
    # One time per batch, in both tables alike, and the batches' times differ.
    at = clean.read(spark).select("batch_id", F.col("upload_time").alias("at"))
    at = at.unionAll(errors.read(spark).select("batch_id", "ts")).distinct().collect()
    assert len(at) == 3 and len({r.at for r in at}) == 3
