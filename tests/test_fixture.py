import re
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from helpers import multiset
from receiptlake import operators as O
from receiptlake.plans import fixture, queries, staging
from receiptlake.plans.queries import checked
from receiptlake.sources import parse_receipts


def test_counts(spark, sf_dir):
    df = checked(spark, sf_dir).select("is_clean", O.reason().alias("reason"), "Items")
    counts = [F.count("*").alias("n"), F.sum(F.size("Items")).alias("lines")]
    rows = df.groupBy("is_clean", "reason").agg(*counts).collect()
    assert sum(r.n for r in rows) == 15_000
    assert sum(r.n for r in rows if r.is_clean) == 2_439
    assert sum(r.lines for r in rows if r.is_clean) == 9_908
    assert sum(r.n for r in rows if r.is_clean is None) == 171
    reasons = Counter({r.reason: r.n for r in rows if r.is_clean is False})
    assert sum(reasons.values()) == 12_390
    assert reasons["bad_iin; bad_vat"] == 3707 and reasons["bad_vat"] == 2875
    assert reasons[""] == 2192 and reasons["bad_iin"] == 1476
    assert reasons["bad_datetime; bad_iin; total <= 0"] == 8 and len(reasons) == 16


def test_lines_are_scanned_once_and_nothing_is_hinted(spark, sf_small, monkeypatch):
    """Besides the pass that finds long orders."""
    for page_lines in (fixture.PAGE_LINES, 2):
        monkeypatch.setattr(fixture, "PAGE_LINES", page_lines)
        docs = fixture.documents(spark, sf_small)
        plan = docs.rows._jdf.queryExecution().toString()
        physical = plan.split("== Physical Plan ==")[1]
        assert physical.count("l_extendedprice") and physical.count("lineitem.parquet") == 1
        assert "ResolvedHint" not in plan and "strategy=broadcast" not in plan
        assert docs.paged == (page_lines == 2)


def test_long_orders_are_found_once_for_each_state_of_the_lines(spark, sf_small, tmp_path):
    def written(times):
        lines = spark.read.parquet(f"{sf_small}/lineitem.parquet").filter("l_orderkey % 100 = 1")
        lines = lines.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("copy")
        lines.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        return fixture.table(spark, str(tmp_path), "lineitem")

    def found(lines, page_lines):
        before = spark.sparkContext.statusTracker().getJobIdsForGroup("long")
        spark.sparkContext.setJobGroup("long", "")
        try:
            rows = fixture.long_orders(lines, str(tmp_path), page_lines)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        ran = len(spark.sparkContext.statusTracker().getJobIdsForGroup("long")) - len(before)
        return rows and {r.long_key for r in rows.collect()}, ran

    lines = written(1)
    few, first = found(lines, 3)
    again, second = found(lines, 3)
    assert few and few == again and first > 0 == second
    assert found(lines, 20)[0] is None
    assert found(lines, 20) == (None, 0)
    more, third = found(written(4), 20)
    assert more and third > 0


def test_hot_order_customer_and_part(spark, sf_small, tmp_path):
    """A third of all lines in one order, of all orders with one customer."""
    hot = str(tmp_path)
    for name in ("part", "customer", "nation"):
        spark.read.parquet(f"{sf_small}/{name}.parquet").write.parquet(f"{hot}/{name}.parquet")
    lineitem = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    third = F.expr("(l_partkey + l_suppkey) % 3 = 0")
    lineitem.withColumns(
        {
            "l_orderkey": F.when(third, 4).otherwise(F.col("l_orderkey")),
            "l_partkey": F.when(third, 7).otherwise(F.col("l_partkey")),
        }
    ).write.parquet(f"{hot}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_small}/orders.parquet")
    orders.withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 3).otherwise(F.col("o_custkey"))
    ).write.parquet(f"{hot}/orders.parquet")
    docs = fixture.documents(spark, hot, page_lines=100)
    pages = parse_receipts(docs.rows, True).groupBy("k").agg(
        F.count("*").alias("pages"), F.sum(F.size("Items")).alias("lines"),
        F.max(F.size("Items")).alias("longest"),
    )
    [row] = pages.filter("k = 4").collect()
    assert row.lines == spark.read.parquet(f"{hot}/lineitem.parquet").filter("l_orderkey = 4").count()
    assert row.pages >= row.lines / 100 and row.longest < 300
    once, paged = [
        O.clean_items(fixture.documents(spark, hot, **o).rows.drop("page")).drop("upload_time")
        for o in ({}, {"page_lines": 100})
    ]
    assert multiset(once) == multiset(paged)


def test_lines_are_dealt_once(spark, sf_small, monkeypatch):
    """By the keys of the documents, with and without pages."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for page_lines, keys in ((fixture.PAGE_LINES, r"l_orderkey#\d+L,"), (2, r"l_orderkey#\d+L, l_page")):
            monkeypatch.setattr(fixture, "PAGE_LINES", page_lines)
            docs = fixture.documents(spark, sf_small).rows
            plan = docs._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(rf"Exchange hashpartitioning\({keys}", plan)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_stream_stages_compressed_documents_and_discards_them(spark, sf_small, tmp_path, monkeypatch):
    made = []

    def staged(spark, sf_dir):
        path = staging.staged_documents(spark, sf_dir)
        files = list(Path(path).glob("part-*"))
        text = spark.read.text(path).agg(F.sum(F.octet_length("value"))).head()[0]
        made.append((path, sum(f.stat().st_size for f in files) / text))
        return path

    monkeypatch.setattr(queries, "staged_documents", staged)
    names = [n for n in queries.queries() if n.endswith("_stream")]
    names += ["merged_layout", "batch_clocks", "routing_metrics"]
    for name in names:
        assert queries.queries()[name](spark, sf_small).count()
    assert len({path for path, _ in made}) == len(names) == 9
    assert all(part < 0.5 for _, part in made)
    assert not any(Path(path).exists() for path, _ in made)
