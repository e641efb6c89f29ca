"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target size over its present size. Each
document draws how often it is repeated from the Poisson distribution of that mean, by
inverting it at a uniform number that a hash of seed, row and number gives: of all columns
of the row, and its number among rows that are equal in all of them. So reruns, retries and
other partitionings draw alike, and rows that share an id, or have none, still draw each for
itself. Means above ``MEAN_STEP`` are the sum of several draws. Copies are dealt to
partitions and ordered in them by a hash of the same, which is a global shuffle.

Equal rows are found by counting hashes; they are counted before they are shuffled and
numbered in chunks, so that a row that makes up a third of a table is no task of its own.

A null source is a source of its own. Sizes are taken from ``size_col``; null or less than
one counts as one. An empty table stays empty. All input columns are kept; ``copy`` and
``n_copies`` replace input columns of these names.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from receiptlake.llm.common import cut

MEAN_STEP = 16
TERMS = 100
# Rates of more sources than this are joined by shuffling, with hot sources salted.
BROADCAST_SOURCES = 50_000
SALTS = 64
# Hashes of rows that stand there more than once, up to which they are broadcast, and rows
# that are numbered at a time.
BROADCAST_ROWS = 200_000
CHUNK = 10_000


def rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    source_col: str = "source",
    size_col: str = "n_chars",
) -> DataFrame:
    """Columns source, parts (draws per document) and mean (of each draw).

    ``weights`` names the target share of each source, and sources it leaves out get none.
    Without it the share goes with the source's size to the power ``temperature``. The mix
    has ``epochs`` times the size of the input.
    """
    size = F.greatest(F.coalesce(F.col(size_col).cast("double"), F.lit(1.0)), F.lit(1.0))
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        shares = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        named = docs.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in weights.items()], "source string, weight double"
        )
        shares = sizes.join(named, sizes["source"].eqNullSafe(named["source"]), "left").select(
            sizes["source"], "size", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    total = shares.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.expr(f"{float(epochs)}D * all_size * weight / nullif(all_weight, 0) / size")
    return (
        shares.crossJoin(F.broadcast(total))  # one row
        .select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))
        .selectExpr("source", f"greatest(int(ceil(rate / {MEAN_STEP})), 1) AS parts", "rate")
        .selectExpr("source", "parts", "rate / parts AS mean")
    )


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns, in which a null differs from every value."""
    parts = []
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            c = F.when(c.isNotNull(), F.to_json(F.struct(c)))
        parts.append(F.md5(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))))
    return F.md5(F.concat(*parts))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with __row, a hash of them, and __number, from 1 on among equal rows."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*columns, _row_hash(docs).alias("__row"))
    again = cut(rows.groupBy("__row").count().filter("count > 1").select("__row"), "again")
    some = again.count()
    if not some:
        return rows.withColumn("__number", F.lit(1).cast("bigint"))
    again = F.broadcast(again) if some <= BROADCAST_ROWS else again
    single = rows.join(again, "__row", "left_anti").select(*columns, "__row", F.lit(1).cast("bigint").alias("__number"))
    equal = rows.join(again, "__row", "left_semi").groupBy("__row").agg(
        F.count("*").alias("__times"), F.first(F.struct(*columns)).alias("__all")
    )
    chunk = F.explode(F.expr(f"sequence(0, (__times - 1) DIV {CHUNK})"))
    equal = equal.withColumn("__chunk", chunk).repartition("__row", "__chunk")
    number = f"explode(sequence(__chunk * {CHUNK} + 1, least(__times, (__chunk + 1) * {CHUNK})))"
    equal = equal.select("__all.*", "__row", F.expr(number).alias("__number"))
    return single.unionAll(equal)


def copies(
    docs: DataFrame,
    rate: DataFrame,
    seed: int = 0,
    source_col: str = "source",
) -> DataFrame:
    """One row per copy of a document, with ``copy`` from 1 on and ``n_copies``."""
    docs = numbered(docs)
    cdf = (
        f"aggregate(sequence(1, {TERMS}), struct(exp(-mean) AS p, array(exp(-mean)) AS c), "
        "(a, i) -> struct(a.p * mean / i AS p, "
        "concat(a.c, array(a.c[i - 1] + a.p * mean / i)) AS c), a -> a.c)"
    )
    rate = rate.select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.expr(cdf).alias("__cdf"))
    rate = cut(rate, "rates")
    same = F.col(source_col).eqNullSafe(F.col("__source"))
    if rate.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rate), same)
    else:
        salt = F.pmod(F.xxhash64("__row", "__number"), F.lit(SALTS)).cast("int")
        salted = rate.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("__s", salt).join(salted, same & (F.col("__s") == F.col("__salt")))
        joined = joined.drop("__s", "__salt")
    key = "__row, __number"
    uniform = (
        f"(double(conv(substring(md5(concat_ws('|', '{int(seed)}', i, {key})), 1, 13), 16, 10)) + 0.5D)"
        " / 4503599627370496D"
    )
    draws = f"aggregate(sequence(1, __parts), 0, (a, i) -> a + (transform(array({uniform}), u -> size(filter(__cdf, c -> c <= u)))[0]))"
    place = f"md5(concat_ws('|', 'place', '{int(seed)}', copy, {key}))"
    return (
        joined.withColumn("n_copies", F.expr(draws))
        .drop("__source", "__parts", "__cdf")
        .filter("n_copies > 0")
        .withColumn("copy", F.expr("explode(sequence(1, n_copies))"))
        .withColumn("__place", F.expr(place))
        .repartition("__place")
        .sortWithinPartitions("__place")
        .drop("__place", "__row", "__number")
    )


def mix(docs: DataFrame, seed: int = 0, source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: ``rates`` of ``docs``, then ``copies``."""
    return copies(docs, rates(docs, source_col=source_col, **options), seed, source_col)


# The query's rows by DuckDB: the same draws, the distribution summed in a window.
_PARTS = " || ".join(f"md5(coalesce('=' || {c}::VARCHAR, '-'))" for c in ("doc_id", "text", "lang", "source", "n_chars"))
ORACLE_SQL = f"""
WITH sizes AS (
  SELECT source, sum(greatest(coalesce(n_chars, 1), 1))::DOUBLE AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, (sum(size) OVER ()) * pow(size, 0.5) / (sum(pow(size, 0.5)) OVER ()) / size AS rate
  FROM sizes
), parts AS (
  SELECT source, greatest(ceil(rate / {MEAN_STEP}), 1)::INT AS parts,
         rate / greatest(ceil(rate / {MEAN_STEP}), 1) AS mean
  FROM rates
), cdf AS (
  SELECT source, i, sum(exp(-mean + i * ln(mean) - lgamma(i + 1))) OVER (PARTITION BY source ORDER BY i) AS c
  FROM parts, range(0, {TERMS + 1}) t(i)
), lists AS (
  SELECT source, list(c) AS c FROM cdf GROUP BY source
), hashed AS (
  SELECT doc_id, text, lang, source, n_chars, md5({_PARTS}) AS hash FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY hash) AS number FROM hashed
), drawn AS (
  SELECT d.*, l.c,
         (('0x' || substr(md5('0|' || j || '|' || hash || '|' || number), 1, 13))::BIGINT + 0.5)
           / 4503599627370496.0 AS u
  FROM numbered d
  JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
  JOIN lists l ON d.source IS NOT DISTINCT FROM l.source, range(1, p.parts + 1) s(j)
), counts AS (
  SELECT doc_id, text, lang, source, n_chars, hash, number,
         sum(len(list_filter(c, lambda x: x <= u)))::INT AS n_copies
  FROM drawn GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy::INT AS copy
FROM counts, range(1, n_copies + 1) r(copy)
"""
