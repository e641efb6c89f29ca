"""Document fingerprints by Order MinHash.

A text's k-mers of code points are numbered by occurrence and hashed, each numbered k-mer
once. Every slot of a fingerprint orders the numbered k-mers anew, by the product of their
hash with an odd factor of the slot, and selects the first ``LENGTH`` of them. These are put
in the order they have in the text and hashed as a tuple.
A slot agrees between two texts only if both select the same k-mers in the same order, so
the share of slots that agree falls with edit distance, moved passages included.

Equal texts have equal fingerprints. A text shorter than a k-mer is one k-mer. Null and
empty texts have the empty fingerprint, like each other and unlike any other.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.common import short_batches

K = 6
SLOTS = 64
LENGTH = 2

_POSITION = 24  # bits of the position in a sort key
_TILE = 1024  # k-mers whose products with all factors stay in a core's cache
_FACTORS = np.random.default_rng(5).integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered_kmers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-numbered k-mers, and the position of each."""
    k = min(K, len(codes))
    rolled = codes[: len(codes) - k + 1].astype(np.uint64)
    for n in range(1, k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[n : len(codes) - k + 1 + n]
    high = _mix(rolled) >> np.uint64(_POSITION)
    count = len(high)
    if count <= 1 << _POSITION:
        keys = (high << np.uint64(_POSITION)) | np.arange(count, dtype=np.uint64)
        keys.sort()
        high = keys >> np.uint64(_POSITION)
        position = (keys & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    else:
        position = np.argsort(high, kind="stable")
        high = high[position]
    new = np.empty(count, dtype=bool)
    new[0], new[1:] = True, high[1:] != high[:-1]
    index = np.arange(count)
    occurrence = index - np.maximum.accumulate(np.where(new, index, 0))
    return _mix(high + occurrence.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), position


def selected(hashes: np.ndarray) -> np.ndarray:
    """Per slot the places of its first ``LENGTH`` numbered k-mers (all, if there are fewer)."""
    slots, found = np.arange(SLOTS), []
    for start in range(0, len(hashes), _TILE):
        order = hashes[start : start + _TILE] * _FACTORS[:, None]
        for _ in range(min(LENGTH, order.shape[1])):
            first = order.argmin(axis=1)
            found.append(start + first)
            order[slots, first] = ~np.uint64(0)
        if len(found) > _TILE:
            found = _least(hashes, found)
    return np.stack(found if len(found) <= LENGTH else _least(hashes, found), axis=1)


def _least(hashes: np.ndarray, found: list[np.ndarray]) -> list[np.ndarray]:
    places = np.stack(found, axis=1)
    first = np.argsort(hashes[places] * _FACTORS[:, None], axis=1, kind="stable")[:, :LENGTH]
    return list(np.take_along_axis(places, first, axis=1).T)


def fingerprint(text: str | None) -> str:
    """Slots of 16 bits in hexadecimal."""
    if not text:
        return ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    hashes, position = numbered_kmers(codes)
    picked = selected(hashes)
    in_text = np.argsort(position[picked], axis=1)
    picked = np.take_along_axis(picked, in_text, axis=1)
    tuples = np.zeros(SLOTS, dtype=np.uint64)
    for column in picked.T:
        tuples = _mix(tuples * np.uint64(0x9E3779B97F4A7C15) + hashes[column])
    return (tuples >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """The share of slots that agree."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(f), dtype=np.uint16) for f in (a, b))
    return float((x == y).mean())


def edited(text: str, following: str) -> str:
    """The last half of a text, rounded down, replaced by as much of another's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col`` and fingerprint."""

    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t) for t in batch], dtype=object)

    return short_batches(docs).select(id_col, made(text_col).alias("fingerprint"))


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range in order, behind them the first row of the next range as a halo row.
    Every row is compared with the one behind it. Copies that follow each other are
    fingerprinted once."""
    last = None  # id, text, fingerprint
    for batch in batches:
        out = []
        for halo, id_, text in zip(batch["halo"], batch["id"], batch["text"], strict=True):
            own = last[2] if last is not None and last[1] == text else fingerprint(text)
            if last is not None:
                out.append(_row(last, text, own))
            last = None if halo else (id_, text, own)
        yield pd.DataFrame(out, columns=_COLUMNS)


_COLUMNS = "id n_chars edited fingerprint edited_fingerprint near_edited near_next".split()


def _row(last: tuple, following: str, next_print: str) -> tuple:
    id_, text, own = last
    changed = edited(text, following)
    print_ = own if changed == text else fingerprint(changed)
    near = likeness(own, print_), likeness(own, next_print)
    return id_, len(text), changed, own, print_, *near


def edit_test(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against its edited form (see ``edited``) and against the next document,
    by ascending id, rows of one id by a hash of the text, then by the text; after the last
    comes the first. Null ids come first. Columns ``id_col``, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next. A single document is its own
    next one.

    Rows are dealt by ranges of ids, and an id with more rows than a range holds by ranges of
    the hash, so that texts are shuffled once; only copies of one text under one id stay
    together. The first document of each range is also sent to the range before. Ranges and
    where they begin, one row per partition, are all that passes through the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(text_col, F.lit(""))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST)).alias("key")
    rows = short_batches(docs).select(
        key, F.xxhash64(text).alias("hash"), F.col(id_col).cast("string").alias("id"), text.alias("text")
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [n / ranges for n in range(1, ranges)] or [0.5]
    bounds = rows.agg(F.percentile_approx("key", shares, 20 * ranges + 1000)).head()[0]
    bounds = split_bounds(bounds or [])
    part = _part(bounds)
    # Where no id is split, the text is not needed to say where a range begins.
    split = len(bounds) > len({k for k, _ in bounds})
    begin = ["key", "hash"] if split else ["key"]
    firsts = rows.groupBy(part.alias("part")).agg(F.min(F.struct(*begin)))
    first = {r[0]: r[1] for r in firsts.collect()}
    parts = sorted(first)
    before = {p: parts[n - 1] for n, p in enumerate(parts)}
    size = len(bounds) + 1
    part_before = F.array(*(F.lit(before.get(p, 0)) for p in range(size)))
    own = rows.withColumn("part", part)
    columns = "part", "halo", "key", "hash", "id", "text"
    at_start = F.lit(True)
    for n, column in enumerate(begin):
        starts = F.array(*(F.lit(first[p][n] if p in first else 0).cast("bigint") for p in range(size)))
        at_start &= F.col(column) == F.get(starts, F.col("part"))
    halo = own.filter(at_start).groupBy(F.get(part_before, F.col("part")).alias("part"))
    halo = halo.agg(F.min(F.struct("key", "hash", "text", "id")).alias("row"), F.lit(True).alias("halo"))
    dealt = (
        own.withColumn("halo", F.lit(False))
        .select(*columns)
        .unionAll(halo.select("part", "halo", "row.key", "row.hash", "row.id", "row.text"))
        .repartitionById(size, F.col("part"))
        .sortWithinPartitions("halo", "key", "hash", "text")
        .select("halo", "id", "text")
    )
    schema = "id string, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(_compared, schema).select(
        F.col("id").cast("bigint").alias(id_col),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


_LEAST, _MOST = -(2**63), 2**63 - 1


def split_bounds(keys: list[int]) -> list[tuple[int, int]]:
    """Last id and hash of each range but the last, from quantiles of the ids: an id that is
    a quantile several times over ends as many ranges, at even steps of the hash."""
    bounds = []
    for key in sorted(set(keys)):
        times = keys.count(key)
        bounds += [(key, _LEAST + (2**64 * n) // times - 1) for n in range(1, times + 1)]
    return bounds


def _part(bounds: list[tuple[int, int]]):
    """How many bounds lie below key and hash: of blocks first, then of one block's."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))

    def sql(value: int) -> str:
        return f"{value}L" if value > _LEAST else f"{_LEAST + 1}L - 1L"

    every = "array(" + ", ".join(f"struct({sql(k)} AS key, {sql(h)} AS hash)" for k, h in bounds) + ")"
    split = len(bounds) > len({k for k, _ in bounds})
    below = "b.key < key OR b.key = key AND b.hash < hash" if split else "b.key < key"
    ends = f"filter({every}, (b, n) -> n % {width} = {width - 1})"
    block = f"size(filter({ends}, b -> {below}))"
    return F.expr(
        f"transform(array({block}), k -> k * {width} + "
        f"size(filter(slice({every}, k * {width} + 1, {width}), b -> {below})))[0]"
    )
