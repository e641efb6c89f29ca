"""Embedding near-deduplication by spherical-cap filters.

Directions are a random product code: a vector, randomly rotated, is split in halves, each
half has a set of random codewords, and every pair of codewords is a direction. A vector
passes all filters whose directions it exceeds the threshold on, one threshold for all
vectors; list decoding finds them from the codewords of each half that can belong to a sum
above it, without scoring all pairs. Vectors in a common filter are compared exactly, in
double precision.

The threshold is set on the code itself: of simulated pairs at the cosine asked for, in any
direction since the code is turned at random, ``REACHED`` share a filter. The number of
codewords is then the one with the least work for the number of vectors: more directions
have higher thresholds and so smaller filters, but a vector passes more of them. It cannot
cost recall. Measured share of pairs at a cosine of 0.9 with a common filter (``tests/llm``;
closer pairs have more): 0.95 or more in 16, 32 and 64 dimensions for 500 to 10 million
vectors.

Equal vectors are taken together first. Filters give links only as far as they are needed
to connect what belongs together; then the links within each component are counted
completely, so a pair counts once however many filters it shares, and also if it shares
none. Large filters and components are cut into blocks, and pairs of blocks are dealt out;
no pair of vectors leaves a task but those links that connect.

Vectors that are null, zero or hold null or non-finite components link with nothing, and
vectors of different length are not compared. Repeated ids are rows of their own: a row
counts the others that are linked to it, repeated ones included. A row without an id is kept.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from math import exp, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.blocks import connecting, groups
from receiptlake.llm.common import cut, short_batches
from receiptlake.llm.components import components

COSINE = 0.9
REACHED = 0.975  # share of simulated pairs that have a filter in common
PAIRS = 1000  # simulated
CODEWORDS = [1 << n for n in range(3, 15)]  # per half, to choose from
# Costs, in those of a vector that travels to a filter: a filter that only its id goes to,
# since no other vector passes it; a comparison; a score on a codeword, per dimension.
ALONE, COMPARISON, SCORE = 0.15, 1 / 500, 1 / 35_000
BLOCK = 512


@lru_cache(maxsize=8)
def code(dimension: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation, and the codewords of both halves."""
    rng = np.random.default_rng([dimension, words])
    rotation = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
    half = (dimension + 1) // 2
    sets = []
    for width in (half, max(1, dimension - half)):
        w = rng.normal(size=(words, width))
        sets.append((w / np.linalg.norm(w, axis=1, keepdims=True)).astype(np.float32))
    return rotation, *sets


def halves(unit: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The score of each unit vector on the codewords of both halves; a direction's is the
    sum of two."""
    rotation, first, second = code(unit.shape[1], words)
    turned = (unit @ rotation).astype(np.float32)
    half = first.shape[1]
    other = turned[:, half:] if unit.shape[1] > half else np.zeros((len(unit), 1), np.float32)
    return turned[:, :half] @ first.T, other @ second.T


def simulated(dimension: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at a cosine (in one dimension, of the same)."""
    rng = np.random.default_rng([dimension, PAIRS])
    x, y = rng.normal(size=(2, PAIRS, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dimension == 1:
        return x, x
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + sqrt(1 - cosine**2) * y


def common_score(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, few: int = 64) -> np.ndarray:
    """Per pair of vectors, with scores a, b and c, d on the halves, the threshold up to which
    they share a filter: the best direction's lower score, among those of the codewords that
    are best for both together."""
    few = min(few, a.shape[1])
    i = np.argpartition(-(a + c), few - 1, axis=1)[:, :few]
    j = np.argpartition(-(b + d), few - 1, axis=1)[:, :few]
    one, two = (np.take_along_axis(v, k, 1) for v, k in ((a, i), (b, j)))
    three, four = (np.take_along_axis(v, k, 1) for v, k in ((c, i), (d, j)))
    lower = np.minimum(one[:, :, None] + two[:, None], three[:, :, None] + four[:, None])
    return lower.reshape(len(a), -1).max(axis=1)


@lru_cache(maxsize=64)
def plan(dimension: int, vectors: int, cosine: float = COSINE) -> tuple[int, float]:
    """Codewords per half and the threshold, for a number of vectors."""
    best = None
    x, y = simulated(dimension, cosine)
    for words in CODEWORDS:
        a, b = halves(x, words)
        threshold = float(np.quantile(common_score(a, b, *halves(y, words)), 1 - REACHED))
        passes = np.mean([len(i) for i, _ in map(decoded, a[:100], b[:100], repeat(threshold))])
        chance = vectors * passes / words**2  # vectors in a filter
        met = 1 - exp(-chance)
        work = passes * (ALONE + met * (1 + chance * COMPARISON)) + words * dimension * SCORE
        if best is None or work < best[0]:
            best = work, words, threshold
        elif work > 4 * best[0] or passes > 2000:
            break
    return best[1], best[2]


def decoded(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of codewords whose sum reaches the threshold, by a vector's scores."""
    i = np.flatnonzero(a >= threshold - b.max())
    j = np.flatnonzero(b >= threshold - a.max())
    x, y = np.nonzero(a[i, None] + b[j] >= threshold)
    return i[x], j[y]


def passed(unit: np.ndarray, words: int, threshold: float) -> list[np.ndarray]:
    """All filters of each unit vector."""
    out, dimension = [], unit.shape[1]
    for start in range(0, len(unit), 200):
        a, b = halves(unit[start : start + 200], words)
        for i, j in map(decoded, a, b, repeat(threshold)):
            out.append((dimension << 32) + i.astype(np.int64) * words + j)
    return out


def _filtered(count: int, cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = len(batch)
            names, raws, lists = [None] * size, [None] * size, [None] * size
            by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
            for n, values in enumerate(batch["embedding"]):
                if values is None or not len(values):
                    continue
                vector = np.array(values, dtype=np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    length = np.linalg.norm(vector)
                if length == 0 or not np.isfinite(length):
                    scale = np.abs(vector).max()  # too small or too large to be squared
                    if not np.isfinite(scale) or scale == 0:
                        continue
                    vector = vector / scale
                    length = np.linalg.norm(vector)
                by_size.setdefault(len(vector), []).append((n, vector / length))
            for found in by_size.values():
                unit = np.stack([v for _, v in found])
                for (n, v), filters in zip(found, passed(unit, *plan(unit.shape[1], count, cosine)), strict=True):
                    raws[n], lists[n] = v.tobytes(), filters
                    names[n] = hashlib.blake2b(raws[n], digest_size=16).digest()
            parts = (pd.Series(x, dtype=object, index=batch.index) for x in (names, raws, lists))
            yield pd.concat([batch["id"], *parts], axis=1, keys=["id", "class", "vector", "filters"])

    return run


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each key dealt to all pairs of its blocks: columns key, i, j (the blocks),
    mine (the row's) and the others. Keys with a single row are left out."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("size")).filter("size > 1")
    sizes = sizes.select(key, F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(sizes, key).withColumn("mine", F.expr("int(pmod(xxhash64(class, 7), parts))"))
    dealt = dealt.withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.withColumn("i", F.least("mine", "with")).withColumn("j", F.greatest("mine", "with"))
    dealt = dealt.drop("parts", "with")
    return dealt.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _matrix(vectors: pd.Series) -> np.ndarray:
    values = np.frombuffer(b"".join(vectors), dtype=np.float64)
    return values.reshape(len(vectors), -1)


def _linked(batch: pd.DataFrame, start: int, end: int, cosine: float) -> np.ndarray:
    """Which rows of a group are linked. Of two different blocks only pairs across count."""
    part = batch.iloc[start:end]
    unit = _matrix(part["vector"])
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    if part["i"].iat[0] != part["j"].iat[0]:
        mine = part["mine"].to_numpy()
        near &= mine[:, None] != mine
    return near


def _connecting(cosine: float):
    """Links that connect what is linked within a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, begins in groups(batches, "filter"):
            names, a, b = batch["class"].to_numpy(), [], []
            sizes = np.diff(begins)
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = np.repeat(sizes <= 8, sizes)
            for step in range(1, 8):  # all small groups at once, row by later row
                if len(group) <= step:
                    break
                at = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
                at = at[batch["i"].to_numpy()[at] == batch["j"].to_numpy()[at]]
                if len(at):
                    x, y = (_matrix(batch["vector"].iloc[n]) for n in (at, at + step))
                    hit = at[np.einsum("nd,nd->n", x, y) >= cosine]
                    a += list(names[hit])
                    b += list(names[hit + step])
            for n in np.flatnonzero((sizes > 8) | (batch["i"].to_numpy() != batch["j"].to_numpy())[begins[:-1]]):
                start, end = begins[n], begins[n + 1]
                x, y = connecting(_linked(batch, start, end, cosine))
                a += list(names[start:end][x])
                b += list(names[start:end][y])
            yield pd.DataFrame({"a": a, "b": b}, dtype=object)

    return run


def _counting(cosine: float):
    """How many rows of its group each class is linked to, copies counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, begins in groups(batches, "component"):
            counts = np.zeros(len(batch), dtype=np.int64)
            copies = batch["copies"].to_numpy()
            for start, end in zip(begins[:-1], begins[1:], strict=True):
                counts[start:end] = _linked(batch, start, end, cosine) @ copies[start:end]
            yield pd.DataFrame({"class": batch["class"], "links": counts})

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per vector: ``id_col``, n_links (others at ``cosine`` or above),
    component_id (the least id reachable by links, its own included) and kept (its id is
    the component's)."""
    rows = short_batches(vectors).select(
        F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("embedding")
    )
    count = 1 << max(rows.count() - 1, 0).bit_length()  # nearly as many vectors share a plan
    schema = "id string, class binary, vector binary, filters array<bigint>"
    rows = rows.mapInPandas(_filtered(count, cosine), schema).withColumn("id", F.col("id").cast("bigint"))
    rows = cut(rows, "filtered")
    classes = rows.filter("class IS NOT NULL").groupBy("class").agg(
        F.min("id").alias("first_id"),
        F.count("*").alias("copies"),
        F.first("vector").alias("vector"),
        F.first("filters").alias("filters"),
    )
    classes = cut(classes, "classes")
    places = classes.select(F.explode("filters").alias("filter"), "class")
    shared = places.groupBy("filter").agg(F.count("*").alias("size")).filter("size > 1").select("filter")
    places = cut(places.join(shared, "filter", "left_semi"), "places")
    places = places.join(classes.select("class", "vector"), "class")
    links = in_blocks(places, "filter").mapInPandas(_connecting(cosine), "a binary, b binary")
    found = cut(components(links).withColumnRenamed("id", "class"), "groups")
    members = found.join(classes.select("class", "copies", "vector"), "class")
    counts = in_blocks(members, "component").mapInPandas(_counting(cosine), "class binary, links bigint")
    counts = counts.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.select("class", "first_id", "copies").join(found, "class", "left")
    known = cut(known.withColumn("component", F.coalesce("component", "class")), "known")
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = known.join(least, "component").join(counts, "class", "left")
    known = known.select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (
        rows.select("id", "class")
        .join(known, "class", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


# The query's rows by DuckDB: all pairs, and the least id reachable.
ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x != 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM good a JOIN good b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
