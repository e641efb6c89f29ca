"""MinHash near-deduplication of weighted bags of word shingles.

A text is the bag of its five-word shingles, each weighing as often as it occurs. BagMinHash
signs it: weights are discretised into intervals [0,1), [1,2), [2,4), [4,8) and so on, and
every shingle runs one Poisson process per interval that its weight reaches into. A process
depends on shingle and interval alone; its points carry a time, a slot of the signature and
a place in the interval, and those placed below the weight count. Each slot keeps its
earliest point, so two bags agree in a slot with the probability of their weighted Jaccard
similarity. Bands of slots are joined, and pairs in a common band are verified by the
overlap of their bags.

Texts that are equal are taken together first, so copies cost one row each. Within a band's
bucket not all pairs are made. Its hub, the member that meets most others in all its buckets,
is compared with the rest; in a group of edited copies that is the text they come from, and
links to it connect most of them. Buckets in which not all are linked to their hub are
gathered by hub, each member once, and all are compared with those that are not: pairs of
blocks are dealt out, a task counts all overlaps in a pair of blocks at once, and only links
that connect leave it. So every pair that shares a band is either connected by its hub or has
been checked, and no group is expanded into pairs.

Words are what white space separates, in lower case. A text of one to four words is one
shingle. Null, empty and wordless texts link with nothing. Overlaps are counted on 32-bit
hashes of numbered shingles.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.blocks import connecting, groups
from receiptlake.llm.common import cut, short_batches
from receiptlake.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
BLOCK = 512
# Ids up to which a list of them is broadcast (8 to 16 bytes each), else it is shuffled.
BROADCAST_IDS = 500_000
SALTS = 16

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.array([chr(c).isspace() for c in range(65536)])


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text, in order."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = ~_SPACE[np.minimum(codes, 65535)] | (codes > 65535)
    begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if not len(begin):
        return [np.empty(0, np.uint64) for _ in texts]
    word_at = np.cumsum(inside[1:] & ~inside[:-1])  # words begun up to the next place
    place = np.arange(1, len(codes)) - begin[np.maximum(word_at - 1, 0)]
    longest = int(place[inside[1:]].max()) + 1
    powers = np.cumprod(np.full(longest, _FACTOR), dtype=np.uint64)
    value = np.where(inside[1:], codes[1:] * powers[np.clip(place, 0, longest - 1)], np.uint64(0))
    words = _mix(np.add.reduceat(value, begin - 1, dtype=np.uint64))
    ends = np.cumsum([1 + len(t) for t in lowered])  # place of the space after each text
    return np.split(words, word_at[ends - 1][:-1])


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles, and their weights."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    width = min(WORDS, len(words))
    rolled = words[: len(words) - width + 1] + np.uint64(width)
    for n in range(1, width):
        rolled = rolled * _FACTOR + words[n : len(words) - width + 1 + n]
    return np.unique(_mix(rolled), return_counts=True)


def numbered(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A bag as a set: 32-bit hashes of shingles numbered by occurrence."""
    each = np.repeat(elements, weights)
    first = np.repeat(np.cumsum(weights) - weights, weights)
    number = (np.arange(len(each)) - first).astype(np.uint64)
    return np.unique((_mix(each + number * _FACTOR) >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def _points(elements, weights, lower, length, until):
    """Slots, times and names of the points before ``until``, of the processes of one
    interval, in the parts of it below the weights."""
    names = _mix(elements ^ _mix(np.uint64([lower + 1])))
    count = int(until * length + 4 * (until * length) ** 0.5 + 6)
    while True:
        point = _mix(names[:, None] + np.arange(1, count + 1, dtype=np.uint64) * _FACTOR)
        times = np.cumsum(-np.log(_uniform(point)), axis=1) / length
        if times[:, -1].min() >= until:
            break
        count *= 2
    early = times < until
    if length > 1:
        coordinate = lower + length * _uniform(_mix(point + np.uint64(2)))
        early &= coordinate < weights[:, None]
    point, times = point[early], times[early]
    slots = (_mix(point + np.uint64(1)) >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)
    return slots.astype(np.int64), times, point


def signature(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The earliest point of each slot."""
    until = SLOTS * (np.log(SLOTS) + 4) / weights.sum()
    while True:
        found, lower, length = [], 0, 1
        some = np.arange(len(weights))
        while len(some):
            found.append(_points(elements[some], weights[some], lower, length, until))
            lower, length = lower + length, max(1, lower + length)
            some = some[weights[some] > lower]
        slots, times, points = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.argsort(-times, kind="stable")
        out = np.zeros(SLOTS, dtype=np.uint64)
        out[slots[order]] = points[order]  # the earliest is written last
        if out.all():
            return out
        until *= 2


def bands(signed: np.ndarray) -> np.ndarray:
    rows = signed.reshape(BANDS, ROWS)
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in rows.T:
        value = _mix(value * _FACTOR + column)
    return value.view(np.int64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with np.errstate(over="ignore"):
        for batch in batches:
            out = []
            for start in range(0, len(batch), 100):
                part = batch.iloc[start : start + 100]
                for words in word_hashes(part["text"].tolist()):
                    bag = shingles(words)
                    size = int(bag[1].sum())
                    out.append((size, bands(signature(*bag)) if size else None, numbered(*bag).tobytes()))
            made = pd.DataFrame(out, columns=["n", "bands", "bag"], index=batch.index)
            yield pd.concat([batch[["id", "class"]], made], axis=1)


def _class(text_col: str):
    """What equal texts have in common."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, class, n (shingles in the bag), bands, and bag: the numbered shingles, as
    sorted 32-bit integers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = short_batches(docs).select(
        F.col(id_col).cast("string").alias("id"), _class(text_col).alias("class"), text.alias("text")
    )
    schema = "id string, class binary, n bigint, bands array<bigint>, bag binary"
    return rows.mapInPandas(_signed, schema).withColumn("id", F.col("id").cast("bigint"))


def _sized(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A list of ids, to be broadcast if it is short."""
    return F.broadcast(ids) if ids.count() <= most else ids


def _verified(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose bags overlap enough. A class may be ``a`` of very many pairs, so
    its bag is dealt by a salt, once for each salt that it meets."""

    @F.pandas_udf("int")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = zip(x, y, strict=True)
        one = (np.frombuffer(a + b, dtype=np.int32) for a, b in pairs)
        return pd.Series([len(v) - len(np.unique(v)) for v in one], dtype="int32")

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    centres = salted.select("a", "salt").distinct().join(bags.withColumnRenamed("class", "a"), "a")
    joined = salted.join(bags.select(F.col("class").alias("b"), F.col("bag").alias("other")), "b")
    joined = joined.join(centres, ["a", "salt"]).withColumn("common", common("bag", "other"))
    sizes = F.expr("octet_length(bag) / 4 + octet_length(other) / 4")
    return joined.filter(F.col("common") >= similarity * (sizes - F.col("common"))).select("a", "b")


def overlaps(bags: list[np.ndarray]) -> np.ndarray:
    """How many elements every two bags share. Elements of one bag only are left out, the
    others are counted some at a time."""
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    _, where, counts = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[where]
    keep = shared[where]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(bags), len(bags)), dtype=np.float32)
    width = 4096
    for start in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (start, start + width))
        has = np.zeros((len(bags), width), dtype=np.float32)
        has[owner[lo:hi], column[lo:hi] - start] = 1
        common += has @ has.T
    return common


def _joining(similarity: float):
    """Links that connect rows, but for those between inner rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, begins in groups(batches, "key"):
            names, inner = batch["id"].to_numpy(), batch["inner"].to_numpy()
            size, mine = batch["n"].to_numpy(), batch["mine"].to_numpy()
            apart = (batch["i"] != batch["j"]).to_numpy()
            a, b = [], []
            for start, end in zip(begins[:-1], begins[1:], strict=True):
                part = slice(start, end)
                bags = [np.frombuffer(x, dtype=np.int32) for x in batch["bag"].iloc[part]]
                if len(bags) < 2:
                    continue
                common = overlaps(bags)
                n = size[part].astype(np.float32)
                near = common >= similarity * (n[:, None] + n - common) - 1e-3
                near &= ~(inner[part][:, None] & inner[part])
                np.fill_diagonal(near, False)
                if apart[start]:
                    near &= mine[part][:, None] != mine[part]
                x, y = connecting(near)
                a += list(names[start:end][x])
                b += list(names[start:end][y])
            yield pd.DataFrame({"a": a, "b": b}, dtype=object)

    return run


def _block(parts: str) -> Column:
    return F.expr(f"int(pmod(xxhash64(id, 7), {parts}))")


def links_in_buckets(members: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that join the classes of every bucket as far as their bags overlap.
    ``members``: bucket, size (of the bucket), id, n; ``bags``: class, bag."""
    meets = members.groupBy("id").agg(F.sum("size").alias("meets"))
    hubs = (
        members.join(meets, "id")
        .groupBy("bucket")
        .agg(F.max(F.struct("meets", "id")).alias("hub"))
        .select("bucket", F.col("hub.id").alias("hub"))
    )
    hubs = cut(hubs, "hubs")
    sizes = members.select("id", "n").distinct()
    pairs = members.join(hubs, "bucket").filter("id != hub").select("hub", "id", "n").distinct()
    pairs = pairs.join(sizes.select(F.col("id").alias("hub"), F.col("n").alias("n_hub")), "hub")
    pairs = pairs.filter(F.least("n", "n_hub") >= similarity * F.greatest("n", "n_hub"))
    links = _verified(pairs.select(F.col("hub").alias("a"), F.col("id").alias("b")), bags, similarity)
    links = cut(links, "links")

    # Buckets in which not all are linked to the hub are gone through by hub, each member
    # once; ``inner`` are the hub and those linked to it.
    known = links.select(F.col("a").alias("hub"), F.col("b").alias("id"), F.lit(True).alias("inner"))
    named = members.select("bucket", "id", "n").join(hubs, "bucket").join(known, ["hub", "id"], "left")
    inner = F.coalesce("inner", F.col("id") == F.col("hub"))
    named = cut(named.select("bucket", F.col("hub").alias("key"), "id", "n", inner.alias("inner")), "named")
    open_ = named.groupBy("bucket").agg(F.every("inner").alias("all")).filter("NOT all").select("bucket")
    rows = cut(named.join(open_, "bucket").select("key", "id", "n", "inner").distinct(), "rows")

    # Inner rows are connected. They are compared with the others only: their blocks come
    # first, and no two of these make a pair.
    parts = rows.groupBy("key").agg(
        F.ceil(F.count_if("inner") / BLOCK).cast("int").alias("own"),
        F.ceil(F.count_if(~F.col("inner")) / BLOCK).cast("int").alias("other"),
    )
    dealt = rows.join(parts, "key").withColumn("mine", F.when(F.col("inner"), _block("own")).otherwise(F.col("own") + _block("other")))
    blocks = F.expr("IF(inner, sequence(own, own + other - 1), sequence(0, own + other - 1))")
    dealt = dealt.withColumn("with", F.explode(blocks))
    dealt = dealt.select(
        "key", "id", "n", "inner", "mine", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j")
    )
    dealt = dealt.join(bags.select(F.col("class").alias("id"), "bag"), "id")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = dealt.mapInPandas(_joining(similarity), "a binary, b binary")
    return cut(links.unionByName(more), "links")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per document: ``id_col``, class (of equal texts, binary), class_id (the least
    id of its class), group (the least class of those reachable by links), group_id (the
    least id in it) and kept, true for the documents with the group's id. Rows that repeat
    an id and its text are alike, so both are kept; ``deduplicated`` takes one."""
    rows = cut(signed(docs, id_col, text_col), "signed")
    first = F.min("id").alias("class_id"), F.first("n").alias("n"), F.first("bands").alias("bands")
    classes = cut(rows.filter("n > 0").groupBy("class").agg(*first), "classes")
    buckets = classes.select(F.explode("bands").alias("bucket"), F.col("class").alias("id"), "n")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut(buckets.join(shared, "bucket"), "members")
    wanted = _sized(members.select(F.col("id").alias("class")).distinct())
    bags = rows.join(wanted, "class", "left_semi").groupBy("class").agg(
        F.first("bag").alias("bag")
    )
    links = links_in_buckets(members, cut(bags, "bags"), similarity)
    reached = components(links).withColumnRenamed("id", "class")
    ids = classes.select("class", "class_id").join(reached, "class", "left")
    ids = ids.withColumn("component", F.coalesce("component", "class"))
    least = ids.groupBy("component").agg(F.min("class_id").alias("group_id"))
    ids = ids.join(least, "component").select("class", "class_id", F.col("component").alias("group"), "group_id")
    return (
        rows.select("id", "class", "n")
        .join(ids, "class", "left")
        .select(
            F.col("id").alias(id_col),
            "class",
            F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
            "group",
            F.when(F.col("n") > 0, F.col("group_id")).otherwise(F.col("id")).alias("group_id"),
        )
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("group_id")))
    )


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One document of each group, with all its columns. Documents without words stay."""
    found = cut(near_duplicates(docs, id_col, text_col, similarity).filter("kept"), "kept")
    # Several texts of a group can bear its least id; the least class stays.
    one = found.filter("group IS NOT NULL").groupBy(id_col, "group").agg(F.min("class").alias("class"))
    wordless = found.filter("group IS NULL").select(id_col, "class").distinct()
    kept = one.select(id_col, "class").unionByName(wordless)
    kept = cut(kept.select(F.col(id_col).alias("__id"), F.col("class").alias("__kept")), "kept")
    rows = docs.withColumn("__class", _class(text_col))
    same = rows[id_col].eqNullSafe(kept["__id"]) & (rows["__class"] == kept["__kept"])
    rows = rows.join(_sized(kept), same, "left_semi")
    repeated = found.groupBy(id_col, "class").count().filter("count > 1").limit(1).count()
    if repeated:
        rows = rows.dropDuplicates([id_col, "__class"])
    return rows.drop("__class")
