"""Toxicity scores from subword-bag embeddings.

A word is the mean of the embeddings of itself and its character 3- to 6-grams, word ends
included, so an unseen misspelling shares most of its vectors with the word it comes from.
A text is the mean of its words, and a linear softmax over it tells toxic from clean.
Embeddings and softmax are trained jointly in numpy, on a bounded sample of labelled rows
cut into passages. Both layers are linear, so the trained model folds into one number per
n-gram bucket, which is what tasks receive.

A text is read whole and in windows of each of ``WINDOWS`` words, at every position, and
scores as its most toxic one: a passage in a long text is not averaged away. Words whose
number stays below a level count nothing, so that the chance leanings of many common words
do not add up. Each width has its own level, slope and shift, calibrated on sample rows that
training has not seen. A passage shorter than the least width still counts by its share of it.

Null, empty and wordless texts have no words and score as the calibration says for none.
Columns other than id and text are never read. Labels of one id that differ count as the
greater; of repeated training rows one is taken; repeated rows are scored row by row. If one
class is missing from the sample, the score is that of the other, 0 or 1, and 0 if both are.
"""

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.common import short_batches

SIZES = (3, 4, 5, 6)
BITS = 20
WINDOWS = (15, 30, 60, 120)
WHOLE = 1 << 62  # words: no text is longer
LEAN = 5.0  # of the bias towards clean, before training
# Bounds of the training sample: clean rows, toxic rows, and characters of a row.
SAMPLE_ROWS = (4000, 2000)
SAMPLE_CHARS = 20_000
PIECES = 20  # of a row that has more
PASSAGE = 100  # words of a training passage, about
# Levels tried, as shares of the words that are below.
LEVELS = (0, 0.5, 0.8, 0.9, 0.95, 0.97, 0.98, 0.985, 0.99, 0.993, 0.995, 0.996, 0.997, 0.998)

_POWERS = np.cumprod(np.full(256, 0x01000193, dtype=np.uint32), dtype=np.uint32)
_LETTER = np.array([chr(c).isalnum() for c in range(65536)])


@dataclass
class Grams:
    """N-grams of a batch of texts: the bucket of each, its word, the n-grams per word, and
    the first word of each text (with the end as one more entry)."""

    bucket: np.ndarray
    word: np.ndarray
    per_word: np.ndarray
    first: np.ndarray


def ngrams(texts: Iterable[str | None]) -> Grams:
    lowered = [(t or "").lower() for t in texts]
    joined = "\0\0" + "\0\0".join(lowered) + "\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    codes[~(_LETTER[np.minimum(codes, 65535)] | (codes > 65535))] = 0
    inside = codes != 0
    starts = inside[1:] & ~inside[:-1]
    word_at = np.cumsum(np.concatenate([[False], starts])) - 1
    ends = np.cumsum([2 + len(t) for t in lowered])  # places after which the next text begins
    first = np.concatenate([[0], word_at[np.minimum(ends, len(codes) - 1)] + 1])
    buckets, words = [], []
    rolled, clear = codes.astype(np.uint32), None
    for n in range(2, max(SIZES) + 1):
        rolled = rolled[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n == 2:
            continue
        middle = inside[n - 2 : len(inside) - 1]
        clear = middle if clear is None else clear[:-1] & middle
        if n in SIZES:
            at = np.flatnonzero(clear)
            mixed = (rolled[at] ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            buckets.append(mixed >> np.uint32(32 - BITS))
            words.append(word_at[at + 1])
    # The word as a whole is one more n-gram.
    begin = np.flatnonzero(starts) + 1
    if len(begin):
        place = np.arange(len(codes)) - begin[np.maximum(word_at, 0)]
        spread = (codes * _POWERS[np.clip(place, 0, len(_POWERS) - 1)]).astype(np.uint32)
        whole = np.add.reduceat(spread, begin, dtype=np.uint32)
        whole = (whole ^ (whole >> np.uint32(15))) * np.uint32(0x9E3779B1)
        buckets.append(whole >> np.uint32(32 - BITS))
        words.append(np.arange(len(begin)))
    bucket, word = np.concatenate(buckets), np.concatenate(words)
    return Grams(bucket, word, np.bincount(word, minlength=int(first[-1])), first)


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and their weights, which sum to one."""
    found = ngrams(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(found.first))
    if not len(found.bucket):
        return [(np.empty(0, np.uint32), np.empty(0, np.float32)) for _ in texts]
    size = np.diff(found.first)[text_of[found.word]]
    weight = 1 / (found.per_word[found.word] * size)
    keys, where = np.unique(text_of[found.word] << BITS | found.bucket, return_inverse=True)
    sums = np.bincount(where, weights=weight).astype(np.float32)
    cuts = np.searchsorted(keys >> BITS, np.arange(1, len(texts)))
    split = np.split((keys & (1 << BITS) - 1).astype(np.uint32), cuts)
    return list(zip(split, np.split(sums, cuts), strict=True))


def in_parts(function, texts: list[str | None], size: int = 100):
    """Results of a function of texts, made for a few of them at a time to save memory."""
    for start in range(0, len(texts), size):
        yield from function(texts[start : start + size])


def train(
    texts: list[str | None],
    labels: list[int],
    dimensions: int = 8,
    epochs: int = 5,
    batch: int = 128,
    rate: float = 0.3,
    seed: int = 3,
    least_rows: int = 5,
    least_steps: int = 1000,
) -> np.ndarray:
    """Joint training by Adagrad; returns a number per bucket, what it adds to the log odds
    of toxic. The classes count alike, whatever their shares. Buckets in fewer than
    ``least_rows`` texts are left out.""" 
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.int64)
    used = np.zeros(1 << BITS, np.int32)
    for bucket, _ in in_parts(bags, texts):
        used[bucket] += 1
    rows = [
        (b[k].astype(np.int32), w[k].astype(np.float16))
        for b, w in in_parts(bags, texts)
        for k in [used[b] >= least_rows]
    ]
    counts = np.bincount(y, minlength=2)
    importance = (len(y) / 2 / np.maximum(counts, 1))[y].astype(np.float32)
    vectors = rng.normal(0, 0.1, (1 << BITS, dimensions)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (dimensions, 2)).astype(np.float32)
    bias = np.array([LEAN, -LEAN], np.float32) / 2
    seen, seen_s, seen_b = np.full(1 << BITS, 1e-6, np.float32), np.float32(1e-6), np.full(2, 1e-6, np.float32)
    # A small sample is gone through more often, for as many steps.
    batch = min(batch, max(8, len(y) // 50))
    epochs = max(epochs, least_steps * batch // max(1, len(y)))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            chosen = order[start : start + batch]
            bucket = np.concatenate([rows[i][0] for i in chosen])
            weight = np.concatenate([rows[i][1] for i in chosen]).astype(np.float32)
            owner = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            bag = np.zeros((len(chosen), dimensions), np.float32)
            scaled = vectors[bucket] * weight[:, None]
            for d in range(dimensions):
                bag[:, d] = np.bincount(owner, weights=scaled[:, d], minlength=len(chosen))
            z = bag @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1
            p *= (importance[chosen] / len(chosen))[:, None]
            pull = (p @ softmax.T)[owner] * weight[:, None]
            hit, where = np.unique(bucket, return_inverse=True)
            step = np.stack([np.bincount(where, weights=pull[:, d]) for d in range(dimensions)], axis=1).astype(np.float32)
            seen[hit] += (step**2).mean(axis=1)
            vectors[hit] -= rate * step / np.sqrt(seen[hit])[:, None]
            step_s, step_b = bag.T @ p, p.sum(axis=0)
            seen_s += (step_s**2).mean()
            seen_b += step_b**2
            softmax -= rate * step_s / np.sqrt(seen_s)
            bias -= rate * step_b / np.sqrt(seen_b)
    lean = softmax[:, 1] - softmax[:, 0]
    return np.where(used >= least_rows, vectors @ lean, 0).astype(np.float32)


def passages(text: str) -> list[str]:
    words = text.split()
    count = max(1, round(len(words) / PASSAGE))
    cuts = [n * len(words) // count for n in range(count + 1)]
    return [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]


def word_numbers(numbers: np.ndarray, texts: list[str | None]) -> list[np.ndarray]:
    """The number of each word of each text, in order."""
    found = ngrams(texts)
    count = int(found.first[-1])
    sums = np.bincount(found.word, weights=numbers[found.bucket], minlength=count)
    return np.split(sums / np.maximum(found.per_word, 1), found.first[1:-1])


@dataclass
class Reading:
    """How windows of a width are scored. Words above the level count by all of their number
    or, if ``excess``, by what exceeds the level."""

    width: int
    level: float
    excess: bool
    slope: float
    shift: float

    def mean(self, words: np.ndarray) -> float:
        """The greatest mean of a window, or of the whole if that is no longer."""
        if not len(words):
            return 0.0
        size = np.abs(words)
        counted = np.where(size > self.level, words - np.sign(words) * self.level * self.excess, 0)
        if len(words) <= self.width:
            return float(counted.sum() / len(words))
        sums = np.concatenate([[0.0], np.cumsum(counted)])
        return float((sums[self.width :] - sums[: -self.width]).max() / self.width)

    def log_odds(self, words: np.ndarray) -> float:
        return self.slope * self.mean(words) + self.shift


@dataclass
class Model:
    numbers: np.ndarray
    readings: list[Reading]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        words = in_parts(lambda some: word_numbers(self.numbers, some), texts)
        odds = np.array([max(r.log_odds(w) for r in self.readings) for w in words])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def constant(score: float) -> Model:
    return Model(np.zeros(1 << BITS, np.float32), [Reading(WHOLE, 0.0, False, 0.0, 60.0 * score - 30.0)])


def calibrated(numbers: np.ndarray, texts: list[str], labels: list[int]) -> Model:
    """For each width the level, and way to count, under which the labels are likeliest, with
    logistic slope and shift."""
    y = np.asarray(labels, dtype=np.float64)
    words = list(in_parts(lambda some: word_numbers(numbers, some), texts))
    every = np.abs(np.concatenate(words)) if words else np.zeros(1)
    levels = np.quantile(every, LEVELS)
    return Model(numbers, [best_reading(width, levels, words, y) for width in (*WINDOWS, WHOLE)])


def best_reading(width: int, levels: np.ndarray, words: list[np.ndarray], y: np.ndarray) -> Reading:
    best = None
    for level, excess in ((float(at), how) for at in levels for how in (True, False)):
        reading = Reading(width, level, excess, 0.0, 0.0)
        x = np.array([reading.mean(w) for w in words])
        unit = x.std() or 1.0
        design = np.stack([x / unit, np.ones_like(x)], axis=1)
        fit = np.zeros(2)
        for _ in range(40):  # Newton, with a slight pull to zero that keeps it finite
            p = 1 / (1 + np.exp(-np.clip(design @ fit, -30, 30)))
            slope = design.T @ (y - p) - 0.01 * fit
            curve = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
            fit += np.clip(np.linalg.solve(curve, slope), -2, 2)
        p = np.clip(1 / (1 + np.exp(-np.clip(design @ fit, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
        if best is None or loss < best[0]:
            best = loss, Reading(width, level, excess, float(fit[0] / unit), float(fit[1]))
    return best[1]


def fit(rows: list[tuple[str, int]]) -> Model:
    """``rows``: texts and labels. Every fourth row is kept from training, to calibrate."""
    classes = {label for _, label in rows}
    if len(classes) < 2:
        return constant(float(classes == {1}))
    with np.errstate(over="ignore"):
        train_rows = [row for n, row in enumerate(rows) if n % 4] or rows
        held = rows[::4] if len({label for _, label in rows[::4]}) == 2 else rows
        cut = [(p, label) for text, label in train_rows for p in passages(text)]
        numbers = train([p for p, _ in cut], [label for _, label in cut])
        return calibrated(numbers, [t for t, _ in held], [label for _, label in held])


def bounded(text: Column) -> Column:
    """At most ``SAMPLE_CHARS`` characters of a text: pieces spread evenly over a longer one."""
    size = SAMPLE_CHARS // PIECES - 1
    step = (F.length(text) - size) / (PIECES - 1)
    pieces = [F.substr(text, (F.lit(n) * step).cast("int") + 1, F.lit(size)) for n in range(PIECES)]
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.concat_ws(" ", *pieces))


def sample_rows(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str) -> DataFrame:
    """Columns text (pieces of long ones), toxic, and place and id, by which they are to be
    ordered, of at most ``SAMPLE_ROWS`` rows: the first of each class by a hash of the id,
    among those ids that have a text and for which ``usable`` holds."""
    known = labels.filter(usable & F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(F.length("__text") > 0)
    known = known.withColumnRenamed(id_col, "__id").join(texts.select("__id"), "__id", "left_semi")
    known = known.withColumn("__place", F.xxhash64("__id"))
    chosen = None
    for label, most in enumerate(SAMPLE_ROWS):
        some = known.filter(F.col("toxic") == label).orderBy("__place", "__id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    # Of a bounded number of rows, whatever the input.
    rows = texts.withColumn("__text", bounded(F.col("__text"))).join(F.broadcast(chosen), "__id")
    rows = rows.groupBy("__id", "toxic", "__place").agg(F.max("__text").alias("__text"))
    return rows.selectExpr("__text AS text", "toxic", "__place AS place", "__id AS id")


def sample(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str, text_col: str) -> list[tuple[str, int]]:
    """The sample's texts and labels, in order, for a look at it."""
    rows = sample_rows(docs, labels, usable, id_col, text_col).collect()
    return [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["place"], r["id"]))]


def _learnt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model of all rows of the task, which is the only one: buckets in use, their
    numbers, and the readings."""
    rows = [row for batch in batches for row in batch.itertuples(index=False)]
    rows.sort(key=lambda r: (r.place, r.id))
    model = fit([(r.text, int(r.toxic)) for r in rows])
    used = np.flatnonzero(model.numbers)
    made = pickle.dumps((used.astype(np.int32), model.numbers[used], model.readings))
    yield pd.DataFrame({"model": [made]})


def toxicity(
    docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs``, and score and predicted (1 from ``threshold`` on), which
    replace columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # as large as the buckets

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with np.errstate(over="ignore"):
            for batch in batches:
                yield pd.Series(sent.value.scores(batch.tolist()))

    return short_batches(docs).withColumn("score", score(text_col)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits in a task, on the bounded sample; only the model, at most a number per bucket,
    comes to the driver."""
    usable = ~F.coalesce(held_out(id_col), F.lit(True))
    rows = short_batches(sample_rows(docs, labels, usable, id_col, text_col)).repartition(1)
    made = rows.mapInPandas(_learnt, "model binary").first()
    if made is None:  # no task has run
        return fit([])
    used, numbers, readings = pickle.loads(bytes(made["model"]))
    out = np.zeros(1 << BITS, np.float32)
    out[used] = numbers
    return Model(out, readings)
