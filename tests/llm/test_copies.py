"""Fingerprints, mixing, near-duplicates and near vectors against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from data import LONG, ODD_TEXTS, documents
from receiptlake.llm import components, embeddings, fingerprints, minhash, mixing
from receiptlake.llm.common import table


@pytest.fixture(autouse=True)
def wrapping_hashes():
    with np.errstate(over="ignore"):
        yield


class Sets:
    def __init__(self, ids):
        self.parent = {i: i for i in ids}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def slow_fingerprint(text):
    """Every numbered k-mer against every slot."""
    if not text:
        return ""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    hashes, position = fingerprints.numbered_kmers(codes)
    out = []
    for factor in fingerprints._FACTORS:
        first = np.argsort(hashes * factor, kind="stable")[: fingerprints.LENGTH]
        first = first[np.argsort(position[first])]
        value = np.zeros(1, dtype=np.uint64)
        for n in first:
            value = fingerprints._mix(value * np.uint64(0x9E3779B97F4A7C15) + hashes[n])
        out.append(f"{int(value[0] >> np.uint64(48)):04x}")
    return "".join(out)


def test_fingerprints(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()} == prints
    got = {r.doc_id: r for r in fingerprints.edit_test(docs).collect()}
    order = sorted(texts)
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        half = len(texts[i]) // 2
        changed = texts[i][: len(texts[i]) - half] + texts[following][:half]
        r = got[i]
        assert r.n_chars == len(texts[i])
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (prints[i], slow_fingerprint(changed))
        assert r.near_edited == fingerprints.likeness(prints[i], slow_fingerprint(changed))
        assert r.near_next == fingerprints.likeness(prints[i], prints[following])
    near = np.mean([r.near_edited for r in got.values()])
    assert near > 0.08 > 0.02 > np.mean([r.near_next for r in got.values()])


def test_likeness_falls_with_edits_and_with_moved_passages():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(600)]
    text = " ".join(words)

    def after(share):
        changed = [w if rng.random() > share else w[::-1] + "x" for w in words]
        return fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(" ".join(changed)))

    close, far = np.mean([after(0.02) for _ in range(5)]), np.mean([after(0.4) for _ in range(5)])
    assert close > 0.6 > 0.3 > far
    moved = " ".join(words[300:] + words[:300])
    assert fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(moved)) < 0.7


def ideal_likeness(a, b, slots=4000):
    """The share of orders, each from a hash of its own, that agree on two texts."""
    both = []
    for text in (a, b):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        hashes, position = fingerprints.numbered_kmers(codes)
        salts = np.random.default_rng(3).integers(0, 2**63, slots, dtype=np.uint64)
        order = np.argsort(fingerprints._mix(hashes ^ salts[:, None]), axis=1)[:, :2]
        order = np.take_along_axis(order, np.argsort(position[order], axis=1), axis=1)
        both.append(hashes[order])
    return (both[0] == both[1]).all(axis=1).mean()


@pytest.mark.parametrize("length", [15, 25, 42, 80])
def test_orders_are_independent_on_short_texts(length):
    rng = random.Random(length)
    off = []
    for _ in range(300):
        text = "".join(rng.choice("abcdefghij ") for _ in range(length))
        cut = rng.randrange(length // 3)
        changed = text[:cut] + "#" + text[cut + 1 :]
        share = ideal_likeness(text, changed)
        got = fingerprints.likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(changed))
        if 0 < share < 1:
            off.append((got - share) / np.sqrt(share * (1 - share) / fingerprints.SLOTS))
    assert len(off) > 250
    assert abs(np.mean(off)) < 0.25  # no bias
    assert 0.85 < np.std(off) < 1.15  # the spread of that many independent slots


def edit_test_of_lists(rows):
    """(id, text) of rows whose ids are all set, in order of id, hash and text."""
    out = []
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        changed = fingerprints.edited(text, following)
        own, other, third = map(slow_fingerprint, (text, changed, following))
        near = fingerprints.likeness(own, other), fingerprints.likeness(own, third)
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, *near))
    return out


@pytest.mark.parametrize("ranges", ["1", "2", "8"])
def test_a_hot_id_is_split(spark, ranges):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefg ") for _ in range(40)) for _ in range(300)]
    rows = [(None if n % 3 == 0 else 7 if n % 3 == 1 else n, t) for n, t in enumerate(texts)]
    rows += [(7, texts[1])] * 40 + [(7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = docs.select("doc_id", "text").orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    want = edit_test_of_lists([(r.doc_id, r.text) for r in order.collect()])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        out = fingerprints.edit_test(docs)
        got = [tuple(r) for r in out.collect()]
        spread = [r[1] for r in out.filter("doc_id = 7").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    if ranges == "8":  # 141 rows, of them 41 copies of one text
        assert len(spread) >= 3 and max(spread) <= 41 + 50


def test_odd_fingerprints(spark):
    ids = [None, None, *range(2, len(ODD_TEXTS) - 1), 2]
    got = fingerprints.edit_test(documents(spark, ODD_TEXTS, ids=ids)).collect()
    assert len(got) == len(ODD_TEXTS)
    by_text = {}
    for r in got:
        assert by_text.setdefault((r.n_chars, r.fingerprint), r.fingerprint) == r.fingerprint
        assert (r.fingerprint == "") == (r.n_chars == 0)
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for t in ODD_TEXTS)
    [only] = fingerprints.edit_test(documents(spark, ["abc"])).collect()
    assert only.near_next == 1.0
    assert fingerprints.edit_test(documents(spark, [])).count() == 0


def mixed_by_duckdb(rows):
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    return sorted(map(repr, duckdb.sql(mixing.ORACLE_SQL).fetchall()))


@pytest.mark.parametrize("most", [mixing.BROADCAST_SOURCES, 0])
def test_mixing(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    docs = table(spark, sf_dir, "documents")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(map(repr, c.sql(mixing.ORACLE_SQL).fetchall()))
    assert sorted(map(repr, map(tuple, mixing.mix(docs).collect()))) == want


def test_mixing_reaches_the_weights(spark):
    docs = spark.range(40_000).selectExpr(
        "id AS doc_id", "'t' AS text", "CASE WHEN id < 30000 THEN 'a' WHEN id < 39990 THEN 'b' END AS source", "10 AS n_chars"
    )
    counts = dict(mixing.mix(docs, weights={"a": 1, "b": 3}).groupBy("source").count().collect())
    assert None not in counts and abs(counts["a"] / 10_000 - 1) < 0.05 and abs(counts["b"] / 30_000 - 1) < 0.05
    # A rate of hundreds is made of several draws.
    many = mixing.mix(docs.filter("doc_id >= 39980"), weights={"b": 1}, epochs=100).filter("source = 'b'")
    assert abs(many.count() / 2000 - 1) < 0.1
    per = mixing.mix(docs, weights={"a": 1, "b": 1}).filter("copy = 1").groupBy("source", "n_copies").count()
    got = {r.n_copies: r["count"] for r in per.filter("source = 'a'").collect()}
    rate = 20_000 / 30_000
    for n in (1, 2, 3):
        want = 30_000 * np.exp(-rate) * rate**n / np.prod(range(1, n + 1))
        assert abs(got[n] / want - 1) < 0.15
    copies = mixing.mix(docs, weights={"b": 1}).select("doc_id", "copy", "n_copies").collect()
    assert len({(r.doc_id, r.copy) for r in copies}) == len(copies) and all(r.copy <= r.n_copies for r in copies)
    first = [r.doc_id for r in mixing.mix(docs).limit(200).collect()]
    assert first != sorted(first)


@pytest.mark.parametrize("most", [mixing.BROADCAST_ROWS, 0])
def test_rows_without_an_id_draw_each_for_itself(spark, tmp_path, monkeypatch, most):
    """10,000 rows of no or the same id, equal ones among them, reach the weights and spread."""
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
    monkeypatch.setattr(mixing, "CHUNK", 700)
    docs = spark.range(20_000).selectExpr(
        "IF(id < 10000, NULL, 7) AS doc_id", "IF(id % 2 = 0, 't', string(id)) AS text", "'en' AS lang",
        "IF(id < 10000, 'a', 'b') AS source", "10L AS n_chars",
    )
    mixed = mixing.mix(docs, weights={"a": 1, "b": 3}).cache()
    counts = dict(mixed.groupBy("source").count().collect())
    assert abs(counts["a"] / 5_000 - 1) < 0.05 and abs(counts["b"] / 15_000 - 1) < 0.05
    placed = mixed.groupBy("source", F.spark_partition_id().alias("part")).count().collect()
    assert len(placed) == 16 and max(r["count"] for r in placed) < 2 * min(r["count"] for r in placed if r.source == "b")
    per = {r.n_copies: r["count"] for r in mixed.filter("copy = 1 AND source = 'b' AND text = 't'").groupBy("n_copies").count().collect()}
    assert len(per) > 3  # equal rows draw different numbers
    docs.filter("hash(text, doc_id) % 40 = 0 OR text = 't'").write.parquet(f"{tmp_path}/part")
    columns = ["doc_id", "text", "lang", "source", "n_chars", "n_copies", "copy"]
    mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/part")).select(columns)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/part/*.parquet'")
    want = c.sql(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, mixed.collect()))) == sorted(map(repr, want))


def test_odd_columns_in_mixing(spark):
    docs = spark.sql(
        "SELECT 1L AS doc_id, 's' AS source, 1L AS n_chars, map('a', 1) AS m, array(1, NULL) AS l, binary('x') AS b, "
        "parse_json('[1]') AS v, 9 AS copy, named_struct('x', 1) AS `a b` FROM range(30)"
    )
    got = mixing.mix(docs, epochs=4)
    assert got.count() > 60 and {"m", "v", "a b", "copy", "n_copies"} <= set(got.columns)


def test_odd_mixing(spark):
    docs = documents(spark)
    got = mixing.mix(docs, epochs=3)
    rows = got.collect()
    assert got.columns == [*docs.columns] and rows and all(1 <= r.copy <= r.n_copies for r in rows)
    assert mixing.mix(documents(spark, [])).count() == 0
    nothing = spark.createDataFrame([(None, None, None)] * 3, "doc_id long, source string, n_chars long")
    assert mixing.mix(nothing).count() in range(40)


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def groups_of(texts):
    bags, by = {i: bag(t) for i, t in texts.items()}, {}
    for i, b in bags.items():
        for g in b:
            by.setdefault(g, []).append(i)
    sets, links, seen = Sets(texts), 0, set()
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    common = sum((bags[a] & bags[b]).values())
                    whole = sum(bags[a].values()) + sum(bags[b].values()) - common
                    if common >= 0.8 * whole:
                        links += 1
                        sets.join(a, b)
    return {i: sets.find(i) for i in texts}, links


def near_copies(seed, copies, words=120, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("block", [minhash.BLOCK, 8])
def test_near_duplicates(spark, monkeypatch, block):
    """Groups of near copies whose members are not all linked to each other, short texts,
    repeated passages; with groups cut into many blocks as well."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = [t for n in range(4) for t in near_copies(n, 40)]
    texts += near_copies(9, 12, words=8, edits=1) + near_copies(10, 30, words=60, edits=6)
    shared = " ".join(near_copies(11, 1, words=70))
    texts += [shared + " " + t for t in near_copies(12, 5, words=200)]
    texts += [shared.upper(), shared.replace(" ", "  "), "one two", "one two", "ONE  two", "", " ", None, ""]
    texts += ["a " * 5000, "a " * 5100, "a " * 9000, LONG]
    docs = documents(spark, texts)
    want, links = groups_of(dict(enumerate(texts)))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert links > 500 and {i: r.group_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.group_id) for i, r in got.items())
    kept = minhash.deduplicated(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == docs.columns


def test_near_duplicates_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want, links = groups_of({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(docs).collect()}
    assert links and got == want


def test_repeated_rows_and_ids(spark):
    texts = ["a b c d e f g", "a b c d e f g", "a b c d e f g", "q r s t u v w", None]
    docs = documents(spark, texts, ids=[1, 1, 2, 1, 3])
    rows = sorted((r.doc_id, r.text) for r in minhash.deduplicated(docs).collect() if r.text)
    assert len(rows) == 2 and {t for _, t in rows} == {texts[0], texts[3]}
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    assert minhash.deduplicated(documents(spark, ["x y z", None, ""])).count() == 3


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(150):
        names = rng.integers(1, 2**63, 30, dtype=np.uint64)
        a = rng.integers(1, 40, 30)
        b = np.maximum(1, a + rng.integers(-6, 7, 30))
        truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        off.append((minhash.signature(names, a) == minhash.signature(names, b)).mean() - truth)
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.06


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1300)]
    links += [(n, n + 1) for n in range(10_000, 10_200)] + [(5000, 5000), (20_000, 19_999), (20_000, 19_999)]
    sets = Sets({x for pair in links for x in pair})
    for a, b in links:
        sets.join(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: sets.find(i) for i in sets.parent if i != 5000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted_vectors(seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, 32))
    near = [base[n % 30] + rng.normal(size=32) * s for n, s in enumerate(rng.uniform(0, 0.6, 400))]
    hot = [base[0] + rng.normal(size=32) * 0.1 for _ in range(120)]
    return np.concatenate([base, near, hot, base[:5], 3 * base[5:8]])


@pytest.mark.parametrize("block", [embeddings.BLOCK, 16])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    x = planted_vectors()
    rows = [(n, v.tolist(), 1) for n, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    sets = Sets(range(len(x)))
    for a, b in zip(*np.nonzero(near), strict=True):
        sets.join(int(a), int(b))
    assert near.sum() > 10_000
    assert sum(r.n_links for r in got.values()) >= 0.99 * near.sum()
    assert all(r.n_links <= near[i].sum() for i, r in got.items())
    right = [got[i].component_id == sets.find(i) and got[i].n_links == near[i].sum() for i in got]
    assert np.mean(right) > 0.98 and all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_vectors_by_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = sorted(map(tuple, embeddings.near_vectors(table(spark, sf_dir, "embeddings")).collect()))
    assert got == sorted(c.sql(embeddings.ORACLE_SQL).fetchall())


@pytest.mark.parametrize("dimension", [16, 32, 64])
@pytest.mark.parametrize("vectors", [500, 10_000, 50_000, 1_000_000, 10_000_000])
def test_recall_at_the_threshold(vectors, dimension):
    """Pairs that the plan was not made on; filters above one threshold, none left out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(800, dimension))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    words, threshold = embeddings.plan(dimension, vectors)
    a = embeddings.passed(x, words, threshold)
    b = embeddings.passed(0.9 * x + np.sqrt(1 - 0.81) * y, words, threshold)
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]) >= 0.95


def test_every_filter_above_the_threshold_is_passed():
    rng = np.random.default_rng(4)
    for dimension in (1, 2, 5, 16):
        x = rng.normal(size=(20, dimension))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = embeddings.halves(x, 32)
        for threshold in (0.1, 0.5, 0.9):
            want = [{(dimension << 32) + 32 * i + j for i, j in np.argwhere(p[:, None] + q >= threshold)} for p, q in zip(a, b)]
            assert [set(v.tolist()) for v in embeddings.passed(x, 32, threshold)] == want


def test_odd_vectors(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]),
        (7, [1.0, 0.1]), (6, [1.0, 0.0]), (9, [1.0]), (10, [2.0]), (None, [1e-200, 0.0]), (12, [1e200, 1e199]),
        (13, [float("inf"), 1.0]), (14, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, embeddings.near_vectors(df).collect()))
    alone = {(i, 0, i, True): 1 for i in (1, 2, 3, 4, 5, 13, 14)}
    assert got == Counter(
        {**alone, (6, 4, 6, True): 2, (7, 4, 6, False): 1, (12, 4, 6, False): 1, (None, 4, 6, True): 1,
         (9, 1, 9, True): 1, (10, 1, 9, False): 1}
    )
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    floats = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert embeddings.near_vectors(floats).count() == len(rows)
