"""Licences, toxicity scores and added secrets against plain versions, one text at a time."""

import math
import random
import re

import numpy as np
import pytest

from data import ODD_TEXTS, documents
from receiptlake.llm import licenses, secret_scan, toxicity
from receiptlake.llm.common import table

NULL_IDS = [None, None, None]


def slow_licences(text):
    """(paragraph, family, probability, similarity) of one text."""
    fit = licenses.model()
    specific, out = set(fit.specific), []
    joined = re.sub(r"(?<![.!?:;\n])\n(?=[a-z(])", " ", text or "")
    for place, line in enumerate(joined.split("\n")):
        tokens = licenses.words(line)
        if not specific & set(tokens):
            continue
        grams = {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}
        z = [float(b) for b in fit.bias]
        for gram in grams & set(fit.vocabulary):
            for k in range(len(z)):
                z[k] += float(fit.w[fit.vocabulary[gram]][k])
        top = max(range(len(z)), key=lambda k: z[k])
        probability = 1 / sum(math.exp(v - z[top]) for v in z)
        if fit.families[top] == "unknown" or probability < fit.threshold:
            continue
        close = 0.0
        for template in licenses.TEMPLATES[fit.families[top]]:
            words = licenses.words(template)
            own = {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}
            if own:
                common = len(own & grams)
                close = max(close, common / len(own), common / max(len(tokens) - 2, 3))  # short excerpts count less
        out.append((place, fit.families[top], probability, close))
    return out


def licence_texts():
    rng = random.Random(8)
    templates = [t for texts in licenses.TEMPLATES.values() for t in texts]
    out = []
    for n in range(150):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice([*templates, *licenses.UNKNOWN]).split()
            start = rng.randrange(max(1, len(words) // 2))
            words = [w for w in words[start : start + rng.randrange(4, 60)] if rng.random() > 0.15]
            if rng.random() < 0.3:
                rng.shuffle(words)
            lines.append(" ".join(words))
        out.append(rng.choice(["\n", "\n\n", " "]).join(lines))
    return out


def test_licences_equal_the_plain_version(spark, sf_dir):
    texts = [*licence_texts(), *ODD_TEXTS]
    texts += [r.text for r in table(spark, sf_dir, "documents").filter("text LIKE '%icense%'").limit(300).collect()]
    rows = documents(spark, texts)
    got = {}
    for r in licenses.licence_paragraphs(rows).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.probability, r.similarity, r.confirmed))
    named = 0
    for i, text in enumerate(texts):
        want = slow_licences(text)
        named += len(want)
        own = sorted(got.get(i, []))
        assert [r[:2] for r in own] == [r[:2] for r in want]
        assert [r[2] for r in own] == pytest.approx([r[2] for r in want], rel=1e-9)
        assert [r[3] for r in own] == pytest.approx([r[3] for r in want], rel=1e-12)
        assert [r[4] for r in own] == [r[3] >= 0.5 for r in want]
    assert named > 100
    confirmed = {r.doc_id: (r.n_named, r.paragraphs) for r in licenses.licences(rows).collect()}
    for i, text in enumerate(texts):
        want = slow_licences(text)
        assert confirmed[i] == (len(want), ",".join(f"{p}:{f}" for p, f, _, s in want if s >= 0.5))


def test_licences_of_rows_without_an_id(spark):
    texts = [t for texts in licenses.TEMPLATES.values() for t in texts][:2]
    rows = documents(spark, [*texts, "no licence here"], ids=NULL_IDS)
    got = sorted((r.doc_id, r.n_confirmed) for r in licenses.licences(rows).collect())
    assert got == [(None, 0), (None, 1), (None, 1)]


M32 = 2**32


def slow_words(text):
    """The buckets of each word of a text."""
    words, word = [], ""
    for c in [*(text or "").lower(), "\0"]:
        if ord(c) > 65535 or c.isalnum():
            word += c
        elif word:
            words.append(word)
            word = ""
    out = []
    for word in words:
        codes = [0, *map(ord, word), 0]
        buckets = []
        for n in toxicity.SIZES:
            for i in range(len(codes) - n + 1):
                value = 0
                for code in codes[i : i + n]:
                    value = (value * 0x01000193 + code) % M32
                value = (value ^ n) * 0x9E3779B1 % M32
                value = (value ^ value >> 15) * 0x85EBCA77 % M32
                buckets.append(value >> 32 - toxicity.BITS)
        value = 0
        for place, code in enumerate(codes[1:-1]):
            value += code * pow(0x01000193, min(place, 255) + 1, M32)
        value %= M32
        value = (value ^ value >> 15) * 0x9E3779B1 % M32
        buckets.append(value >> 32 - toxicity.BITS)
        out.append(buckets)
    return out


def slow_score(text, model):
    numbers = [sum(float(model.numbers[b]) for b in word) / len(word) for word in slow_words(text)]
    odds = []
    for r in model.readings:
        counted = []
        for v in numbers:
            beyond = v - math.copysign(r.level, v) if r.excess else v
            counted.append(beyond if abs(v) > r.level else 0.0)
        width = min(r.width, len(numbers))
        means = [sum(counted[i : i + width]) / width for i in range(len(counted) - width + 1)] if numbers else [0.0]
        odds.append(r.slope * max(means) + r.shift)
    return 1 / (1 + math.exp(-min(30, max(-30, max(odds)))))


def toxic_texts():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgäß日😀1") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    texts = [rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randrange(400))) for _ in range(40)]
    return [*texts, *(t and t[:3000] for t in ODD_TEXTS), "y" * 300 + "z", "A1-b2_c3", words[0]]


def some_model():
    rng = np.random.default_rng(4)
    numbers = rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32)
    readings = [
        toxicity.Reading(w, level, excess, 2.0 + n, -1.0 - n / 4)
        for n, (w, level, excess) in enumerate(
            [(15, 0.3, True), (30, 0.2, False), (60, 0.0, True), (120, 0.1, True), (toxicity.WHOLE, 0.0, False)]
        )
    ]
    return toxicity.Model(numbers, readings)


def test_bags_equal_the_plain_version():
    with np.errstate(over="ignore"):
        got = toxicity.bags(toxic_texts())
    for text, (buckets, weights) in zip(toxic_texts(), got, strict=True):
        words, want = slow_words(text), {}
        for word in words:
            for b in word:
                want[b] = want.get(b, 0) + 1 / len(word) / len(words)
        assert dict(zip(buckets.tolist(), weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)


def test_toxicity_scores_equal_the_plain_version(spark):
    texts, model = toxic_texts(), some_model()
    rows = documents(spark, texts)
    got = {r.doc_id: r for r in toxicity.toxicity(rows, model).collect()}
    for i, text in enumerate(texts):
        want = slow_score(text, model)
        assert got[i].score == pytest.approx(want, rel=1e-4)
        if abs(want - 0.7) > 1e-3:
            assert got[i].predicted == int(want >= 0.7)
    twice = toxicity.toxicity(documents(spark, texts[:3], ids=NULL_IDS), model).collect()
    assert sorted(r.score for r in twice) == sorted(got[i].score for i in range(3))


def exp(x):
    return math.exp(min(x, 700))


def normal(z):
    z = abs(z)
    return 2 / (1 + exp(1.5976 * z + 0.07056 * z**3))


def battery(key):
    """The combined p-value of the three tests, and ln of the inverse of the e-value."""
    key = re.sub("=+$", "", key.translate(str.maketrans("-_", "+/")))
    alphabet = next(a for p, a in secret_scan.ENCODINGS if re.search(p, key))
    size, n = len(alphabet), len(key)
    x = [alphabet.index(c) for c in key]
    mean = sum(x) / n
    parts = [0] * 8
    for v in x:
        parts[v * 8 // size] += 1
    chi = 0
    for b in range(8):
        expected = n * (math.ceil((b + 1) * size / 8) - math.ceil(b * size / 8)) / size
        chi += (parts[b] - expected) ** 2 / expected
    deviation = ((chi / 7) ** (1 / 3) - (1 - 2 / 63)) / math.sqrt(2 / 63)
    uniform = 1 / (1 + exp(1.5976 * deviation + 0.07056 * deviation**3))
    side = [v < size / 2 for v in x]
    runs = 1 + sum(a != b for a, b in zip(side, side[1:]))
    low = sum(side)
    expected = 2 * low * (n - low) / n + 1
    spread = max((expected - 1) * (expected - 2) / (n - 1), 1e-9)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:]))
    serial /= max(sum((v - mean) ** 2 for v in x), 1e-9)
    p = uniform, normal((runs - expected) / math.sqrt(spread)), normal(serial * math.sqrt(n))
    fisher = -sum(math.log(max(v, 1e-12)) for v in p)
    kinds = ["0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "+" for c in key]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    letters = {"0": 10, "a": 26, "A": 26, "+": 2}
    text = (n - 1 - changes) * math.log(0.9) + changes * math.log(0.1 / 3) - math.log(4)
    text -= sum(math.log(letters[k]) for k in kinds)
    return exp(-fisher) * (1 + fisher + fisher**2 / 2), text + n * math.log(size)


def slow_spans(text, q=0.01, alpha=0.001):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    for kind, pattern in (1, r"AKIA[A-Z0-9]+"), (2, r"[0-9a-f]+"):
        least = 18 if kind == 1 else 16
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    free = [
        m
        for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", text)
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])
        and not any(s < m.end() and m.start() < e for s, _, e in base)
    ]
    tested = [(*battery(m[0]), m) for m in free]
    passed = [(log_p, m) for p, log_p, m in tested if p >= alpha and log_p < 0]
    ranked = sorted(p for p, _ in passed)
    bounds = [p for r, p in enumerate(ranked, 1) if p <= math.log(r * q / len(free))]
    added = [(m.start(), 3, m.end()) for p, m in passed if bounds and p <= bounds[-1]]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + added)), len(added)


_ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)


def secret_texts():
    rng = random.Random(10)
    alphabets = [a for _, a in secret_scan.ENCODINGS] + ["abcde1", "aB3", "0123456789abcdef"]
    out = []
    for n in range(150):
        parts = []
        for _ in range(rng.randrange(1, 14)):
            key = "".join(rng.choices(rng.choice(alphabets), k=rng.randrange(12, 70)))
            if rng.random() < 0.3:  # of words
                key = rng.choice("-_/").join(rng.choices(["alpha", "Beta", "v2", "2024", "main", "x"], k=7))
            parts.append(rng.choice(["", "token: ", "see ", "a=", "日本 "]) + key + rng.choice(["", "=", "==", "."]))
        out.append(rng.choice([" ", "\n", ", "]).join(parts))
    return out


def test_added_secrets_equal_the_plain_version(spark, sf_dir):
    texts = [*secret_texts(), *ODD_TEXTS]
    texts += [r.text for r in table(spark, sf_dir, "documents").limit(1000).collect()]
    got = {r.doc_id: (r.spans, r.n_random) for r in secret_scan.secret_spans(documents(spark, texts)).collect()}
    want = {i: slow_spans(t) for i, t in enumerate(texts)}
    assert got == want
    added = sum(n for _, n in want.values())
    candidates = sum(len(re.findall(secret_scan.CANDIDATE, t or "")) for t in texts)
    assert 100 < added < 0.9 * candidates


def test_secrets_of_rows_without_an_id_and_of_no_rows(spark):
    texts = secret_texts()[:3]
    got = secret_scan.secret_spans(documents(spark, texts, ids=NULL_IDS)).collect()
    assert sorted(r.spans for r in got) == sorted(slow_spans(t)[0] for t in texts)
    assert secret_scan.secret_spans(documents(spark, [])).count() == 0
    assert secret_scan.redact(documents(spark, [])).count() == 0
