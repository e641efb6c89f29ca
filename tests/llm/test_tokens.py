"""Token counts and BPE against the libraries themselves."""

import hashlib
import random
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest

from data import ODD_TEXTS, documents
from receiptlake.llm import bpe, token_counts
from receiptlake.llm.common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark, sf_small):
    return [r.text for r in table(spark, sf_small, "documents").collect()] + ODD_TEXTS


@pytest.fixture(scope="module")
def pieces():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


def test_counts(spark, texts, pieces):
    got = token_counts.token_counts(documents(spark, texts)).collect()
    for r in got:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(pieces.encode(text))), text[:50]
        assert r.over_limit == (r.n_tokens > 4096)
    assert len(got) == len(texts)


def test_every_string_proved_whole_is_one_token(pieces):
    counter = token_counts.PieceCounter(PIECES)
    assert counter.splits and len(counter.whole) > 10_000
    whole = [w for w in counter.whole if w]
    assert all(len(ids) == 1 for ids in pieces.encode(whole))


def test_forgetting_changes_nothing(texts):
    few = token_counts.PieceCounter(PIECES, remember=0)
    some = [t or "" for t in texts[:100]]
    assert [few.count([t])[0] for t in some] == token_counts.PieceCounter(PIECES).count(some)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_round_trip(spark, texts, library):
    got = bpe.round_trip(documents(spark, texts)).collect()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(np.asarray(ids, dtype="<u4").tobytes())
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())
    assert len(got) == len(texts)


def test_decoding_alone(spark, texts):
    encoded = bpe.encode_documents(documents(spark, texts[-20:]))
    for r in bpe.decode_ids(encoded).collect():
        assert r.decoded == (texts[-20:][r.doc_id] or "")


def test_chunks_are_shared_and_cut_by_content():
    text = " ".join(f"word{n * n % 977}" for n in range(4000))
    ends = bpe.chunk_ends(text)
    shifted = bpe.chunk_ends("some words in front " + text)
    assert len(ends) > 3 and set(e + 20 for e in ends[1:]) <= set(shifted)
    coder = bpe.ChunkCoder(BYTES)
    coder.encode(text)
    known = len(coder.chunks)
    coder.encode("some words in front " + text)
    assert len(coder.chunks) <= known + 2


def test_shared_passages_are_reused_and_joins_compared(library, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu'é1.") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    passages = [rng.choice([" ", "  ", " ("]).join(rng.choices(words, k=3000)) for _ in range(5)]
    own = lambda: " ".join(rng.choices(words, k=300))
    texts = [own() + rng.choice(["", " ", "\n\n"]) + rng.choice(passages) + own() for _ in range(40)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for remember in (6000, 3, 0):
        coder = bpe.ChunkCoder(BYTES, remember)
        assert [coder.encode(t).tolist() for t in texts] == want
        assert len(coder.chunks) <= remember
        if remember == 6000:
            assert coder.reused > 0.5 * coder.seen
    # A chunk whose words have other ids than in the join is not used.
    coder = bpe.ChunkCoder(BYTES)
    honest = coder.words

    def wrong(text):
        made = honest(text)
        return made and replace(made, lead=(made.lead[0], made.lead[1] + made.lead[1][:1]))

    monkeypatch.setattr(coder, "words", wrong)
    assert [coder.encode(t).tolist() for t in texts] == want


def test_settled_characters_are_split_alike(library):
    """The two libraries agree on every character that the faster one is trusted with."""
    coder = bpe.ChunkCoder(BYTES)
    assert coder.fast is not None
    settled = [chr(c) for c in range(0x2100) if bpe._SETTLED.fullmatch(chr(c))]
    assert len(settled) > 700
    for c in settled:
        text = f"a{c}b {c}{c} c1{c} {c}'s  {c}\n{c}"
        assert coder.fast.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids


def test_empty(spark):
    empty = documents(spark, [])
    assert token_counts.token_counts(empty).count() == 0 == bpe.round_trip(empty).count()
