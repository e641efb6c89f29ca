"""Packing: every id once, no padding, order along the curve."""

import itertools

import numpy as np
import public_tokenizers
import pytest
from data import documents
from tokenizers import Tokenizer

from receiptlake.llm import packing
from receiptlake.llm.common import table


@pytest.fixture(scope="module")
def library():
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.no_padding()
    one.no_truncation()
    return one


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, packing.END]


def held(pieces, want, length=packing.LENGTH):
    """Pieces against ids by document, for documents with different ids."""
    by_document, by_sequence = {}, {}
    for p in pieces:
        by_document.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_document.keys() == want.keys()
    for doc, own in by_document.items():
        own.sort(key=lambda p: p.start)
        ids = [np.frombuffer(p.ids, "<u4").tolist() for p in own]
        assert sum(ids, []) == want[doc]
        assert [p.start for p in own] == [0, *itertools.accumulate(map(len, ids))][:-1]
        assert all(p.length == len(i) and p.doc_tokens == len(want[doc]) for p, i in zip(own, ids))
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        ends = [0, *itertools.accumulate(p.length for p in own)]
        assert [p.offset for p in own] == ends[:-1]
        assert ends[-1] <= length and ends[-1].bit_count() == 1
    return by_sequence


def test_curve():
    """All places once, each step to a neighbour."""
    for bits, dimensions in ((3, 2), (2, 4), (4, 2), (1, 5), (3, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
        place = packing.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_whole_table(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents")
    rows = docs.collect()
    pieces = packing.pack(docs, bytes_per_partition=1 << 18).collect()
    assert len({p.sequence_id >> 40 for p in pieces}) > 5
    held(pieces, {r.doc_id: ids_of(library, r.text) for r in rows})
    # Documents that follow each other are alike far more often than by chance.
    lang = {r.doc_id: r.lang for r in rows}
    order = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    order = list(dict.fromkeys(order))
    same = np.mean([lang[a] == lang[b] for a, b in zip(order, order[1:])])
    shares = np.unique(list(lang.values()), return_counts=True)[1] / len(lang)
    assert same > 0.8 > 0.6 > (shares**2).sum()
    total = packing.padding(packing.pack(docs)).first()
    assert total.padded == 0 and total.sequences <= total.tokens // packing.LENGTH + 20 * 20


def test_odd_documents(spark, library):
    docs = documents(spark)
    held(packing.pack(docs).collect(), {r.doc_id: ids_of(library, r.text) for r in docs.collect()})
    held(packing.pack(docs, length=64).collect(), {r.doc_id: ids_of(library, r.text) for r in docs.collect()}, 64)


def test_none_and_repeated_rows(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    copies = documents(spark, ["one two three"] * 3000, ids=[None] * 3000)
    pieces = packing.pack(copies, bytes_per_partition=1 << 12).collect()
    size = pieces[0].doc_tokens
    assert sum(p.length for p in pieces) == 3000 * size
    assert sum(p.start == 0 for p in pieces) == 3000
    parts = np.unique([p.sequence_id >> 40 for p in pieces], return_counts=True)[1]
    assert len(parts) > 3 and parts.max() < 1500  # a group of copies is spread


def test_large_ids_take_four_bytes():
    for ids in ([], [1, 65535], [65536, 0]):
        data = packing.narrow(np.array(ids, "<u4"))
        assert packing.widened(data).tolist() == ids and data[-1] == (4 if 65536 in ids else 2)
