"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the last 16 characters cuts texts into chunks, so that equal passages
give equal chunks wherever they stand. A chunk is encoded once per worker and kept for the
texts to come, those used longest ago making room. An encoding made without its neighbours
can be wrong at its ends, so a chunk gives only the ids between its first and last stable
cut, a place where a space follows a letter, digit or punctuation: no pre-token of the
byte-level pattern holds a space behind another character. Each join is repaired by encoding
anew what lies between two chunks' ids together with the last word of the left ones and the
first word of the right ones, until these words come out with exactly the ids they have
there. A chunk with too few cuts, or whose own words do not agree with it, joins the stretch;
a join that does not agree grows to the whole text.

Nulls count as empty texts, which have no ids. Other columns are left out, repeated rows
are encoded row by row, and texts of any length are handled whole.
"""

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.common import short_batches

# The byte-level split pattern and special token of the vocabulary.
PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)
SPECIAL = "<|endoftext|>"

# Characters of old and settled classes, on which both libraries' patterns agree.
_SETTLED = re.compile("[\t\n\r -~¡-¬®-ɏΑ-ΡΣ-ϿЀ-џ‐-…]*")
_STABLE = re.compile(r"(?<=[\w.,;:!?)\]}\"'%*/-]) ")
_GEAR = np.random.default_rng(20).integers(1, 2**32, 4096, dtype=np.uint64).astype(np.uint32)


def chunk_ends(text: str, bits: int = 11) -> list[int]:
    """Ends of chunks of 2^bits characters on average, set by the 16 characters before."""
    if len(text) <= 32:
        return [len(text)] if text else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rolled = _GEAR[codes & 4095]
    factor = 2654435761
    for width in (1, 2, 4, 8):
        rolled = rolled[width:] + rolled[:-width] * np.uint32(factor)
        factor = factor * factor % 2**32
    ends = np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + 16
    ends = ends.tolist()
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return ends


def _bytes_of_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes
    stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@dataclass(slots=True)
class Chunk:
    """``head`` and ``tail`` stand before the first and behind the last stable cut, ``ids``
    are those between, ``lead`` and ``trail`` the first and last word there, with their ids."""

    head: str
    ids: array
    tail: str
    lead: tuple[str, array]
    trail: tuple[str, array]


class ChunkCoder:
    """``remember`` bounds the chunks kept between texts. ``seen`` and ``reused`` count the
    characters of all chunks and of those that were kept."""

    def __init__(self, path: str, remember: int = 6_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.library = Tokenizer.from_str(text)
        self.library.no_padding()
        self.library.no_truncation()
        self.remember = remember
        self.chunks: dict[str, Chunk] = {}
        self.seen = self.reused = 0
        self.fast = self._ranked(json.loads(text))

    def _ranked(self, spec: dict):
        """The same merges by rank, if the vocabulary numbers tokens in merge order."""
        import tiktoken

        letters, model = _bytes_of_letters(), spec["model"]
        ranks = {
            bytes(letters[c] for c in token): n
            for token, n in model["vocab"].items()
            if token != SPECIAL
        }
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"]["".join(pair)] for pair in pairs]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = spec["normalizer"] is None and not spec["pre_tokenizer"]["add_prefix_space"]
        if not plain or ids != sorted(set(ids)) or set(added) - {SPECIAL}:
            return None
        return tiktoken.Encoding(
            "ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added
        )

    def direct(self, text: str) -> list[int]:
        """Ids of a text as it stands alone."""
        if not text:
            return []
        if self.fast is None or not _SETTLED.fullmatch(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if "<|" in text:
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    def words(self, text: str) -> Chunk | None:
        """A chunk encoded; None if its first and last word cannot be held against a join."""
        first = _STABLE.search(text)
        second = first and _STABLE.search(text, first.end())
        if not second:
            return None
        cuts, end = [], len(text)
        while len(cuts) < 2:
            end = text.rfind(" ", 0, end)
            if _STABLE.match(text, end):
                cuts.append(end)
        start, end = first.start(), cuts[0]
        ids = array("I", self.direct(text[start:end]))
        lead, trail = text[start : second.start()], text[cuts[1] : end]
        leads, trails = array("I", self.direct(lead)), array("I", self.direct(trail))
        if ids[: len(leads)] != leads or ids[len(ids) - len(trails) :] != trails:
            return None
        return Chunk(text[:start], ids, text[end:], (lead, leads), (trail, trails))

    def chunk(self, text: str) -> Chunk | None:
        kept = self.chunks.pop(text, None)
        self.seen += len(text)
        if kept is None:
            kept = self.words(text)
        else:
            self.reused += len(text)
        if kept is not None and len(text) <= 65536:
            self.chunks[text] = kept  # the latest is last
            if len(self.chunks) > self.remember:
                del self.chunks[next(iter(self.chunks))]
        return kept

    def join(self, left: Chunk | None, between: str, right: Chunk | None) -> array | None:
        """Ids of what lies between two chunks' ids; None if the words beside it, encoded
        with it, have other ids than there."""
        word, before = left.trail if left else ("", array("I"))
        after, behind = right.lead if right else ("", array("I"))
        ids = array("I", self.direct(word + between + after))
        end = len(ids) - len(behind)
        if end < len(before) or ids[: len(before)] != before or ids[end:] != behind:
            return None
        return ids[len(before) : end]

    def encode(self, text: str) -> array:
        ids, open_, left, start = array("I"), [], None, 0
        for end in chunk_ends(text):
            part = text[start:end]
            start = end
            right = self.chunk(part)
            if right is None:
                open_.append(part)
                continue
            joined = self.join(left, "".join([*open_, right.head]), right)
            if joined is None:
                return array("I", self.direct(text))
            ids.extend(joined)
            ids.extend(right.ids)
            open_, left = [right.tail], right
        joined = self.join(left, "".join(open_), None)
        if joined is None:
            return array("I", self.direct(text))
        ids.extend(joined)
        return ids

    def decode(self, ids: list[int]) -> str:
        if self.fast is None:
            return self.library.decode(ids, skip_special_tokens=False)
        try:
            return self.fast.decode_bytes(ids).decode("utf-8")
        except UnicodeDecodeError:
            return self.library.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def coder(path: str | None) -> ChunkCoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return ChunkCoder(path)


def _ids(texts: Iterable[str], path: str | None) -> list[bytes]:
    encode = coder(path).encode
    return [np.asarray(encode(t), dtype="<u4").tobytes() for t in texts]


def _decoded(ids: Iterable[bytes | None], path: str | None) -> list[str]:
    decode = coder(path).decode
    return [decode(np.frombuffer(b or b"", dtype="<u4").tolist()) for b in ids]


def encode_documents(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    decode: bool = False,
) -> DataFrame:
    """Columns ``id_col`` and ids (binary, little-endian unsigned 32-bit integers); with
    ``decode`` also decoded, the text these ids decode to, in the same pass."""

    @F.pandas_udf("ids binary, decoded string" if decode else "ids binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"ids": _ids(batch, path)}
            if decode:
                out["decoded"] = _decoded(out["ids"], path)
            yield pd.DataFrame(out, dtype=object)

    text = F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    rows = short_batches(docs).select(F.col(id_col), text)
    return rows.select(id_col, coded("__text").alias("__coded")).select(id_col, "__coded.*")


def decode_ids(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The rows with a column decoded; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_decoded(batch, path), dtype=object)

    return short_batches(encoded).withColumn("decoded", text(ids_col))


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Columns ``id_col``, n_tokens, ids_sha256 and decoded_sha256."""
    return encode_documents(docs, path, id_col, decode=True).select(
        id_col,
        F.expr("bigint(octet_length(ids) / 4)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
