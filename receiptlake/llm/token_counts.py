"""Token counts by the whole-token shortcut.

A piece vocabulary without a piece that has a word start after other characters never
merges across word starts, so a text's count is the sum of its words' counts. Which
vocabulary strings encode alone as one token is proved once per worker by encoding each of
them; words among those count one, and only the rest is merged, each distinct word of a
batch once.

Nulls count as empty texts, empty texts have no tokens, other columns are left out, and
repeated rows are counted row by row. A vocabulary for which the proof fails is served by
encoding whole texts.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.common import short_batches

WORD_START = "▁"
_SPACED = re.compile(" +[^ ]*")
_SLICE_CHARS = 4_000_000


class PieceCounter:
    """``remember`` bounds the merged words kept between batches, and ``longest`` the
    characters of one that is kept; both only trade memory for time."""

    def __init__(self, path: str, remember: int = 700_000, longest: int = 40):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.remember, self.longest = remember, longest
        pieces = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
        self.splits = self._splits_at_words(pieces)
        words = [p[1:] for p in pieces if p[0] == WORD_START and WORD_START not in p[1:]]
        words = [w for w in words if w]  # a last space alone is the piece WORD_START
        encoded = self.model.encode(words, num_threads=1)
        self.whole = {w: 1 for w, ids in zip(words, encoded, strict=True) if len(ids) == 1}
        self.whole[""] = 1
        self.splits &= WORD_START in pieces
        self.known = dict(self.whole)

    def _splits_at_words(self, pieces: list[str]) -> bool:
        """No piece continues over a word start, and texts reach the merges unchanged."""
        over = any(WORD_START in p.lstrip(WORD_START) for p in pieces)
        probe = "ﬁ½①Å  é  ｘ　 "
        kept = self.model.decode(self.model.encode(probe)) == probe
        spaced = self.model.encode("x", out_type=str)[0].startswith(WORD_START)
        return kept and spaced and not over

    def words(self, text: str) -> list[str]:
        """The parts between word starts, without the first space of each."""
        text = text.replace(WORD_START, " ")
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _SPACED.findall(" " + text)]
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(ids) for ids in self.model.encode(texts, num_threads=1)]
        if len(self.known) > self.remember:
            self.known = dict(self.whole)
        known, counts = self.known, []
        split = [self.words(t) for t in texts]
        rest = {w for words in split for w in words if w not in known}
        rest = list(rest)
        merged = dict(zip(rest, map(len, self.model.encode(rest, num_threads=1)), strict=True))
        known.update((w, n) for w, n in merged.items() if len(w) <= self.longest)
        for words in split:
            found = list(map(known.get, words))
            if None in found:
                found = [merged[w] if n is None else n for w, n in zip(words, found, strict=True)]
            counts.append(sum(found))
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def slices(texts: list[str], chars: int = _SLICE_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about so many characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_counts(
    docs: DataFrame,
    path: str | None = None,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Columns ``id_col``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).
    ``path`` is the vocabulary's place on every executor; by default that of the package
    of public vocabularies, asked on the executor."""

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path is None:
            import public_tokenizers

            count = counter(public_tokenizers.path("piece_bpe_32k.model")).count
        else:
            count = counter(path).count
        for batch in batches:
            yield pd.Series([n for run in slices(batch.tolist()) for n in count(run)], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        short_batches(docs).select(F.col(id_col), text.alias("__text"))
        .select(id_col, F.octet_length("__text").cast("bigint").alias("n_bytes"), tokens("__text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
