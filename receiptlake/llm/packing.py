"""Packing in the order of a space-filling curve.

A document's token ids are hashed into a vector (each id adds, with a weight that falls with
its number in the text, the directions that its hash has in a few dimensions), whose
direction gives a cell of a fine grid. The Hilbert curve runs through all cells so that
neighbours on it are neighbours in space; documents are range-partitioned and sorted by
their place on it, and packed along the curve: their ids form one stream per partition, cut
every 1,024 ids, so a sequence holds documents that are alike. What is left at the end of a
partition is cut into sequences of falling powers of two, which need no padding: no sequence
is ever padded.

Ids are made once, written to the shared folder in two bytes each where the vocabulary
allows it, and shuffled once. Places on the curve are tied by id, hash of the ids, and the
row's number where it was written, so no place is too hot: a group of copies that holds a
third of all rows is cut like any other stretch of the curve.

Null texts count as empty ones, which have only the end's id. Rows that repeat an id or a
text are packed each. An empty table gives no rows. Other columns are ignored. A document of
any length is packed whole; its ids stay in one row until they are cut.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from receiptlake.llm.bpe import coder
from receiptlake.llm.common import cut, short_batches

LENGTH = 1024
END = 0
DIMENSIONS, BITS = 5, 12
BYTES_PER_PARTITION = 16 << 20


def directions(buckets: int, seed: int = 11) -> np.ndarray:
    """Per hashed id its share in each of the few dimensions."""
    return np.random.default_rng(seed).normal(size=(buckets, DIMENSIONS)).astype(np.float32)


def cells(ids: list[np.ndarray], share: np.ndarray) -> np.ndarray:
    """The grid cell (a row of whole numbers below 2^BITS) of each list of ids."""
    out = np.zeros((len(ids), DIMENSIONS))
    for n, own in enumerate(ids):
        bucket = (own.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
        found, times = np.unique(bucket, return_counts=True)
        if len(found):
            weight = 1 + np.log(times)
            out[n] = weight @ share[found] / np.sqrt(weight @ weight)
    # Sums of many directions are about normal; the logistic curve spreads them evenly.
    spread = 1 / (1 + np.exp(-1.702 * out))
    return np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(cell: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each cell on the Hilbert curve through the grid of 2^bits cells a side.

    From coarse to fine, a cell's part of its cube is turned so that the curve through the
    part starts and ends where its neighbours' do; what is left of the coordinates is a Gray
    code of the place, its bits taken from the dimensions in turn.
    """
    x = cell.T.astype(np.int64).copy()
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            high = (x[i] >> bit & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | (axis >> bit & 1)
    return place


def encoded(docs: DataFrame, path: str | None, id_col: str, text_col: str) -> DataFrame:
    """Columns id, place (on the curve), size (of the ids, with the end's) and ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, encode = directions(4096), coder(path).direct
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                some = batch.slice(start, 100)
                ids = [np.asarray(encode(t), dtype="<u4") for t in some.column(1).to_pylist()]
                place = hilbert(cells(ids, share))
                whole = [np.append(own, np.uint32(END)).astype("<u4") for own in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array(place),
                        pa.array([len(own) for own in whole], pa.int64()),
                        pa.array([narrow(own) for own in whole], pa.binary()),
                    ],
                    ["id", "place", "size", "ids"],
                )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = short_batches(docs).select(F.col(id_col).alias("id"), text.alias("text"))
    return rows.mapInArrow(made, f"id {kind}, place bigint, size bigint, ids binary")


def narrow(ids: np.ndarray) -> bytes:
    """Ids in two bytes each if all fit, else in four; the last byte tells which."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        return ids.astype("<u4").tobytes() + b"\x04"
    return ids.astype("<u2").tobytes() + b"\x02"


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data[:-1], dtype="<u2" if data[-1] == 2 else "<u4").astype("<u4")


class Packer:
    """Cuts the stream of documents of a partition into sequences."""

    def __init__(self, first: int, length: int = LENGTH):
        self.sequence, self.length = first, length
        self.open: list[tuple] = []
        self.filled = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces (key, start, ids, size of the document, sequence, offset) of the sequences
        that become full."""
        start = 0
        while start < len(ids):
            piece = ids[start : start + self.length - self.filled]
            self.open.append((key, start, piece, len(ids), self.sequence, self.filled))
            start += len(piece)
            self.filled += len(piece)
            if self.filled == self.length:
                yield from self.open
                self.sequence, self.open, self.filled = self.sequence + 1, [], 0

    def close(self) -> Iterator[tuple]:
        """What is left, in sequences of falling powers of two."""
        rest, left = self.open, self.filled
        self.open, self.filled, filled = [], 0, 0
        room = 1 << max(left.bit_length() - 1, 0)
        for key, start, piece, size, _, _ in rest:
            while len(piece):
                part, piece = piece[: room - filled], piece[room - filled :]
                yield key, start, part, size, self.sequence, filled
                start += len(part)
                filled += len(part)
                if filled == room:
                    self.sequence, left, filled = self.sequence + 1, left - room, 0
                    room = 1 << max(left.bit_length() - 1, 0)


def pack(
    docs: DataFrame,
    length: int = LENGTH,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    bytes_per_partition: int = BYTES_PER_PARTITION,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (binary, little-endian unsigned
    32-bit integers), doc_tokens, sequence_id, offset. Sequences are numbered along the
    curve within a partition, from the partition's number times 2^40 on."""
    kind = docs.schema[id_col].dataType.simpleString()
    made = cut(encoded(docs, path, id_col, text_col), "packing")
    total = made.agg(F.sum("size")).first()[0] or 0
    spread = max(1, -(-2 * total // bytes_per_partition))
    row = F.monotonically_increasing_id()
    order = ["place", "id", "digest", "row"]
    laid = made.withColumns({"digest": F.xxhash64("ids"), "row": row})
    laid = laid.repartitionByRange(spread, *order).sortWithinPartitions(*order)
    shape = (
        f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
        "`offset` bigint"
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(TaskContext.get().partitionId() << 40, length)
        ids_kind = None
        for batch in batches:
            ids_kind = batch.schema.field(0).type
            for start in range(0, batch.num_rows, 100):
                some = batch.slice(start, 100)
                keys, stored = some.column(0).to_pylist(), some.column(1)
                pieces = [p for k, own in zip(keys, stored) for p in packer.add(k, widened(own.as_py()))]
                if pieces:
                    yield as_batch(pieces, ids_kind, id_col)
        if packer.open:
            yield as_batch(list(packer.close()), ids_kind, id_col)

    return laid.select("id", "ids").mapInArrow(packed, shape)


def as_batch(pieces: list[tuple], kind: pa.DataType, id_col: str) -> pa.RecordBatch:
    key, start, ids, size, sequence, offset = zip(*pieces)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key, kind),
            pa.array(start, pa.int64()),
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
            pa.array(size, pa.int64()),
            pa.array(sequence, pa.int64()),
            pa.array(offset, pa.int64()),
        ],
        [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def padding(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences, tokens, and what sequences are padded with, being padded to
    ``length`` unless their size is a power of two."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("size"))
    power = F.expr("bit_count(size) = 1")
    return sizes.agg(
        F.count("*").alias("sequences"),
        F.sum("size").alias("tokens"),
        F.sum(F.when(power, 0).otherwise(length - F.col("size"))).alias("padded"),
    )
