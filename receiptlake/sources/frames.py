"""Captured event streams as a source of Spark, in batch and as a stream.

    spark.dataSource.register(EventStreamSource)
    spark.readStream.format("event_stream").option("path", "s3://captures/").load()

An event is a run of lines up to a blank one. Its ``data:`` lines are joined by line breaks,
``id:`` and ``event:`` lines are kept, comments (``:``) and other fields are passed over, and
a bare ``{...}`` line counts as data. Events without data give no row. Files are read by
ranges of bytes, so a large capture is read by many tasks: an event belongs to the range its
first byte lies in, and is read on beyond the end of that range. The offset of a stream says
how far each file has been read; a batch takes all that has landed, cut into ranges, and one
that runs again reads the same bytes.

Complete files end their last event. With ``growing`` files may become longer, and an event
is read when the blank line behind it is there. Lines end with ``\\n`` or ``\\r\\n``; text that
is no UTF-8 is replaced letter by letter. An empty file, or folder, gives no row.

Files named ``.snappy`` hold blocks of text as Hadoop's codec writes them, and Spark's text
writer with it. Ranges, offsets and bytes_per_partition count bytes of the text. Where its
blocks begin is looked up on the driver, which reads their headers only; a task reads from the
block on in which its range begins. One that is cut off inside a block is an error, or, if
growing, is read as far as blocks are whole.

Options: path (a file or folder, on a local disk or any store that Arrow can reach),
bytes_per_partition, growing.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value string, id string, event string, file string, offset bigint"
BYTES_PER_PARTITION = 32 << 20
BLOCK = 1 << 20
ROWS = 1000
PACKED = ".snappy"
LOOKUPS = 16

# As many blank lines as follow each other: where they end does not depend on where one
# begins to read, if that is three bytes before at least.
_GAP = re.compile(rb"\n(?:\r?\n)+")


class Place(NamedTuple):
    """Where a chunk of a compressed file begins, in the text and as stored, and how much text
    its block has from there on. With none, the header of a block comes first."""

    text: int = 0
    stored: int = 0
    left: int = 0


@dataclass
class Range(InputPartition):
    """The events of a file that begin in [low, high); from ``start`` on it is read, ``end``
    is as far as it may be. ``place`` is where a compressed file is read from."""

    path: str
    start: int
    low: int
    high: int
    end: int
    place: Place | None = None


def _files(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str) -> dict[str, int]:
    """Size of each file below a path; hidden ones apart."""
    from pyarrow import fs

    files, root = _files(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return {}
    found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
    shown = [f for f in found if f.is_file and f.base_name[0] not in "._"]
    return {path.rstrip("/") + f.path.removeprefix(root.rstrip("/")): f.size for f in shown}


def following(file, at: Place, size: int) -> tuple[int, int, int, Place] | None:
    """The chunk at a place: where its bytes are, their number, that of its text, and the place
    behind it. A block without text counts as a chunk. None if ``size`` bytes end before it does.

    A block is the length of its text and chunks, a chunk its length as stored and its bytes;
    these begin with the length of its text, seven bits a byte."""
    text, stored, left = at
    file.seek(stored)
    head = file.read(13)
    if not left:
        left, head, stored = int.from_bytes(head[:4]), head[4:], stored + 4
        if not left and stored <= size:
            return stored, 0, 0, Place(text, stored)
    begin, length = stored + 4, int.from_bytes(head[:4])
    if len(head) < 5 or begin + length > size:
        return None
    count = shift = 0
    for byte in head[4:]:
        count |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            break
    if not 0 < count <= left:
        raise ValueError(f"no block of snappy at byte {at.stored}")
    return begin, length, count, Place(text + count, begin + length, left - count)


@dataclass
class Index:
    """Places in a compressed file, not much more than ``BLOCK`` bytes of text from each other,
    and the place behind its last whole chunk."""

    places: list[Place]
    end: Place = Place()
    size: int = 0

    def extend(self, file, size: int) -> None:
        while found := following(file, self.end, size):
            self.end = found[3]
            if self.end.text - self.places[-1].text >= BLOCK:
                self.places.append(self.end)
        self.size = size

    def before(self, at: int) -> Place:
        return self.places[bisect_right(self.places, at, key=lambda p: p.text) - 1]


class Text:
    """The text of a compressed file, read like a file from the first of some places on."""

    def __init__(self, file, index: Index):
        self.file, self.index, self.size = file, index, file.seek(0, 2)
        self.codec = pa.Codec("snappy")
        self.seek(index.places[0].text)

    def seek(self, at: int) -> None:
        self.place = self.index.before(at)
        self.skip, self.held = at - self.place.text, memoryview(b"")

    def read(self, count: int) -> bytes:
        out = []
        while count > 0:
            if not self.held:
                found = following(self.file, self.place, self.size)
                if found is None:
                    raise EOFError(f"the file ends in byte {self.size}, before its text does")
                begin, length, text, self.place = found
                if text <= self.skip:
                    self.skip -= text
                    continue
                self.file.seek(begin)
                chunk = self.codec.decompress(self.file.read(length), text, asbytes=True)
                self.held, self.skip = memoryview(chunk)[self.skip :], 0
            out.append(self.held[:count])
            self.held = self.held[count:]
            count -= len(out[-1])
        return b"".join(out)


def complete(file, size: int, start: int = 0) -> int:
    """Where the last event ends that has a blank line behind it."""
    high = size
    while high > start:
        low = max(start, high - BLOCK)
        file.seek(low)
        block = file.read(min(high + 3, size) - low)  # a gap may span two blocks
        ends = [m.end() for m in _GAP.finditer(block)]
        if ends:
            return low + ends[-1]
        high = low
    return start


def ranges(path: str, start: int, end: int, size: int, index: Index | None = None) -> list[Range]:
    out = [Range(path, start, low, min(low + size, end), end) for low in range(start, end, size)]
    for part in out if index else ():
        part.place = index.before(max(start, part.low - 3))  # as far back as ``events`` goes
    return out


def events(file, part: Range, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """Offset and text of each event that begins in a range. The buffer is cut once for each
    block that is read, not once for each event in it."""
    first = part.low == part.start
    base = part.low if first else max(part.start, part.low - 3)
    buffer, at, scan, ended, inside = b"", 0, 0, False, first
    file.seek(base)
    while True:
        gap = _GAP.search(buffer, scan)
        if not ended and (gap is None or len(buffer) - gap.end() < 2):
            if gap is not None:
                scan = gap.start()  # it may go on
            else:
                scan = max(at, len(buffer) - 3)
                at = at if inside else scan
            buffer, base, at, scan = buffer[at:], base + at, 0, scan - at
            if not inside and base >= part.high:
                return
            read = file.read(min(block, part.end - base - len(buffer)))
            ended = not read
            buffer += read
            continue
        if gap is None:
            break
        if inside:
            yield base + at, buffer[at : gap.start()]
        at = scan = gap.end()
        if base + at >= part.high:
            return
        inside = base + at >= part.low
    if inside and at < len(buffer):
        yield base + at, buffer[at:]


def decoded(text: bytes) -> tuple[str, str | None, str | None] | None:
    """Data, id and name of an event; None without data."""
    data, id_, name = [], None, None
    for line in text.decode("utf-8", "replace").split("\n"):
        line = line.removesuffix("\r")
        field, colon, value = line.partition(":")
        value = value.removeprefix(" ")
        if line.startswith("{"):
            data.append(line)
        elif field == "data":
            data.append(value if colon else "")
        elif field == "id" and colon:
            id_ = value
        elif field == "event" and colon:
            name = value
    return ("\n".join(data), id_, name) if data else None


def rows(part: Range) -> Iterator[pa.RecordBatch]:
    files, inner = _files(part.path)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64()]

    def batch(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    some: list[tuple] = []
    with files.open_input_file(inner) as file:
        source = Text(file, Index([part.place])) if part.place else file
        for offset, text in events(source, part):
            if found := decoded(text):
                some.append((*found, part.path, offset))
            if len(some) == ROWS:
                yield batch(some)
                some = []
    if some:
        yield batch(some)


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options.get("bytes_per_partition", BYTES_PER_PARTITION))
        self.growing = options.get("growing", "false").lower() == "true"
        self.indexes: dict[str, Index] = {}

    def index(self, path: str, size: int) -> Index:
        """Of a compressed file, as far as it is stored; what is known of it is not read again."""
        index = self.indexes.setdefault(path, Index([Place()]))
        if index.size < size:
            files, inner = _files(path)
            with files.open_input_file(inner) as file:
                index.extend(file, size)
        if not self.growing and (index.end.stored, index.end.left) != (size, 0):
            raise EOFError(f"{path} ends inside a block")
        return index

    def end(self, path: str, size: int, known: int) -> int:
        """How far the text of a file can be read."""
        index = self.index(path, size) if path.endswith(PACKED) else None
        size = index.end.text if index else size
        if not self.growing or size <= known:
            return size
        files, inner = _files(path)
        with files.open_input_file(inner) as file:
            return complete(Text(file, index) if index else file, size, known)

    def ends(self, known: dict[str, int]) -> dict[str, int]:
        """How far each file can be read."""
        found = listed(self.path)
        with ThreadPoolExecutor(LOOKUPS) as pool:
            ends = pool.map(self.end, found, found.values(), [known.get(p, 0) for p in found])
            return dict(zip(found, ends))

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        new = {p: upto for p, upto in sorted(end.items()) if upto > start.get(p, 0)}
        if any(p.endswith(PACKED) and p not in self.indexes for p in new):
            self.ends(end)  # a batch that runs again after a restart
        out = []
        for path, upto in new.items():
            out += ranges(path, start.get(path, 0), upto, self.size, self.indexes.get(path))
        return out


class _Batch(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Range]:
        return self.options.ranges({}, self.options.ends({}))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows(partition) if partition is not None else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options = options
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        self.known |= self.options.ends(self.known)
        return {"files": dict(sorted(self.known.items()))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.options.ranges(start["files"], end["files"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows(partition) if partition is not None else iter(())


class EventStreamSource(DataSource):
    """Format ``event_stream``: value, id, event, file, offset (of the event in its file)."""

    @classmethod
    def name(cls) -> str:
        return "event_stream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Options(self.options))
