"""The event-stream source: any cut into ranges gives the same events."""

import io
import os
import random
import time

import pyarrow as pa
import pytest

from receiptlake.plans import fixture, queries, staging
from receiptlake.sources import EventStreamSource, decode_sse_lines, frames
from receiptlake.sources.frames import Index, Place, Range, Text, complete, decoded, events, ranges
from receiptlake.streaming import files


def plain(data: bytes) -> list[bytes]:
    """Texts of the events, read from the first byte to the last."""
    lines = data.replace(b"\r\n", b"\n").split(b"\n")
    out, own = [], []
    for line in [*lines, b""]:
        if line:
            own.append(line)
        elif own:
            out.append(b"\n".join(own))
            own = []
    return out


def in_ranges(data: bytes, size: int, block: int = 7, start: int = 0) -> list[tuple[int, bytes]]:
    found = []
    for part in ranges("", start, len(data), size):
        own = list(events(io.BytesIO(data), part, block))
        assert all(part.low <= at < part.high for at, _ in own)
        found += own
    return found


def texts(found):
    kept = [t.replace(b"\r\n", b"\n").strip(b"\n\r") for _, t in found]
    return [t for t in kept if t]


@pytest.mark.parametrize("newline", [b"\n", b"\r\n"])
def test_any_ranges_give_the_same_events(newline):
    rng = random.Random(1)
    for _ in range(150):
        pieces = []
        for _ in range(rng.randint(0, 12)):
            lines = [b"data: " + bytes(rng.choices(b"abc{}:\xc3\xa9 ", k=rng.randint(0, 9))) for _ in range(rng.randint(1, 3))]
            pieces.append(newline.join(lines) + newline * rng.randint(2, 5))
        data = newline * rng.randint(0, 3) + b"".join(pieces) + rng.choice([b"", b"data: last", b"data: last" + newline])
        whole = in_ranges(data, len(data) + 1)
        assert texts(whole) == plain(data)
        for size in (1, 2, 3, 5, 16, 40):
            assert in_ranges(data, size, rng.choice([1, 2, 3, 64])) == whole


def test_mixed_line_ends_and_no_events():
    data = b"data: a\r\n\n\r\ndata: b\n\r\ndata: c\n\ndata: d\r\n\r\n"
    for size in range(1, 30):
        assert [decoded(t)[0] for _, t in in_ranges(data, size) if decoded(t)] == ["a", "b", "c", "d"]
    for data in (b"", b"\n", b"\n\n\n", b"\r\n\r\n"):
        assert texts(in_ranges(data, 1)) == []
    assert texts(in_ranges(b"x" * 100, 9)) == [b"x" * 100]


def test_an_event_much_longer_than_its_range():
    data = b"data: " + b"x" * 5000 + b"\n\ndata: y\n\n"
    assert [len(t) for _, t in in_ranges(data, 64)] == [5006, 7]


def test_reading_goes_on_where_it_ended():
    data = b"data: a\n\ndata: b\n\n\n\ndata: c\n\n"
    for cut in (9, 18, 20):
        parts = in_ranges(data[:cut], 4) + in_ranges(data, 4, start=cut)
        assert [decoded(t)[0] for _, t in parts if decoded(t)] == ["a", "b", "c"]


def test_complete():
    for data, want in ((b"", 0), (b"data: a", 0), (b"data: a\n\n", 9), (b"data: a\n\ndata: b\n", 9), (b"a\r\n\r\nb", 5)):
        assert complete(io.BytesIO(data), len(data)) == want
    assert complete(io.BytesIO(b"data: a\n\ndata: b"), 16, 9) == 9


def test_lines_of_an_event():
    assert decoded(b"data: a\ndata:b\ndata\n: note\nid: 7\nevent: x\nretry: 3") == ("a\nb\n", "7", "x")
    assert decoded(b'{"a": 1}\r\ndata:  two') == ('{"a": 1}\n two', None, None)
    assert decoded(b": ping") is None and decoded(b"retry: 1") is None
    assert decoded(b"data: \xff\xc3\xa9")[0] == "�é"


@pytest.fixture
def registered(spark):
    spark.dataSource.register(EventStreamSource)
    return spark


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "ab") as file:
        file.write(text.encode())


def test_batch(registered, tmp_path):
    folder = str(tmp_path / "captures")
    for n in range(3):
        write(folder, f"{n}.txt", "".join(f'id: {n}-{i}\ndata: {{\ndata: "n": {i}}}\n\n: ping\n\n' for i in range(50)))
    write(folder, "_SUCCESS", "data: no\n\n")
    write(folder, "empty.txt", "")
    for size in ("100", "100000"):
        df = registered.read.format("event_stream").option("path", folder).option("bytes_per_partition", size).load()
        rows = df.collect()
        assert sorted(r.id for r in rows) == sorted(f"{n}-{i}" for n in range(3) for i in range(50))
        assert {r.value for r in rows if r.id == "1-7"} == {'{\n"n": 7}'}
        assert len({(r.file, r.offset) for r in rows}) == 150
    assert decode_sse_lines(df).count() == 150
    one = registered.read.format("event_stream").load(f"file://{folder}/1.txt")
    assert one.count() == 50
    assert registered.read.format("event_stream").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("growing", ["false", "true"])
def test_stream_and_restart(registered, tmp_path, growing):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("captures", "out", "c"))

    def values():
        source = registered.readStream.format("event_stream").option("path", folder)
        source = source.option("growing", growing).option("bytes_per_partition", "16").load()
        query = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        return sorted(r.value for r in registered.read.parquet(out).collect())

    write(folder, "a.txt", "data: 1\n\ndata: 2\n\n")
    assert values() == ["1", "2"]
    assert values() == ["1", "2"]
    write(folder, "b.txt", "data: 3\n\n")
    if growing == "true":
        write(folder, "a.txt", "data: 4\nda")
        assert values() == ["1", "2", "3"]
        write(folder, "a.txt", "ta: 5\n\n")
        assert values() == ["1", "2", "3", "4\n5"]
    assert len(values()) == (4 if growing == "true" else 3)
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.unlink(f"{checkpoint}/commits/{name}")
    assert len(values()) == (4 if growing == "true" else 3)


def test_ranges_are_bounded():
    parts = ranges("f", 10, 100, 32)
    assert [(p.low, p.high) for p in parts] == [(10, 42), (42, 74), (74, 100)]
    assert all(isinstance(p, Range) and p.start == 10 and p.end == 100 for p in parts)


def test_the_time_of_an_event_does_not_grow_with_the_block():
    text = b"".join(b"id: %d\ndata: {}\n\n" % n for n in range(150_000))
    whole = Range("", 0, 0, len(text), len(text))

    def seconds(block):
        start = time.perf_counter()
        assert sum(1 for _ in events(io.BytesIO(text), whole, block)) == 150_000
        return time.perf_counter() - start

    assert seconds(len(text)) < 5 * seconds(1 << 14) + 0.1


class Counted(io.BytesIO):
    taken = 0

    def read(self, *size):
        out = super().read(*size)
        self.taken += len(out)
        return out


def packed(pieces: list[bytes], chunk: int = 100) -> bytes:
    """Each piece as a block, in chunks, as Hadoop's codec writes them."""
    codec, out = pa.Codec("snappy"), b""
    for piece in pieces:
        out += len(piece).to_bytes(4)
        for at in range(0, len(piece), chunk):
            stored = codec.compress(piece[at : at + chunk], asbytes=True)
            out += len(stored).to_bytes(4) + stored
    return out


def indexed(stored: bytes, block: int, monkeypatch) -> Index:
    monkeypatch.setattr(frames, "BLOCK", block)
    index = Index([Place()])
    index.extend(io.BytesIO(stored), len(stored))
    return index


def test_compressed_ranges_give_the_events_of_the_text(monkeypatch):
    rng = random.Random(2)
    for _ in range(60):
        data = b"".join(b"data: " + bytes(rng.choices(b"abc{} ", k=rng.randint(0, 60))) + b"\n" * rng.randint(2, 4) for _ in range(rng.randint(0, 20)))
        cuts = sorted(rng.choices(range(len(data) + 1), k=rng.randint(0, 8)))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        stored = packed([*pieces, b""], rng.choice([1, 7, 1000]))
        index = indexed(stored, rng.choice([1, 50, 1 << 20]), monkeypatch)
        assert index.end == Place(len(data), len(stored), 0)
        for size in (1, 5, 40, 5000):
            found = []
            for part in ranges("", 0, len(data), size, index):
                found += events(Text(io.BytesIO(stored), Index([part.place])), part, rng.choice([3, 64]))
            assert found == in_ranges(data, size)
        assert complete(Text(io.BytesIO(stored), index), len(data)) == complete(io.BytesIO(data), len(data))


def test_a_range_reads_its_own_blocks_only(monkeypatch):
    rng = random.Random(3)
    lines = [b"data: " + rng.randbytes(50).hex().encode() + b"\n\n" for _ in range(20_000)]
    text = b"".join(lines)
    stored = packed([b"".join(lines[n : n + 100]) for n in range(0, len(lines), 100)], 4000)
    index = indexed(stored, 1 << 14, monkeypatch)
    looked = Counted(stored)
    Index([Place()]).extend(looked, len(stored))
    assert looked.taken < len(stored) / 50
    for part in ranges("", 0, len(text), 1 << 16, index):
        file = Counted(stored)
        assert sum(1 for _ in events(Text(file, Index([part.place])), part, 1 << 12)) <= 609
        assert file.taken < 1.5 * (1 << 16)


def test_files_that_are_no_whole_blocks():
    stored = packed([b"data: a\n\n", b"data: b\n\n"])
    for cut in range(1, len(stored)):
        index = Index([Place()])
        index.extend(io.BytesIO(stored), cut)
        assert index.end.text == (9 if index.end.stored == len(stored) // 2 else 0)
        assert (index.end.stored, index.end.left) != (cut, 0) or cut == len(stored) // 2
    with pytest.raises(EOFError):
        Text(io.BytesIO(stored[:-1]), Index([Place()])).read(18)
    with pytest.raises(ValueError):
        Index([Place()]).extend(io.BytesIO((8).to_bytes(4) + stored[4:]), len(stored))


def test_compressed_batch_and_cut_off(registered, tmp_path):
    folder = str(tmp_path / "captures")
    rows = [f'id: {i}\ndata: {{"n": "{"x" * (300_000 if i == 7 else i)}"}}\n' for i in range(2000)]
    texts = registered.createDataFrame([(r,) for r in rows], "value string")
    for part in range(2):
        texts.coalesce(1).write.mode("append").option("compression", "snappy").text(folder)
    write(folder, "plain.txt", "id: plain\ndata: {}\n\n")
    for size in ("300000", "100000000"):
        df = registered.read.format("event_stream").option("path", folder).option("bytes_per_partition", size).load()
        got = sorted((r.id, r.value) for r in df.select("id", "value").collect())
        want = [(str(i), f'{{"n": "{"x" * (300_000 if i == 7 else i)}"}}') for i in range(2000)]
        assert got == sorted([*want, *want, ("plain", "{}")])
        assert df.select("file", "offset").distinct().count() == 4001
    with open(f"{folder}/cut.snappy", "wb") as file:
        file.write(packed([b"data: a\n\n"])[:-1])
    with pytest.raises(Exception, match="ends inside a block"):
        registered.read.format("event_stream").load(folder).count()


@pytest.mark.parametrize("growing", ["false", "true"])
def test_compressed_stream_and_restart(registered, tmp_path, growing):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("captures", "out", "c"))
    os.makedirs(folder)

    def add(name, stored):
        with open(f"{folder}/{name}", "ab") as file:
            file.write(stored)

    def values():
        source = registered.readStream.format("event_stream").option("path", folder)
        source = source.option("growing", growing).option("bytes_per_partition", "16").load()
        query = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.value for r in registered.read.parquet(out).collect())

    add("a.snappy", packed([b"data: 1\n\nda", b"ta: 2\n\n"]))
    assert values() == ["1", "2"]
    assert values() == ["1", "2"]
    add("b.snappy", packed([b"data: 3\n\n"]))
    if growing == "true":
        more = packed([b"data: 4\nda", b"ta: 5\n\n"])
        add("a.snappy", more[:-3])
        assert values() == ["1", "2", "3"]
        add("a.snappy", more[-3:])
        assert values() == ["1", "2", "3", "4\n5"]
    assert len(values()) == (4 if growing == "true" else 3)
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.unlink(f"{checkpoint}/commits/{name}")
    assert len(values()) == (4 if growing == "true" else 3)


def test_captures_take_less_disk_than_their_documents(spark, sf_dir, monkeypatch):
    """They were plain text, and most of what the query writes."""
    sizes = {}

    def discard(session, path):
        sizes[os.path.basename(path)] = files.size(session, path)
        staging.discard(session, path)

    monkeypatch.setattr(queries, "discard", discard)
    queries.sse_frames(spark, sf_dir)
    text = fixture.documents(spark, sf_dir).rows.selectExpr("sum(octet_length(json))").first()[0]
    assert 0 < sizes["captures"] < text / 2
