"""Tables whose readers see whole batches only, and their upkeep.

Below the path of a table lie

    batches/stream_id=.../batch_id=.../attempt=...   rows of one run of one batch
    _batches/<stream>/<batch>-<version>.json         which run of a batch counts
    months/v=.../month=.../                          rows of many batches, merged
    _merges/<version>.json                           which folder a month is in, and which
                                                     batches are in there

A batch is written to a folder of its own and published by a small file that appears at
once, after the rows. A batch that is run again gets a new folder and a file of the next
version: until that is there readers see the rows of the first run, afterwards those of the
second, never both, none or a part. What a failed run leaves is in no file and seen by
nobody.

A merge moves the rows of published batches into month folders above the batch ids. Months
that get rows are written anew, beside the old ones; the others stay where they are. Rows
are dealt by ranges of (month, order of the table), so a hot month becomes as many files as
its size asks for, each a range of its own, and small months share a task. Merged rows keep
stream and batch, so the rows of a batch that is run again after a merge can be told and
left out, by readers at once and by the next merge for good. Like a batch, a merge counts
from the moment its small file appears; of two at a time the second fails.
"""

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from receiptlake.functions.checks import year_month
from receiptlake.schema import CLEAN, ERROR
from receiptlake.streaming import files
from receiptlake.streaming.sinks import Sink, write_parquet

KEY = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("batch_id", T.LongType())])


@dataclass(frozen=True)
class Batch:
    """A published run of a batch."""

    stream_id: str
    batch_id: int
    version: int
    folder: str


@dataclass
class Merged:
    """State of the month folders: version of the merge, folder of each month, runs of
    batches (from, to) per stream, and the version of those that had been run again."""

    version: int = 0
    months: dict[str, str] = field(default_factory=dict)
    runs: dict[str, list[list[int]]] = field(default_factory=dict)
    versions: dict[str, dict[str, int]] = field(default_factory=dict)

    def of(self, stream_id: str, batch_id: int) -> int:
        """The version of a batch that is in the months, 0 if none is."""
        if not any(a <= batch_id <= b for a, b in self.runs.get(stream_id, [])):
            return 0
        return self.versions.get(stream_id, {}).get(str(batch_id), 1)

    def add(self, batch: Batch) -> None:
        ids = sorted([*self.runs.get(batch.stream_id, []), [batch.batch_id] * 2])
        joined = [ids[0][:]]
        for a, b in ids[1:]:
            if a <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        self.runs[batch.stream_id] = joined
        if batch.version > 1:
            self.versions.setdefault(batch.stream_id, {})[str(batch.batch_id)] = batch.version


@dataclass(frozen=True)
class PublishedTable:
    """``time``: the column whose month rows are filed under; ``order``: of rows in a file."""

    path: str
    schema: T.StructType
    time: str
    order: Sequence[str]

    def _log(self, stream_id: str) -> str:
        return f"{self.path}/_batches/{files.escaped(stream_id)}"

    def merged(self, spark: SparkSession) -> Merged:
        """The state after the last merge."""
        log = f"{self.path}/_merges"
        last = max(files.names(spark, log), default=None)
        return Merged(**json.loads(files.read_text(spark, f"{log}/{last}"))) if last else Merged()

    def _versions(self, spark: SparkSession, stream_id: str) -> dict[int, int]:
        """The last published version of each batch that has a file."""
        found: dict[int, int] = {}
        for name in files.names(spark, self._log(stream_id)):
            batch_id, version = map(int, name.removesuffix(".json").split("-"))
            found[batch_id] = max(version, found.get(batch_id, 0))
        return found

    def batches(self, spark: SparkSession, state: Merged | None = None) -> list[Batch]:
        """Published batches whose rows are not in the months; of each the last run."""
        state = state or self.merged(spark)
        out = []
        for stream in files.names(spark, f"{self.path}/_batches"):
            stream_id = unquote(stream)
            for batch_id, version in sorted(self._versions(spark, stream_id).items()):
                if version > state.of(stream_id, batch_id):
                    text = files.read_text(spark, f"{self._log(stream_id)}/{_name(batch_id, version)}")
                    out.append(Batch(stream_id, batch_id, version, json.loads(text)["folder"]))
        return out

    def sink(self, stream_id: str, write: Callable[[DataFrame, str], None] = write_parquet) -> Sink:
        """For ``foreachBatch``: write a run of the batch, then publish it."""

        def publish(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            run = f"stream_id={files.escaped(stream_id)}/batch_id={batch_id}/attempt={uuid.uuid4().hex}"
            write(batch, f"{self.path}/batches/{run}")
            known = self._versions(spark, stream_id).get(batch_id, 0)
            version = max(known, self.merged(spark).of(stream_id, batch_id)) + 1
            text = json.dumps({"folder": run})
            while not files.write_once(spark, f"{self._log(stream_id)}/{_name(batch_id, version)}", text):
                version += 1

        return publish

    def read(self, spark: SparkSession, months: Sequence[str | None] | None = None) -> DataFrame:
        """All published rows with stream_id, batch_id and month. ``months`` narrows it to the
        folders of some months; a filter on ``month`` prunes the merged ones as well."""
        state = self.merged(spark)
        live = self.batches(spark, state)
        out = _without(self._months(spark, state, months), _again(live, state))
        batches = self._batches(spark, live)
        if months is not None:
            batches = batches.filter(_in(F.col("month"), months))
        return out.unionByName(batches)

    def _columns(self) -> list[str]:
        return [*self.schema.names, *KEY.names, "month"]

    def _batches(self, spark: SparkSession, live: Sequence[Batch]) -> DataFrame:
        """Rows of batches, each from the folder of its run."""
        shape = T.StructType([*self.schema, *KEY, T.StructField("attempt", T.StringType())])
        base = f"{self.path}/batches"
        folders = [f"{base}/{b.folder}" for b in live if files.names(spark, f"{base}/{b.folder}")]
        if folders:
            rows = spark.read.schema(shape).option("basePath", base).parquet(*folders)
        else:
            rows = spark.createDataFrame([], shape)
        return rows.withColumn("month", year_month(self.time)).select(self._columns())

    def _months(self, spark: SparkSession, state: Merged, months=None) -> DataFrame:
        extra = [T.StructField(c, T.StringType()) for c in ("v", "month")]
        shape = T.StructType([*self.schema, *KEY, *extra])
        base = f"{self.path}/months"
        wanted = state.months if months is None else {_folder(m) for m in months}
        folders = [f"{base}/{v}/{name}" for name, v in state.months.items() if name in wanted]
        if not folders:
            return spark.createDataFrame([], shape).select(self._columns())
        rows = spark.read.schema(shape).option("basePath", base).parquet(*folders)
        return rows.select(self._columns())

    def merge(
        self, spark: SparkSession, file_bytes: int = 256 << 20, file_rows: int = 1_000_000
    ) -> int | None:
        """Bring the rows of published batches into the month folders. The version of the
        merge, or None if there was nothing to do. It may be stopped and run again at any
        time: until its file is there nothing has changed for readers.

        A task sorts ``file_bytes`` or ``file_rows``, whichever is less: rows alike shrink to
        a twentieth in a file, and its size alone would not bound what a task has to hold."""
        state = self.merged(spark)
        live = self.batches(spark, state)
        if not live:
            return None
        new, again = self._batches(spark, live), _again(live, state)
        old = self._months(spark, state)
        touched = new.select("month")
        if again:  # months that lose rows
            touched = touched.unionAll(old.filter(_of(again)).select("month"))
        months = [r["month"] for r in touched.distinct().collect()]
        old = _without(self._months(spark, state, months), again)
        version = state.version + 1
        folder = f"v={version:010d}-{uuid.uuid4().hex}"
        below = [f"batches/{b.folder}" for b in live]
        below += [f"months/{v}/{name}" for name, v in state.months.items() if name in map(_folder, months)]
        held = sum(files.size(spark, f"{self.path}/{p}") for p in below)
        rows = old.unionByName(new)
        spread = max(1, -(-held // file_bytes), -(-rows.count() // file_rows))
        order = ["month", *self.order]
        rows = rows.repartitionByRange(spread, *order).sortWithinPartitions(*order)
        rows.write.partitionBy("month").parquet(f"{self.path}/months/{folder}")
        for name in map(_folder, months):
            state.months.pop(name, None)
        for name in files.names(spark, f"{self.path}/months/{folder}"):
            state.months[name] = folder
        for batch in live:
            state.add(batch)
        state.version = version
        if not files.write_once(spark, f"{self.path}/_merges/{version:010d}.json", json.dumps(vars(state))):
            raise RuntimeError(f"another merge has become version {version} of {self.path}")
        return version

    def discard(self, spark: SparkSession, keep: int = 1) -> None:
        """Remove what the last ``keep`` merges and the state before them do not use: batches
        that are in the months, and month folders that were written anew. Readers that began
        before must be done."""
        log = f"{self.path}/_merges"
        logged = files.names(spark, log)
        if len(logged) <= keep:
            return
        states = [Merged(**json.loads(files.read_text(spark, f"{log}/{n}"))) for n in logged[-keep - 1 :]]
        used = {f"{v}/{name}" for s in states for name, v in s.months.items()}
        newest = states[-1].version
        for folder in files.names(spark, f"{self.path}/months"):
            if int(folder[2:].split("-")[0]) > newest:
                continue  # of a merge at work
            inside = files.names(spark, f"{self.path}/months/{folder}")
            unused = [name for name in inside if f"{folder}/{name}" not in used]
            for name in unused if len(unused) < len(inside) else [""]:
                files.remove(spark, f"{self.path}/months/{folder}/{name}".rstrip("/"))
        first = states[0]
        for stream in files.names(spark, f"{self.path}/_batches"):
            stream_id = unquote(stream)
            for name in files.names(spark, self._log(stream_id)):
                batch_id, version = map(int, name.removesuffix(".json").split("-"))
                if version <= first.of(stream_id, batch_id):
                    path = f"{self._log(stream_id)}/{name}"
                    folder = json.loads(files.read_text(spark, path))["folder"]
                    files.remove(spark, path)
                    files.remove(spark, f"{self.path}/batches/{folder}")
        for name in logged[: -keep - 1]:
            files.remove(spark, f"{log}/{name}")


def _name(batch_id: int, version: int) -> str:
    return f"{batch_id:019d}-{version:06d}.json"


def _folder(month: str | None) -> str:
    return f"month={'__HIVE_DEFAULT_PARTITION__' if month is None else month}"


def _in(column: Column, values: Sequence[str | None]) -> Column:
    return reduce(Column.__or__, [column.eqNullSafe(F.lit(v)) for v in values], F.lit(False))


def _again(live: Sequence[Batch], state: Merged) -> list[Batch]:
    """Batches that were run again after their rows had been merged."""
    return [b for b in live if state.of(b.stream_id, b.batch_id)]


def _of(batches: Sequence[Batch]) -> Column:
    same = [(F.col("stream_id") == b.stream_id) & (F.col("batch_id") == b.batch_id) for b in batches]
    return reduce(Column.__or__, same)


def _without(rows: DataFrame, batches: Sequence[Batch]) -> DataFrame:
    return rows.filter(~_of(batches)) if batches else rows


def _carried(schema: T.StructType, carried: str) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL(carried), *schema]) if carried else schema


def clean_table(path: str, carried: str = "") -> PublishedTable:
    """The table of clean line items. ``carried``: columns, as in DDL, that travel in front."""
    order = ("date_time", "tax_payer_iin", "upload_time")
    return PublishedTable(path, _carried(CLEAN, carried), "date_time", order)


def error_table(path: str, carried: str = "") -> PublishedTable:
    """The table of rejected receipts."""
    return PublishedTable(path, _carried(ERROR, carried), "ts", ("ts", "reason"))
