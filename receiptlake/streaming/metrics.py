"""How many receipts of each batch go where, counted on the way and kept per batch.

A receipt whose ``is_clean`` is unknown goes to neither table unless ``on_null`` sends it to
the errors, and no table tells how many these are. The counts are observed in the plan that
makes the batch, so they need no pass of their own, and reach a listener with the progress
of the query. They are written one small file per batch; a batch that is run again finds
its file and leaves it, so restarts count nothing twice.

Observed counts are those of the run that reports them. Tasks that have to be repeated,
after an executor with a kept part of the batch was lost, may count their rows again; where
that matters compare with the rows of the tables.
"""

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from receiptlake.streaming import files

NAME = "receipt_routes"
ROUTES = ("clean", "error", "neither")
COUNTS = T.StructType(
    [
        T.StructField("stream_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        *[T.StructField(r, T.LongType()) for r in ROUTES],
    ]
)


def observed(checked: DataFrame, on_null: str = "drop", count: Column | None = None) -> DataFrame:
    """Checked receipts, with the number on each route observed as they pass."""
    flag = F.col("is_clean")
    unknown = flag.isNull()
    routes = {
        "clean": flag,
        "error": ~flag | unknown if on_null == "error" else ~flag,
        "neither": F.lit(False) if on_null == "error" else unknown,
    }
    rows = F.lit(True) if count is None else count
    return checked.observe(NAME, *[F.count_if(F.coalesce(c & rows, F.lit(False))).alias(r) for r, c in routes.items()])


class RoutingLog(StreamingQueryListener):
    """Keeps the observed counts of named queries below ``path``. Give a query its stream's
    id as name. Add it by ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ended: dict[str, threading.Event] = {}
        self.names: dict[str, str] = {}
        self.failures: list[str] = []

    def _event(self, run_id: str) -> threading.Event:
        return self.ended.setdefault(run_id, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(NAME)
        if row is None or not progress.name or progress.numInputRows == 0:
            return
        try:
            counts = {r: row[r] or 0 for r in ROUTES}
            line = json.dumps({"stream_id": progress.name, "batch_id": progress.batchId, **counts})
            name = f"{files.escaped(progress.name)}-{progress.batchId:019d}.json"
            files.write_once(self.spark, f"{self.path}/{name}", line)
        except Exception as error:  # a listener must not end the bus; ``wait`` reports it
            self.failures.append(f"batch {progress.batchId} of {progress.name}: {error}")

    def onQueryTerminated(self, event) -> None:
        self._event(str(event.runId)).set()

    def wait(self, query, timeout: float = 60) -> None:
        """Until all progress of an ended query has been kept: its end is told last."""
        if not self._event(str(query.runId)).wait(timeout):
            raise TimeoutError(f"the end of query {query.name} was not told within {timeout} s")
        if self.failures:
            raise RuntimeError("; ".join(self.failures))


def routing_counts(spark: SparkSession, path: str) -> DataFrame:
    """Columns stream_id, batch_id, clean, error, neither: a row per batch."""
    if not files.names(spark, path):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).json(path)
