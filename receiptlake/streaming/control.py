"""Keeping several queries running.

Ending when the first query stops leaves the others without an owner, and a sink that fails
for a moment ends a job for good. A supervisor starts queries in order, starts one that fails
again from its checkpoint, a bounded number of times within a span of time and with growing
pauses, and when one is beyond that stops the others in the reverse order, each after the
batch it is working on, and tells which one failed.
"""

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Job:
    """``start`` starts the query on its checkpoint, also after a failure."""

    name: str
    start: Callable[[], StreamingQuery]
    query: StreamingQuery | None = None
    failures: list[float] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    due: float | None = None
    state: str = "waiting"  # running, failed (to be started again), done, stopped, given up


class GivenUp(RuntimeError):
    """A query has failed too often."""


class Supervisor:
    """``restarts``: how often a query may fail within ``span`` seconds; the pause before its
    next start begins at ``pause`` seconds and doubles with each of these failures, to
    ``longest_pause`` at most."""

    def __init__(
        self,
        spark: SparkSession,
        jobs: Sequence[tuple[str, Callable[[], StreamingQuery]]],
        restarts: int = 3,
        span: float = 3600,
        pause: float = 1,
        longest_pause: float = 60,
        clock: Callable[[], float] = time.monotonic,
    ):
        self.spark, self.clock = spark, clock
        self.jobs = [Job(name, start) for name, start in jobs]
        if len({j.name for j in self.jobs}) < len(self.jobs):
            raise ValueError("two jobs have one name")
        self.restarts, self.span = restarts, span
        self.pause, self.longest_pause = pause, longest_pause

    def start(self) -> None:
        """All queries, in order. If one does not start, those before it are stopped."""
        for job in self.jobs:
            self._start(job)
            if job.state == "given up":
                self._end(job)

    def run(self, timeout: float | None = None) -> dict[str, list[str]]:
        """Start them and wait until all have ended by themselves; of each the errors it came
        back from. Raises ``GivenUp`` when one is beyond its restarts. After ``timeout``
        seconds all are stopped in order."""
        until = None if timeout is None else self.clock() + timeout
        self.start()
        while any(j.state in ("running", "failed") for j in self.jobs):
            if until is not None and self.clock() >= until:
                self.stop()
                break
            self._wait(until)
            for job in self.jobs:
                self._look(job)
        return {j.name: j.errors for j in self.jobs}

    def stop(self) -> None:
        """The queries that run, the last one first; each ends its batch or drops it, and
        goes on from its checkpoint when it is started again."""
        for job in reversed(self.jobs):
            if job.state in ("running", "failed"):
                if job.query is not None and job.query.isActive:
                    job.query.stop()
                job.state = "stopped"

    def _wait(self, until: float | None) -> None:
        now = self.clock()
        times = [t for t in (until, *(j.due for j in self.jobs if j.state == "failed")) if t is not None]
        seconds = max(0.05, min(times) - now) if times else None
        if any(j.state == "running" for j in self.jobs):
            # Wakes up at the end of any query, also one of others.
            try:
                self.spark.streams.awaitAnyTermination(min(seconds or 5, 5))
            except StreamingQueryException:
                pass  # ``_look`` sees which one failed
            self.spark.streams.resetTerminated()
        elif seconds:
            time.sleep(min(seconds, 5))

    def _look(self, job: Job) -> None:
        if job.state == "failed" and self.clock() >= job.due:
            self._start(job)
        elif job.state == "running" and not job.query.isActive:
            error = job.query.exception()
            if error is None:
                job.state = "done"
            else:
                self._failed(job, str(error))
        if job.state == "given up":
            self._end(job)

    def _start(self, job: Job) -> None:
        try:
            job.query = job.start()
            job.state = "running"
        except Exception as error:
            self._failed(job, str(error))

    def _failed(self, job: Job, error: str) -> None:
        now = self.clock()
        job.errors.append(error)
        job.failures = [t for t in job.failures if now - t < self.span] + [now]
        if len(job.failures) > self.restarts:
            job.state = "given up"
        else:
            job.state = "failed"
            job.due = now + min(self.longest_pause, self.pause * 2 ** (len(job.failures) - 1))

    def _end(self, job: Job) -> None:
        self.stop()
        raise GivenUp(f"{job.name} failed {len(job.failures)} times, at last: {job.errors[-1]}")
