"""States of batches, written ahead of each step, so that what a failure leaves can be settled."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: In the order in which a batch passes them; the last two end it.
BEGUN, CHECKED, COMMITTING, MOVED, DONE, UNDONE = "begun", "checked", "committing", "moved", "done", "undone"


class BatchStates:
    """Files ``<batch>/<n>-<state>-<version>`` under ``path``; that of greatest n counts. Through Spark's own file system; one writer a batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._of = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._of().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str = "") -> list[str]:
        there = self._of(name)
        return [s.getPath().getName() for s in self._fs.listStatus(there)] if self._fs.exists(there) else []

    def last(self, batch: str) -> tuple[str, int] | None:
        """State and version of a batch, or None of one that never began."""
        marks = [(int(n), state, int(version)) for n, state, version in (name.split("-") for name in self._names(batch))]
        return max(marks)[1:] if marks else None

    def mark(self, batch: str, state: str, version: int = 0) -> None:
        n = max((int(name.split("-")[0]) for name in self._names(batch)), default=0) + 1
        if not self._fs.createNewFile(self._of(f"{batch}/{n}-{state}-{version}")):  # at once or not at all
            raise RuntimeError(f"another writer works on batch {batch}")

    def open(self) -> list[str]:
        """Batches that have not ended."""
        return sorted(b for b in self._names() if (self.last(b) or (DONE, 0))[0] not in (DONE, UNDONE))
