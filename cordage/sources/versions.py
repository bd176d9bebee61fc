"""Tables in versions: a commit writes a new folder and then moves a pointer.

A reader never sees a half-written version, a failed job leaves the pointer
where it was, and a rollback moves it back. All through Spark's own file
system, so a table can be in any store that it knows. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """A table at ``path`` with folders ``v=N`` and pointer files ``at=N-K``; the pointer of greatest K counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._of = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._of("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, start: str) -> list[str]:
        if not self._fs.exists(self._of("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._of(""))]
        return [n.removeprefix(start) for n in names if n.startswith(start)]

    def version(self) -> int | None:
        """The version that readers see."""
        moves = [tuple(map(int, n.split("-"))) for n in self._names("at=")]
        return max(moves, key=lambda m: m[1])[0] if moves else None

    def _point(self, version: int) -> None:
        if not self._fs.createNewFile(self._of(f"at={version}-{self.moves() + 1}")):  # one file, made at once or not at all
            raise RuntimeError("another writer moved the pointer")

    def read(self, version: int | None = None) -> DataFrame:
        """The current or a given version."""
        version = self.version() if version is None else version
        if version is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={version}")

    def next_version(self) -> int:
        """The number that the next commit will have."""
        return max(map(int, self._names("v=")), default=0) + 1

    def moves(self) -> int:
        """How often the pointer has been moved."""
        return max((int(n.split("-")[1]) for n in self._names("at=")), default=0)

    def was_published(self, version: int) -> bool:
        """Whether the pointer ever stood on ``version``."""
        return any(n.split("-")[0] == str(version) for n in self._names("at="))

    def commit(self, rows: DataFrame) -> int:
        """Write ``rows`` as a new version and make it the current one."""
        version = self.next_version()
        rows.write.parquet(f"{self.path}/v={version}")
        self._point(version)
        return version

    def rollback(self, version: int) -> None:
        """Make an older version the current one; nothing is deleted."""
        if str(version) not in self._names("v="):
            raise FileNotFoundError(f"no version {version} of {self.path}")
        self._point(version)
